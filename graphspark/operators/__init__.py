"""Operators over graph tables: DataFrames in, DataFrames out, no caps on rows."""
