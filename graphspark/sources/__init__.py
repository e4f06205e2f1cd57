"""Readers of graph exports and logs, and the sink of findings."""
