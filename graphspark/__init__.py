"""Spark jobs for product-knowledge graphs kept as tables."""
