"""Operators for large training-data corpora: thirteen Spark jobs over documents, pages and embeddings.

Nothing outside this folder imports it; its queries are in ``queries`` and its pipeline in ``corpus_pipeline.py``.
"""
