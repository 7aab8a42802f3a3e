"""Semantic retrieval and corpus indexing expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
