"""Compositions of operators: indexing and searching."""
