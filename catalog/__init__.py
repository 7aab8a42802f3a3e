"""Registered queries over the given tables and their SQL counterparts."""

from catalog.base import ORACLES, QUERIES
from catalog import audit, chunks, derive, maintain, search  # noqa: F401  (registration)

__all__ = ["ORACLES", "QUERIES"]
