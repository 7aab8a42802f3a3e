"""Distances, similarity scores and their bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspan.functions import fixed
from seekspan.functions.paths import col

METRICS = ("l2", "l2sq", "cosine")


def _literal(vector: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in vector) + ")")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def vector_distance(embedding: Column | str, vector: Sequence[float] | Column, metric: str = "l2") -> Column:
    """Distance of a vector column to a literal vector (or another vector column), computed in double.

    The literal is inlined, so a single-query scan stays one narrow stage without a join.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    left = col(embedding).cast("array<double>")
    right = vector.cast("array<double>") if isinstance(vector, Column) else _literal(vector)
    if metric == "cosine":
        dot = _fold(F.zip_with(left, right, lambda a, b: a * b))
        norm = F.sqrt(_fold(F.transform(left, lambda a: a * a))) * F.sqrt(_fold(F.transform(right, lambda b: b * b)))
        return 1.0 - dot / norm
    square = _fold(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)))
    return square if metric == "l2sq" else F.sqrt(square)


def similarity(distance: Column | str) -> Column:
    """1 / (1 + distance)."""
    return F.lit(1.0) / (F.lit(1.0) + col(distance))


def similarity_band(score: Column | str, bands=fixed.SIMILARITY_BANDS, weak: str = fixed.WEAK_BAND) -> Column:
    """Name of the first band whose lower bound the score reaches."""
    (low, name), *rest = bands
    expr = F.when(col(score) >= low, name)
    for low, name in rest:
        expr = expr.when(col(score) >= low, name)
    return expr.otherwise(weak)
