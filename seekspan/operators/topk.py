"""Ranking: top-k per group, global top-k, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspan.functions import fixed

SALTS = 32


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = SALTS
) -> DataFrame:
    """The first k rows of every group.

    `row_number() <= k` is planned as a window group limit, which already cuts each map task's groups to k rows before
    the shuffle. A group that holds a large share of all rows would still send k rows per map task to one reducer, so a
    salted round runs first: the second round sees at most k * salts rows per group. The salt is the number of the map
    task, so each task still sends only k rows per group, and a retried task sends the same ones.
    """

    def cut(rows: DataFrame, part: list) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order)
        return rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")

    keys = list(keys)
    if salts > 1:
        salted = df.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        df = cut(salted, [*keys, "__salt"]).drop("__salt")
    return cut(df, keys)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. Copies are cut to one row per map task before the shuffle, however many there are."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def check_page(top_k: int | None, page: int | None, page_size: int | None) -> tuple[int, int, int]:
    """Defaults for missing or zero values, then range checks."""
    top_k = top_k or fixed.DEFAULT_TOP_K
    page = page or fixed.DEFAULT_PAGE
    page_size = page_size or fixed.DEFAULT_PAGE_SIZE
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size must be >= 1")
    if not 1 <= top_k <= fixed.MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {fixed.MAX_TOP_K}")
    return top_k, page, page_size


def global_top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Sort and limit; planned as one per-task top-k and a merge."""
    return df.orderBy(*order).limit(k)


def paginate(ranked: DataFrame, order: Sequence[Column], page: int, page_size: int) -> DataFrame:
    """Rank within the whole result, total count and the requested page.

    The input is already cut to at most `MAX_TOP_K` rows, so the single-partition window is bounded.
    """
    w = Window.orderBy(*order)
    first = (page - 1) * page_size
    return (
        ranked.withColumn("rank", F.row_number().over(w))
        .withColumn("total_count", F.count(F.lit(1)).over(Window.partitionBy()).cast("int"))
        .filter((F.col("rank") > first) & (F.col("rank") <= first + page_size))
        .withColumn("page", F.lit(page))
        .withColumn("page_size", F.lit(page_size))
        .withColumn("total_pages", F.ceil(F.col("total_count") / F.lit(page_size)).cast("int"))
    )
