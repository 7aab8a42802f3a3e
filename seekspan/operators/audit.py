"""Audit lines: format, parse, check, count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspan.functions import fixed

LINE = r"\A\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] \[([A-Z_]+)\] ?(.*)\z"
# a quoted value ends at the quote before the next key or the end of the line
PAIR = r'([A-Za-z_]\w*)=("(.*?)"(?= [A-Za-z_]\w*=|\z)|\S*)'
STAMP = "yyyy-MM-dd HH:mm:ss"


def pair_text(key: str, value: Column) -> Column:
    """`k=v`, quoted when the value has spaces, null when it is null."""
    v = value.cast("string")
    quoted = F.when(F.contains(v, F.lit(" ")), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
    return F.concat(F.lit(f"{key}="), quoted)


def format_audit(df: DataFrame, keys: Sequence[str], ts: str = "ts", op: str = "op") -> DataFrame:
    """G1: adds `line`: UTC stamp, operation and the non-null fields in the given order."""
    pairs = F.concat_ws(" ", *[pair_text(k, F.col(k)) for k in keys])
    head = F.concat(F.lit("["), F.date_format(ts, STAMP), F.lit("] ["), F.col(op), F.lit("] "))
    return df.withColumn("line", F.concat(head, pairs))


def parse_audit(lines: DataFrame, column: str = "line") -> DataFrame:
    """`(ts, op, kv, raw)`; ts and op are null for malformed lines. The first of repeated keys counts."""
    raw = F.col(column)
    part = lambda i: F.regexp_extract(raw, LINE, i)
    names = F.regexp_extract_all("rest", F.lit(PAIR), F.lit(1))
    values = F.regexp_extract_all("rest", F.lit(PAIR), F.lit(2))
    plain = F.transform(
        values,
        lambda v: F.when(
            (F.length(v) >= 2) & v.startswith('"') & v.endswith('"'), F.substr(v, F.lit(2), F.length(v) - 2)
        ).otherwise(v),
    )
    pairs = F.arrays_zip(names.alias("k"), plain.alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return (
        lines.select(raw.alias("raw"), part(1).alias("stamp"), part(2).alias("op"), part(3).alias("rest"))
        .select(
            F.try_to_timestamp("stamp", F.lit(STAMP)).alias("ts"),
            F.when(F.col("op") != "", F.col("op")).alias("op"),
            F.map_from_arrays(
                F.transform(first, lambda p: p["k"]), F.transform(first, lambda p: p["v"])
            ).alias("kv"),
            "raw",
        )
    )


def is_valid(ops: Sequence[str] = fixed.AUDIT_OPS) -> Column:
    """G4 predicate: the line was readable and its operation is known."""
    return F.coalesce(F.col("ts").isNotNull() & F.col("op").isin(list(ops)), F.lit(False))


def split_valid(audit: DataFrame, ops: Sequence[str] = fixed.AUDIT_OPS) -> tuple[DataFrame, DataFrame]:
    """Parsed lines with a known operation, and the rest."""
    return audit.filter(is_valid(ops)), audit.filter(~is_valid(ops))


def audit_counts(audit: DataFrame) -> DataFrame:
    """Lines per day and operation."""
    return audit.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "op").agg(F.count(F.lit(1)).alias("events"))
