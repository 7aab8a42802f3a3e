"""Registry, and the named SQL building blocks shared by the oracles."""

from __future__ import annotations

import sys
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

import seekspan
from seekspan.session import ship_packages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# name -> (names it builds on, SELECT text)
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, select: str, *needs: str) -> None:
    BLOCKS[name] = (needs, select)


def sql(select: str, *needs: str, recursive: bool = False) -> str:
    """`select` preceded by the blocks it needs, in dependency order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in BLOCKS[name][0]:
            visit(dep)
        done.append(name)

    for name in needs:
        visit(name)
    if not done:
        return select
    head = "WITH RECURSIVE " if recursive or any("UNION ALL" in BLOCKS[n][1] for n in done) else "WITH "
    return head + ",\n".join(f"{n} AS ({BLOCKS[n][1]})" for n in done) + "\n" + select


def query(name: str, oracle: str | None = None):
    """Register a query function and, where it can be said in SQL, its oracle."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_packages(spark, seekspan, sys.modules["catalog"])
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (with '__' for '.') for the time a streaming query runs."""
    values = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def state_partitions(spark: SparkSession) -> dict[str, str]:
    """The number of state partitions is fixed when a stream starts; these short streams need no more than the cores."""
    return {"spark__sql__shuffle__partitions": str(spark.sparkContext.defaultParallelism)}


def case(expr: str, table: dict, default: str) -> str:
    """CASE expression over a fixed lookup table."""
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)
