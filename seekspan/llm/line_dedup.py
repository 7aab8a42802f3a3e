"""Removal of boilerplate lines by their frequency on a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspan.llm.common import stored

RATIO = 0.1
MIN_PAGES = 5


def line_key(line: Column) -> Column:
    """Lines are the same if they agree without blanks at either end; blank lines have no key."""
    bare = F.trim(F.regexp_replace(line, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", ""))
    return F.when(bare != "", F.xxhash64(bare, F.length(bare)))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, keys) from (host, text): the lines of each host that more than `ratio` of its pages contain, and at least
    `min_pages` pages. A line counts once per page. With `copies_once`, pages of a host that are equal in text are one page,
    for a line as well as in the host's total. A host has at most (mean distinct lines of a page) / `ratio` such
    lines, so the list of a host stays short however many pages it has."""
    keys = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), line_key), lambda k: k.isNotNull()))
    pages = pages.select("host", keys.alias("keys"), *[F.sha2("text", 256).alias("digest")] * copies_once)
    if copies_once:
        pages = stored(pages.groupBy("host", "digest").agg(F.first("keys").alias("keys")), "distinct-pages")
    per_page = pages.select("host", F.explode("keys").alias("key"))
    contained = per_page.groupBy("host", "key").agg(F.count("*").alias("n"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    often = contained.filter(F.col("n") >= min_pages).join(totals, "host").filter(F.col("n") > ratio * F.col("total"))
    return often.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """`docs` with the boilerplate lines of each host cut out of the text, and two more columns: `n_lines` (of the old
    text) and `n_dropped`.

    A null host is a host of its own; a null text stays null with no lines; blank lines always stay; repeated rows count
    as pages of their own, unless `copies_once` makes equal texts of a host one page: else a text with many copies is
    boilerplate as a whole and lost in all of them. Texts that lose no line are returned unchanged; a text of boilerplate only becomes empty.
    Columns of the input keep their values, except that clashing names `n_lines` and `n_dropped` are replaced.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host")
    rows = docs.select(row, F.col(host_col).isNull().alias("_null_host"), host, F.col(text_col).alias("_text"))
    pages = rows.select(F.struct("_null_host", "_host").alias("host"), F.col("_text").alias("text")).filter(F.col("text").isNotNull())
    found = stored(boilerplate(pages, ratio, min_pages, copies_once), "boilerplate").select("host._null_host", "host._host", F.col("keys").alias("_keys"))
    # a left join, which adaptive execution splits for a host with a large share of the pages
    joined = rows.join(found, ["_null_host", "_host"], "left")
    lines = F.split("_text", "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_keys"), line_key(x)), F.lit(False)))
    flagged = joined.withColumns({"_lines": F.size(lines), "_kept": F.when(F.col("_keys").isNotNull(), kept)})
    dropped = F.when(F.col("_text").isNull(), 0).otherwise(F.coalesce(F.col("_lines") - F.size("_kept"), F.lit(0)))
    text = F.when(dropped > 0, F.concat_ws("\n", "_kept")).otherwise(F.col("_text"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return flagged.select(
        *[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in names],
        F.when(F.col("_text").isNull(), 0).otherwise(F.col("_lines")).cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
    )
