"""Change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspan.functions import paths, text

ADDED = "added"
MODIFIED = "modified"
DELETED = "deleted"
RENAMED = "renamed"

KEY = ["repo_id", "file_path"]


def diff_snapshot(files: DataFrame, manifest: DataFrame, by: str = "mtime") -> DataFrame:
    """Added, modified and deleted files.

    Both sides are cut to the key and the compared value before the full outer join, so no file text is shuffled.
    Times are compared at second precision; `by='hash'` compares SHA-256 of the content instead.
    """
    if by == "hash":
        now = files.select(*KEY, text.content_hash("content").alias("__new"))
        then = manifest.select(*KEY, F.col("content_hash").alias("__old"))
    else:
        now = files.select(*KEY, F.date_trunc("second", "mtime").alias("__new"))
        then = manifest.select(*KEY, F.date_trunc("second", "mtime").alias("__old"))
    now = now.withColumn("__here", F.lit(True))
    then = then.withColumn("__known", F.lit(True))
    change = (
        F.when(F.col("__known").isNull(), ADDED)
        .when(F.col("__here").isNull(), DELETED)
        .when(~F.col("__new").eqNullSafe(F.col("__old")), MODIFIED)
    )
    return (
        now.join(then, KEY, "full_outer")
        .select(*KEY, change.alias("change"), F.lit(None).cast("string").alias("new_path"))
        .filter(F.col("change").isNotNull())
    )


def diff_name_status(entries: DataFrame) -> DataFrame:
    """Changes from name-status entries (see `sources.name_status`); code files only."""
    status = F.col("status")
    change = (
        F.when(status == "A", ADDED)
        .when(status == "M", MODIFIED)
        .when(status == "D", DELETED)
        .when(status.startswith("R") & F.col("new_path").isNotNull(), RENAMED)
    )
    is_code = paths.index_language("file_path") != paths.UNKNOWN
    new_is_code = paths.index_language("new_path") != paths.UNKNOWN
    return (
        entries.withColumn("change", change)
        .filter(F.col("change").isNotNull() & is_code & ((F.col("change") != RENAMED) | new_is_code))
        .select("repo_id", "file_path", "change", F.when(F.col("change") == RENAMED, F.col("new_path")).alias("new_path"))
    )


def expand_renames(changes: DataFrame, renames: str = "split") -> DataFrame:
    """A rename becomes a deletion and an addition; `renames='ignore'` drops it."""
    if renames == "ignore":
        return changes.filter(F.col("change") != RENAMED)
    moved = F.col("change") == RENAMED
    pair = F.array(
        F.struct(F.col("file_path").alias("file_path"), F.lit(DELETED).alias("change")),
        F.struct(F.col("new_path").alias("file_path"), F.lit(ADDED).alias("change")),
    )
    same = F.array(F.struct(F.col("file_path").alias("file_path"), F.col("change").alias("change")))
    return (
        changes.select("repo_id", F.explode(F.when(moved, pair).otherwise(same)).alias("c"))
        .select("repo_id", "c.file_path", "c.change")
        .distinct()
    )


def files_to_index(changes: DataFrame) -> DataFrame:
    """Keys of added and modified files."""
    return changes.filter(F.col("change").isin(ADDED, MODIFIED)).select(*KEY)


def files_to_retire(changes: DataFrame) -> DataFrame:
    """U2 and modified files: keys whose chunks are tombstoned first."""
    return changes.filter(F.col("change").isin(DELETED, MODIFIED)).select(*KEY)


def plan_refresh(changes: DataFrame, projects: DataFrame) -> DataFrame:
    """D3: per project 'full' (never indexed), 'none' (no change) or 'incremental', with the change counts."""
    counts = changes.groupBy("repo_id").agg(
        *[
            F.count_if(F.col("change") == name).cast("int").alias(name)
            for name in (ADDED, MODIFIED, DELETED, RENAMED)
        ]
    )
    zero = [F.coalesce(name, F.lit(0)).alias(name) for name in (ADDED, MODIFIED, DELETED, RENAMED)]
    total = F.col(ADDED) + F.col(MODIFIED) + F.col(DELETED) + F.col(RENAMED)
    fresh = F.coalesce(F.col("last_indexed_commit"), F.lit("")) == ""
    return (
        projects.select("repo_id", "last_indexed_commit")
        .join(counts, "repo_id", "left")
        .select("repo_id", "last_indexed_commit", *zero)
        .withColumn("plan", F.when(fresh, "full").when(total == 0, "none").otherwise("incremental"))
        .drop("last_indexed_commit")
    )
