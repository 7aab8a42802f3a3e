"""Chunk-table lifecycle: upsert, tombstone, restore, purge, clear (L1-L7). All DataFrame in, DataFrame out.

None of the joins carries a hint: change lists are usually small and are then broadcast after a size check, and a large
one falls back to a shuffled join, which adaptive execution splits where a key is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspan.functions import times
from seekspan.operators.filters import ACTIVE, DELETED

FILE = ["repo_id", "file_path"]


def upsert(
    chunks: DataFrame, batch: DataFrame, ids: DataFrame | None = None, within: Sequence[str] = ("repo_id",)
) -> DataFrame:
    """Rows of the batch replace stored rows of the same id as a whole; everything else stays.

    `ids` is a cheaper source of the batch's ids, such as the stored chunks before they were embedded. Ids are compared
    `within` a collection, or within a file: stable ids contain their path, and the join can then reuse a partitioning
    by file.
    """
    key = [*within, "chunk_id"]
    kept = chunks.join((batch if ids is None else ids).select(*key), key, "left_anti")
    return kept.select(*chunks.columns).unionByName(batch.select(*chunks.columns))


def upsert_counts(chunks: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch accepted, inserted and updated, per collection."""
    known = chunks.select("repo_id", "chunk_id").withColumn("__known", F.lit(True))
    return (
        batch.select("repo_id", "chunk_id")
        .join(known, ["repo_id", "chunk_id"], "left")
        .groupBy("repo_id")
        .agg(
            F.count(F.lit(1)).alias("accepted"),
            F.count_if(F.col("__known").isNull()).alias("inserted"),
            F.count_if(F.col("__known").isNotNull()).alias("updated"),
        )
    )


def _mark(chunks: DataFrame, files: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """New column values for the chunks of the listed files."""
    listed = files.select(*FILE).distinct().withColumn("__hit", F.lit(True))
    hit = F.col("__hit").isNotNull()
    joined = chunks.join(listed, FILE, "left")
    values = {
        name: F.when(hit, value.cast(chunks.schema[name].dataType)).otherwise(F.col(name))
        for name, value in changed.items()
    }
    return joined.withColumns(values).select(*chunks.columns)


def tombstone(chunks: DataFrame, files: DataFrame, now: times.Moment, commit: str | None = None) -> DataFrame:
    """L2: chunks of the listed files become deleted, stamped to the second; an absent commit leaves the old one."""
    changed = {"status": F.lit(DELETED), "deleted_at": F.date_trunc("second", times.moment(now))}
    if commit:
        changed["deleted_in_commit"] = F.lit(commit)
    return _mark(chunks, files, changed)


def restore(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """L3: chunks of the listed files become active and lose their deletion fields."""
    return _mark(
        chunks, files, {"status": F.lit(ACTIVE), "deleted_at": F.lit(None), "deleted_in_commit": F.lit(None)}
    )


def soft_delete(chunks: DataFrame, files: DataFrame, now: times.Moment) -> tuple[DataFrame, DataFrame]:
    """L4: tombstone without a commit, and the number of chunks hit for each listed file."""
    listed = files.select(*FILE).distinct()
    counts = chunks.select(*FILE).join(listed, FILE, "left_semi").groupBy(*FILE).agg(F.count(F.lit(1)).alias("n"))
    hits = (
        listed.join(counts, FILE, "left")
        .select(*FILE, F.coalesce("n", F.lit(0)).alias("deleted_count"))
    )
    return tombstone(chunks, files, now), hits


def purgeable(cutoff: times.Moment | None = None) -> Column:
    """Deleted, and not stamped later than the cutoff; a missing or unreadable stamp counts as old."""
    gone = F.coalesce(F.col("status") == DELETED, F.lit(False))
    if cutoff is None:
        return gone
    return gone & ~F.coalesce(times.parse_stamp("deleted_at") > times.moment(cutoff), F.lit(False))


def deleted_files(chunks: DataFrame, cutoff: times.Moment | None = None) -> DataFrame:
    """A3: purgeable chunks per file with the earliest deletion stamp."""
    return (
        chunks.filter(purgeable(cutoff))
        .groupBy(*FILE)
        .agg(F.count(F.lit(1)).alias("chunk_count"), F.min("deleted_at").alias("deleted_at"))
    )


def purge(chunks: DataFrame, cutoff: times.Moment | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the per-file report; a dry run keeps every row."""
    kept = chunks if dry_run else chunks.filter(~purgeable(cutoff))
    return kept, deleted_files(chunks, cutoff)


def purge_summary(report: DataFrame, dry_run: bool = False) -> DataFrame:
    """Chunks found and removed per collection."""
    removed = F.lit(0).cast("bigint") if dry_run else F.sum("chunk_count")
    return report.groupBy("repo_id").agg(
        F.sum("chunk_count").alias("chunks_found"),
        removed.alias("chunks_removed"),
        F.count(F.lit(1)).alias("files"),
    )


def purge_report(report: DataFrame) -> DataFrame:
    """One text line per purged file."""
    line = F.format_string("  - %s (%d chunks, deleted %s)", "file_path", "chunk_count", times.stamp_date("deleted_at"))
    return report.select(*FILE, line.alias("line"))


def purge_headline(summary: DataFrame, list_only: bool = False, dry_run: bool = False) -> DataFrame:
    """One headline per collection."""
    if list_only:
        text = F.format_string("Found %d deleted chunks", "chunks_found")
    elif dry_run:
        text = F.format_string("Would remove %d chunks (dry-run)", "chunks_found")
    else:
        text = F.format_string("Removed %d chunks", "chunks_removed")
    return summary.select("repo_id", text.alias("headline"))


def clear(chunks: DataFrame, repo_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of all other collections, and 'deleted' or 'not_found' for each requested one."""
    wanted = repo_ids.select("repo_id").distinct()
    kept = chunks.join(wanted, "repo_id", "left_anti").select(*chunks.columns)
    present = chunks.select("repo_id").distinct().withColumn("__here", F.lit(True))
    status = wanted.join(present, "repo_id", "left").select(
        "repo_id", F.when(F.col("__here").isNull(), "not_found").otherwise("deleted").alias("status")
    )
    return kept, status
