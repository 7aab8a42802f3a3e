"""Stored tables: chunks, manifests, projects, results, audit lines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspan.functions import fixed
from seekspan.functions.times import Moment, moment
from seekspan.schemas import CHUNKS, MANIFEST_FILES, struct_of
from seekspan.sources.storage import Storage

RESULT_COLUMNS = ("id", "repo_id", "file_path", "start_line", "end_line", "content", "language")

_FILE_INFO = struct_of("language string, line_count int, chunk_count bigint, last_mod_time string, content_hash string")
MANIFEST_JSON = T.StructType(
    [
        *struct_of(
            "repo_id string, project_name string, repo_path string, last_indexed_commit string, indexed_at string"
        ).fields,
        T.StructField("indexed_files", T.MapType(T.StringType(), _FILE_INFO)),
        *struct_of("active_chunk_count bigint, deleted_chunk_count bigint").fields,
    ]
)
DOCUMENT_PARTS = 64
ROW_GROUP_BYTES = 16 << 20
RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"


def read_chunks(
    spark: SparkSession, path: str, repo_ids: Sequence[str] | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """The chunk table; `repo_ids` prunes partitions and `columns` prunes the scan."""
    df = spark.read.schema(CHUNKS).parquet(path)
    if repo_ids is not None:
        df = df.filter(F.col("repo_id").isin(list(repo_ids)))
    return df.select(*columns) if columns else df


def _rebalanced(df: DataFrame, column: str) -> DataFrame:
    """Rows of one output partition together, in files of the advisory size.

    Adaptive execution splits the large groups and merges the small ones from the sizes it has measured, so a collection
    or day with a large share of all rows is written by many tasks, and small ones do not end up in many tiny files.
    """
    return df.hint("rebalance", F.col(column))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Write the chunk table partitioned by collection. Collections present in `chunks` are replaced; all others are
    left alone.

    Files are sorted by id, in small row groups with a Bloom filter on the id, so reading the rows of a page skips the
    row groups that hold none of its ids."""
    (
        _rebalanced(chunks.select(*CHUNKS.names), "repo_id")
        .sortWithinPartitions("repo_id", "chunk_id")
        .write.mode("overwrite")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.bloom.filter.enabled#chunk_id", "true")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo_id")
        .parquet(path)
    )


def write_manifest(files: DataFrame, path: str) -> None:
    """S3: file manifest as a table, one row per indexed file; replaces the repositories present in `files`."""
    (
        _rebalanced(files.select(*MANIFEST_FILES.names), "repo_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo_id")
        .parquet(path)
    )


def read_manifest(spark: SparkSession, path: str, repo_ids: Sequence[str] | None = None) -> DataFrame:
    """S3: file manifest table."""
    df = spark.read.schema(MANIFEST_FILES).parquet(path)
    return df.filter(F.col("repo_id").isin(list(repo_ids))) if repo_ids is not None else df


def import_manifest_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: JSON manifests (a directory of one or more documents per repository) as `projects`, `manifest_files`."""
    docs = spark.read.schema(MANIFEST_JSON).option("multiLine", True).json(path)
    projects = docs.select(
        "repo_id",
        "project_name",
        "repo_path",
        "last_indexed_commit",
        F.try_to_timestamp("indexed_at").alias("indexed_at"),
    ).distinct()
    files = docs.select("repo_id", F.explode("indexed_files").alias("file_path", "i")).select(
        "repo_id",
        "file_path",
        "i.language",
        "i.line_count",
        "i.chunk_count",
        F.try_to_timestamp("i.last_mod_time").alias("mtime"),
        "i.content_hash",
    )
    return projects, files


def export_manifest_json(projects: DataFrame, files: DataFrame, path: str, parts: int = DOCUMENT_PARTS) -> None:
    """S3: JSON documents for exchange. Each repository is `parts` documents, dealt out by a hash of the path (fewer if it
    has no file for some of them, one if it has no files); `import_manifest_json` puts them together again."""
    info = F.struct(
        "language",
        "line_count",
        "chunk_count",
        F.date_format("mtime", RFC3339).alias("last_mod_time"),
        "content_hash",
    )
    part = F.pmod(F.xxhash64("file_path"), F.lit(parts)).alias("__part")
    maps = (
        files.select("repo_id", part, "file_path", info.alias("info"))
        .groupBy("repo_id", "__part")
        .agg(F.map_from_entries(F.collect_list(F.struct("file_path", "info"))).alias("indexed_files"))
    )
    (
        projects.join(maps.drop("__part"), "repo_id", "left")
        .withColumn("indexed_at", F.date_format("indexed_at", RFC3339))
        .write.mode("overwrite")
        .option("maxRecordsPerFile", 1)
        .json(path)
    )


def save_results(results: DataFrame, path: str) -> None:
    """Ranked results as JSON lines in rank order. A result page is at most a thousand rows."""
    results.orderBy("rank").select(F.col("chunk_id").alias("id"), *RESULT_COLUMNS[1:]).coalesce(1).write.mode(
        "overwrite"
    ).json(path)


def write_audit(audit: DataFrame, path: str, mode: str = "append") -> None:
    """Audit lines as gzip text, one partition per UTC day."""
    lines = audit.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("line").alias("value"))
    (
        _rebalanced(lines, "day")
        .write.mode(mode)
        .option("compression", "gzip")
        .partitionBy("day")
        .text(path)
    )


def read_audit_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(line, day)` of stored audit lines."""
    schema = struct_of("value string, day string")
    return spark.read.schema(schema).text(path).select(F.col("value").alias("line"), "day")


def retain(audit: DataFrame, now: Moment, days: int = fixed.AUDIT_RETENTION_DAYS) -> DataFrame:
    """Lines of the last `days` days; the filter on `day` prunes partitions."""
    first = F.date_format(F.date_sub(moment(now).cast("date"), days), "yyyy-MM-dd")
    return audit.filter(F.col("day") >= first)


def expire(spark: SparkSession, path: str, now: dt.datetime, days: int = fixed.AUDIT_RETENTION_DAYS) -> list[str]:
    """Delete the days of stored audit lines that are older than the retention; returns them. A day is a folder, so nothing is
    read or written, and the folders of other days are not touched. Days that `retain` keeps stay."""
    storage = Storage(spark, path)
    first = (now.date() - dt.timedelta(days=days)).isoformat()
    old = [n for n in storage.names() if n.startswith("day=") and n.removeprefix("day=") < first]
    for name in old:
        storage.delete(name)
    return [n.removeprefix("day=") for n in old]
