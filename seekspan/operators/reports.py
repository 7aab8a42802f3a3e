"""Reports over files, chunks and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspan.functions import fixed, paths, text, times
from seekspan.operators.filters import DELETED


def collection_stats(chunks: DataFrame, advice_percent: float = fixed.CLEANUP_ADVICE_PERCENT) -> DataFrame:
    """A1, A2: active, deleted and total chunks, overhead in percent, cleanup advice. No status counts as active."""
    gone = F.count_if(F.col("status") == DELETED)
    total = F.count(F.lit(1))
    return (
        chunks.groupBy("repo_id")
        .agg(gone.alias("deleted_chunks"), total.alias("total_chunks"))
        .select(
            "repo_id",
            (F.col("total_chunks") - F.col("deleted_chunks")).alias("active_chunks"),
            "deleted_chunks",
            "total_chunks",
            F.round(F.col("deleted_chunks") / F.col("total_chunks") * 100, 1).alias("overhead_percent"),
        )
        .withColumn("cleanup_advised", F.col("overhead_percent") > advice_percent)
    )


def list_files(files: DataFrame) -> DataFrame:
    """File count and size per language, with the grand total in the row of the null language."""
    return (
        files.rollup("language")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
        .withColumn("megabytes", F.round(F.col("bytes") / F.lit(1024 * 1024), 2))
    )


def file_listing(files: DataFrame) -> DataFrame:
    """Files with size in KB, by language and path."""
    return files.select(
        "repo_id", "language", "file_path", "lines", F.round(F.col("size") / F.lit(1024), 2).alias("kilobytes")
    ).orderBy("language", "file_path")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """A5: chunks per file."""
    return chunks.groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("chunk_count"))


def list_projects(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    """Project name, short id, active chunks, date of the last indexing."""
    active = chunks.groupBy("repo_id").agg(
        F.count_if(F.coalesce(F.col("status"), F.lit("active")) != DELETED).alias("active_chunks")
    )
    return projects.join(active, "repo_id", "left").select(
        "project_name",
        F.substring("repo_id", 1, 12).alias("repo_id"),
        F.coalesce("active_chunks", F.lit(0)).alias("active_chunks"),
        times.stamp_date("indexed_at").alias("indexed_at"),
    )


def method_stats(chunks: DataFrame) -> DataFrame:
    """Files chunked by symbols and by windows."""
    return chunks.groupBy("method").agg(
        F.countDistinct("repo_id", "file_path").alias("files"), F.count(F.lit(1)).alias("chunks")
    )


def index_summary(batch: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct files and chunks of a batch, per collection."""
    files = F.approx_count_distinct("file_path") if approximate else F.countDistinct("file_path")
    return batch.groupBy("repo_id").agg(files.alias("files"), F.count(F.lit(1)).alias("chunks"))


def list_collections(chunks: DataFrame) -> DataFrame:
    """A9."""
    return chunks.select("repo_id").distinct()


def collection_count(chunks: DataFrame) -> DataFrame:
    """A10: rows per collection."""
    return chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("chunks"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Number within the file, lines, length, estimated tokens, short MD5."""
    return chunks.select(
        "repo_id",
        "file_path",
        (F.col("chunk_index") + 1).alias("number"),
        "start_line",
        "end_line",
        F.length("content").alias("chars"),
        text.estimate_tokens("content").alias("tokens"),
        F.concat(F.substring(text.content_md5("content"), 1, 8), F.lit("...")).alias("hash"),
    )


def chunk_head(chunks: DataFrame, n: int = 5) -> DataFrame:
    """T4: the first n chunks of every file, named 'window-<i>' when they have no symbol, and how many more follow.

    The count comes from a partial aggregate joined on the file key; the window only ranks narrow rows and is cut to n
    rows per file on the map side.
    """
    key = ["repo_id", "file_path"]
    narrow = chunks.select(*key, "chunk_index", "symbol_name", "symbol_kind", "start_line", "end_line", "chunk_tokens")
    w = Window.partitionBy(*key).orderBy("chunk_index")
    head = narrow.withColumn("number", F.row_number().over(w)).filter(F.col("number") <= n)
    name = F.coalesce("symbol_name", F.concat(F.lit("window-"), F.col("number").cast("string")))
    return (
        head.join(chunk_counts(chunks), key)
        .withColumn("name", name)
        .select(
            *key, "number", "name", "symbol_kind", "start_line", "end_line", "chunk_tokens",
            F.greatest(F.col("chunk_count") - n, F.lit(0)).alias("more"),
        )
    )


def symbol_listing(chunks: DataFrame) -> DataFrame:
    """Symbol, kind, parent, lines and one-line preview of each chunk."""
    return chunks.select(
        "repo_id", "file_path", "symbol_name", "symbol_kind", "parent_name", "start_line", "end_line",
        text.symbol_preview("content").alias("preview"),
    )


def symbol_outline(symbols: DataFrame) -> DataFrame:
    """One indented line per symbol, in file order."""
    line = F.concat(
        F.repeat(F.lit("  "), F.col("depth")),
        F.format_string("• %s (%s) [L%d-%d]", "name", "kind", "start_line", "end_line"),
    )
    return symbols.select("repo_id", "file_path", "start_line", "depth", "symbol_id", line.alias("line")).orderBy(
        "repo_id", "file_path", "start_line", "depth", "symbol_id"
    )


def format_results(results: DataFrame, now: times.Moment) -> DataFrame:
    """Display lines of ranked results."""
    percent = (F.col("similarity").cast("float") * F.lit(100).cast("float")).cast("int")
    stamp = F.coalesce(F.date_format("deleted_at", "yyyy-MM-dd"), F.lit(""))
    gone = F.when(F.col("status") == DELETED, F.concat(F.lit(" [DELETED "), stamp, F.lit("]"))).otherwise(F.lit(""))
    return results.select(
        "rank",
        F.format_string(
            "[%d] %s:%d-%d (similarity: %d%%)", "rank", "file_path", "start_line", "end_line", percent
        ).alias("title"),
        F.concat(
            F.lit("    ["), F.substring("repo_id", 1, 8), F.lit("] "), F.col("project_name"), F.lit(" | "),
            F.col("language"), gone,
        ).alias("origin"),
        F.concat(F.lit("    "), F.array_join(text.content_preview("content"), "\n    ")).alias("preview"),
        F.concat(F.lit("    indexed: "), times.relative_time("indexed_at", now)).alias("indexed"),
    )


def known_projects(requested: DataFrame, projects: DataFrame) -> DataFrame:
    """Requested collections that exist."""
    return requested.join(projects.select("repo_id"), "repo_id", "left_semi")


def locate(results: DataFrame, projects: DataFrame) -> DataFrame:
    """Results with the absolute location of their file."""
    where = projects.select("repo_id", "repo_path")
    return results.join(where, "repo_id").withColumn("location", paths.join_location("repo_path", "file_path"))


def pick_result(results: DataFrame, wanted: str) -> DataFrame:
    """The result with that 1-based rank, or else the first one whose id starts with the text."""
    rank = int(wanted) if wanted.isdecimal() else -1
    hit = (F.col("rank") == rank) | F.col("chunk_id").cast("string").startswith(wanted)
    return results.filter(hit).orderBy(F.when(F.col("rank") == rank, 0).otherwise(1), "rank").limit(1)
