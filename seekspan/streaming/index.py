"""Streaming index maintenance and dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seekspan.functions.times import Moment
from seekspan.operators.changes import ADDED, MODIFIED
from seekspan.plans.indexing import incremental_index
from seekspan.schemas import CHUNKS, FILES
from seekspan.sources.tables import read_chunks, write_chunks
from seekspan.sources.versions import VersionedChunks


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def apply_changes(batch: DataFrame, table: str, now: Moment, **options) -> None:
    """D5 for one micro-batch of `(files columns, change)` rows: only collections named in the batch are rewritten.

    Chunk ids are stable, so running a batch twice gives the same table.
    """
    spark = batch.sparkSession
    # the collections of one micro-batch, which the source's rate limit bounds, prune the partitions of the table
    touched = [r["repo_id"] for r in batch.select("repo_id").distinct().collect()]
    if path_exists(spark, table):
        stored = read_chunks(spark, table, touched).select(*CHUNKS.names)
    else:  # the first batch creates the table
        stored = spark.createDataFrame([], CHUNKS)
    changes = batch.select("repo_id", "file_path", "change", F.lit(None).cast("string").alias("new_path"))
    files = batch.filter(F.col("change").isin(ADDED, MODIFIED)).select(*FILES.names)
    write_chunks(incremental_index(changes, files, stored, now, **options), table)


def dealt(batch: DataFrame) -> DataFrame:
    """The rows of a micro-batch over all cores: it arrives in as many tasks as it has files, few of them large."""
    return batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)


def stream_index(changes: DataFrame, table: str, checkpoint: str, now: Moment | None = None, **options) -> StreamingQuery:
    """Keep the chunk table at `table` up to date from a stream of file changes."""
    stamp = F.current_timestamp() if now is None else now

    def run(batch: DataFrame, batch_id: int) -> None:
        # read once per use below; the rows of one micro-batch are bounded by the source's rate limit
        kept = dealt(batch).persist()
        try:
            apply_changes(kept, table, stamp, **options)
        finally:
            kept.unpersist()

    return (
        changes.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_versions(
    changes: DataFrame, table: VersionedChunks, checkpoint: str, now: Moment | None = None, source: str = "changes", **options
) -> StreamingQuery:
    """R1 on a table of versions: each micro-batch of `(files columns, change)` rows becomes one more version, in which only the
    buckets of its files have new files. A batch that is delivered again after a failure is known by its number."""
    stamp = F.current_timestamp() if now is None else now

    def run(batch: DataFrame, batch_id: int) -> None:
        kept = dealt(batch).persist()
        try:
            listed = kept.select("repo_id", "file_path", "change", F.lit(None).cast("string").alias("new_path"))
            files = kept.filter(F.col("change").isin(ADDED, MODIFIED)).select(*FILES.names)
            table.refresh(listed, files, stamp, batch=(source, batch_id), **options)
        finally:
            kept.unpersist()

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(chunks: DataFrame, ts: str = "indexed_at", delay: str = "1 hour", key: str = "chunk_id") -> DataFrame:
    """Drop repeated chunk ids that arrive within `delay`; the state of older ids is dropped by the watermark."""
    return chunks.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def file_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream of the Parquet files of a folder that match a glob."""
    return (
        spark.readStream.schema(like.schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
