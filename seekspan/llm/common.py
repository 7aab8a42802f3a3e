"""What the operators of this package share: input columns, scratch tables, splitting of texts into words."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import seekspan
from seekspan.session import scratch_dir, ship_packages
from seekspan.sources.storage import Storage

# Python tasks see at most so many bytes of text at once (a longer single text comes alone and whole)
BATCH_BYTES = 6 << 20
# and get them from the JVM in Arrow batches of about this size
ARROW_BYTES = "8m"


def prepare(spark: SparkSession) -> None:
    """What the Python tasks of this package need: the package itself, and batches that leave them little to hold."""
    ship_packages(spark, seekspan)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """The two columns that most operators read; a null text becomes an empty one. With `whole`, the input row comes along
    as one struct column `_row`, whatever its columns are called."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *row)


def row_type(docs: DataFrame) -> str:
    return docs.schema.simpleString()


def write_scratch(df: DataFrame, name: str, *partition_by: str) -> str:
    """Write an intermediate table to the shared scratch folder and return its path.

    The table cuts the lineage: a lost executor costs a re-read, not a re-run. Spark drops the shuffle files of the write
    when it has ended, so a job of several steps needs the disk of its largest step.
    """
    path = scratch_dir(df.sparkSession, name)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, name))


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    for path in paths:
        Storage(spark, path).delete("")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def buckets(spark: SparkSession) -> int:
    """Number of buckets of keyed intermediate tables: the deployment's shuffle parallelism."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes of text, one row at least."""
    sizes = np.maximum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), 1)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        part = batch.slice(at, stop - at)
        # a copy of the texts: some string kernels of Arrow mistake the offsets of sliced arrays
        text = pa.concat_arrays([part.column("text").cast(pa.large_string()), pa.array([], pa.large_string())])
        yield part.set_column(part.schema.get_field_index("text"), "text", text)
        at = stop


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts, A-Z lower-cased, in order, and the row that each stands in."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(text.cast(pa.large_string())))
    flat, rows = split.flatten(), pc.list_parent_indices(split)
    keep = pc.not_equal(flat, "")
    return flat.filter(keep), rows.filter(keep).to_numpy()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
