"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest, one row per distinct text: (digest, keep_id). New rows are reduced to
one per digest, anti-joined with the index (a sort-merge join; the bucketing spares the index its shuffle) and appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspan.llm.common import buckets, id_and_text, setting, stored
from seekspan.session import scratch_dir

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of blanks as one space. Most texts have only single spaces and need no rewriting."""
    return F.when(text.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(text, BLANKS, " ")).otherwise(text)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the normalised text in UTF-8, as 32 bytes. Null counts as empty."""
    return id_and_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))


class DigestIndex:
    """A digest index at `path`, in a shared folder. The bucket count is fixed when the index is made."""

    def __init__(self, spark: SparkSession, path: str, bucket_count: int):
        self.spark, self.path, self.bucket_count = spark, path, bucket_count
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {bucket_count} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Add the digests of `rows` (doc_id, digest) that the index does not hold; of several rows with one digest the
        smallest doc_id is entered. Loading the same rows again adds nothing."""
        fresh = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        fresh = fresh.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            placed = fresh.repartition(self.bucket_count, "digest")
            placed.write.mode("append").bucketBy(self.bucket_count, "digest").sortBy("digest").format("parquet").saveAsTable(self.table)

    def drop(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row; the smallest doc_id of equal texts stays.

    The rows are loaded in two batches, smaller doc_ids first, as a growing corpus would be: the second one meets the
    first in the index. Without `index` a new one is made, whose name in the catalog goes when the result is there. Rows without
    a doc_id come last; where no row of a group has one, keep_id is null and all its rows are kept. A null text counts as empty. Rows that repeat a doc_id
    count in the group each, and all of those with the smallest doc_id are kept. An empty table gives none.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs, id_col, text_col), "digests")
    own = None if index else DigestIndex(spark, scratch_dir(spark, "digest-index"), buckets(spark))
    index = index or own
    try:
        middle = rows.agg(F.percentile_approx("doc_id", 0.5, 100)).first()[0]
        first = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
        index.append(rows.filter(first))
        index.append(rows.filter(~first))
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        groups = sizes.join(index.read().hint("merge"), "digest")
        groups = stored(groups, "digest-groups") if own else groups
    finally:
        if own:
            own.drop()
    joined = rows.join(groups.hint("merge"), "digest")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
