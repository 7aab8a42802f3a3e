"""A stored cache of vectors by content (E8, D2): every content is embedded once for all runs, and for all files it moves through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspan.functions import text
from seekspan.operators.embedding import Embedder, embed
from seekspan.schemas import struct_of
from seekspan.session import materialize
from seekspan.sources.storage import Storage

_CACHE = struct_of("content_hash string, embedding array<float>, model_id string, part string")


class VectorCache:
    """Vectors of one model below `path`, in folders by the first hex digits of the content hash."""

    def __init__(self, spark: SparkSession, path: str, model_id: str, digits: int = 1):
        self.spark, self.path, self.model_id, self.digits = spark, path.rstrip("/"), model_id, digits

    def read(self) -> DataFrame:
        """(content_hash, embedding), one row per content: batches that were written twice count once."""
        if not Storage(self.spark, self.path).exists():
            return self.spark.createDataFrame([], "content_hash string, embedding array<float>")
        rows = self.spark.read.schema(_CACHE).parquet(self.path).filter(F.col("model_id") == self.model_id)
        return rows.select("content_hash", "embedding").dropDuplicates(["content_hash"])

    def embed(self, df: DataFrame, embedder: Embedder | None, column: str = "content") -> DataFrame:
        """`df` with `embedding`: contents that the cache knows take its vectors, the others are embedded once and appended.

        Only hashes meet the cache to find what is new; texts travel for new contents alone. A run that fails after the append
        finds its vectors there the next time."""
        keyed = df if "content_hash" in df.columns else df.withColumn("content_hash", text.content_hash(column))
        keyed = keyed.drop("embedding")
        hashes = keyed.select("content_hash").distinct()
        fresh = materialize(hashes.join(self.read().select("content_hash"), "content_hash", "left_anti"), "fresh")
        texts = keyed.select("content_hash", column).join(fresh, "content_hash", "left_semi").dropDuplicates(["content_hash"])
        vectors = embed(texts, embedder, column).select(
            "content_hash", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(self.model_id).alias("model_id"),
            F.substring("content_hash", 1, self.digits).alias("part"),
        )
        vectors.hint("rebalance", F.col("part")).write.mode("append").partitionBy("model_id", "part").parquet(self.path)
        return keyed.join(self.read(), "content_hash", "left")
