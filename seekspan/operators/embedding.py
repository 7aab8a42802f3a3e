"""Embeddings: a deterministic built-in embedder, pluggable models, and joins with precomputed vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspan.functions import text

# An embedder takes texts and returns one vector per text; it runs on executors, a batch at a time.
Embedder = Callable[[Sequence[str]], np.ndarray]

DEFAULT_DIM = 64
DEFAULT_MODEL = "feature-hash-64"


def hash_embed(
    df: DataFrame, dim: int = DEFAULT_DIM, column: str = "content", out: str = "embedding", unit: bool = True
) -> DataFrame:
    """Word counts hashed into `dim` cells, of unit length unless `unit` is off; evaluated in the JVM.

    The cell of a word is the number in the first four hex digits of its MD5, modulo `dim`, so the same text gives the
    same vector everywhere.
    """
    words = F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[a-z0-9_]+"), F.lit(0))
    cells = F.transform(
        words, lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % F.lit(dim)).cast("string")
    )
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="__cells", outputCol="__counts")
    counted = counter.transform(df.withColumn("__cells", cells))
    vector = "__counts"
    if unit:
        counted = Normalizer(p=2.0, inputCol="__counts", outputCol="__unit").transform(counted)
        vector = "__unit"
    return counted.withColumn(out, vector_to_array(vector, "float32")).drop("__cells", "__counts", "__unit")


def embed(df: DataFrame, embedder: Embedder | None = None, column: str = "content", out: str = "embedding") -> DataFrame:
    """One vector per text. A model plugs in as a batch function; lower the Arrow batch size for large models."""
    if embedder is None:
        return hash_embed(df, column=column, out=out)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = np.asarray(embedder(texts.tolist()), dtype=np.float32)
            yield pd.Series(list(vectors), dtype=object)

    return df.withColumn(out, run(F.col(column)))


def embed_distinct(df: DataFrame, embedder: Embedder | None = None, column: str = "content") -> DataFrame:
    """Embed each distinct content once and join the vectors back on the content hash.

    Copies collapse on the map side of the distinct step; in the join back adaptive execution splits the rows of a heavily
    copied content, which is why the vectors are on the right of a left join and carry no hint. The input is read once for the distinct contents and once for the join: pass a stored
    table rather than a long computation.
    """
    keyed = df if "content_hash" in df.columns else df.withColumn("content_hash", text.content_hash(column))
    once = embed(keyed.select("content_hash", column).dropDuplicates(["content_hash"]), embedder, column)
    vectors = once.select("content_hash", "embedding")
    return keyed.drop("embedding").join(vectors, "content_hash", "left")


def attach_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with precomputed vectors by content hash; chunks without a vector are left out."""
    pairs = vectors.select("content_hash", "embedding").dropDuplicates(["content_hash"])
    return chunks.drop("embedding").join(pairs, "content_hash")


def embed_query(spark: SparkSession, query: str, embedder: Embedder | None = None) -> list[float]:
    """Vector of one query text."""
    if embedder is not None:
        return [float(x) for x in np.asarray(embedder([query]))[0]]
    row = hash_embed(spark.createDataFrame([(query,)], "content string")).select("embedding").first()
    return [float(x) for x in row[0]]
