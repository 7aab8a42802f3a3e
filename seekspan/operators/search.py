"""Nearest-neighbour search: one query, many queries, approximate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspan.functions import scoring
from seekspan.operators.filters import same_dim
from seekspan.operators.topk import global_top_k, top_k_per_group

# Vectors in one block of queries and of chunks.
QUERY_BLOCK = 1024
CHUNK_BLOCK = 8192
# Tables of the approximate index, and planes of each.
LSH_TABLES, LSH_BITS = 8, 4
# Most numbers in one exact re-computation.
EXACT_CELLS = 1 << 22


def knn(chunks: DataFrame, vector: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """Exact nearest neighbours of one vector, ties broken by chunk id."""
    scored = same_dim(chunks, len(vector)).withColumn("distance", scoring.vector_distance("embedding", vector, metric))
    return global_top_k(scored, [F.col("distance"), F.col("chunk_id")], k).withColumn(
        "similarity", scoring.similarity("distance")
    )


def knn_per_collection(chunks: DataFrame, vector: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """W3 over E3: nearest neighbours within every collection."""
    scored = same_dim(chunks, len(vector)).withColumn("distance", scoring.vector_distance("embedding", vector, metric))
    return top_k_per_group(scored, ["repo_id"], [F.col("distance"), F.col("chunk_id")], k)


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return 1.0 - (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))
    square = ((q - x) ** 2).sum(axis=1)
    return square if metric == "l2sq" else np.sqrt(square)


def _candidates(queries: np.ndarray, rows: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query index, row index and exact distance of every row that can be among a query's k nearest.

    A matrix product ranks the rows; whatever lies within rounding error of the k-th one is measured again exactly.
    """
    q, x = queries, rows
    if metric == "cosine":
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    rough = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2.0 * (q @ x.T)
    if rough.shape[1] > k:
        slack = 1e-9 * (1.0 + np.abs(rough).max())
        keep = rough <= np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + slack
        qi, xi = np.nonzero(keep | np.isnan(rough))
    else:
        qi, xi = (a.ravel() for a in np.indices(rough.shape))
    step = max(1, EXACT_CELLS // rows.shape[1])
    exact = [_exact(queries[qi[i : i + step]], rows[xi[i : i + step]], metric) for i in range(0, len(qi), step)]
    return qi, xi, np.concatenate(exact) if exact else np.empty(0)


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["q", "repo_id", "distance", "chunk_id"], kind="stable")
    return found.groupby(["q", "repo_id"], sort=False).head(k)


def _packed(df: DataFrame, vector: str, size: int, prefix: str) -> DataFrame:
    """Rows in blocks of at most `size`: their other columns as lists, their vectors of one length as one matrix."""
    keys = [c for c in df.columns if c != vector]
    fields = [T.StructField(f"{prefix}{c}", T.ArrayType(df.schema[c].dataType)) for c in keys]
    fields += [T.StructField(f"{prefix}dim", T.IntegerType()), T.StructField(f"{prefix}matrix", T.BinaryType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(vector).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[~np.isnan(lengths.astype(float))]).astype(int).tolist():
                places = np.flatnonzero(lengths == dim)
                for at in range(0, len(places), size):
                    part = batch.take(pa.array(places[at : at + size]))
                    matrix = part.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    lists = [pa.array([part.column(c).to_pylist()], pa.list_(part.column(c).type)) for c in keys]
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([dim], pa.int32()), pa.array([matrix.tobytes()])], names=names)

    return df.mapInArrow(run, T.StructType(fields))


def knn_batch_per_collection(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    block: int = QUERY_BLOCK,
    carry: Sequence[str] = (),
) -> DataFrame:
    """E4 within every collection: (query_id, repo_id, chunk_id, carry..., distance).

    Queries and chunks are packed into blocks, and every block of queries meets every block of chunks on some executor,
    where one matrix product ranks them; at most k rows per query, collection and pair of blocks go on. Blocks, not rows,
    are combined, nothing goes through the driver, and the plan is the same for any number of queries. Vectors of another
    length than a query's are no candidates for it.
    """
    types = {f.name: f.dataType for f in chunks.schema.fields}
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("repo_id", types["repo_id"]),
            T.StructField("chunk_id", types["chunk_id"]),
            *[T.StructField(c, types[c]) for c in carry],
            T.StructField("distance", T.DoubleType()),
        ]
    )
    carry = list(carry)
    asked = _packed(queries.select("query_id", "query_vec"), "query_vec", block, "q_")
    stock = _packed(chunks.select("repo_id", "chunk_id", *carry, "embedding"), "embedding", CHUNK_BLOCK, "c_")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                dim = pair["q_dim"]
                if dim != pair["c_dim"]:
                    continue
                wanted = np.frombuffer(pair["q_matrix"], np.float64).reshape(-1, dim)
                rows = np.frombuffer(pair["c_matrix"], np.float64).reshape(-1, dim)
                names, ids = np.array(pair["q_query_id"], dtype=object), np.array(pair["c_chunk_id"], dtype=object)
                repos = pd.Series(pair["c_repo_id"])
                for repo, where in repos.groupby(repos, sort=False).indices.items():
                    qi, xi, dist = _candidates(wanted, rows[where], k, metric)
                    row = where[xi]
                    part = _best(pd.DataFrame({"q": qi, "repo_id": repo, "chunk_id": ids[row], "distance": dist, "row": row}), k)
                    out = pd.DataFrame({"query_id": names[part["q"].to_numpy(dtype=int)]}, index=part.index)
                    out = out.assign(repo_id=part["repo_id"], chunk_id=part["chunk_id"])
                    for c in carry:
                        out[c] = np.array(pair[f"c_{c}"], dtype=object)[part["row"].to_numpy(dtype=int)]
                    out = out.assign(distance=part["distance"])
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    found = stock.crossJoin(asked).mapInArrow(scan, schema)
    return top_k_per_group(found, ["query_id", "repo_id"], [F.col("distance"), F.col("chunk_id")], k)


def knn_batch(chunks: DataFrame, queries: DataFrame, k: int, metric: str = "l2", block: int = QUERY_BLOCK) -> DataFrame:
    """Exact nearest neighbours of many queries, per query and collection, then merged per query."""
    per_repo = knn_batch_per_collection(chunks, queries, k, metric, block)
    return top_k_per_group(per_repo, ["query_id"], [F.col("distance"), F.col("chunk_id")], k, salts=1)


def plane(table: int, bit: int, dim: int) -> list[float]:
    """A hyperplane with components 1 and -1 from a fixed hash, so that stored buckets stay valid and SQL can repeat them."""
    sign = lambda i: 1.0 if hashlib.md5(f"{table}:{bit}:{i}".encode()).hexdigest()[0] < "8" else -1.0
    return [sign(i) for i in range(dim)]


def lsh_buckets(embedding: Column, dim: int, tables: int = LSH_TABLES, bits: int = LSH_BITS) -> Column:
    """E5: for each table, the number whose bits tell on which side of each of its planes the vector lies."""
    vector = F.transform(embedding, lambda x: x.cast("double"))

    def side(table: int, bit: int) -> Column:
        signs = F.array(*[F.lit(x) for x in plane(table, bit, dim)])
        dot = F.aggregate(F.zip_with(vector, signs, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.when(dot > 0, 1 << bit).otherwise(0)

    return F.array(*[sum((side(t, b) for b in range(1, bits)), side(t, 0)) for t in range(tables)])


def lsh_index(chunks: DataFrame, dim: int, tables: int = LSH_TABLES, bits: int = LSH_BITS) -> DataFrame:
    """E5: the chunks with vectors of `dim` numbers once per table and bucket, to be stored with `partitionBy("bucket")` or
    bucketed; searching it reads the buckets of the query only."""
    buckets = lsh_buckets(F.col("embedding"), dim, tables, bits)
    return same_dim(chunks, dim).select("*", F.posexplode(buckets).alias("hash_table", "bucket"))


def knn_lsh(index: DataFrame, vector: Sequence[float], k: int, tables: int = LSH_TABLES, bits: int = LSH_BITS) -> DataFrame:
    """E5: approximate nearest neighbours from a stored `lsh_index`: exact ranking of the chunks that share a bucket with
    the vector. May return fewer or other rows than E3."""
    dim = len(vector)
    asked = [
        sum(1 << b for b in range(bits) if sum(x * y for x, y in zip(vector, plane(t, b, dim))) > 0) for t in range(tables)
    ]
    shared = [(F.col("hash_table") == t) & (F.col("bucket") == n) for t, n in enumerate(asked)]
    wanted = shared[0]
    for more in shared[1:]:
        wanted = wanted | more
    near = index.filter(wanted & F.col("bucket").isin(asked)).drop("hash_table", "bucket")
    scored = near.withColumn("distance", scoring.vector_distance("embedding", vector))
    # a chunk that shares several buckets came several times; at most `tables` times k rows are ranked twice
    first = global_top_k(scored, [F.col("distance"), F.col("chunk_id")], k * tables).dropDuplicates(["repo_id", "chunk_id"])
    return global_top_k(first, [F.col("distance"), F.col("chunk_id")], k).withColumn("similarity", scoring.similarity("distance"))
