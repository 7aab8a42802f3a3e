"""Inverted-file index over vectors: approximate search with a few probed cells, and an exact join pruned by distances.

Vectors are grouped round centres fitted on a bounded sample. Every vector lies in the cell of its nearest centre and knows its
distance to it, so the table is one of rings: blocks of vectors of one cell in the order of that distance. By the triangle
inequality a query whose distance to the centre differs from all those of a ring by more than its k-th best distance so far
cannot have a neighbour there, and whole cells and rings are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspan.operators.filters import same_dim
from seekspan.operators.search import _candidates
from seekspan.operators.topk import top_k_per_group
from seekspan.session import materialize, small_batches

# Centres are fitted on about SAMPLE_PER_CELL vectors for each, chosen by a hash of the id; there are at most MAX_CELLS of them,
# so the sample and the centres have a fixed bound whatever the table.
SAMPLE_PER_CELL, MAX_CELLS, ROUNDS = 64, 1024, 4
# Vectors of one ring, and queries that meet a ring together.
RING_ROWS, QUERY_ROWS = 2048, 256
# Relative slack of the bounds, far above the rounding of distances.
SLACK = 1e-9
PROBES = 8


@dataclass(frozen=True)
class Cells:
    """Centres, and the metric they are for. `cosine` compares vectors of unit length, whose Euclidean distance has its order."""

    centres: np.ndarray
    metric: str = "l2"

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def prepared(self, vectors: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return vectors
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Euclidean distance of every (prepared) vector to every centre."""
        square = (vectors**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1)[None, :] - 2.0 * vectors @ self.centres.T
        return np.sqrt(np.maximum(square, 0.0))

    def bound(self, distance: np.ndarray) -> np.ndarray:
        """A distance of the metric as a Euclidean one of prepared vectors."""
        if self.metric == "cosine":
            return np.sqrt(2.0 * np.maximum(distance, 0.0))
        return np.sqrt(np.maximum(distance, 0.0)) if self.metric == "l2sq" else distance


def default_cells(rows: int) -> int:
    return min(max(int(math.sqrt(rows) / 2), 1), MAX_CELLS)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def fit_cells(chunks: DataFrame, dim: int, cells: int | None = None, metric: str = "l2", per_cell: int = SAMPLE_PER_CELL) -> Cells:
    """Centres by k-means over a sample: rows whose MD5 of the id is small enough, about `per_cell` for each centre. The first
    centres are the sample's first rows in the order of that hash, so equal tables give equal centres."""
    usable = same_dim(chunks, dim)
    total = usable.count()
    cells = min(cells or default_cells(total), MAX_CELLS)
    share = min(cells * per_cell / total, 1.0) if total else 1.0
    tag = F.md5("chunk_id")
    some = usable.filter(F.conv(F.substring(tag, 1, 8), 16, 10).cast("bigint") < F.lit(int(share * 2**32)))
    sample = some.select(tag.alias("tag"), F.col("embedding").cast("array<double>").alias("v")).toArrow().sort_by("tag")
    vectors = _matrix(sample.column("v").combine_chunks(), dim) if sample.num_rows else np.zeros((1, dim))
    vectors = Cells(vectors, metric).prepared(vectors)
    found = Cells(vectors[:cells].copy(), metric)
    for _ in range(ROUNDS):
        nearest = found.distances(vectors).argmin(axis=1)
        sums, counts = np.zeros_like(found.centres), np.bincount(nearest, minlength=len(found.centres))
        np.add.at(sums, nearest, vectors)
        used = counts > 0
        centres = found.centres.copy()
        centres[used] = sums[used] / counts[used, None]
        found = Cells(centres, metric)
    return found


def assign(chunks: DataFrame, cells: Cells) -> DataFrame:
    """The chunks with vectors of the index's length, each with its `cell` and its distance `spread` to the centre."""
    rows = same_dim(chunks, cells.dim)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("spread", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = cells.distances(cells.prepared(_matrix(batch.column("embedding"), cells.dim)))
            cell = far.argmin(axis=1)
            columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def rings(assigned: DataFrame, rows: int = RING_ROWS) -> DataFrame:
    """Blocks of at most `rows` vectors of one cell, in the order of their distance to the centre: (cell, lo, hi, n, repo_ids,
    chunk_ids, matrix). Ranges of that order are dealt out, so a cell with a large share of all rows is many tasks' work."""
    tasks = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", "spread", "chunk_id"]
    laid = assigned.select("repo_id", *order, F.col("embedding").cast("array<float>").alias("embedding"))
    laid = laid.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ring(batch: pa.RecordBatch) -> pa.RecordBatch:
            spread = batch.column("spread").to_numpy()
            matrix = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
            lists = [pa.array([batch.column(c).to_pylist()], pa.list_(pa.string())) for c in ("repo_id", "chunk_id")]
            facts = [pa.array([x]) for x in (float(spread[0]), float(spread[-1]))]
            cell, n = pa.array([batch.column("cell")[0].as_py()], pa.int32()), pa.array([batch.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays([cell, *facts, n, *lists, pa.array([matrix], pa.binary())], names=_RING.names)

        def emptied() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return ring(whole)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0].column("cell")[0].as_py() != cell[a]:
                    yield emptied()
                while a < b:
                    room = rows - sum(h.num_rows for h in held)
                    held.append(batch.slice(a, min(room, b - a)))
                    a += held[-1].num_rows
                    if sum(h.num_rows for h in held) == rows:
                        yield emptied()
        if held:
            yield emptied()

    return laid.mapInArrow(run, _RING)


_RING = T.StructType(
    [
        T.StructField("cell", T.IntegerType()),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("repo_ids", T.ArrayType(T.StringType())),
        T.StructField("chunk_ids", T.ArrayType(T.StringType())),
        T.StructField("matrix", T.BinaryType()),
    ]
)


def write_index(chunks: DataFrame, cells: Cells, path: str, mode: str = "overwrite") -> None:
    """Store an index: centres, and rings in one folder per cell. With `mode="append"` more chunks join an index of the same
    centres; every chunk with a vector of its length is indexed."""
    spark = chunks.sparkSession
    if mode == "overwrite":
        rows = [(i, cells.metric, c.tolist()) for i, c in enumerate(cells.centres)]
        spark.createDataFrame(rows, "cell int, metric string, centre array<double>").coalesce(1).write.mode(mode).parquet(f"{path}/centres")
    rings(assign(chunks, cells)).write.mode(mode).partitionBy("cell").parquet(f"{path}/rings")


def read_index(spark: SparkSession, path: str) -> tuple[Cells, DataFrame]:
    """The centres, at most MAX_CELLS rows, and the table of rings."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    cells = Cells(np.array([r["centre"] for r in rows]), rows[0]["metric"])
    return cells, spark.read.schema(_RING).parquet(f"{path}/rings").select(*_RING.names)


def _probed(queries: DataFrame, cells: Cells, probes: int, radius: np.ndarray | None = None, known: bool = False) -> DataFrame:
    """(cell, query_id, vector, way, reach) for the cells that a query looks into; `way` is its distance to the centre.

    The nearest `probes` cells without `radius`; with it the further ones in which something can lie within `reach` of the query."""
    kind = queries.schema["query_id"].dataType
    schema = T.StructType(
        [
            T.StructField("cell", T.IntegerType()),
            T.StructField("query_id", kind),
            T.StructField("vector", T.BinaryType()),
            T.StructField("way", T.DoubleType()),
            T.StructField("reach", T.DoubleType()),
        ]
    )
    fitting = queries.filter(F.size("query_vec") == cells.dim)
    columns = ["query_id", F.col("query_vec").cast("array<double>").alias("query_vec"), (F.col("reach") if known else F.lit(math.inf)).alias("reach")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch.column("query_vec"), cells.dim)
            way = cells.distances(cells.prepared(raw))
            rank = way.argsort(axis=1, kind="stable").argsort(axis=1)
            reach = cells.bound(batch.column("reach").to_numpy())
            reach = reach + SLACK * (1.0 + np.where(np.isinf(reach), 0.0, reach))
            wanted = rank < probes if radius is None else (rank >= probes) & (way - radius[None, :] <= reach[:, None] + SLACK * (1.0 + way))
            at, cell = np.nonzero(wanted)
            packed = pa.array([row.tobytes() for row in raw], pa.binary())
            columns = [pa.array(cell.astype(np.int32)), batch.column("query_id").take(pa.array(at)), packed.take(pa.array(at))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(way[at, cell]), pa.array(reach[at])], names=schema.names)

    return fitting.select(*columns).mapInArrow(run, schema)


def _together(probed: DataFrame, size: int) -> DataFrame:
    """Queries of one cell in groups of at most `size`, in the order of their distance to its centre, with the range of
    distances of vectors that can concern any of them."""
    kind = probed.schema["query_id"].dataType
    fields = [("q_cell", T.IntegerType()), ("low", T.DoubleType()), ("high", T.DoubleType()), ("query_ids", T.ArrayType(kind)), ("asked", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    tasks = int(probed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", "way", "query_id"]
    laid = probed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, way, reach = (batch.column(c).to_numpy() for c in ("cell", "way", "reach"))
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for first, end in zip(cuts, cuts[1:]):
                for a in range(first, end, size):
                    b = min(a + size, end)
                    ids = pa.array([batch.column("query_id").slice(a, b - a).to_pylist()], pa.list_(batch.column("query_id").type))
                    asked = b"".join(batch.column("vector").slice(a, b - a).to_pylist())
                    facts = [pa.array([int(cell[a])], pa.int32()), pa.array([float((way - reach)[a:b].min())]), pa.array([float((way + reach)[a:b].max())])]
                    yield pa.RecordBatch.from_arrays([*facts, ids, pa.array([asked], pa.binary())], names=schema.names)

    return laid.mapInArrow(run, schema)


def pairs(rings_: DataFrame, asked: DataFrame) -> DataFrame:
    """Groups of queries with the rings that can hold neighbours of theirs. The ring's range is part of the join condition, so
    other pairs are never formed."""
    near = (F.col("cell") == F.col("q_cell")) & (F.col("hi") >= F.col("low")) & (F.col("lo") <= F.col("high"))
    # a merge join by cell: the packed columns look small to the planner, and neither side may pass through the driver
    return rings_.join(asked.hint("merge"), near)


def _ranked(pairs_: DataFrame, kind: T.DataType, k: int, cells: Cells) -> DataFrame:
    """At most k rows for each query and ring: (query_id, repo_id, chunk_id, distance)."""
    schema = T.StructType(
        [T.StructField("query_id", kind), T.StructField("repo_id", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("distance", T.DoubleType())]
    )
    dim, metric = cells.dim, cells.metric
    # a row is up to 2048 vectors and 256 queries, so ten thousand rows are no batch
    small_batches(pairs_.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda c: batch.column(c)[i]  # noqa: B023, E731
                stock = np.frombuffer(value("matrix").as_buffer(), "<f4").astype(np.float64).reshape(-1, dim)
                asked = np.frombuffer(value("asked").as_buffer(), np.float64).reshape(-1, dim)
                qi, xi, far = _candidates(asked, stock, k, metric)
                ids = np.array(value("chunk_ids").as_py(), dtype=object)[xi]
                best = pd.DataFrame({"q": qi, "x": xi, "id": ids, "distance": far}).sort_values(["q", "distance", "id"], kind="stable").groupby("q", sort=False).head(k)
                q, x = pa.array(best["q"].to_numpy()), pa.array(best["x"].to_numpy())
                columns = [value("query_ids").values.take(q), value("repo_ids").values.take(x), value("chunk_ids").values.take(x), pa.array(best["distance"].to_numpy())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pairs_.select("matrix", "asked", "chunk_ids", "repo_ids", "query_ids").mapInArrow(run, schema)


ORDER = ("distance", "chunk_id")


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k_per_group(found, ["query_id"], [F.col(c) for c in ORDER], k, salts=1)


def knn_cells(cells: Cells, rings_: DataFrame, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """E5: approximate neighbours of many queries (query_id, query_vec), from the `probes` nearest cells of each, ranked exactly:
    (query_id, repo_id, chunk_id, distance). Only the folders of probed cells are read from a stored index."""
    probed = materialize(_probed(queries, cells, probes), "probed")
    wanted = [r["cell"] for r in probed.select("cell").distinct().collect()]  # at most MAX_CELLS numbers
    read = rings_.filter(F.col("cell").isin(wanted))
    asked = _together(probed, QUERY_ROWS)
    return _best(_ranked(pairs(read, asked), queries.schema["query_id"].dataType, k, cells), k)


def knn_join(cells: Cells, rings_: DataFrame, queries: DataFrame, k: int, probes: int = 2) -> DataFrame:
    """Exact neighbours of many queries, over all collections, with pruned pairs.

    The nearest `probes` cells give each query k rows and with them a bound; then only the cells and rings that the triangle
    inequality leaves are looked into. Vectors of another length than the index's are not in it, and queries of another length
    find nothing.
    """
    near, further, first = candidate_groups(cells, rings_, queries, k, probes)
    more = _ranked(pairs(rings_, further), queries.schema["query_id"].dataType, k, cells)
    return _best(first.unionByName(more), k)


def probes_for(cells: Cells, rings_: DataFrame, queries: DataFrame, k: int, recall: float = 0.95) -> int:
    """The least number of probes that finds `recall` of the true neighbours of some sample queries, at most a few hundred: their
    true neighbours come from the exact join, and what counts is how near the cells are that these lie in. The sample is stored
    first: one that was taken with a limit could be other rows each time it is computed."""
    queries = materialize(queries, "sample")
    true = knn_join(cells, rings_, queries, k).select("query_id", "repo_id", "chunk_id")
    each = rings_.select("cell", F.explode(F.arrays_zip("repo_ids", "chunk_ids")).alias("x"))
    # k rows for each sample query go to the ids of all rows, which stay where they are
    every = each.select("cell", F.col("x.repo_ids").alias("repo_id"), F.col("x.chunk_ids").alias("chunk_id"))
    lies = every.join(F.broadcast(true), ["repo_id", "chunk_id"])
    asked = {r["query_id"]: r["query_vec"] for r in queries.collect()}
    found = lies.select("query_id", "cell").collect()
    if not found:
        return PROBES
    names = list(asked)
    order = cells.distances(cells.prepared(np.array([asked[n] for n in names], dtype=np.float64)))
    rank = dict(zip(names, order.argsort(axis=1, kind="stable").argsort(axis=1)))
    ranks = np.sort([rank[r["query_id"]][r["cell"]] for r in found])
    return int(ranks[max(math.ceil(recall * len(ranks)) - 1, 0)]) + 1


def candidate_groups(cells: Cells, rings_: DataFrame, queries: DataFrame, k: int, probes: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The groups of queries of either round, and the rows that the first one has found."""
    kind = queries.schema["query_id"].dataType
    near = _together(_probed(queries, cells, probes), QUERY_ROWS)
    first = materialize(_best(_ranked(pairs(rings_, near), kind, k, cells), k), "neighbours")
    bounds = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
    reach = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(math.inf)).alias("reach")
    known = queries.join(bounds, "query_id", "left").select("query_id", "query_vec", reach)
    radius = np.full(len(cells.centres), -math.inf)
    for row in rings_.groupBy("cell").agg(F.max("hi").alias("hi")).collect():  # at most MAX_CELLS rows
        radius[row["cell"]] = row["hi"]
    further = _together(_probed(known, cells, probes, radius, known=True), QUERY_ROWS)
    return near, further, first
