"""A chunk table of versions: changes are small delta files, a pointer is switched last.

Rows are dealt into buckets by a hash of their file. A change writes new images of the rows it touches, in a folder of its own
with one sub-folder per touched bucket, and then a manifest that names, for every bucket, its base folder and the deltas after
it. A manifest appears whole under the next number or not at all, so readers always see one complete version, a batch that fails
half-way leaves the old one in place, and of two writers one has to start again. Reading and writing concern the touched
buckets only; the others are neither listed nor opened. Compaction folds the deltas of a bucket into a new base.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspan.functions.times import Moment
from seekspan.operators import lifecycle
from seekspan.operators.changes import expand_renames
from seekspan.plans.indexing import incremental_index
from seekspan.schemas import CHUNKS
from seekspan.session import materialize
from seekspan.sources.storage import Storage

FILE = ["repo_id", "file_path"]
KEY = [*FILE, "chunk_id"]
BUCKETS = 64
# applied batches that a manifest remembers, the newest of each source
PUT, GONE = "put", "gone"
_STORED = T.StructType([*CHUNKS.fields, T.StructField("op", T.StringType()), T.StructField("set", T.StringType()), T.StructField("bucket", T.IntegerType())])


class Conflict(RuntimeError):
    """Somebody else has written the next version; start again from it."""


class VersionedChunks:
    """The chunk table below `path`. Its number of buckets is fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.storage = Storage(spark, path)

    # versions

    @classmethod
    def create(cls, spark: SparkSession, path: str, chunks: DataFrame | None = None, buckets: int = BUCKETS) -> VersionedChunks:
        table = cls(spark, path)
        if table.versions():
            raise ValueError(f"{path} is a table already")
        rows = spark.createDataFrame([], CHUNKS) if chunks is None else chunks
        name, touched = table._write(rows.select(*CHUNKS.names).withColumn("op", F.lit(PUT)), 1, buckets)
        table._commit(1, {"buckets": buckets, "sets": {str(b): [name] for b in touched}, "batches": {}})
        return table

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.storage.names("versions") if n.endswith(".json")]

    def version(self) -> int:
        return max(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(self.storage.read(f"versions/{version or self.version():012d}.json"))

    def _commit(self, version: int, manifest: dict) -> int:
        done = self.storage.create(f"versions/{version:012d}.json", json.dumps(manifest), f"pending/{uuid.uuid4().hex}")
        if not done:
            raise Conflict(f"version {version} of {self.path} exists")
        return version

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*FILE), F.lit(buckets)).cast("int")

    def _newest(self, rows: DataFrame, buckets: int, order: Column | None = None) -> DataFrame:
        """Of the rows of one key those of the newest set, or any one without `order`; laid out by bucket, so that one shuffle does
        for both. A bucket is several parts where there are more tasks than buckets."""
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets, 1) * buckets
        laid = rows.withColumn("__part", F.pmod(F.xxhash64(*FILE), F.lit(parts))).repartition("__part")
        keys = Window.partitionBy("__part", *KEY)
        place = F.row_number().over(keys.orderBy("chunk_id")) if order is None else F.rank().over(keys.orderBy(order))
        return laid.withColumn("__n", place).filter(F.col("__n") == 1).drop("__n", "__part")

    def _write(self, rows: DataFrame, version: int, buckets: int, laid: bool = False) -> tuple[str, list[int]]:
        """Rows as one more set of files, clustered by collection and id so that row groups can be skipped; its name and buckets.
        Rows that are `laid` out by bucket already are not shuffled again."""
        name = f"{version:012d}-{uuid.uuid4().hex[:12]}"
        rows = rows.withColumn("bucket", self._bucket(buckets))
        rows = rows if laid else rows.hint("rebalance", F.col("bucket"))
        writer = rows.sortWithinPartitions("bucket", "repo_id", "chunk_id").write.partitionBy("bucket").option("compression", "zstd")
        writer.option("parquet.bloom.filter.enabled#chunk_id", "true").option("parquet.block.size", 16 << 20).parquet(f"{self.path}/data/set={name}")
        found = [n.removeprefix("bucket=") for n in self.storage.names(f"data/set={name}")]
        return name, [int(b) for b in found if b.isdigit()]

    # reading

    def _files(self, folders: list[tuple[str, str]]) -> DataFrame:
        paths = [f"{self.path}/data/set={s}/bucket={b}" for b, s in folders]
        reader = self.spark.read.schema(_STORED).option("basePath", f"{self.path}/data")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], _STORED)

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None, files: DataFrame | None = None) -> DataFrame:
        """One version as a chunk table; `buckets` leaves out the files of all others, `files` the rows of all other files of the
        chunks, before anything is compared or shuffled."""

        def stored(folders: list[tuple[str, str]]) -> DataFrame:
            rows = self._files(folders)
            return rows if files is None else rows.join(files, FILE, "left_semi")

        sets = self.manifest(version)["sets"]
        if buckets is not None:
            wanted = {str(b) for b in buckets}
            sets = {b: s for b, s in sets.items() if b in wanted}
        if files is not None and any(len(s) > 1 for s in sets.values()):
            sets = self._holding(sets, files)
        still = stored([(b, s[0]) for b, s in sets.items() if len(s) == 1]).filter(F.col("op") == PUT)
        out = still.select(*CHUNKS.names)
        if all(len(s) == 1 for s in sets.values()):
            return out
        base = stored([(b, s[0]) for b, s in sets.items() if len(s) > 1]).filter(F.col("op") == PUT)
        deltas = stored([(b, s) for b, all_ in sets.items() for s in all_[1:]])
        images = deltas
        if any(len(s) > 2 for s in sets.values()):
            # all rows of the newest set, which has copies of a row where the base has them
            newest = F.rank().over(Window.partitionBy(*KEY).orderBy(F.col("set").desc()))
            images = deltas.withColumn("__n", newest).filter(F.col("__n") == 1)
        # only the ids of changed rows meet the base
        old = base.join(deltas.select(*KEY).distinct(), KEY, "left_anti").select(*CHUNKS.names)
        return out.unionByName(old).unionByName(images.filter(F.col("op") == PUT).select(*CHUNKS.names))

    def _holding(self, sets: dict[str, list[str]], files: DataFrame) -> dict[str, list[str]]:
        """Of the sets of each bucket those with rows of the listed files, in the same order. Only names of files are read, so that a
        change does not read the texts of all changes before it."""
        names = self._files([(b, s) for b, all_ in sets.items() for s in all_]).select(*FILE, "set", "bucket")
        # as many rows as there are folders at most
        held = {(str(r["bucket"]), r["set"]) for r in names.join(files, FILE, "left_semi").select("set", "bucket").distinct().collect()}
        kept = {b: [s for s in all_ if (b, s) in held] for b, all_ in sets.items()}
        return {b: s for b, s in kept.items() if s}

    def touched(self, files: DataFrame) -> list[int]:
        """Buckets of the listed files, as many as the table has at most."""
        bucket = self._bucket(self.manifest()["buckets"])
        return sorted(r["b"] for r in files.select(bucket.alias("b")).distinct().collect())

    def rows_of(self, files: DataFrame) -> DataFrame:
        """Stored chunks of the listed files, from their buckets."""
        listed = files.select(*FILE).distinct()
        return self.read(buckets=self.touched(listed), files=listed)

    # changing

    def _apply(self, change: Callable[[], DataFrame], batch: tuple[str, int] | None, laid: bool = False) -> int:
        """Write the new images that `change` gives and switch to a version with them. A batch (source, number) that has been
        applied before changes nothing."""
        before = self.version()
        manifest = self.manifest(before)
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return before
        name, touched = self._write(change(), before + 1, manifest["buckets"], laid)
        for b in touched:
            manifest["sets"].setdefault(str(b), []).append(name)
        if batch:
            manifest["batches"][batch[0]] = batch[1]
        return self._commit(before + 1, manifest)

    @staticmethod
    def _put(rows: DataFrame) -> DataFrame:
        return rows.select(*CHUNKS.names, F.lit(PUT).alias("op"))

    def upsert(self, chunks: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """L1: rows of `chunks` replace those of the same file and id; nothing stored is read."""
        return self._apply(lambda: self._newest(self._put(chunks), self.manifest()["buckets"]), batch, laid=True)

    def tombstone(self, files: DataFrame, now: Moment, commit: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """L2."""
        return self._apply(lambda: self._put(lifecycle.tombstone(self.rows_of(files), files, now, commit)), batch)

    def restore(self, files: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """L3."""
        return self._apply(lambda: self._put(lifecycle.restore(self.rows_of(files), files)), batch)

    def refresh(
        self,
        changes: DataFrame,
        files: DataFrame,
        now: Moment,
        commit: str | None = None,
        renames: str = "split",
        batch: tuple[str, int] | None = None,
        **options,
    ) -> int:
        """Chunks of deleted and modified files are tombstoned, added and modified files are indexed."""

        def change() -> DataFrame:
            flat = materialize(expand_renames(changes, renames), "changes").withColumn("new_path", F.lit(None).cast("string"))
            return self._put(incremental_index(flat, files, self.rows_of(flat), now, commit, renames=None, **options))

        return self._apply(change, batch)

    def _remove(self, rows: DataFrame, batch: tuple[str, int] | None) -> int:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in KEY else F.col(f.name) for f in CHUNKS.fields]
        return self._apply(lambda: rows.select(*empty, F.lit(GONE).alias("op")), batch)

    def purge(self, cutoff: Moment | None = None, batch: tuple[str, int] | None = None) -> int:
        """Deleted rows, stamped no later than `cutoff`, leave the table. Ids, status and stamps are read, not texts."""
        return self._remove(self.read().filter(lifecycle.purgeable(cutoff)).select(*KEY), batch)

    def clear(self, repos: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """All rows of the listed collections leave the table."""
        return self._remove(self.read().join(repos.select("repo_id").distinct(), "repo_id", "left_semi").select(*KEY), batch)

    # upkeep

    def compact(self, deltas: int = 4) -> int:
        """Fold the deltas of all buckets that have `deltas` of them or more into new bases; other buckets stay as they are."""
        before = self.version()
        manifest = self.manifest(before)
        due = [b for b, s in manifest["sets"].items() if len(s) > deltas]
        if not due:
            return before
        # bases and deltas are shuffled once, by the parts that are written
        images = self._newest(self._files([(b, s) for b in due for s in manifest["sets"][b]]), manifest["buckets"], F.col("set").desc())
        rows = images.filter(F.col("op") == PUT).select(*CHUNKS.names, "op")
        name, written = self._write(rows, before + 1, manifest["buckets"], laid=True)
        for b in due:
            manifest["sets"].pop(b)
        manifest["sets"] |= {str(b): [name] for b in written}
        return self._commit(before + 1, manifest)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete files that none of the last `keep` versions names, with older manifests; returns the sets that went. Writers
        must not be at work: their files are named by no version yet."""
        versions = self.versions()
        kept = sorted(versions)[-keep:]
        named = {s for v in kept for sets in self.manifest(v)["sets"].values() for s in sets}
        gone = [n.removeprefix("set=") for n in self.storage.names("data") if n.removeprefix("set=") not in named]
        for v in versions:
            if v not in kept:
                self.storage.delete(f"versions/{v:012d}.json")
        for name in gone:
            self.storage.delete(f"data/set={name}")
        self.storage.delete("pending")
        return gone
