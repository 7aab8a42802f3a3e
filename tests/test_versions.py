"""The table of versions: same rows as the whole-table operators, and nothing else read or written."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seekspan.operators import lifecycle
from seekspan.plans.indexing import full_index, incremental_index
from seekspan.schemas import CHUNKS, FILES
from seekspan.sources import versions
from seekspan.sources.symbols import flatten_symbols
from seekspan.sources.versions import VersionedChunks
from seekspan.streaming import index as live

NOW = dt.datetime(2024, 3, 10, 12)


def files(spark, texts):
    rows = [(f"r{i % 2}", "p", f"src/f{i}.go", "go", len(t), t.count("\n") + 1, NOW, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, FILES)


@pytest.fixture(scope="module")
def start(spark):
    base = files(spark, [f"func f{i}() {{}}\n" * (20 * (i % 9) + 1) for i in range(40)])
    return base, full_index(base, NOW).cache()


def state(df):
    names = ["chunk_id", "repo_id", "file_path", "content", "status", "deleted_at", "deleted_in_commit"]
    return sorted(map(str, df.select(*names).collect()))


def changed(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], "repo_id string, file_path string, change string, new_path string")


def test_same_rows_as_whole_tables(spark, start, tmp_path):
    base, chunks = start
    table = VersionedChunks.create(spark, str(tmp_path / "t"), chunks, buckets=8)
    assert state(table.read()) == state(chunks)
    some = base.filter("file_path IN ('src/f3.go', 'src/f8.go')")
    later = NOW + dt.timedelta(days=1)

    expected = lifecycle.tombstone(chunks, some, later, "abc")
    table.tombstone(some, later, "abc")
    assert state(table.read()) == state(expected)

    expected = lifecycle.restore(expected, some.limit(1))
    table.restore(some.limit(1))
    assert state(table.read()) == state(expected)

    new = files(spark, [f"func g{i}() {{}}\n" * (30 * (i % 4) + 2) for i in range(12)])
    found = changed(spark, ("r0", "src/f0.go", "modified"), ("r1", "src/f1.go", "modified"), ("r0", "src/f30.go", "deleted"), ("r1", "src/f11.go", "added"))
    expected = incremental_index(found, new, expected, later, "def")
    table.refresh(found, new, later, "def")
    assert state(table.read()) == state(expected)

    batch = chunks.filter("file_path = 'src/f5.go'").withColumn("content", F.lit("other"))
    expected = lifecycle.upsert(expected, batch, within=versions.FILE)
    table.upsert(batch.unionByName(batch))
    assert state(table.read()) == state(expected)

    expected, _ = lifecycle.purge(expected, later)
    table.purge(later)
    assert state(table.read()) == state(expected)

    before = table.version()
    table.compact(deltas=1)
    assert table.version() == before + 1 and state(table.read()) == state(expected)
    assert all(len(s) <= 2 for s in table.manifest()["sets"].values())
    assert table.vacuum(keep=1) and state(table.read()) == state(expected)

    expected, _ = lifecycle.clear(expected, spark.createDataFrame([("r1",)], "repo_id string"))
    table.clear(spark.createDataFrame([("r1",)], "repo_id string"))
    assert state(table.read()) == state(expected) and state(table.read(before + 1)) != state(expected)


def test_copies_of_a_row_stay(spark, start, tmp_path):
    """Two windows of a file can be equal and share their id; a tombstone keeps both."""
    base, chunks = start
    twice = chunks.unionByName(chunks.filter("file_path = 'src/f3.go'"))
    table = VersionedChunks.create(spark, str(tmp_path / "t"), twice, buckets=4)
    some = base.filter("file_path IN ('src/f3.go', 'src/f8.go')")
    expected = lifecycle.tombstone(twice, some, NOW, "abc")
    table.tombstone(some, NOW, "abc")
    assert state(table.read()) == state(expected)
    table.restore(some)
    assert state(table.read()) == state(lifecycle.restore(expected, some))


def test_one_shuffle_for_a_compaction(spark, start, tmp_path, monkeypatch):
    """The rows of a compaction and of an upsert are compared and laid out for writing by the same shuffle."""
    base, chunks = start
    table = VersionedChunks.create(spark, str(tmp_path / "t"), chunks, buckets=4)
    plans, write = [], VersionedChunks._write

    def seen(self, rows, *args, **named):
        plans.append((rows if named.get("laid") or args[-1] is True else rows.hint("rebalance"))._jdf.queryExecution().executedPlan().toString())
        return write(self, rows, *args, **named)

    monkeypatch.setattr(VersionedChunks, "_write", seen)
    stored = spark.read.schema(CHUNKS).parquet(f"{tmp_path}/t/data")
    table.upsert(stored)
    before = state(table.read())
    table.compact(deltas=1)
    assert [p.count("Exchange ") for p in plans] == [1, 1]
    assert state(table.read()) == before == state(chunks)


def test_only_touched_buckets_are_read_and_written(spark, start, tmp_path):
    base, chunks = start
    table = VersionedChunks.create(spark, str(tmp_path / "t"), chunks, buckets=16)
    one = changed(spark, ("r0", "src/f0.go", "modified"))
    (bucket,) = table.touched(one)
    # every file of another bucket is destroyed: a refresh that opened one would fail
    other = [f for f in (tmp_path / "t" / "data").rglob("*.parquet") if f"bucket={bucket}/" not in str(f)]
    assert len(other) > 5
    for f in other:
        f.write_bytes(b"broken")
    table.refresh(one, base, NOW + dt.timedelta(days=1))
    (name,) = [s for s in table.storage.names("data") if s.startswith("set=000000000002")]
    assert [n for n in table.storage.names(f"data/{name}") if n.startswith("bucket=")] == [f"bucket={bucket}"]
    assert table.read(buckets=[bucket]).filter("file_path = 'src/f0.go' AND status = 'active'").count() > 0


def test_failed_batch_leaves_the_old_version(spark, start, tmp_path, monkeypatch):
    base, chunks = start
    table = VersionedChunks.create(spark, str(tmp_path / "t"), chunks, buckets=4)
    before = state(table.read())
    some = base.limit(3)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table.storage, "create", fails)
        with pytest.raises(OSError):
            table.tombstone(some, NOW, batch=("s", 0))
    assert table.version() == 1 and state(table.read()) == before
    assert table.tombstone(some, NOW, batch=("s", 0)) == 2
    after = state(table.read())
    assert after != before
    # the same batch again changes nothing, the unfinished files of the first try go with the next clearing
    assert table.tombstone(base, NOW, batch=("s", 0)) == 2 and state(table.read()) == after
    assert len(table.vacuum(keep=2)) == 1 and state(table.read()) == after and state(table.read(1)) == before


def test_second_writer_starts_again(spark, start, tmp_path):
    _, chunks = start
    table = VersionedChunks.create(spark, str(tmp_path / "t"), chunks, buckets=4)
    manifest = table.manifest()
    table._commit(2, manifest)
    with pytest.raises(versions.Conflict):
        table._commit(2, {**manifest, "buckets": 5})
    assert table.manifest()["buckets"] == 4
    with pytest.raises(ValueError):
        VersionedChunks.create(spark, str(tmp_path / "t"), chunks)


def test_rows_of_a_page_skip_row_groups(spark, start, tmp_path):
    """Files are sorted by collection and id: a wanted collection and id reach the scan as filters."""
    _, chunks = start
    table = VersionedChunks.create(spark, str(tmp_path / "t"), chunks, buckets=2)
    spark.conf.set("spark.sql.maxMetadataStringLength", "3000")
    plan = table.read().filter("repo_id = 'r0' AND chunk_id = 'x'")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(repo_id,r0)" in plan and "EqualTo(chunk_id,x)" in plan


def test_stream(spark, start, tmp_path):
    base, chunks = start
    table = VersionedChunks.create(spark, str(tmp_path / "t"), chunks, buckets=4)
    new = files(spark, ["func new() {}\n" * 30] * 6)
    found = changed(spark, *[(f"r{i % 2}", f"src/f{i}.go", "modified") for i in range(6)], ("r0", "src/f20.go", "deleted"))
    rows = found.drop("new_path").join(new, versions.FILE, "left").select(*FILES.names, "change")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.file_stream(spark, str(tmp_path / "in"), rows, "*.parquet", files_per_trigger=1)
    live.stream_versions(stream, table, str(tmp_path / "progress"), NOW, commit="abc").awaitTermination()
    expected = state(incremental_index(found, new, chunks, NOW, "abc"))
    assert table.version() > 2 and state(table.read()) == expected
    # a batch that is delivered again is known
    assert table.refresh(changed(spark, ("r0", "src/f2.go", "deleted")), new, NOW, batch=("changes", 0)) == table.version()
    assert state(table.read()) == expected


def test_empty_table(spark, tmp_path):
    table = VersionedChunks.create(spark, str(tmp_path / "t"))
    assert table.read().count() == 0 and table.read().columns == CHUNKS.names
    table.purge()
    assert table.read().count() == 0


def test_change_reads_only_sets_of_its_files(spark, start, tmp_path):
    """What a change reads of the stored texts does not grow with the changes of other files before it."""
    base, chunks = start
    table = VersionedChunks.create(spark, str(tmp_path / "t"), chunks, buckets=1)
    for i in (0, 1, 2):
        table.tombstone(base.filter(f"file_path = 'src/f{i}.go'"), NOW)
    sets = table.manifest()["sets"]["0"]
    folders = lambda df: {s for s in sets for f in df.inputFiles() if f"set={s}/" in f}
    assert folders(table.rows_of(base.filter("file_path = 'src/f1.go'"))) == {sets[0], sets[2]}
    for i in (0, 1, 2, 3):
        one = base.filter(f"file_path = 'src/f{i}.go'")
        assert state(table.rows_of(one)) == state(table.read().join(one, versions.FILE, "left_semi"))
    new = base.filter("file_path = 'src/f4.go'").withColumn("file_path", F.lit("src/new.go"))
    assert table.rows_of(new).count() == 0


def test_micro_batch_is_dealt_over_all_cores(spark, tmp_path):
    rows = spark.range(100).selectExpr("CAST(id AS STRING) AS text")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    cores = spark.sparkContext.defaultParallelism
    assert live.dealt(batch).rdd.getNumPartitions() == cores and live.dealt(batch).count() == 100


def test_symbols_are_made_for_listed_files_only(spark, start):
    base, chunks = start
    found = changed(spark, ("r0", "src/f2.go", "modified"), ("r1", "src/f3.go", "deleted"))
    one = spark.createDataFrame([(f"r{i % 2}", f"src/f{i}.go", f'[{{"name": "f", "kind": 12, "range": {{"start": {{"line": 0, "character": 0}}, "end": {{"line": 3, "character": 0}}}}}}]') for i in range(40)], "repo_id string, file_path string, symbols string")
    asked = []

    def made(listed):
        asked.append(sorted(r["file_path"] for r in listed.collect()))
        return flatten_symbols(one.join(listed, versions.FILE, "left_semi"))

    got = incremental_index(found, base, chunks, NOW, "abc", symbols=made)
    assert asked == [["src/f2.go"]]
    assert state(got) == state(incremental_index(found, base, chunks, NOW, "abc", symbols=flatten_symbols(one)))
