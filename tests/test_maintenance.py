import datetime as dt
import os

import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekspan.operators import audit, changes, lifecycle, ratelimit, reports
from seekspan.plans.indexing import full_index, incremental_index
from seekspan.schemas import CHUNKS, conform
from seekspan.sources import tables, trees
from seekspan.sources.files import scan_repo, scan_trees
from seekspan.sources.name_status import read_name_status

NOW = dt.datetime(2024, 3, 10, 12)
T0 = dt.datetime(2024, 1, 1)


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, file_path string, mtime timestamp, content string, language string, lines int, project_name string, size bigint")


def file(path, content="x\ny", mtime=T0):
    return ("r", path, mtime, content, "go", content.count("\n") + 1, "p", len(content))


def manifest(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, file_path string, mtime timestamp")


def test_snapshot_diff(spark):
    files = snapshot(spark, [file("same.go"), file("new.go"), file("later.go", mtime=T0 + dt.timedelta(seconds=2))])
    known = manifest(
        spark, [("r", "same.go", T0 + dt.timedelta(milliseconds=400)), ("r", "later.go", T0), ("r", "gone.go", T0)]
    )
    got = {(r.file_path, r.change) for r in changes.diff_snapshot(files, known).collect()}
    assert got == {("new.go", "added"), ("later.go", "modified"), ("gone.go", "deleted")}
    assert changes.diff_snapshot(files, manifest(spark, [])).filter("change = 'added'").count() == 3


def test_name_status(spark):
    lines = ["A\ta.go", "M\tmy file.py", "D\tc.js", "R090\told.go\tnew.go", "R100\told.py\tnew.txt", "A\tnotes.txt", "", "X", "C50\ta.go\tb.go"]
    df = spark.createDataFrame([("r", s) for s in lines], ["repo_id", "line"])
    got = {(r.file_path, r.change, r.new_path) for r in changes.diff_name_status(read_name_status(df)).collect()}
    assert got == {("a.go", "added", None), ("my file.py", "modified", None), ("c.js", "deleted", None), ("old.go", "renamed", "new.go")}


def test_refresh_plan(spark):
    projects = spark.createDataFrame([("a", None), ("b", "abc1234"), ("c", "abc1234")], "repo_id string, last_indexed_commit string")
    found = spark.createDataFrame([("c", "x.go", "added")], "repo_id string, file_path string, change string")
    plans = {r.repo_id: r.plan for r in changes.plan_refresh(found, projects).collect()}
    assert plans == {"a": "full", "b": "none", "c": "incremental"}


@pytest.fixture(scope="module")
def index(spark):
    files = snapshot(spark, [file("a.go", "a\n" * 900), file("b.go", "b"), file("c.go", "c")])
    return full_index(files, NOW).cache()


def test_upsert_is_idempotent(index):
    once = lifecycle.upsert(index, index)
    rows = lambda df: sorted((r.chunk_id, r.status, r.content) for r in df.collect())
    assert rows(once) == rows(index)
    counts = lifecycle.upsert_counts(index, index).first()
    assert (counts.inserted, counts.updated) == (0, index.count())


def test_tombstone_and_restore(spark, index):
    paths = spark.createDataFrame([("r", "a.go"), ("r", "a.go"), ("other", "b.go")], ["repo_id", "file_path"])
    gone = lifecycle.tombstone(index, paths, NOW, "abc1234")
    assert {r.file_path for r in gone.filter("status = 'deleted'").collect()} == {"a.go"}
    assert gone.count() == index.count()
    back = lifecycle.restore(gone, paths)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(back) == rows(index)
    _, hits = lifecycle.soft_delete(index, paths, NOW)
    assert {(r.file_path, r.deleted_count) for r in hits.collect()} == {("a.go", index.filter("file_path = 'a.go'").count()), ("b.go", 0)}


def test_purge(spark):
    rows = [
        ("1", "deleted", "2024-02-01 00:00:00"), ("2", "deleted", "2024-03-01 00:00:00"), ("3", "deleted", "2024-03-02 00:00:00"),
        ("4", "deleted", "garbage"), ("5", "deleted", None), ("6", "active", "2024-01-01 00:00:00"), ("7", None, None),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, status string, deleted_at string").withColumns(
        {"repo_id": F.lit("r"), "file_path": F.concat(F.lit("f"), "chunk_id")}
    )
    cutoff = "2024-03-01 00:00:00"
    kept, report = lifecycle.purge(df, cutoff)
    assert {r.chunk_id for r in kept.collect()} == {"3", "6", "7"}
    lines = {r.file_path: r.line for r in lifecycle.purge_report(report).collect()}
    assert lines["f4"] == "  - f4 (1 chunks, deleted unknown)" and lines["f1"].endswith("deleted 2024-02-01)")
    kept, _ = lifecycle.purge(df)
    assert {r.chunk_id for r in kept.collect()} == {"6", "7"}
    kept, report = lifecycle.purge(df, cutoff, dry_run=True)
    assert kept.count() == 7 and report.count() == 4


def test_incremental_index_revives(spark, index):
    files = snapshot(spark, [file("a.go", "a\n" * 900), file("b.go", "B!"), file("d.go", "d")])
    rows = [("r", "b.go", "modified", None), ("r", "c.go", "deleted", None), ("r", "a.go", "modified", None), ("r", "d.go", "added", None)]
    found = spark.createDataFrame(rows, "repo_id string, file_path string, change string, new_path string")
    after = incremental_index(found, files, index, NOW, "abc1234")
    by = lambda s: {(r.file_path, r.content) for r in after.filter(F.col("status") == s).collect()}
    assert by("deleted") == {("b.go", "b"), ("c.go", "c")}
    active = by("active")
    assert ("b.go", "B!") in active and ("d.go", "d") in active
    assert after.filter("file_path = 'a.go' and status = 'active'").count() == index.filter("file_path = 'a.go'").count()
    again = incremental_index(found, files, after, NOW, "abc1234")
    assert sorted(r.chunk_id for r in again.collect()) == sorted(r.chunk_id for r in after.collect())


def test_renames(spark):
    df = spark.createDataFrame([("r", "a.go", "renamed", "b.go"), ("r", "c.go", "added", None)], "repo_id string, file_path string, change string, new_path string")
    split = {(r.file_path, r.change) for r in changes.expand_renames(df).collect()}
    assert split == {("a.go", "deleted"), ("b.go", "added"), ("c.go", "added")}
    assert changes.expand_renames(df, "ignore").count() == 1


def test_stats(spark):
    rows = [("r", "deleted")] + [("r", "active")] * 4 + [("r", None)] * 3 + [("s", "active")]
    stats = {r.repo_id: r for r in reports.collection_stats(spark.createDataFrame(rows, "repo_id string, status string")).collect()}
    assert (stats["r"].active_chunks, stats["r"].deleted_chunks, stats["r"].overhead_percent) == (7, 1, 12.5)
    assert stats["s"].overhead_percent == 0.0 and not stats["r"].cleanup_advised


def test_scan_repo(spark, tmp_path):
    tree = {
        "pkg/__init__.py": b"", "src/__init__.py": b"x = 1\n", "src/main.go": "café\n".encode(), "src/bad.py": b"\xff\xfe\n",
        "node_modules/a.js": b"1", ".hidden/a.py": b"1", "README.md": b"#", "_private.ts": b"a\nb\nc",
    }
    for name, data in tree.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    rows = {r.file_path: r for r in scan_repo(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/__init__.py", "src/main.go", "src/bad.py", "_private.ts"}
    assert (rows["_private.ts"].lines, rows["_private.ts"].language) == (3, "typescript")
    assert rows["src/main.go"].content == "café\n" and rows["src/main.go"].size == 6
    assert "�" in rows["src/bad.py"].content
    assert abs(rows["src/main.go"].mtime.timestamp() - os.stat(tmp_path / "src/main.go").st_mtime) < 1


def test_expired_days_leave_storage(spark, tmp_path):
    path = tmp_path / "audit"
    rows = [(dt.datetime(2024, 1, day, 3), f"line {day}") for day in (1, 2, 9, 10)]
    tables.write_audit(spark.createDataFrame(rows, "ts timestamp, line string"), str(path))
    kept = {f: f.stat().st_mtime_ns for f in path.glob("day=*/*.gz") if f.parent.name >= "day=2024-01-09"}
    assert tables.expire(spark, str(path), dt.datetime(2024, 1, 10, 23), days=1) == ["2024-01-01", "2024-01-02"]
    assert {f: f.stat().st_mtime_ns for f in path.glob("day=*/*.gz")} == kept
    assert {r.line for r in tables.read_audit_lines(spark, str(path)).collect()} == {"line 9", "line 10"}
    assert tables.expire(spark, str(path), dt.datetime(2024, 1, 10), days=1) == []


def test_trees_are_listed_by_levels(spark, tmp_path, monkeypatch):
    """A deep branch and a wide folder are found whole; what cannot be read is reported; the driver lists nothing."""
    deep = tmp_path / "/".join(f"d{i}" for i in range(9))
    deep.mkdir(parents=True)
    (deep / "end.go").write_text("package end\n")
    for i in range(700):
        (tmp_path / f"wide{i}.py").write_text(f"x = {i}\n")
    (tmp_path / "d0" / "loop").symlink_to(tmp_path, target_is_directory=True)
    monkeypatch.setattr(os, "scandir", lambda *_: pytest.fail("listed on the driver"))
    roots = [("r", "p", str(tmp_path)), ("q", "p", str(tmp_path / "missing")), ("s", "p", f"file://{tmp_path}/d0")]
    rows = scan_trees(spark, roots).select("repo_id", "file_path", "size", "error").collect()
    good = {(r.repo_id, r.file_path) for r in rows if r.error is None}
    assert good == {("r", f"wide{i}.py") for i in range(700)} | {("r", "/".join(f"d{i}" for i in range(9)) + "/end.go"), ("s", "/".join(f"d{i}" for i in range(1, 9)) + "/end.go")}
    (bad,) = [r for r in rows if r.error]
    assert bad.repo_id == "q" and "FileNotFoundError" in bad.error and bad.size is None


def test_unreadable_file_is_reported(spark, tmp_path):
    (tmp_path / "a.py").write_text("a")
    (tmp_path / "b.py").write_text("b")
    listed = trees.list_trees(spark, [("r", "p", str(tmp_path))], (".py",), frozenset())
    (tmp_path / "b.py").unlink()
    rows = {r.file_path: r for r in trees.read_files(listed).collect()}
    assert rows["a.py"].error is None and bytes(rows["a.py"].raw) == b"a"
    assert rows["b.py"].raw is None and "FileNotFoundError" in rows["b.py"].error


def test_chunk_table_replaces_only_its_collections(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = conform(spark.createDataFrame([("1", "a", "x"), ("2", "b", "x")], "chunk_id string, repo_id string, file_path string"), CHUNKS)
    tables.write_chunks(rows, path)
    tables.write_chunks(rows.filter("repo_id = 'a'").withColumn("chunk_id", F.lit("3")), path)
    assert {(r.chunk_id, r.repo_id) for r in tables.read_chunks(spark, path).collect()} == {("3", "a"), ("2", "b")}
    assert tables.read_chunks(spark, path, ["b"], ["chunk_id"]).collect()[0].chunk_id == "2"


def test_page_reads_few_rows(spark, tmp_path, monkeypatch):
    """The rows of a few ids are read from few row groups, not from all texts of their collection."""
    monkeypatch.setattr(tables, "ROW_GROUP_BYTES", 64 << 10)
    ids = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("chunk_id"), F.lit("r").alias("repo_id"), F.lit("f").alias("file_path"))
    texts = F.concat(*[F.sha2(F.concat("chunk_id", F.lit(i)), 256) for i in "abc"])
    path = str(tmp_path / "t")
    tables.write_chunks(conform(ids.withColumn("content", texts), CHUNKS), path)
    wanted = [r.chunk_id for r in ids.filter("hash(chunk_id) % 5000 = 0").collect()][:3]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        page = tables.read_chunks(spark, path, ["r"]).filter(F.col("chunk_id").isin(wanted)).select("chunk_id", "content")
        assert {r.chunk_id for r in page.collect()} == set(wanted)
        (scan,) = [n for n in [page._jdf.queryExecution().executedPlan().collectLeaves().apply(0)]]
        read = scan.metrics().get("numOutputRows").get().value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < read < 2_000


def test_audit_round_trip(spark):
    rows = [(dt.datetime(2024, 1, 2, 3, 4, 5), "QUERY", "r", 'say "hi" now', None, 3)]
    df = spark.createDataFrame(rows, "ts timestamp, op string, collection string, query string, user string, results int")
    line = audit.format_audit(df, ["collection", "query", "results", "user"]).select("line")
    assert line.first()[0] == '[2024-01-02 03:04:05] [QUERY] collection=r query="say "hi" now" results=3'
    row = audit.parse_audit(line).first()
    assert row.kv == {"collection": "r", "query": 'say "hi" now', "results": "3"} and row.op == "QUERY"
    bad = spark.createDataFrame([("nonsense",), ("[2024-13-02 03:04:05] [QUERY] a=b",), ("[2024-01-02 03:04:05] [INDEX] k=1 k=2",)], ["line"])
    ok, rejected = audit.split_valid(audit.parse_audit(bad))
    assert rejected.count() == 2 and ok.first().kv == {"k": "1"}


def attempts(spark, times):
    rows = [("ip", T0 + dt.timedelta(seconds=t), i) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "ip string, ts timestamp, event_id bigint")


def test_failure_counts_and_alert(spark):
    times = [0, 0, 1, 30, 59, 60, 61, 90, 119.5, 120, 500]
    got = {r.event_id: r.failures for r in ratelimit.failure_counts(attempts(spark, times)).collect()}
    assert got == {i: sum(1 for u in times if t - 60 < u <= t) for i, t in enumerate(times)}
    alert = ratelimit.first_alert(attempts(spark, range(20))).first()
    assert (alert.alert_at, alert.failures) == (T0 + dt.timedelta(seconds=9), 10)
    assert ratelimit.first_alert(attempts(spark, range(0, 600, 60))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=120), st.integers(1, 6))
def test_gate_state(moments, limit):
    import numpy as np

    moments = sorted(moments)
    gate = ratelimit.GateState(limit, 60)
    half = len(moments) // 2
    none = np.zeros(len(moments), dtype=bool)
    parts = [gate.admit(np.array(moments[a:b], dtype=np.int64), none[a:b]) for a, b in ((0, half), (half, len(moments)))]
    assert np.concatenate(parts).tolist() == plain.admitted(moments, limit, 60)


def test_gate_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        times = sorted((i * 37 % 400) + i / 100 for i in range(120))
        got = {r.event_id: r.admitted for r in ratelimit.rate_gate(attempts(spark, times)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i] for i in range(len(times))] == plain.admitted([round(t * 1e6) for t in times], 5, 60_000_000)


def test_a_change_batch_reads_only_its_collections(spark, tmp_path):
    from seekspan.schemas import CHUNKS, conform
    from seekspan.sources.tables import read_chunks, write_chunks

    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "repo_id string, chunk_id string")
    write_chunks(conform(rows, CHUNKS), str(tmp_path / "t"))
    plan = read_chunks(spark, str(tmp_path / "t"), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(repo_id" in plan or "repo_id#" in plan.split("PartitionFilters: [")[1].split("]")[0]
