import datetime as dt

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekspan.operators.chunking import hybrid_chunks, pack_lines, symbol_chunks, window_chunks
from seekspan.operators.lifecycle import upsert
from seekspan.operators.tokens import count_tokens, fit_tokens, pattern_counter, resplit
from seekspan.plans.indexing import build_chunks
from seekspan.schemas import CHUNKS, conform
from seekspan.sources.symbols import DUMPS, flatten_symbols

TEXTS = [
    "",
    "short",
    "x" * 1200,
    "x" * 1201,
    "line\n" * 700,
    "é🙂\n" * 900,
    "a" * 999 + "\n" + "b" * 2500 + "\n\n\n",
    "汉" * 5000,
]


def files(spark, texts, ext=".go"):
    rows = [("r", "p", f"f{i}{ext}", "go", len(t), t.count("\n") + 1, None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows,
        "repo_id string, project_name string, file_path string, language string, size bigint, lines int,"
        " mtime timestamp, content string",
    )


@pytest.mark.parametrize(("target", "overlap"), [(300, 50), (300, 200), (10, 0)])
def test_windows(spark, target, overlap):
    got = {}
    for r in window_chunks(files(spark, TEXTS), target, overlap).orderBy("file_path", "chunk_index").collect():
        got.setdefault(r.file_path, []).append((r.content, r.start_line, r.end_line))
    for i, t in enumerate(TEXTS):
        assert got.get(f"f{i}.go", []) == plain.windows(t, target * 4, overlap * 4)


def test_byte_windows(spark):
    got = {}
    for r in window_chunks(files(spark, TEXTS), unit="byte").orderBy("file_path", "chunk_index").collect():
        got.setdefault(r.file_path, []).append((bytes(r.raw), r.start_line, r.end_line))
        assert r.content == bytes(r.raw).decode("utf-8", "replace") or "�" in r.content
    for i, t in enumerate(TEXTS):
        assert got.get(f"f{i}.go", []) == plain.windows(t.encode())


def test_windows_cover_the_file(spark):
    for r in window_chunks(files(spark, TEXTS)).groupBy("file_path").agg(
        F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("c")
    ).collect():
        whole = "".join(c.content[:1000] for c in r.c[:-1]) + r.c[-1].content
        assert whole == TEXTS[int(r.file_path[1:-3])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=80), st.integers(10, 120))
def test_line_packing(lengths, target):
    lines = ["x" * n for n in lengths]
    assert pack_lines(np.array(lengths), target) == plain.split_lines(lines, target)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab_ .\né", max_size=1500), st.integers(60, 200))
def test_resplit_fits_and_covers(content, limit):
    total = pattern_counter([content])[0]
    parts = resplit(content, total, limit, pattern_counter)
    assert all(p["tokens"] <= limit for p in parts)
    assert all(p["content"] in content for p in parts)
    if total <= limit:
        assert [p["content"] for p in parts] == [content]
    elif content:
        assert content.startswith(parts[0]["content"]) and content.endswith(parts[-1]["content"])


def test_fit_tokens_plugin_matches_builtin(spark):
    chunks = window_chunks(files(spark, TEXTS))
    builtin = fit_tokens(chunks, 150)
    plugin = fit_tokens(chunks, 150, pattern_counter)
    cached = fit_tokens(chunks, 150, pattern_counter, cached=True)
    columns = ["file_path", "chunk_index", "fit_index", "start_line", "end_line", "chunk_tokens", "content"]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert rows(builtin) == rows(plugin) == rows(cached)
    assert max(r[5] for r in rows(builtin)) <= 150


def test_fit_tokens_bytes(spark):
    fitted = fit_tokens(window_chunks(files(spark, TEXTS), unit="byte"), 150).collect()
    assert all(r.chunk_tokens <= 150 for r in fitted)
    assert any(len(bytes(r.raw)) < 1200 for r in fitted)


SYMBOLS = [
    {
        "name": "Big", "kind": 5, "start": 0, "end": 39,
        "children": [{"name": "m", "kind": 6, "start": 1, "end": 3}],
    },
    {
        "name": "Small", "kind": 5, "start": 40, "end": 49,
        "children": [
            {"name": "ok", "kind": 6, "start": 41, "end": 43, "children": [{"name": "deep", "kind": 12, "start": 42, "end": 42}]},
            {"name": "field", "kind": 8, "start": 44, "end": 44, "children": [{"name": "lambda", "kind": 12, "start": 44, "end": 44}]},
        ],
    },
    {"name": "beyond", "kind": 99, "start": 48, "end": 90},
]


def node(s):
    point = lambda n: {"line": n, "character": 0}
    return {
        "name": s["name"],
        "kind": s["kind"],
        "range": {"start": point(s["start"]), "end": point(s["end"])},
        "children": [node(c) for c in s.get("children", [])],
    }


def dumps(spark, path="f0.go"):
    import json

    doc = {"repo_id": "r", "file_path": path, "symbols": [node(s) for s in SYMBOLS]}
    lines = spark.createDataFrame([(json.dumps(doc),)], ["v"])
    return lines.select(F.from_json("v", DUMPS).alias("d")).select("d.*")


def test_symbol_rows(spark):
    rows = {r.name: r for r in flatten_symbols(dumps(spark)).collect()}
    assert len(rows) == 8
    assert (rows["deep"].depth, rows["deep"].parent_name, rows["deep"].start_line) == (2, "ok", 43)
    assert rows["deep"].ancestor_ids == [rows["Small"].symbol_id, rows["ok"].symbol_id]
    assert rows["beyond"].kind == "unknown"


def test_symbol_chunks(spark):
    lines = [f"{i:02d} " + "w" * 97 for i in range(50)]
    rows = symbol_chunks(files(spark, ["\n".join(lines)]), flatten_symbols(dumps(spark))).collect()
    got = {(r.symbol_name, r.start_line, r.end_line) for r in rows}
    runs = plain.split_lines(lines[:40], 1200)
    expected = {(f"Big (part {i + 1})", a + 1, b) for i, (a, b) in enumerate(runs)}
    # the member of the split class and the field go; functions below a field stay
    expected |= {("Small", 41, 50), ("ok", 42, 44), ("deep", 43, 43), ("lambda", 45, 45), ("beyond", 49, 91)}
    assert got == expected
    text = {r.symbol_name: r.content for r in rows}
    assert text["Small"] == "\n".join(lines[40:50])
    assert text["beyond"] == "\n".join(lines[48:])
    assert text["Big (part 1)"] == "\n".join(lines[runs[0][0] : runs[0][1]])


def test_hybrid_reasons(spark):
    f = files(spark, ["a\nb", "c"]).unionByName(files(spark, ["d"], ".md"))
    symbols = flatten_symbols(dumps(spark))
    got = {(r.file_path, r.method, r.fallback_reason) for r in hybrid_chunks(f, symbols.filter("name = 'beyond'")).collect()}
    assert got == {("f0.go", "symbol", None), ("f1.go", "window", "no_symbols"), ("f0.md", "window", "no_parser")}


def test_build_is_stable_and_unique(spark):
    f = files(spark, TEXTS + ["same line " * 900])
    now = F.lit("2024-01-01").cast("timestamp")
    first = build_chunks(f, now)
    ids = sorted(r.chunk_id for r in first.collect())
    assert len(ids) == len(set(ids))
    assert ids == sorted(r.chunk_id for r in build_chunks(f.repartition(3), now).collect())
    assert first.filter("chunk_tokens > 300").count() == 0


def test_count_tokens_plugin_is_batched(spark):
    df = files(spark, ["a b", "c"])
    counted = count_tokens(df, lambda texts: [len(t) for t in texts]).orderBy("file_path").collect()
    assert [r.tokens for r in counted] == [3, 1]


def test_text_is_cut_once(spark):
    """The cut stands once in the optimized plan, however often its pieces are referred to."""
    some = files(spark, TEXTS)
    now = dt.datetime(2024, 3, 10)
    for cut in (window_chunks(some), build_chunks(some, now)):
        plan = cut._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1, plan
    plan = window_chunks(some, unit="byte")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(0") <= 3, plan  # the cuts, and the two references of the running line numbers
    stored = conform(build_chunks(some, now), CHUNKS)
    plan = upsert(stored, stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3, plan  # one for each of the three references to the computed table
