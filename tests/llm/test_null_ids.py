"""Rows without a doc_id, repeated rows, clashing columns, long texts and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seekspan.llm import exact_dedup, katz, near_dedup

WORDS = "the of and thing water house under night would about people little where great never again".split()


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choices(WORDS, k=n)) + "."


def test_near_groups(spark):
    same, alone = prose(1), prose(2)
    rows = [(None, same), (1, same), (2, same), (3, same), (None, alone), (None, alone), (None, ""), (None, None), (4, ""), (5, prose(1, 59) + " x y.")]
    found = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()
    got = sorted(map(str, map(tuple, found)))
    expected = [(None, 1, False), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (None, None, True), (None, None, True), (None, None, True), (4, 4, True), (5, 1, False)]
    assert got == sorted(map(str, expected))


def test_exact(spark):
    rows = [(None, "a  b"), (None, "a b"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    names = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")}
    before = names()
    found = sorted((r.group_size, r.keep_id, r.doc_id, r.kept) for r in exact_dedup.dedupe(frame).collect())
    assert found == [(1, None, None, True), (2, None, None, True), (2, None, None, True)]
    mixed = frame.unionByName(spark.createDataFrame([(7, "a b"), (9, "a b")], "doc_id long, text string"))
    found = sorted((r.group_size, r.keep_id or 0, r.doc_id or 0, r.kept) for r in exact_dedup.dedupe(mixed).collect())
    assert found == [(1, 0, 0, True), (4, 7, 0, False), (4, 7, 0, False), (4, 7, 7, True), (4, 7, 9, False)]
    assert names() == before


def test_katz(spark):
    frame = spark.createDataFrame([(None, "a b c"), (-1, "a b"), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in katz.train_and_score(frame, F.lit(True)).collect()} == {None, -1, 3}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _key int, component_id int, n_dropped int, kept string"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "r", 1, 2, 3, "k") for k, t in rows], SCHEMA)


def test_near_duplicate_stage(spark):
    """One row of each group stays, with its own columns; rows without words stay, whatever their id."""
    same, alone, long = prose(1), prose(2), prose(3, 30_000)
    rows = [(None, same), (1, same), (1, same), (2, same), (None, alone), (None, alone), (None, ""), (None, ""), (None, None), (8, long), (8, long), (9, long)]
    docs = table(spark, rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = kept.collect()
    expected = [(1, same), (8, long), (None, alone), (None, ""), (None, ""), (None, None)]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted((k is None, k or 0, t or "") for k, t in expected)
    assert {(r._row, r._key, r.component_id, r.n_dropped, r.kept) for r in got} == {("r", 1, 2, 3, "k")}


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, stage):
    """Empty tables give none; clashing columns and long texts pass through."""
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, table(spark, []), "").count() == 0
    rows = [(k, prose(k)) for k in range(8)] + [(None, prose(40)), (20, prose(50, 30_000)), (21, "word " * 20_000), (22, "1" * 40_000)]
    docs = table(spark, rows)
    out = run(spark, docs, "")
    if stage != "packing":
        assert out.columns == docs.columns
        assert {(r._row, r._key, r.component_id, r.n_dropped, r.kept) for r in out.collect()} == {("r", 1, 2, 3, "k")}
    assert {20} <= {r.doc_id for r in out.select("doc_id").collect()}
