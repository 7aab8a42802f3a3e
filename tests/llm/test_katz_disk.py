"""The language model: what its scratch tables hold at a time, and how it sorts and packs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspan.llm import common, katz


def size(root):
    return sum(os.path.getsize(os.path.join(base, f)) for base, _, files in os.walk(root) for f in files)


def test_scratch_tables_are_deleted_when_read(spark, tmp_path, monkeypatch):
    """Tables of earlier steps do not stay beside later ones; at the end there are the scores alone."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.2, 800) % 20_000)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    live, write = [], common.write_scratch

    def watched(df, name, *partition_by):
        path = write(df, name, *partition_by)
        live.append(size(tmp_path))
        return path

    monkeypatch.setattr(common, "write_scratch", watched)
    monkeypatch.setattr(katz, "write_scratch", watched)
    monkeypatch.setattr(common, "scratch_dir", lambda _, name: f"{tmp_path}/{name}-{len(os.listdir(tmp_path))}{len(live)}")
    assert katz.train_and_score(docs, F.col("doc_id") % 5 != 1, order=3).count() == len(rows)
    names = {name.rsplit("-", 1)[0] for name in os.listdir(tmp_path)}
    assert names == {"katz-scores"}
    assert max(live) < 2.5 * sum(len(t) for _, t in rows), max(live) / sum(len(t) for _, t in rows)


@pytest.mark.parametrize("top", [5, 1 << 40, (1 << 64) - 1])
def test_sorting(top):
    keys = np.random.default_rng(1).integers(0, top, 3000, np.uint64, endpoint=True)
    keys = np.concatenate([keys, keys[:500]])
    assert (katz.sorting(keys) == np.argsort(keys, kind="stable")).all()
    rank, at = katz.ranks(keys)
    assert (rank == np.unique(keys, return_inverse=True)[1]).all() and (keys[at] == np.unique(keys)).all()
    other = np.random.default_rng(2).integers(0, top, len(keys), np.uint64, endpoint=True)
    expected = np.unique(np.stack([keys, other], axis=1), axis=0, return_inverse=True)[1].ravel()
    assert (katz.ranks(katz.fold([keys >> np.uint64(1), other >> np.uint64(1)]))[0] ==
            np.unique(np.stack([keys >> np.uint64(1), other >> np.uint64(1)], axis=1), axis=0, return_inverse=True)[1].ravel()).all()
    order = katz.by_word_and_context(keys, other)
    assert (np.diff(expected[order]) != 0).sum() == len(set(expected)) - 1  # equal pairs together
    assert (np.diff(keys[order].astype(object)) != 0).sum() == len(set(keys.tolist())) - 1


def test_cut_keys_that_are_alike_fall_back():
    """Contexts that differ only in the bits that the short key drops do not interleave."""
    word = np.repeat(np.arange(40, dtype=np.uint64), 6)
    context = np.tile(np.array([1, 2, 1, 2, 3, 1], np.uint64), 40)
    order = katz.by_word_and_context(word, context)
    pairs = list(zip(word[order], context[order]))
    assert sum(a != b for a, b in zip(pairs, pairs[1:])) == len(set(pairs)) - 1


@pytest.mark.parametrize("values", [[], [0], [255, 256, 0], [1 << 63, 7], list(range(70_000))])
def test_thin(values):
    values = np.array(values, np.uint64)
    assert (katz.from_thin(katz.thin(values)) == values).all()
    assert katz.unpacked(katz.packed(values.tobytes())) == values.tobytes()


def test_odd_tables(spark, nothing):
    """No rows, no training rows, and rows without words, with histories of two words."""
    assert katz.train_and_score(nothing, F.lit(True), order=3).count() == 0
    frame = spark.createDataFrame([(None, "a b c"), (1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    untrained = katz.train_and_score(frame, F.lit(False), order=3).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.score) for r in untrained) == [(1, 0, 0, 0.0), (1, 0, 0, 0.0), (3, 0, 0, 0.0), (4, 0, 0, 0.0)]
    trained = katz.train_and_score(frame, F.col("doc_id").isNull(), order=3).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in trained} == {(None, 4, 4, 4), (1, 3, 3, 4), (2, 1, 1, 4), (3, 1, 1, 4)}
    assert all(r.score < 0 for r in trained)
