"""Collocations against plain counting, and the index of a shard against its definition."""

import random

import numpy as np
import pyarrow as pa
import pytest
import restated
from hypothesis import given, settings
from hypothesis import strategies as st

from seekspan.llm import phrases

SCHEMA = "text string, lang string, doc_id long, a long, n long, k1 string, word string"


def texts(n=160):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None, "und"])
        words = rng.choices("x y z the The of état 日本 w w".split(" "), k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "!\n", ", "]) for w in words)
        rows.append((text, lang, i, 1, 2, "c", "d"))
    rows += [(None, "en", None, 1, 2, "c", "d"), ("", None, 1, 1, 2, "c", "d"), (" \t ..\n", "de", 2, 1, 2, "c", "d"), rows[0]]
    rows += [("x " * 3000, "en", 5, 1, 2, "c", "d"), ("one two. " * 700, "de", 6, 1, 2, "c", "d")]
    return rows


@pytest.mark.parametrize("words, bits, longest, top", [(600_000, 28, 5, 2000), (50, 28, 5, 7), (300, 10, 4, 40), (10**6, 28, 2, 5)])
def test_collocations(spark, words, bits, longest, top):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = phrases.phrases(docs, least=4, longest=longest, top=top, shard_words=words, filter_bits=bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = restated.collocations([(r[1], r[0]) for r in rows], 4, longest, top)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert len(expected) > 10


def test_products_beyond_64_bits(spark):
    """Counts whose products only fit 128 bits are divided exactly."""
    from pyspark.sql import functions as F

    a, n, left, right = 3 * 10**12 + 7, 10**14 + 3, 4 * 10**12 + 1, 3 * 10**12 + 9
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(n).alias("n"), F.array(F.lit(left), F.lit(a)).alias("heads"), F.array(F.lit(a), F.lit(right)).alias("tails"))
    cut = row.select(phrases._least_cut(2).alias("c")).first().c
    assert (cut.score, cut.k, cut.l, cut.r) == (1000 * a * n // (left * right), 1, left, right)


def test_empty_table(spark):
    assert phrases.phrases(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.phrases(spark.createDataFrame([(None, None, 1, 1, 1, "", "")], SCHEMA)).count() == 0


def test_shared_keys_take_another_seed(spark, monkeypatch):
    seen = []
    real = phrases.shards

    def clumsy(docs, text_col, lang_col, seed, size):
        seen.append(seed)
        packed = real(docs, text_col, lang_col, seed, size)
        return packed if seed else packed.selectExpr("lang", "words", "transform(keys, k -> 5L) AS keys", "counts", "text")

    monkeypatch.setattr(phrases, "shards", clumsy)
    rows = texts(60)
    found = phrases.phrases(spark.createDataFrame(rows, SCHEMA), least=4, longest=3)
    assert seen == [0, 1]
    assert sorted(map(tuple, found.collect())) == sorted(restated.collocations([(r[1], r[0]) for r in rows], 4, 3, 2000))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.sampled_from([0, 1]), min_size=1, max_size=4))
def test_index(letters, sides):
    """Intervals of all phrases, grown on either side, have the sizes that counting gives."""
    text = np.array([0, *letters, 0], np.int32)
    keys = np.array([11, 22, 33], np.int64)
    order = phrases.suffix_order(text)
    marked = [(-1, i) if c == 0 else (c, 0) for i, c in enumerate(text.tolist())]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: marked[i:] + marked[:i])
    index = phrases.Index(keys, phrases.transform(text), phrases.transform(text[::-1]))
    found = index.words()
    found = found.take(found.size > 0)
    for n, side in enumerate(sides, 2):
        found = index.extend(found, side)
        counts = {}
        for i in range(len(text) - n + 1):
            phrase = tuple(text[i : i + n].tolist())
            if 0 not in phrase:
                counts[phrase] = counts.get(phrase, 0) + 1
        assert dict(zip(map(tuple, found.letters.tolist()), found.size.tolist())) == counts


def test_filter_forgets_nothing(spark):
    rng = np.random.default_rng(1)
    draw = lambda n: phrases.hashed(*(rng.integers(-(2**63), 2**63 - 1, n) for _ in range(2)))
    mine, other = draw(3000), draw(20000)
    frequent = spark.createDataFrame([(int(h),) for h in mine], "h long")
    known = phrases.build_filter(frequent, 28)
    assert known.has(mine).all() and known.has(other).mean() < 0.01
    assert phrases.build_filter(frequent, 10).bits == 10


def test_packed_counts():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**phrases.HASH_BITS, 5000).astype(np.uint64)
    words, counts = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(1, 10**12, 5000)
    batch = phrases._blocks(hashes, [words, counts], 4)
    assert batch.num_rows == 16 and set(batch.column("length").to_pylist()) == {1}
    got = []
    for n, raw in zip(batch.column("n").to_pylist(), batch.column("counts").to_pylist()):
        got += list(zip(*(c.tolist() for c in phrases._unpacked(raw, n, 3))))
    assert sorted(got) == sorted(zip(hashes.astype(np.int64).tolist(), words.tolist(), counts.tolist()))


def test_rows_of_shards_are_small(spark):
    """Rows of shards and of their indexes pass through the JVM, where objects of several MB fragment the heap."""
    text = " ".join(f"w{i * i % 97}" for i in range(20_000)) + ", "
    docs = spark.createDataFrame([(text * 5, "en")], "text string, lang string")
    packed = phrases.shards(docs, "text", "lang", 0, 100_000).cache()
    every = phrases.Filter(10, np.full(16, -1, np.int64).view(np.uint64))
    rows = packed.select("text").collect() + phrases.index_shards(packed, lambda: every).select("forward", "backward").collect()
    assert len(rows) == 2 and all(0 < len(value) < 100_000 for row in rows for value in row)


def test_squeezed_numbers_come_back():
    for numbers in (np.zeros(0, np.int32), np.arange(70_000, dtype=np.int32), np.array([-1, 2**31 - 1, 0], np.int32)):
        assert np.array_equal(phrases.unsqueezed(pa.scalar(phrases.squeezed(numbers), pa.binary())), numbers)
