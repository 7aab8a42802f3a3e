"""Katz backoff language model: Good-Turing discounted n-gram counts, evaluated recursively, with exactly normalised backoff weights.

Words are known by 64-bit keys. A bigram model is two tables, both partitioned by bucket of a key: `pairs` holds the counts of
(context, word), bucketed by word, and `words` holds for every word its count, its denominator as a context and its
backoff weight. Texts are cut into blocks; a block asks each bucket once for what its distinct words and pairs need, and
then evaluates all its tokens. So what is shuffled are distinct keys of blocks, not tokens, and no table is held whole
anywhere. Very frequent words are spread over all buckets by their contexts.

Each further word of history is one more step of the recursion (`climb`). A block knows the probability of each of its tokens
by the shorter history, and so how often each of its histories was seen; it asks the buckets of histories for its distinct n-grams
whose histories were seen, and is answered with their counts and, where some were never seen, with what their histories leave to
unseen words. Words have numbers there, small ones if they are frequent. Buckets and blocks are dealt with in rounds, so that
only a part of them is shuffled at a time, and a table is deleted as soon as no later step reads it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspan.llm.common import buckets, discard, mix64, stored, text_slices, words, write_scratch

# counts up to this one are discounted
DISCOUNTED = 5
BLOCK_BYTES = 12 << 20
# no word contains a line break, so these are the keys of no word
KEY_BYTES = 8
# words of an n-gram of the registered query; buckets of histories for each bucket of words; in how many rounds buckets are asked, and
# in how many blocks are evaluated
ORDER, SPLIT, ROUNDS, BLOCK_ROUNDS = 3, 2, 2, 2


def key_of(word: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & ((1 << 8 * KEY_BYTES) - 1)


END, START = key_of(b"\nend"), key_of(b"\nstart")


# arrays in binary columns

def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, first all low bytes and so on, which compresses well as most are small."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def read_keys(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return wide.view("<u8").ravel()


def thin(values: np.ndarray) -> bytes:
    """Unsigned integers in as many planes as the largest needs, compressed."""
    width = max((int(values.max()).bit_length() + 7) // 8, 1) if len(values) else 1
    return bytes([width]) + packed(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def from_thin(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(unpacked(raw[1:]), np.uint8).reshape(raw[0], -1)
    wide = np.zeros((flat.shape[1], 8), np.uint8)
    wide[:, : raw[0]] = flat.T
    return wide.view("<u8").ravel()


def packed(raw: bytes) -> bytes:
    """Blocks pass through the JVM as a few rows, whose arrays would be objects of many MB as they are."""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(raw: bytes) -> bytes:
    n = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], n, "zstd", asbytes=True) if n else b""


# sorting and grouping

def sorting(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned integers; where key and place fit into 64 bits they are sorted as one number."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()) >> (64 - bits) == 0:
        both = (keys.astype(np.uint64) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64)
        both.sort()
        return (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.argsort(keys, kind="stable")


def starts(ordered: np.ndarray) -> np.ndarray:
    """Flags of the places where a run of equal values begins."""
    return np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key among the distinct ones, and a place of each distinct key."""
    order = sorting(keys)
    new = starts(keys[order])
    rank = np.empty(len(keys), np.int64 if len(keys) >> 31 else np.int32)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row of some unsigned columns, equal for equal rows and in the order of the rows."""
    key = columns[0].astype(np.uint64)
    for column in columns[1:]:
        if not len(key):
            break
        if (int(key.max()) + 1) * (int(column.max()) + 1) >= 1 << 63:
            key, column = ranks(key)[0].astype(np.uint64), ranks(column)[0]
        key = key * np.uint64(int(column.max()) + 1) + column.astype(np.uint64)
    return key


def runs(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(flags)


# blocks of tokens

# stands for a null id while ids are packed
NO_ID = -(1 << 63)
BLOCKS = "block long, doc_ids binary, train binary, sizes binary, keys binary, codes binary, hot array<struct<key: long, n: long>>, n_train long"


def before(values: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The value of the token before each one of some documents, `start` at their beginnings."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[np.cumsum(sizes) - sizes] = start
    return out


@dataclass
class Block:
    """Tokens of some documents, each closed by the end token, as places in the sorted keys of the block."""

    doc_ids: np.ndarray
    train: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    codes: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        return cls(
            np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["train"], bool), np.frombuffer(row["sizes"], np.int32),
            read_keys(row["keys"]), from_planes(unpacked(row["codes"])),
        )

    def contexts(self) -> np.ndarray:
        """The code before each token; the start code at the beginning of a document."""
        return before(self.codes, self.sizes, int(np.flatnonzero(self.keys == np.uint64(START))[0]))

    def pairs(self, count: int, hot: np.ndarray, low: int = 0, high: int | None = None) -> Pairs:
        """Distinct (word, context) of the buckets from `low` to `high` by bucket, and within a bucket by word."""
        width, context = len(self.keys), self.contexts()
        mine = None
        if high is not None and (low, high) != (0, count):
            bucket = (self.keys % np.uint64(count))[self.codes]
            if len(hot):
                spread = np.flatnonzero(np.isin(self.keys, hot)[self.codes])
                bucket[spread] = (self.keys[self.codes[spread]] + self.keys[context[spread]]) % np.uint64(count)
            mine = np.flatnonzero((bucket >= low) & (bucket < high))
        codes, context = (self.codes, context) if mine is None else (self.codes[mine], context[mine])
        place, at = ranks(codes.astype(np.uint64) * np.uint64(width) + context.astype(np.uint64))
        word, context = self.keys[codes[at]], self.keys[context[at]]
        bucket = word % np.uint64(count)
        if len(hot):
            spread = np.isin(word, hot)
            bucket[spread] = (word[spread] + context[spread]) % np.uint64(count)
        order = sorting(bucket)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return Pairs(word[order], context[order], np.searchsorted(bucket[order], np.arange(count + 1, dtype=np.uint64)), back[place], mine)


@dataclass
class Pairs:
    words: np.ndarray
    contexts: np.ndarray
    ends: np.ndarray  # where each bucket starts
    of_token: np.ndarray  # the pair of each token
    tokens: np.ndarray | None = None  # which tokens, if not all

    def slice(self, bucket: int) -> dict:
        a, b = self.ends[bucket], self.ends[bucket + 1]
        word = self.words[a:b]
        first = runs(np.concatenate([[True], word[1:] != word[:-1]])) if b > a else np.zeros(0, np.int64)
        return {
            "words": pack_keys(word[first]), "numbers": planes(np.diff(np.concatenate([first, [b - a]]))), "contexts": pack_keys(self.contexts[a:b]),
        }


def read_pairs(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(read_keys(row["words"]), from_planes(row["numbers"])), read_keys(row["contexts"])


def blocks(docs: DataFrame) -> DataFrame:
    """Tokens of `docs` (doc_id, text, train) in blocks, stored."""
    return stored(cut(docs), "blocks")


def cut(docs: DataFrame) -> DataFrame:
    count = buckets(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for part in (p for batch in batches for p in text_slices(batch, BLOCK_BYTES)):
            flat, rows = words(part.column("text"))
            coded = flat.dictionary_encode()
            keys = np.array([*map(key_of, coded.dictionary.to_pylist()), END, START], np.uint64)
            order = np.lexsort((keys, keys % np.uint64(count)))
            code = np.empty(len(keys), np.int64)
            code[order] = np.arange(len(keys))
            sizes = np.bincount(rows, minlength=part.num_rows) + 1
            tokens = np.empty(sizes.sum(), np.int64)
            tokens[np.arange(len(rows)) + rows] = code[coded.indices.to_numpy()]
            tokens[np.cumsum(sizes) - 1] = code[-2]
            train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(keys))
            often = np.flatnonzero(counts * 4 * count >= max(counts.sum(), 1))
            yield pa.RecordBatch.from_pylist([{
                "block": number, "doc_ids": part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), "train": train.tobytes(),
                "sizes": sizes.astype(np.int32).tobytes(), "keys": pack_keys(keys[order]), "codes": packed(planes(tokens)),
                "hot": [{"key": int(k), "n": int(n)} for k, n in zip(keys[order][often].view(np.int64), counts[often])], "n_train": int(counts.sum()),
            }], schema=pa.schema([
                ("block", pa.int64()), ("doc_ids", pa.binary()), ("train", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("codes", pa.binary()),
                ("hot", pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))), ("n_train", pa.int64()),
            ]))
            number += 1

    return docs.select("doc_id", "text", "train").mapInArrow(run, BLOCKS)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


# the model

def discounts(frequencies: np.ndarray) -> np.ndarray:
    """Good-Turing discount factors for counts 0 to DISCOUNTED, from the numbers of keys with counts 0 to DISCOUNTED + 1.

    The usual factors need falling frequencies; where some are not between 0 and 1, as in small or odd corpora, the range
    of discounted counts is shortened, and if nothing remains each count gives up a half (absolute discounting)."""
    n = frequencies.astype(float)
    for k in range(DISCOUNTED, 0, -1):
        r = np.arange(1, k + 1)
        if n[1] and (n[r] > 0).all() and (cut := (k + 1) * n[k + 1] / n[1]) < 1:
            factor = ((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut)
            if ((factor > 0) & (factor < 1)).all():
                return np.concatenate([[1.0], factor, np.ones(DISCOUNTED - k)])
    return np.concatenate([[1.0], 1 - 0.5 / np.arange(1, DISCOUNTED + 1)])


def by_word_and_context(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """An order that brings equal words together, and equal pairs within them."""
    place, distinct = ranks(word)
    bits = np.uint64(max(len(distinct).bit_length(), 1))
    short = place.astype(np.uint64) << (np.uint64(64) - bits) | context >> bits
    order = np.argsort(short)
    a, b = order[1:], order[:-1]
    if ((short[a] == short[b]) & (context[a] != context[b])).any():  # cut keys that are alike
        return np.lexsort((context, word))
    return order


@dataclass
class Constants:
    """What is global: token and word numbers, and the discounts of single words and of pairs."""

    tokens: int
    vocabulary: int
    word_discounts: np.ndarray
    pair_discounts: np.ndarray
    kept: float  # discounted mass of the known words

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by their counts; all unknown words together have the mass that discounting freed."""
        small = np.minimum(counts, DISCOUNTED + 1)
        factor = np.append(self.word_discounts, 1.0)[small]
        if not self.tokens:
            return np.ones(len(counts))
        if self.kept >= self.tokens:  # nothing was discounted
            return np.where(counts > 0, counts, 1) / (self.tokens + 1)
        return np.where(counts > 0, factor * counts, self.tokens - self.kept) / self.tokens

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return np.append(self.pair_discounts, 1.0)[np.minimum(counts, DISCOUNTED + 1)] * counts


@dataclass
class KatzModel:
    """A trained model: paths of its tables and its constants."""

    spark: SparkSession
    paths: list[str]
    buckets: int
    hot: np.ndarray
    hot_counts: dict[int, int]
    constants: Constants
    words_path: str = ""

    def table(self, kind: str) -> DataFrame:
        if kind == "words":
            return self.spark.read.schema(WORDS).parquet(self.words_path)
        return read_counted(self.spark, self.paths).filter(F.col("kind") == kind).drop("kind")


def read_counted(spark: SparkSession, paths: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.schema(PAIRS).parquet(p) for p in paths])


PAIRS = "bucket int, block long, words binary, numbers binary, contexts binary, counts binary, totals binary, statistics array<long>, kind string"


def train(tokens: DataFrame, answer: bool = False) -> KatzModel:
    """Count, discount and normalise over the training documents of `tokens` (from `blocks`).

    With `answer`, all pairs of all blocks are sent to be counted, and the counts of each block's pairs are kept with the
    model (`answers`): scoring these blocks needs no second exchange of their pairs."""
    spark, count = tokens.sparkSession, buckets(tokens.sparkSession)
    total = tokens.agg(F.sum("n_train")).first()[0] or 0
    local = tokens.select(F.explode("hot").alias("x")).groupBy("x.key").agg(F.sum("x.n").alias("n"))
    # at most 4 x buckets words
    hot = np.array([r["key"] for r in local.filter(F.col("n") * 4 * count >= total).collect()], np.int64).view(np.uint64)

    def asker(low: int, high: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                block = Block.read(row)
                pairs = block.pairs(count, hot, low, high)
                trained = np.repeat(block.train, block.sizes)
                n = np.bincount(pairs.of_token[trained if pairs.tokens is None else trained[pairs.tokens]], minlength=len(pairs.words))
                seen = (n > 0) | answer
                ends = np.concatenate([[0], np.cumsum(seen)])[pairs.ends]
                own = Pairs(pairs.words[seen], pairs.contexts[seen], ends, pairs.of_token)
                n = n[seen]
                out = [{"bucket": i, "block": row["block"], **own.slice(i), "counts": planes(n[ends[i] : ends[i + 1]])} for i in range(low, high) if ends[i] < ends[i + 1]]
                yield pa.RecordBatch.from_pylist(out, schema=ask_schema)

        return ask

    ask_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("words", "numbers", "contexts", "counts"))])

    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        asked = table.select(["block", "words", "numbers", "contexts", "counts"]).to_pylist()
        parts = [(*read_pairs(r), from_planes(r["counts"])) for r in asked]
        word, context, n = (np.concatenate(x) for x in zip(*parts))
        order = by_word_and_context(word, context)
        word, context, n = word[order], context[order], n[order].astype(np.int64)
        flags = np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])])
        new = runs(flags)
        word, context, n = word[new], context[new], np.add.reduceat(n, new)
        answers = []
        if answer:
            back = np.empty(len(order), np.int64)
            back[order] = n[np.cumsum(flags) - 1]
            cut = np.cumsum([len(p[0]) for p in parts])[:-1]
            answers = [{"bucket": bucket, "block": r["block"], "totals": planes(x), "kind": "answers"} for r, x in zip(asked, np.split(back, cut))]
            counted = n > 0
            word, context, n = word[counted], context[counted], n[counted]
            if not len(n):
                return pa.Table.from_pylist(answers, schema=merged_schema)
        first = runs(np.concatenate([[True], word[1:] != word[:-1]]))
        totals = np.add.reduceat(n, first)
        whole = ~np.isin(word[first], hot)
        shape = [np.bincount(np.minimum(x, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2] for x in (n, totals[whole])]
        statistics = [*shape[0], *shape[1], int(whole.sum()), int(totals[whole].sum())]
        big = pa.table({
            "bucket": pa.array([bucket], pa.int32()), "block": pa.array([None], pa.int64()), "words": [pack_keys(word[first])], "numbers": [planes(np.diff(np.concatenate([first, [len(word)]])))],
            "contexts": [pack_keys(context)], "counts": [planes(n)], "totals": [totals.astype(np.int64).tobytes()],
            "statistics": pa.array([statistics], pa.list_(pa.int64())), "kind": ["pairs"],
        })
        spread = [{"bucket": bucket, "words": pack_keys(w[None]), "totals": t.tobytes(), "kind": "hot"} for w, t in zip(word[first][~whole], totals[~whole])]
        return pa.concat_tables([big.cast(merged_schema), pa.Table.from_pylist(spread + answers, schema=merged_schema)])

    kinds = {"bucket": pa.int32(), "block": pa.int64(), "statistics": pa.list_(pa.int64()), "kind": pa.string()}
    merged_schema = pa.schema([(f.split(" ")[0], kinds.get(f.split(" ")[0], pa.binary())) for f in PAIRS.split(", ")])
    asking = "bucket int, block long, words binary, numbers binary, contexts binary, counts binary"
    tokens = tokens.select("block", "doc_ids", "train", "sizes", "keys", "codes")
    paths = [write_scratch(tokens.mapInArrow(asker(low, high), asking).groupBy("bucket").applyInArrow(merge, PAIRS), "katz-pairs", "kind") for low, high in cuts(count)]
    counted = read_counted(spark, paths)
    width = DISCOUNTED + 2
    sums = [F.sum(F.col("statistics")[i]).alias(str(i)) for i in range(2 * width + 2)]
    statistics = np.array([x or 0 for x in counted.filter("kind = 'pairs'").agg(*sums).first()], np.int64)
    hot_counts: dict[int, int] = {}
    for row in counted.filter("kind = 'hot'").select("words", "totals").collect():  # at most (4 x buckets) x buckets rows
        key = int(read_keys(row["words"])[0])
        hot_counts[key] = hot_counts.get(key, 0) + int(np.frombuffer(row["totals"], np.int64)[0])
    shape = statistics[width : 2 * width].copy()
    for n in hot_counts.values():
        if n <= DISCOUNTED + 1:
            shape[n] += 1
    size, vocabulary = int(statistics[-1]) + sum(hot_counts.values()), int(statistics[-2]) + len(hot_counts)
    by_word = discounts(shape)
    lost = sum((1 - by_word[r]) * r * shape[r] for r in range(1, DISCOUNTED + 1))
    constants = Constants(size, vocabulary, by_word, discounts(statistics[:width]), size - lost)
    model = KatzModel(spark, paths, count, hot, hot_counts, constants)
    model.words_path = write_scratch(normalise(model), "katz-words")
    if answer:  # the pairs themselves are not asked again
        discard(spark, *[f"{p}/kind=pairs" for p in paths])
    return model


def cuts(count: int) -> list[tuple[int, int]]:
    """The buckets of each round."""
    ends = [count * i // ROUNDS for i in range(ROUNDS + 1)]
    return [(low, high) for low, high in zip(ends, ends[1:]) if low < high]


WORDS = "bucket int, keys binary, counts binary, denominators binary, backoffs binary"


def normalise(model: KatzModel) -> DataFrame:
    """The `words` table: for every context its count, denominator and backoff weight.

    With P* the discounted and P the single-word probabilities, the weight is (1 - sum of P*) / (1 - sum of P), both over
    the words seen after the context. A context all of whose counts are too high to be discounted gets one more in its
    denominator, which is then what it leaves to unseen words."""
    count, constants = model.buckets, model.constants
    hot, hot_totals = np.array(sorted(model.hot_counts), np.uint64), np.array([model.hot_counts[k] for k in sorted(model.hot_counts)], np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            word, totals = read_keys(row["words"]), np.frombuffer(row["totals"], np.int64).copy()
            numbers, context, n = from_planes(row["numbers"]), read_keys(row["contexts"]), from_planes(row["counts"]).astype(np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
                totals = np.where(hot[at] == word, hot_totals[at], totals)
            single = np.repeat(constants.word_probability(totals), numbers)
            order = np.lexsort((context, context % np.uint64(count)))
            context, n, single = context[order], n[order], single[order]
            new = runs(np.concatenate([[True], context[1:] != context[:-1]]))
            sums = [np.add.reduceat(x, new) for x in (n, constants.discounted(n), single)]
            context = context[new]
            ends = np.searchsorted(context % np.uint64(count), np.arange(count + 1, dtype=np.uint64))
            yield pa.RecordBatch.from_pylist([
                {"bucket": i, "keys": pack_keys(context[a:b]), **{c: x[a:b].tobytes() for c, x in zip(("n", "kept", "single"), sums)}}
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b
            ], schema=pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "n", "kept", "single"))]))

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([read_keys(r["keys"]) for r in rows])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = runs(np.concatenate([[True], keys[1:] != keys[:-1]]))
        kinds = (("n", np.int64), ("kept", float), ("single", float))
        n, kept, single = (np.add.reduceat(np.concatenate([np.frombuffer(r[c], t) for r in rows])[order], new) for c, t in kinds)
        full = kept > n - 1e-9 * np.maximum(n, 1)
        denominator = n + full
        free = np.where(full, 1.0, n - kept) / denominator
        return pa.table({
            "bucket": table.column("bucket")[:1], "keys": [pack_keys(keys[new])], "counts": [n.tobytes()],
            "denominators": [denominator.astype(np.int64).tobytes()], "backoffs": [(free / np.maximum(1 - single, 1e-300)).tobytes()],
        })

    pairs = model.table("pairs").select("words", "totals", "numbers", "contexts", "counts")
    return pairs.mapInArrow(partial, "bucket int, keys binary, n binary, kept binary, single binary").groupBy("bucket").applyInArrow(merge, WORDS)


# evaluation

NO_PAIRS = {"words": b"", "numbers": b"", "contexts": b""}
SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def score(tokens: DataFrame, model: KatzModel, answered: bool = False, order: int = 2, used: Sequence[str] = ()) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, base_score, score) of every document in `tokens` (from `blocks`; `answered` if
    the model was trained on these very blocks and holds the counts of their pairs).

    The probability of a token is the discounted relative frequency of its pair if that was seen; if not, the backoff
    weight of the context times the probability of the word alone; and that alone after a context never seen. With an
    `order` above 2 the same holds for longer histories, whose counts are taken from the training documents of `tokens`; the tables
    at the paths in `used` are then deleted when they are no longer needed."""
    count, hot, constants = model.buckets, model.hot, model.constants
    columns = ["kind", "bucket", "block", "keys", "counts", "denominators", "backoffs", "words", "numbers", "contexts", "totals", "ids"]
    types = {"kind": "string", "bucket": "int", "block": "long"}
    shape = ", ".join(f"{c} {types.get(c, 'binary')}" for c in columns)
    schema = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}.get(types.get(c), pa.binary())) for c in columns])

    def like(df: DataFrame, kind: str) -> DataFrame:
        have = {"kind": F.lit(kind), **{c: F.col(c) for c in df.columns}}
        return df.select(*[have.get(c, F.lit(None)).cast(types.get(c, "binary")).alias(c) for c in columns])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block.read(row)
            pairs = None if answered else block.pairs(count, hot)
            ends = np.searchsorted(block.keys % np.uint64(count), np.arange(count + 1, dtype=np.uint64))
            yield pa.RecordBatch.from_pylist([
                {"kind": "ask", "bucket": i, "block": row["block"], "keys": pack_keys(block.keys[ends[i] : ends[i + 1]]), **(pairs.slice(i) if pairs else NO_PAIRS)} for i in range(count)
            ], schema=schema)

    def answer(table: pa.Table) -> pa.Table:
        rows = {"ask": [], "words": [], "pairs": []}
        for r in table.to_pylist():
            rows[r["kind"]].append(r)
        known = rows["words"][0] if rows["words"] else {"keys": b"", "counts": b"", "denominators": b"", "backoffs": b""}
        keys = read_keys(known["keys"])
        facts = [np.frombuffer(known[c], t) for c, t in (("counts", np.int64), ("denominators", np.int64), ("backoffs", float))]
        # numbers of words, small for frequent ones
        number = np.empty(len(keys), np.int64)
        number[np.lexsort((keys, -facts[0]))] = (np.arange(len(keys)) * count + (table.column("bucket")[0].as_py() + IDS))
        parts = [read_pairs(r) for r in rows["pairs"] + rows["ask"]]
        stock = sum(len(p[0]) for p in parts[: len(rows["pairs"])])
        numbers = np.zeros(sum(len(p[0]) for p in parts), np.int64)
        if rows["pairs"]:
            numbers[:stock] = from_planes(rows["pairs"][0]["counts"])
        if len(numbers):
            # equal pairs side by side, the model's first; its count goes to all of them
            word, context = (np.concatenate(x) for x in zip(*parts))
            alike = np.lexsort((context, word))
            word, context = word[alike], context[alike]
            new = np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])])
            numbers[alike] = numbers[alike][runs(new)][np.cumsum(new) - 1]
        out, at = [], stock
        for r, (w, _) in zip(rows["ask"], parts[len(rows["pairs"]) :]):
            asked = read_keys(r["keys"])
            spot = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
            found = keys[spot] == asked if len(keys) else np.zeros(len(asked), bool)
            n, d, b, ids = (np.where(found, x[spot], 0) if len(keys) else np.zeros(len(asked), x.dtype) for x in (*facts, number))
            out.append({
                "kind": "answer", "bucket": r["bucket"], "block": r["block"], "counts": thin(n), "denominators": planes(d - n),
                "backoffs": b.tobytes(), "totals": planes(numbers[at : at + len(w)]), "ids": thin(ids) if order > 2 else None,
            })
            at += len(w)
        return pa.Table.from_pylist(out, schema=schema)

    asked = tokens.select("block", "doc_ids", "train", "sizes", "keys", "codes").mapInArrow(ask, shape)
    tables = like(model.table("words"), "words")
    if not answered:
        tables = tables.unionByName(like(model.table("pairs").drop("block", "totals", "statistics"), "pairs"))
    answers_path = write_scratch(asked.unionByName(tables).groupBy("bucket").applyInArrow(answer, shape), "katz-answers")
    answers = model.spark.read.schema(shape).parquet(answers_path)

    def evaluate(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block = Block.read(next(r for r in rows if r["bucket"] is None))
        every = sorted((r for r in rows if r["bucket"] is not None), key=lambda r: r["bucket"])
        answers = [r for r in every if r["counts"] is not None]
        numbers = [r for r in every if r["counts"] is None] if answered else answers
        n = np.concatenate([from_thin(r["counts"]) for r in answers]).astype(np.int64)
        denominator = n + np.concatenate([from_planes(r["denominators"]) for r in answers]).astype(np.int64)
        backoff = np.concatenate([np.frombuffer(r["backoffs"], float) for r in answers])
        paired = np.concatenate([from_planes(r["totals"]) for r in numbers]).astype(np.int64)
        start, end = (int(np.flatnonzero(block.keys == np.uint64(k))[0]) for k in (START, END))
        as_word = n.copy()
        as_word[end] = n[start]  # every training document has one of either
        context, paired = block.contexts(), paired[block.pairs(count, hot).of_token]
        single = constants.word_probability(as_word)[block.codes]
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = constants.discounted(paired) / denominator[context]
        probability = np.where(paired > 0, seen, np.where(n[context] > 0, backoff[context] * single, single))
        base = np.log10((as_word + 0.5) / (constants.tokens + 0.5 * (constants.vocabulary + 1)))[block.codes]
        first = np.cumsum(block.sizes) - block.sizes
        if order > 2:
            known, base = (np.add.reduceat(x, first) for x in ((as_word > 0)[block.codes].astype(np.int64), base))
            ids = np.concatenate([from_thin(r["ids"]) for r in answers])
            ids[end] = END_ID
            row = next(r for r in rows if r["bucket"] is None)
            row = {**row, "start": start, "documents": int(n[start]), "ids": thin(ids), "known": known.tobytes(), "base": base.tobytes()}
            return state_of(row, paired, denominator, probability)
        sums = [np.add.reduceat(x, first) for x in ((as_word > 0)[block.codes].astype(np.int64), base, np.log10(probability))]
        arrays = [block.doc_ids, block.train, block.sizes.astype(np.int64), *sums]
        return pa.table([pa.array(a) for a in arrays], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    whole = tokens.select("block", "doc_ids", "train", "sizes", "keys", "codes", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("bucket", "int"), ("counts", "binary"), ("denominators", "binary"), ("backoffs", "binary"), ("totals", "binary"), ("ids", "binary"))])
    if answered:
        known = model.table("answers").select("bucket", "block", "totals")
        answers = answers.drop("totals").unionByName(known, allowMissingColumns=True)
    parts = answers.select("block", *[F.lit(None).cast("binary").alias(c) for c in ("doc_ids", "train", "sizes", "keys", "codes")],
                           "bucket", "counts", "denominators", "backoffs", "totals", "ids")
    if order == 2:
        return whole.unionByName(parts).groupBy("block").applyInArrow(evaluate, SCORES)
    return climb(model.spark, in_rounds(whole, parts, evaluate, STATE, "katz-state"), constants.pair_discounts, order, [answers_path, *used])


def in_rounds(whole: DataFrame, parts: DataFrame, evaluate, schema: str, name: str) -> list[str]:
    """Paths of what `evaluate` makes of each block's row of `whole` and its rows of `parts`; a share of the blocks at a time."""
    share = F.pmod(F.shiftright("block", 24) + F.col("block"), F.lit(BLOCK_ROUNDS))
    some = [whole.filter(share == i).unionByName(parts.filter(share == i)) for i in range(BLOCK_ROUNDS)]
    return [write_scratch(df.groupBy("block").applyInArrow(evaluate, schema), name) for df in some]


# longer histories

_TOKENS = ("doc_ids", "train", "sizes", "ids", "codes")
_FACTS = ("known", "base", "counts", "denominators", "backed")
STATE = "block long, start long, documents long, " + ", ".join(f"{c} binary" for c in (*_TOKENS, *_FACTS))
_STATE = pa.schema([*((c, pa.int64()) for c in ("block", "start", "documents")), *((c, pa.binary()) for c in (*_TOKENS, *_FACTS))])
_ASKS = ("histories", "numbers", "words", "counts", "lower", "denominators")
_ANSWERS = ("totals", "masks", "shapes", "singles")
# numbers of words: 0 for those that were never seen, one for the end, then all others
END_ID, IDS = 1, 2


def state_of(row: dict, counts: np.ndarray, denominators: np.ndarray, probability: np.ndarray) -> pa.Table:
    """What a block knows of its tokens by histories of one length: the counts of their n-grams, the denominators of their histories
    (for a history of one word those of the block's words), and the probabilities of those that were never seen there."""
    # a history that was never seen has no denominator
    facts = {"counts": thin(counts), "denominators": thin(np.asarray(denominators, np.int64)), "backed": packed(probability[counts == 0].tobytes())}
    return pa.Table.from_pylist([{**{c: row[c] for c in _STATE.names if c not in facts}, **facts}], schema=_STATE)


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return np.append(factors, 1.0)[np.minimum(counts, DISCOUNTED + 1)] * counts


@dataclass
class State:
    """A block's tokens, and what is known of them by histories of `length` - 2 words."""

    train: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    contexts: list[np.ndarray]  # codes of the words before each token, the nearest first
    counts: np.ndarray
    denominators: np.ndarray
    seen: np.ndarray  # how often the history of `length` - 1 words was seen before any word

    @classmethod
    def read(cls, row: dict, length: int) -> State:
        sizes, codes = np.frombuffer(row["sizes"], np.int32), from_planes(unpacked(row["codes"]))
        contexts = [before(codes, sizes, row["start"])]
        while len(contexts) < length - 1:
            contexts.append(before(contexts[-1], sizes, row["start"]))
        counts, denominators = from_thin(row["counts"]).astype(np.int64), from_thin(row["denominators"]).astype(np.int64)
        if length == 3:
            denominators = denominators[contexts[0]]
        # every n-gram but one that closes a document is the history of one token; the start is that of each document's first
        return cls(np.frombuffer(row["train"], bool), sizes, from_thin(row["ids"]), codes, contexts, counts, denominators, before(counts, sizes, row["documents"]))

    def probability(self, row: dict, factors: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.counts))
        out[self.counts == 0] = np.frombuffer(unpacked(row["backed"]), float)
        some = self.counts > 0
        out[some] = discounted(self.counts[some], factors) / self.denominators[some]
        return out

    def grams(self, count: int, low: int, high: int) -> tuple[Grams, np.ndarray, np.ndarray]:
        """N-grams whose histories were seen and lie in the buckets from `low` to `high`; their tokens, and the buckets of these."""
        mixed, key = mix64(self.ids), np.zeros(len(self.codes), np.uint64)
        for context in self.contexts:
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += mixed[context]
        key >>= np.uint64(32)
        key *= np.uint64(count)
        key >>= np.uint64(32)
        tokens = np.flatnonzero((self.seen > 0) & (key >= low) & (key < high))
        bucket = key[tokens].astype(np.int32)
        del key
        return Grams.of(fold([c[tokens] for c in reversed(self.contexts)]), self.codes[tokens], bucket), tokens, bucket


@dataclass
class Grams:
    """Distinct n-grams of some tokens, by history and word, and the histories themselves."""

    first: np.ndarray  # a token of each n-gram
    of_token: np.ndarray
    heads: np.ndarray  # the first n-gram of each history
    history: np.ndarray  # the history of each n-gram, as a place in `heads`

    @classmethod
    def of(cls, histories: np.ndarray, words: np.ndarray, bucket: np.ndarray | None = None) -> Grams:
        """`bucket`, if given, is one for all tokens of a history and comes before it in the order."""
        rank, at = ranks(histories)
        if bucket is not None:
            by = sorting(bucket[at])
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            rank = place[rank]
        of_token, first = ranks(fold([rank, words]))
        newer = starts(rank[first])
        return cls(first, of_token, np.flatnonzero(newer), np.cumsum(newer) - 1)


def climb(spark: SparkSession, paths: list[str], factors: np.ndarray, order: int, used: list[str]) -> DataFrame:
    """Scores by histories of `order` - 1 words, from the state of blocks by histories of one word, stored at `paths`; what is at
    `used` was needed for these."""
    for length in range(3, order + 1):
        discard(spark, *used)
        state = spark.read.schema(STATE).parquet(*paths)
        answers, longer, answer_paths = answer_histories(state, factors, length)
        used = [*paths, *answer_paths]
        paths = evaluate_histories(state, answers, factors, longer, length, length == order)
        factors = longer
    discard(spark, *used)
    return spark.read.schema(SCORES).parquet(*paths)


def answer_histories(state: DataFrame, factors: np.ndarray, length: int) -> tuple[DataFrame, np.ndarray, list[str]]:
    """(bucket, block, ...): for the distinct n-grams of each block their counts in all training documents; for their histories which of
    the counts 1 to DISCOUNTED there are, and where an n-gram was never seen the numbers of n-grams with these counts and what the
    shorter history gives to the words seen. And the discounts of n-grams of this length, and the paths of the table."""
    spark = state.sparkSession
    count = SPLIT * buckets(spark)

    def asker(low: int, high: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                own = State.read(row, length)
                grams, tokens, bucket = own.grams(count, low, high)
                if not len(tokens):
                    continue
                trained = np.bincount(grams.of_token[np.repeat(own.train, own.sizes)[tokens]], minlength=len(grams.first))
                at = tokens[grams.first]
                head = at[grams.heads]
                word, lower = own.ids[own.codes[at]], np.where(trained > 0, own.counts[at], 0)
                numbers = np.diff(np.append(grams.heads, len(at)))
                key, below = [own.ids[c[head]] for c in own.contexts], own.denominators[head]
                # heads of each bucket, and their n-grams
                ends = np.searchsorted(bucket[grams.first[grams.heads]], np.arange(low, high + 1))
                inner = np.append(grams.heads, len(at))[ends]
                yield pa.RecordBatch.from_pylist([
                    {"bucket": low + i, "block": row["block"], "histories": thin(np.concatenate([k[a:b] for k in key])), "numbers": thin(numbers[a:b]),
                     "words": thin(word[c:d]), "counts": thin(trained[c:d]), "lower": thin(lower[c:d]), "denominators": thin(below[a:b])}
                    for i, (a, b, c, d) in enumerate(zip(ends, ends[1:], inner, inner[1:])) if a < b
                ], schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in _ASKS)]))

        return ask

    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in _ANSWERS), ("statistics", pa.list_(pa.int64()))])

    def merge(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()
        numbers = [from_thin(r["numbers"]).astype(np.int64) for r in asked]
        each = np.concatenate(numbers)
        keys = np.hstack([from_thin(r["histories"]).reshape(length - 1, -1) for r in asked])
        word, trained, lower = (np.concatenate([from_thin(r[c]) for r in asked]) for c in ("words", "counts", "lower"))
        histories, _ = ranks(fold(list(keys)))
        grams = Grams.of(np.repeat(histories, each), word)
        totals = np.bincount(grams.of_token, trained, len(grams.first)).astype(np.int64)
        # those that did not see an n-gram in training do not say its lower count
        below = np.repeat(np.concatenate([from_thin(r["denominators"]) for r in asked]), each)[grams.first].astype(np.int64)
        known = np.zeros(len(grams.first), np.int64)
        told = np.flatnonzero(trained)
        known[grams.of_token[told]] = lower[told]
        single = np.where(totals > 0, discounted(known, factors) / np.maximum(below, 1), 0.0)
        singles = np.add.reduceat(single, grams.heads)
        shapes = [np.add.reduceat((totals == r).astype(np.int64), grams.heads) for r in range(1, DISCOUNTED + 1)]
        masks = sum((s > 0).astype(np.int64) << r for r, s in enumerate(shapes))
        statistics = np.bincount(np.minimum(totals, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]
        out, at, head = [], 0, np.cumsum(each) - each
        near = 0
        for r, some in zip(asked, numbers):
            there = grams.history[grams.of_token[head[near : near + len(some)]]]
            n = int(some.sum())
            own = totals[grams.of_token[at : at + n]]
            back = there[np.logical_or.reduceat(own == 0, head[near : near + len(some)] - at)]
            out.append({
                "bucket": r["bucket"], "block": r["block"], "totals": thin(own), "masks": thin(masks[there]),
                "singles": packed(singles[back].tobytes()), "shapes": thin(np.concatenate([s[back] for s in shapes])), "statistics": None,
            })
            at, near = at + n, near + len(some)
        out[0]["statistics"] = statistics.tolist()
        return pa.Table.from_pylist(out, schema=schema)

    asks = "bucket int, block long, " + ", ".join(f"{c} binary" for c in _ASKS)
    answers = "bucket int, block long, " + ", ".join(f"{c} binary" for c in _ANSWERS) + ", statistics array<long>"
    paths = [write_scratch(state.mapInArrow(asker(low, high), asks).groupBy("bucket").applyInArrow(merge, answers), "katz-histories") for low, high in cuts(count)]
    found = spark.read.schema(answers).parquet(*paths)
    sums = found.agg(*[F.sum(F.col("statistics")[i]).alias(str(i)) for i in range(DISCOUNTED + 2)]).first()
    return found.drop("statistics"), discounts(np.array([x or 0 for x in sums], np.int64)), paths


def evaluate_histories(state: DataFrame, answers: DataFrame, factors: np.ndarray, longer: np.ndarray, length: int, last: bool) -> list[str]:
    """Paths of the state of blocks by histories of `length` - 1 words, or of the scores by these if they are the `last` ones."""
    count = SPLIT * buckets(state.sparkSession)

    def evaluate(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        row = next(r for r in rows if r["bucket"] is None)
        every = sorted((r for r in rows if r["bucket"] is not None), key=lambda r: r["bucket"])
        own = State.read(row, length)
        probability = own.probability(row, factors)
        counts, denominators = np.zeros(len(probability), np.int64), np.zeros(len(probability), np.int64)
        for low, high in cuts(count):  # a part of the n-grams at a time, as they are asked
            grams, tokens, _ = own.grams(count, low, high)
            if not len(tokens):
                continue
            told = [r for r in every if low <= r["bucket"] < high]
            totals, masks = (np.concatenate([from_thin(r[c]) for r in told]).astype(np.int64) for c in ("totals", "masks"))
            single = np.concatenate([np.frombuffer(unpacked(r["singles"]), float) for r in told])
            shapes = np.hstack([from_thin(r["shapes"]).reshape(DISCOUNTED, -1) for r in told]).astype(np.int64)
            n = own.seen[tokens[grams.first[grams.heads]]]
            # as for contexts of one word: a history whose counts are all too high to be discounted gets one more in its denominator
            full = masks & sum(1 << r for r in range(DISCOUNTED) if longer[r + 1] < 1) == 0
            denominator = n + full
            back = np.logical_or.reduceat(totals == 0, grams.heads)
            lost = sum((1 - longer[r]) * r * shapes[r - 1] for r in range(1, DISCOUNTED + 1))
            weight = np.ones(len(n))
            weight[back] = np.where(full[back], 1.0, lost) / denominator[back] / np.maximum(1 - single, 1e-300)
            history = grams.history[grams.of_token]
            counts[tokens], denominators[tokens] = totals[grams.of_token], denominator[history]
            new = np.flatnonzero(counts[tokens] == 0)
            probability[tokens[new]] *= weight[history[new]]
            del grams, tokens, history, new
        if not last:
            return state_of(row, counts, denominators, probability)
        some = counts > 0
        probability[some] = discounted(counts[some], longer) / denominators[some]
        first = np.cumsum(own.sizes) - own.sizes
        arrays = [
            np.frombuffer(row["doc_ids"], np.int64), own.train, own.sizes.astype(np.int64), np.frombuffer(row["known"], np.int64), np.frombuffer(row["base"], float),
            np.add.reduceat(np.log10(probability), first),
        ]
        return pa.table([pa.array(a) for a in arrays], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    missing = [c for c in (*_ANSWERS, "bucket") if c not in state.columns]
    whole = state.select(*_STATE.names, *[F.lit(None).cast("int" if c == "bucket" else "binary").alias(c) for c in missing])
    parts = answers.select("block", *[F.lit(None).cast("long").alias(c) for c in ("start", "documents")],
                           *[F.lit(None).cast("binary").alias(c) for c in (*_TOKENS, *_FACTS)], *missing)
    return in_rounds(whole, parts, evaluate, SCORES if last else STATE, "katz-scores" if last else "katz-state")


def train_and_score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Learn n-grams of up to `order` words from the rows of `docs` where `training` holds and score all rows: the columns of
    `score` and `train_tokens`.

    A null text counts as empty: it is the end token alone. Repeated rows are counted and scored one by one; with no
    training rows every probability is 1; an empty table gives no rows; a null id stays null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    if order < 2:
        raise ValueError("an n-gram has two words at least")
    blocks_path = write_scratch(cut(rows), "blocks")
    tokens = docs.sparkSession.read.schema(BLOCKS).parquet(blocks_path)
    model = train(tokens, answer=True)
    scored = score(tokens, model, answered=True, order=order, used=[blocks_path, model.words_path, *model.paths]).withColumn("train_tokens", F.lit(model.constants.tokens).cast("long"))
    return scored.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
