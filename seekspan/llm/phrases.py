"""Phrase collocation mining with an FM-index per shard over word numbers.

Texts are dealt into shards of one language each. Words are counted first; the words below the least count separate the rest.
Each shard then gets a bidirectional FM-index: the Burrows-Wheeler transforms of its words and of its words read backwards.
A phrase is a pair of intervals of equal size, one in either transform, and its size is the number of its occurrences. Growing
phrases by a word on the left reads the one transform, on the right the other, and keeps both intervals in step. Counts of all
shards are summed, and only phrases that are frequent in the whole language are grown further.

Shards learn what is frequent from Bloom filters of bounded size, so nothing that grows with the corpus is broadcast or joined
to the shards. For each length the shards first sum up counts by a hash of 40 bits, which makes the filter; when all filters are
there, the phrases that pass them are counted once more by their words. Hashes and filters only decide what is looked at: a
false positive costs some bytes, never a wrong count. Where a corpus has more frequent phrases than `FILTER_BITS` can tell
apart, shards send more; results stay the same. Counts travel in packed blocks, one for each shard and bucket of hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekspan.llm.common import buckets, mix64, prepare, stored, text_slices
from seekspan.operators.topk import top_k_per_group

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
# words of a shard, and bytes of text that are split at once
SHARD_WORDS, SLICE_BYTES = 600_000, 2 << 20
# the filter has sixteen bits for each frequent phrase, and 2^28 (32 MB) at most
FILTER_BITS = 28
PLACES = 4
HASH_BITS = 40
# counts of one bucket of hashes, which one task sums up at a time
BUCKET_ENTRIES = 1 << 20
UNKNOWN_LANGUAGE = "und"

_SHARD = "lang string, words array<string>, keys array<bigint>, counts array<bigint>, text binary"
_INDEX = "keys binary, forward binary, backward binary"


def _split(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, the number of the piece each stands in, and the row of each piece."""
    parts = pc.split_pattern_regex(pc.ascii_lower(text.cast(pa.large_string())), "[.,;:!?\n-\r]")
    bare = pc.replace_substring(parts.flatten(), "\t", " ")
    split = pc.split_pattern(bare, " ")
    flat, piece = split.flatten(), pc.list_parent_indices(split)
    keep = pc.not_equal(flat, "")
    return flat.filter(keep), piece.filter(keep).to_numpy(), pc.list_parent_indices(parts).to_numpy()


def word_keys(lang: str, words: list[str], seed: int) -> np.ndarray:
    """64-bit keys of the words of a language; `phrases` makes sure that no two words of a corpus share one."""
    head = f"{lang}\0"
    return np.array([xxhash.xxh64_intdigest(head + w, seed) for w in words], np.uint64).view(np.int64)


def shards(docs: DataFrame, text_col: str, lang_col: str, seed: int, size: int) -> DataFrame:
    """Documents as shards of about `size` words of one language: its distinct words with their keys and counts, and the
    words in order as numbers from 1, with 0 between pieces. No piece is cut, and no text is moved."""
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang")
    schema = pa.schema(
        {"lang": pa.string(), "words": pa.list_(pa.string()), "keys": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "text": pa.binary()}
    )

    def pack(name: str, waiting: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        coded = pa.concat_arrays([w for w, _ in waiting]).dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int32) + 1
        new = np.concatenate([n for _, n in waiting])
        text = np.zeros(len(number) + int(new.sum()), np.int32)
        text[np.arange(len(number)) + np.cumsum(new)] = number
        words = coded.dictionary.to_pylist()
        columns = [[name], [words], [word_keys(name, words, seed)], [np.bincount(number)[1:]], [squeezed(text)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {}
        held: dict[str, int] = {}
        for part in (p for batch in batches for p in text_slices(batch, SLICE_BYTES)):
            coded = part.column("lang").dictionary_encode()
            for n, name in enumerate(coded.dictionary.to_pylist()):
                flat, piece, _ = _split(part.column("text").filter(pc.equal(coded.indices, n)))
                # a very long text is cut between pieces
                at = 0
                while at < len(flat):
                    stop = min(at + max(size - held.get(name, 0), 1), len(flat))
                    stop = int(np.searchsorted(piece, piece[stop - 1], side="right"))
                    new = np.diff(piece[at:stop], prepend=-1) != 0
                    waiting.setdefault(name, []).append((flat.slice(at, stop - at), new))
                    held[name] = held.get(name, 0) + stop - at
                    at = stop
                    if held[name] >= size:
                        yield pack(name, waiting.pop(name))
                        held.pop(name)
            while sum(held.values()) > 3 * size:
                name = max(held, key=held.get)
                yield pack(name, waiting.pop(name))
                held.pop(name)
        for name, some in waiting.items():
            yield pack(name, some)

    rows = docs.select(lang, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, _SHARD)


# the index of one shard


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits in few bytes: a shard's arrays as they are would be objects of several MB, which fragment the heap of
    every JVM that they pass through."""
    planes = np.ascontiguousarray(numbers, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unsqueezed(raw: pa.BinaryScalar) -> np.ndarray:
    whole = raw.as_buffer()
    n = int.from_bytes(whole.slice(0, 8).to_pybytes(), "little")
    planes = np.frombuffer(pa.decompress(whole.slice(8), 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all rotations of the text in order; each 0 is a letter of its own, less than all others.

    Ranks by the first 1, 2, 4, ... letters; only starts that are not yet told apart are sorted again."""
    n = len(text)
    gaps = np.cumsum(text == 0)
    letter = np.where(text == 0, gaps - 1, text.astype(np.int64) + (gaps[-1] if n else 0))
    order = np.argsort(letter, kind="stable")
    key = letter[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])[:n]
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    step = 1
    alone = first & np.concatenate([first[1:], [True]])[:n]
    open_ = order[~alone]
    while len(open_):
        mine, next_ = rank[open_], rank[(open_ + step) % n]
        by = np.argsort(mine * n + next_)
        open_, mine, next_ = open_[by], mine[by], next_[by]
        group = np.concatenate([[True], mine[1:] != mine[:-1]])
        new = group | np.concatenate([[True], next_[1:] != next_[:-1]])
        at = np.arange(len(open_))
        rank[open_] = mine + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def transform(text: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform: the letter before each rotation, in the order of the rotations."""
    return text[suffix_order(text) - 1]


class Phrases:
    """Phrases of equal length in one shard: where their interval starts in either transform, how often they occur, the
    letters they consist of, and a hash of these."""

    def __init__(self, starts: list[np.ndarray], size: np.ndarray, letters: np.ndarray, hashes: np.ndarray):
        self.starts, self.size, self.letters, self.hashes = starts, size, letters, hashes

    def take(self, which: np.ndarray) -> Phrases:
        return Phrases([s[which] for s in self.starts], self.size[which], self.letters[which], self.hashes[which])


class Index:
    """Bidirectional FM-index of one shard."""

    def __init__(self, keys: np.ndarray, forward: np.ndarray, backward: np.ndarray):
        self.keys = keys
        self.transforms = [forward, backward]
        self.counts = np.bincount(forward, minlength=len(keys) + 1)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.steps = [self._steps(b) for b in self.transforms]

    def _steps(self, letters: np.ndarray) -> np.ndarray:
        """For each place, the one of the rotation that starts a letter earlier: C[c] + occurrences of c before it."""
        out = np.empty(len(letters), np.int32)
        out[np.argsort(letters, kind="stable")] = np.arange(len(letters), dtype=np.int32)
        return out

    def words(self) -> Phrases:
        letters = np.arange(1, len(self.keys) + 1)
        start, size = self.first[1:-1], self.counts[1:]
        return Phrases([start, start], size, letters[:, None], hashed(self.keys))

    def extend(self, phrases: Phrases, side: int) -> Phrases:
        """Every phrase with every word that stands before it (side 0) or after it (side 1), if the part without its other
        end is one of `phrases` too."""
        start, other = phrases.starts[side], phrases.starts[1 - side]
        owner = np.repeat(np.arange(len(start)), phrases.size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(phrases.size) - phrases.size, phrases.size)
        place = start[owner] + inside
        letter = self.transforms[side][place].astype(np.int64)
        order = np.argsort(owner * len(self.first) + letter, kind="stable")
        owner, letter, place = owner[order], letter[order], place[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (letter[1:] != letter[:-1])])[: len(owner)]
        at = np.flatnonzero(new)
        size = np.diff(np.concatenate([at, [len(owner)]]))
        owner, letter, place = owner[at], letter[at], place[at]
        # in this transform the interval is entered by the letter; in the other one it lies behind those of smaller letters
        begin = np.concatenate([[0], np.cumsum(phrases.size)])[owner]
        starts = [np.empty(0)] * 2
        starts[side], starts[1 - side] = self.steps[side][place], other[owner] + at - begin
        real = letter > 0
        # the rest after the phrase's far end has gone is a prefix in this transform: its interval contains the new one
        by = np.argsort(start)
        near = np.searchsorted(start[by], starts[side], side="right") - 1
        rest = by[np.maximum(near, 0)] if len(by) else near
        real &= (near >= 0) & (starts[side] < start[rest] + phrases.size[rest])
        owner, letter, size = owner[real], letter[real], size[real]
        starts = [s[real] for s in starts]
        parts = [letter[:, None], phrases.letters[owner]]
        letters = np.hstack(parts if side == 0 else parts[::-1])
        return Phrases(starts, size, letters, hashed(*[self.keys[letters[:, i] - 1] for i in range(letters.shape[1])]))


def hashed(*words: np.ndarray) -> np.ndarray:
    """Hashes of HASH_BITS bits of phrases, given as their words' keys in order."""
    out = np.full(len(words[0]), 7, np.uint64)
    for word in words:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64))
    return out >> np.uint64(64 - HASH_BITS)


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places in a filter of 2^bits bits."""
    return [mix64(hashes + np.uint64(i << HASH_BITS)) >> np.uint64(64 - bits) for i in range(1, PLACES + 1)]


class Filter:
    """Bloom filter of the frequent phrases of one length."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in _places(hashes, self.bits):
            found &= (self.table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def build_filter(hashes: DataFrame, most_bits: int) -> Filter:
    """The filter of a table (h) of hashes. It is put together on the executors; what comes to the driver is the filter itself,
    2^most_bits bits at most."""
    bits = min(max(int(np.ceil(np.log2(16 * max(hashes.count(), 1)))), 10), most_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(_places(batch.column("h").to_numpy().astype(np.uint64), bits)))
            cell = place >> np.uint64(6)
            cells, at = np.unique(cell, return_index=True)
            if len(cells):
                value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), at)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(value.view(np.int64))], names=["cell", "value"])

    cells = hashes.mapInArrow(run, "cell bigint, value bigint").groupBy("cell").agg(F.bit_or("value").alias("value"))
    got = cells.toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got.column("cell").to_numpy()] = got.column("value").to_numpy().astype(np.int64).view(np.uint64)
    return Filter(bits, table)


# packed counts


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers, byte by byte, so that their empty high bytes cost nothing; the first one ascends."""
    first = np.diff(columns[0], prepend=columns[0][:1] * 0)
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in (first, *columns[1:])]
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, width: int) -> list[np.ndarray]:
    flat = np.frombuffer(pa.decompress(raw, n * width * 8, "zstd", asbytes=True), np.uint8).reshape(width, 8, n)
    columns = [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in flat]
    return [np.cumsum(columns[0]), *columns[1:]]


_BLOCK = "bucket bigint, length int, n int, counts binary"


def _blocks(hashes: np.ndarray, columns: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Counts of one shard in blocks, by the highest `bits` bits of the hash; the hash itself is the first column."""
    order = np.argsort(hashes)
    hashes = hashes[order].astype(np.int64)
    columns = [hashes, *[c[order] for c in columns]]
    bucket = hashes >> (HASH_BITS - bits)
    cuts = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]]).tolist()
    packed = [_packed([c[a:b] for c in columns]) for a, b in zip(cuts, cuts[1:])]
    sizes = np.diff(cuts)
    lengths = np.full(len(sizes), len(columns) - 2)
    rows = [pa.array(bucket[cuts[:-1]]), pa.array(lengths, pa.int32()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(rows, names=["bucket", "length", "n", "counts"])


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of equal values in all columns but the last, which is summed."""
    order = np.lexsort(columns[-2::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [*[c[at] for c in columns[:-1]], np.add.reduceat(columns[-1], at) if len(at) else columns[-1]]


def _totals(blocks: DataFrame, least: int, width: int, finish: Callable[[int, list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """Counts of all shards, bucket by bucket; those of `least` or more go on. `width` columns of words follow the hash."""
    tasks = buckets(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, weight, least_weight = None, [], 0, 0

        def done():
            columns = _summed([np.concatenate(c) for c in zip(*held)])
            return finish(now[1], [c[columns[-1] >= least] for c in columns])

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, length, n, raw = (batch.column(c)[i] for c in ("bucket", "length", "n", "counts"))
                key = bucket.as_py(), length.as_py()
                if held and key != now:
                    yield done()
                    held, weight, least_weight = [], 0, 0
                now = key
                held.append(_unpacked(raw.as_py(), n.as_py(), key[1] + 2))
                weight += n.as_py()
                # what is held is at most twice what is distinct, or half a bucket more
                if weight > 2 * least_weight + BUCKET_ENTRIES // 2:
                    held = [_summed([np.concatenate(c) for c in zip(*held)])]
                    weight = least_weight = len(held[0][0])
        if held:
            yield done()

    return blocks.repartition(tasks, "bucket", "length").sortWithinPartitions("bucket", "length").mapInArrow(run, schema)


def index_shards(packed: DataFrame, known: Callable[[], Filter]) -> DataFrame:
    """The index of every shard, over the words that may be frequent; all others become gaps between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, raw in zip(batch.column("keys"), batch.column("text")):
                keys = keys.values.to_numpy()
                kept = known().has(hashed(keys))
                number = np.concatenate([[0], np.where(kept, np.cumsum(kept), 0)]).astype(np.int32)
                text = number[unsqueezed(raw)]
                gap = text == 0
                text = np.concatenate([text[~(gap & np.concatenate([[False], gap[:-1]]))[: len(text)]], np.zeros(1, np.int32)])
                if len(text) < 3:
                    continue
                columns = [keys[kept].tobytes(), squeezed(transform(text)), squeezed(transform(text[::-1]))]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["keys", "forward", "backward"])

    return packed.select("keys", "text").mapInArrow(run, _INDEX)


def _indexes(batch: pa.RecordBatch) -> Iterator[Index]:
    for keys, forward, backward in zip(*(batch.column(c) for c in ("keys", "forward", "backward"))):
        yield Index(np.frombuffer(keys.as_buffer(), np.int64), unsqueezed(forward), unsqueezed(backward))


def grow(index: Index, known: list[Callable[[], Filter]]) -> Iterator[Phrases]:
    """Phrases of 2, 3, ... words in one shard: those that the filter of their length knows are grown by a word, on the right
    and on the left in turn."""
    phrases = index.words()
    for length, filter_ in enumerate(known, 1):
        phrases = index.extend(phrases.take(filter_().has(phrases.hashes)), side=length % 2)
        yield phrases


def frequent_hashes(indexed: DataFrame, known: list[Callable[[], Filter]], least: int, bits: int) -> DataFrame:
    """(h): hashes that phrases of one word more than the last filter's have, if their counts come to `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index in _indexes(batch):
                *_, phrases = grow(index, known)
                if len(phrases.size):
                    yield _blocks(phrases.hashes, [phrases.size.astype(np.int64)], bits)

    def finish(_: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[0])], names=["h"])

    return _totals(indexed.mapInArrow(run, _BLOCK), least, 0, finish, "h bigint")


def frequent_phrases(indexed: DataFrame, known: list[Callable[[], Filter]], longest: int, least: int, bits: int) -> DataFrame:
    """(length, k1, ..., a): all phrases of 2 to `longest` words that stand `least` times or more, counted by their words."""
    names = [f"k{i + 1}" for i in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index in _indexes(batch):
                for phrases, filter_ in zip(grow(index, known[:-1]), known[1:]):
                    phrases = phrases.take(filter_().has(phrases.hashes))
                    words = [index.keys[phrases.letters[:, i] - 1] for i in range(phrases.letters.shape[1])]
                    if len(phrases.size):
                        yield _blocks(phrases.hashes, [*words, phrases.size.astype(np.int64)], bits)

    def finish(length: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        n = len(columns[0])
        words = [pa.array(c) for c in columns[1:-1]] + [pa.nulls(n, pa.int64())] * (longest - length)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, length), pa.int32()), *words, pa.array(columns[-1])], names=["length", *names, "a"])

    schema = "length int, " + ", ".join(f"{c} bigint" for c in [*names, "a"])
    return _totals(indexed.mapInArrow(run, _BLOCK), least, longest, finish, schema)


# counts of the whole corpus


def _words(packed: DataFrame) -> DataFrame:
    """(lang, word, k1, a) of all words; n, the number of words of a language, follows from it."""
    each = packed.select("lang", F.explode(F.arrays_zip("words", "keys", "counts")).alias("w"))
    return each.groupBy("lang", F.col("w.words").alias("word"), F.col("w.keys").alias("k1")).agg(F.sum("w.counts").alias("a"))


def _keyed(docs: DataFrame, text_col: str, lang_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Shards and words, with keys that tell all words of the corpus apart: if two share one, another seed is taken."""
    seed = 0
    while True:
        packed = stored(shards(docs, text_col, lang_col, seed, size), "phrase-shards")
        words = stored(_words(packed), "phrase-words")
        if words.groupBy("k1").count().filter("count > 1").isEmpty():
            return packed, words
        seed += 1


def _shared(spark: SparkSession, known: Filter) -> Callable[[], Filter]:
    sent = spark.sparkContext.broadcast((known.bits, known.table))
    return lambda: Filter(*sent.value)


def counted(docs: DataFrame, text_col: str, lang_col: str, least: int, longest: int, size: int, most_bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """n of each language, and for each length from 1 the frequent phrases (k1, ..., kn, a); single words have `lang`, `word`."""
    spark = docs.sparkSession
    packed, words = _keyed(docs, text_col, lang_col, size)
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    levels = [stored(words.filter(F.col("a") >= least), "phrases-1")]
    # so many bits of the hash make the bucket that each holds about BUCKET_ENTRIES counts
    amount = words.agg(F.sum("a")).first()[0] or 0
    bits = min(max(int(np.ceil(np.log2(max(amount / BUCKET_ENTRIES, buckets(spark), 1)))), 0), HASH_BITS - 1)
    known = [_shared(spark, build_filter(_word_hashes(levels[0]), most_bits))]
    indexed = stored(index_shards(packed, known[0]), "phrase-index")
    for n in range(2, longest + 1):
        found = stored(frequent_hashes(indexed, known, least, bits), f"phrase-hashes-{n}")
        known.append(_shared(spark, build_filter(found, most_bits)))
    found = stored(frequent_phrases(indexed, known, longest, least, bits), "phrases-counted")
    for n in range(2, longest + 1):
        levels.append(found.filter(F.col("length") == n).select(*[f"k{i + 1}" for i in range(n)], "a"))
    return totals, levels


def _word_hashes(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashed(batch.column("k1").to_numpy()).astype(np.int64))], names=["h"])

    return words.select("k1").mapInArrow(run, "h bigint")


def _scored(levels: list[DataFrame]) -> Iterator[DataFrame]:
    """Phrases of each length from 2: (lang, phrase, a, heads, tails, within).

    `heads` counts their first 1, 2, ... words, `tails` their words from the first, second, ... on; `within` is the count of
    their most frequent extension by one word. Longer extensions are no more frequent than the shorter ones between."""
    one = F.array("a")
    whole = levels[0].select("k1", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), one.alias("heads"), one.alias("tails"))
    for n, level in enumerate(levels[1:], 2):
        keys = [f"k{i + 1}" for i in range(n)]
        shorter = keys[:-1]
        head = whole.select(*shorter, "lang", "phrase", "heads")
        tail = whole.select(*[F.col(a).alias(b) for a, b in zip(shorter, keys[1:])], "last", "tails")
        whole = stored(
            level.join(head, shorter)
            .join(tail, keys[1:])
            .select(
                *keys,
                "a",
                "lang",
                F.concat_ws(" ", "phrase", "last").alias("phrase"),
                "last",
                F.concat("heads", F.array("a")).alias("heads"),
                F.concat(F.array("a"), "tails").alias("tails"),
            ),
            f"phrases-{n}-whole",
        )
        if n < len(levels):
            longer = levels[n]
            following = [F.col(f"k{i + 2}").alias(k) for i, k in enumerate(keys)]
            inside = longer.select(*keys, "a").unionByName(longer.select(*following, "a")).groupBy(*keys).agg(F.max("a").alias("within"))
            yield whole.join(inside, keys, "left")
        else:
            yield whole.withColumn("within", F.lit(None).cast("bigint"))


def _least_cut(n: int) -> Column:
    """The cut of least score, the earliest of equal ones; products have up to 38 digits."""

    def cut(k: int) -> Column:
        left, right = f"heads[{k - 1}]", f"tails[{k}]"
        share = "CAST(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) AS DECIMAL(34,0)) * CAST(1000 AS DECIMAL(4,0))"
        score = F.expr(f"({share}) DIV (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0)))")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(left).alias("l"), F.expr(right).alias("r"))

    return F.array_min(F.array(*[cut(k) for k in range(1, n)]))


def phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = MIN_COUNT,
    longest: int = MAX_WORDS,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The best collocations of every language: (lang, rank, phrase, a, l, r, n, score).

    Words are `[^\\x20\\x09]+` of the pieces between `[.,;:!?\\x0A-\\x0D]`, A-Z in lower case. Candidates are phrases of 2 to
    `longest` words that stand `least` times or more in the texts of a language, overlaps included, and in no longer candidate
    as often as anywhere. A cut into l and r, the counts of both parts, has the score floor(1000 * a * n / (l * r)) with n words
    in the language; the cut of least score counts. The `top` phrases of each language are ranked by score, count and phrase
    (in byte order), so ties have one order.

    A null text counts as empty and a null language as "und"; repeated rows count again; a very long text is dealt into
    several shards, cut between pieces; an empty table gives no rows; columns other than these two are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words at least, and stand somewhere")
    totals, levels = counted(docs, text_col, lang_col, least, longest, shard_words, filter_bits)
    found = None
    for n, level in enumerate(_scored(levels), 2):
        free = level.filter(F.col("within").isNull() | (F.col("within") < F.col("a"))).join(totals, "lang")
        cut = free.withColumn("cut", _least_cut(n)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        found = cut if found is None else found.unionByName(cut)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = top_k_per_group(found, ["lang"], order, top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint").alias("rank")
    return best.select("lang", rank, "phrase", "a", "l", "r", "n", "score")
