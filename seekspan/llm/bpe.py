"""Byte-pair encoding and decoding with a given byte-level vocabulary file.

A text is cut before every single space that stands between two non-blank characters. Such a cut never falls inside a
piece of the vocabulary's splitting pattern, so the chunks can be encoded one by one: each distinct chunk, and each
distinct word in it, once per slice of texts.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspan.llm.common import id_and_text, text_slices

# Fixed: how the vocabulary's ByteLevel pre-tokenizer splits a text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words of more bytes than this are merged through a heap; scanning all ranks again and again would be quadratic
SHORT_WORD = 128
BLOCK = 20_000
SLICE_BYTES = 6 << 20
NONE = 1 << 30

# Blanks in Unicode or in Python's sense; a space next to another blank or at an end of the text is no place to cut
BLANK = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD_SPACE = rf" [{BLANK}]|[{BLANK}] |^ | $"
# Signs that often end a chunk; the pattern keeps a run of them after letters together
SIGNS = ".,;:!?|)]\"-"
_single_space = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others in order
    from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class BytePairCoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.table: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.table[i] = bytes(letters[c] for c in token)
        self.byte_ids = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.ranks = dict(zip(keys.tolist(), range(len(pairs))))
        top = int(self.byte_ids.max()) + 1
        first = np.arange(top)
        self.byte_ranks = self.rank_of(np.repeat(first, top), np.tile(first, top)).reshape(top, top)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.table[i] = content.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)

    # merging

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_ranks[at], np.int32(NONE))

    def merge_short(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contiguous rank arrays of many short words side by side: rows of bytes in, rows of ids and their numbers out.

        A row of `ids` holds the parts of a word, ranks[i] the rank of joining parts i and i + 1. In every round each
        word looks for its smallest rank, deletes that boundary, and takes the ranks of the two neighbours anew; words
        without a rank left are done."""
        n, width = raw.shape
        columns = np.arange(width, dtype=np.int32)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :-1] = np.where(columns < sizes[:, None], self.byte_ids[raw], -1)
        ranks = self.byte_ranks[np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0)]
        ranks[ids[:, 1:] < 0] = NONE
        result, counts, rows = np.full((n, width), -1, np.int32), np.zeros(n, np.int32), np.arange(n)
        sizes = sizes.astype(np.int32)
        while len(rows):
            at = ranks.argmin(1)
            each = np.arange(len(rows))
            least = ranks[each, at]
            going = least != NONE
            if not going.all():
                done = ~going
                result[rows[done]], counts[rows[done]] = ids[done, :-1], sizes[done]
                rows, ids, ranks, sizes, at, least = rows[going], ids[going], ranks[going], sizes[going], at[going], least[going]
                each = each[: len(rows)]
                if not len(rows):
                    break
            behind = columns >= at[:, None]
            np.copyto(ids[:, 1:-1], ids[:, 2:].copy(), where=behind[:, :-1])
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=behind[:, :-1])
            ranks[:, -1] = NONE
            new = self.merged[least]
            ids[each, at] = new
            ranks[each, at] = self.rank_of(new, ids[each, at + 1])
            inner = np.flatnonzero(at)
            left = at[inner] - 1
            ranks[inner, left] = self.rank_of(ids[inner, left], new[inner])
            sizes = sizes - 1
        return result, counts

    def merge_long(self, word: bytes) -> bytes:
        """The same merges for one very long word: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(ids[i] << 32 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or self.ranks.get(ids[i] << 32 | ids[j], NONE) != rank:
                continue  # one of the two parts has changed since
            ids[i], alive[j], after[i] = int(self.merged[rank]), False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.ranks.get(ids[k] << 32 | ids[after[k]], NONE)) != NONE:
                    heapq.heappush(heap, (r, k))
        return np.array([x for x, kept in zip(ids, alive) if kept], "<u4").tobytes()

    def encode_words(self, words: pa.Array) -> pa.Array:
        """Packed ids of distinct words (pieces of the splitting pattern), as binary values."""
        raw = words.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        order = np.argsort(sizes, kind="stable")
        short = order[: np.searchsorted(sizes[order], SHORT_WORD, side="right")]
        flats, counts, places = [], [], []
        at = 0
        while at < len(short):
            stop = at + BLOCK  # words of similar size, since they are sorted by it
            part = short[at:stop]
            width = max(1, int(sizes[part[-1]]))
            spots = offsets[part][:, None] + np.arange(width)
            inside = np.arange(width) < sizes[part][:, None]
            ids, n = self.merge_short(np.where(inside, data[np.where(inside, spots, 0)], 0) if len(data) else np.zeros((len(part), width), np.uint8), sizes[part])
            flats.append(ids[np.arange(width) < n[:, None]].astype("<u4"))
            counts.append(n)
            places.append(part)
            at = stop
        for i in order[len(short) :].tolist():
            ids = np.frombuffer(self.merge_long(data[offsets[i] : offsets[i + 1]].tobytes()), "<u4")
            flats.append(ids)
            counts.append(np.array([len(ids)]))
            places.append(np.array([i]))
        if not places:
            return pa.array([], pa.large_binary())
        packed = binaries(np.concatenate(flats), np.concatenate(counts))
        back = np.empty(len(raw), np.int64)
        back[np.concatenate(places)] = np.arange(len(raw))
        return packed.take(pa.array(back))

    # encoding

    def pieces(self, chunk: str) -> list[str | int]:
        """The words of a chunk, and the ids of added tokens that stand in it."""
        if self.special is None or not self.special.search(chunk):
            return self.pattern.findall(chunk)
        out: list[str | int] = []
        for part in self.special.split(chunk):
            out.extend([self.added[part]] if part in self.added else self.pattern.findall(part))
        return out

    def encode_chunks(self, chunks: pa.Array) -> pa.Array:
        """Packed ids of distinct chunks."""
        # the usual chunk is letters, then perhaps signs, and the pattern splits it in just these two
        word = pc.ascii_rtrim(chunks, SIGNS)
        bare = pc.ascii_ltrim(word, " ")
        usual = pc.and_(pc.utf8_is_alpha(bare), pc.less_equal(pc.subtract(pc.binary_length(word), pc.binary_length(bare)), 1))
        cut = pc.greater(pc.binary_length(chunks), pc.binary_length(word)).filter(usual).to_numpy(zero_copy_only=False)
        word, whole = word.filter(usual), chunks.filter(usual)
        ends = [c[len(w) :] for c, w in zip(whole.filter(pa.array(cut)).to_pylist(), word.filter(pa.array(cut)).to_pylist())]
        signs_at, signs = np.full(len(word), -1), pa.array(ends, chunks.type).dictionary_encode()
        signs_at[cut] = signs.indices.to_numpy()
        word = word.dictionary_encode()
        odd = [self.pieces(c) for c in chunks.filter(pc.invert(usual)).to_pylist()]
        more = list({p for parts in odd for p in parts if isinstance(p, str)})
        kinds = [word.dictionary, signs.dictionary, pa.array(more, chunks.type)]
        coded = self.encode_words(pa.concat_arrays(kinds))
        at = len(word.dictionary), len(word.dictionary) + len(signs.dictionary)
        empty = len(coded)
        coded = pa.concat_arrays([coded, pa.array([b""], pa.large_binary())])
        tails = np.where(signs_at < 0, empty, at[0] + signs_at)
        joined = pc.binary_join_element_wise(coded.take(word.indices), coded.take(pa.array(tails)), pa.scalar(b"", pa.large_binary()))
        known = dict(zip(more, coded.slice(at[1], len(more)).to_pylist()))
        rest = [b"".join([known[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in parts]) for parts in odd]
        both = pa.concat_arrays([joined, pa.array(rest, pa.large_binary())])
        mask = usual.to_numpy(zero_copy_only=False)
        place = np.where(mask, np.cumsum(mask) - 1, len(joined) + np.cumsum(~mask) - 1)
        return both.take(pa.array(place))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of whole texts one after the other, and the places where each text's ids start and end."""
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        flat, starts = split.flatten(), split.offsets.to_numpy()
        first = np.zeros(len(flat), bool)
        first[starts[:-1]] = True
        later = flat.filter(pa.array(~first)).dictionary_encode()
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), later.dictionary, pa.scalar(" ", pa.large_string()))
        strange = [_single_space.split(t) for t in texts.filter(odd).to_pylist()]
        loose = pa.array([(" " if i else "") + c for parts in strange for i, c in enumerate(parts)], pa.large_string())
        alone = pa.concat_arrays([flat.filter(pa.array(first)), loose]).dictionary_encode()
        coded = self.encode_chunks(pa.concat_arrays([spaced, alone.dictionary]))
        chunk = np.empty(len(flat), np.int64)
        chunk[~first] = later.indices.to_numpy()
        own = alone.indices.to_numpy() + len(spaced)
        chunk[first] = own[: len(starts) - 1]
        # chunks of all texts in the order of the texts
        mask = odd.to_numpy(zero_copy_only=False)
        numbers = np.zeros(len(texts), np.int64)
        numbers[~mask] = np.diff(starts)
        numbers[mask] = [len(p) for p in strange]
        order = np.empty(numbers.sum(), np.int64)
        of_odd = np.repeat(mask, numbers)
        order[~of_odd], order[of_odd] = chunk, own[len(starts) - 1 :]
        taken = coded.take(pa.array(order))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
        ids = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[: ends[-1]].view("<u4")
        return ids, ends[np.concatenate([[0], np.cumsum(numbers)])] // 4

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def binaries(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ids as binary values."""
    offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


@lru_cache(maxsize=2)
def coder(path: str) -> BytePairCoder:
    """One coder per worker process and file."""
    return BytePairCoder(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; `ids` is the list of token ids. A null or empty text has no ids; rows with equal ids
    are treated one by one; further columns are left out. `vocabulary` is the path of a byte-level vocabulary file that
    every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for part in (p for batch in batches for p in text_slices(batch, SLICE_BYTES)):
            ids, ends = bpe.encode_all(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Broken UTF-8 sequences become U+FFFD; a null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for batch in batches:
            texts = [bpe.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again in the same pass: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    The hashes are over the ids as little-endian unsigned 32-bit integers and over the decoded text in UTF-8. Null counts
    as empty, repeated rows give repeated rows, an empty table gives none.
    """
    schema = pa.schema({"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for part in (p for batch in batches for p in text_slices(batch, SLICE_BYTES)):
            flat, ends = bpe.encode_all(part.column("text"))
            packed = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            counts = pa.array(np.diff(ends), pa.int64())
            ids = pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string())
            texts = pa.array([hashlib.sha256(bpe.decode(p).encode("utf-8")).hexdigest() for p in packed], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), counts, ids, texts], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
