"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A word's tokens are found from left to right: an Aho-Corasick automaton tells every vocabulary piece that starts at every
place; the longest one that may follow the last token is taken. Two tokens may stand next to each other if merging their
joined characters from scratch gives just those two again. Where no piece fits, the last token is taken back and a bit marks
its end as failed, so no place is tried twice. A sequence of pairwise compatible tokens is what the merges themselves give:
merges of the parts never meet, whatever the order in which they are done.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from seekspan.llm.common import id_and_text, text_slices

SLICE_BYTES = 4 << 20
# the mark that stands for a space, at the start of a word
SPACE = "▁"
# remembered words, their longest length, and remembered pairs of tokens, for each worker process
KNOWN_WORDS, LONGEST_KNOWN, KNOWN_PAIRS = 1 << 20, 64, 1 << 20

# every byte that is no UTF-8 becomes a replacement mark of its own
codecs.register_error("mark_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class _Words(dict):
    """Word -> token ids as little-endian bytes; unknown words are encoded when they are first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= LONGEST_KNOWN:
            self[word] = ids
        return ids


class PieceCoder:
    """Encoder and decoder of one merge-type model file without text normalisation."""

    def __init__(self, path: str):
        processor = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = model_pb2.ModelProto.FromString(f.read())
        kinds = model_pb2.ModelProto.SentencePiece
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != model_pb2.TrainerSpec.BPE:
            raise ValueError("a model of merge type is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("the model must not normalise its texts")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with user-defined or unused pieces, or with spaces as suffixes, are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.begin, self.end, self.unknown = processor.bos_id(), processor.eos_id(), processor.unk_id()
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        # the higher the score, the earlier the merge; equal scores are merged from the left
        scores = sorted({model.pieces[i].score for i in self.ids.values()}, reverse=True)
        place = {score: n for n, score in enumerate(scores)}
        self.rank = {piece: place[model.pieces[i].score] for piece, i in self.ids.items()}
        self.names = {i: piece for piece, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merge(piece) == [piece]:  # no other is ever a token
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # a text falls into words before each run of marks, unless some piece reaches over such a place
        across = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids)
        self.word = re.compile("(?s).+" if across else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        # and into parts where letters and other characters meet, but at pairs of them that some piece holds
        letters, others = f"[^\\W_{SPACE}]", f"(?:(?!{SPACE})[\\W_])"
        borders = re.compile(f"(?={letters}{others}|{others}{letters})(?s:..)")
        self.part = re.compile(f"{SPACE}*(?:{letters}+|{others}+)|{SPACE}+")
        mixed = {m for piece in self.ids for m in borders.findall(piece)}
        self.mixed = re.compile("|".join(map(re.escape, sorted(mixed))) or "(?!)")
        self.whole = across
        surface = model.trainer_spec.unk_surface
        self.spoken = [
            self.names[i].replace(SPACE, " ") if i in self.names else surface if p.type == kinds.UNKNOWN else ""
            for i, p in enumerate(model.pieces)
        ]
        self.shown = [text.encode() for text in self.spoken]
        for i, b in self.byte_of.items():
            self.shown[i] = bytes([b])
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        pack = lambda i: int(i).to_bytes(4, "little")
        self.packed = {piece: pack(i) for piece, i in self.ids.items()}
        self.packed_bytes = {b: pack(i) for b, i in self.bytes.items()}
        self.packed_unknown = pack(self.unknown)
        self.known, self.pairs = _Words(self.encode_word), {}

    def merge(self, text: str) -> list[str]:
        """The definition: the adjacent pair with the best piece is merged, the leftmost of equal ones, until none is left."""
        parts = list(text)
        while True:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return parts
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both tokens gives the two tokens."""
        key = left, right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(left + right) == [left, right]
        return found

    def split(self, word: str) -> list[str]:
        """The tokens of a word, as text; a character without a piece is a token of its own."""
        # what starts at each place, shorter ones first; the longest is taken from the end and not tried there again
        starting: list[list[str]] = [[] for _ in word]
        for last, piece in self.automaton.iter(word):
            starting[last - len(piece) + 1].append(piece)
        for at, char in enumerate(word):
            if not starting[at] or len(starting[at][0]) > 1:
                starting[at].insert(0, char)
        n, failed = len(word), bytearray(len(word) + 1)
        tokens: list[str] = []
        at, left, known = 0, "", self.pairs.get
        while at < n:
            choice = starting[at]
            while choice:
                token = choice.pop()
                if failed[at + len(token)]:
                    continue
                fits = known((left, token)) if left else True
                if fits or (fits is None and self.compatible(left, token)):
                    tokens.append(token)
                    at += len(token)
                    left = token
                    break
            else:
                failed[at] = 1
                at -= len(tokens.pop())
                left = tokens[-1] if tokens else ""
        return tokens

    def encode_word(self, word: str) -> bytes:
        """Ids of the tokens of a word as little-endian unsigned 32-bit integers."""
        parts = [] if self.whole or self.mixed.search(word) else self.part.findall(word)
        if len(parts) > 1:
            out = b"".join(map(self.known.__getitem__, parts))
        else:
            out = b"".join([self.packed[t] if t in self.packed else self.spelled(t) for t in self.split(word)])
        unknown = self.packed_unknown
        while not self.bytes and unknown * 2 in out:  # adjacent unknown characters are one unknown token
            out = out.replace(unknown * 2, unknown)
        return out

    def spelled(self, char: str) -> bytes:
        """A character without a piece: its bytes, or the unknown token."""
        return b"".join(self.packed_bytes[b] for b in char.encode()) if self.bytes else self.packed_unknown

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text, without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.word.findall(self.prefix + text.replace(" ", SPACE))))

    def encode(self, text: str, ends: bool = True) -> list[int]:
        ids = np.frombuffer(self.encode_bytes(text), "<u4").tolist()
        return [self.begin, *ids, self.end] if ends else ids

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids: control tokens are silent, one space at the very start goes, bytes are put together."""
        first = next((i for i in ids if i not in self.control), None)
        if self.control.isdisjoint(ids[1:-1]):
            runs = [ids]
        else:  # bytes on both sides of a control token are no part of one character
            cuts = [at for at, i in enumerate(ids) if i in self.control]
            runs = [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)])]
        joined = "".join(b"".join(map(self.shown.__getitem__, run)).decode("utf-8", "mark_each_byte") for run in runs)
        return joined[1:] if self.prefix and first in self.names and self.names[first].startswith(SPACE) else joined


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    """One coder per worker process and file."""
    return PieceCoder(path)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True) -> DataFrame:
    """(doc_id, ids) of every row, with the begin and end ids unless `ends` is off. A null text counts as empty, equal rows are
    treated one by one, an empty table gives none, further columns are left out. `model` is a file that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = coder(model)
        for part in (p for batch in batches for p in text_slices(batch, SLICE_BYTES)):
            lists = pa.array([pieces.encode(t, ends) for t in part.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). A byte token that is no part of a character becomes U+FFFD; a null list gives an
    empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = coder(model)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text with begin and end ids and decode the ids again in the same pass: (doc_id, n_tokens, ids_sha256,
    decoded_sha256).

    The hashes are over the ids as little-endian unsigned 32-bit integers and over the decoded text in UTF-8. A text is taken
    whole, however long; a null one counts as empty and has the two end ids; a null id stays null; repeated rows give repeated
    rows; an empty table gives none. Ties between pieces of one score are settled from the left, as the library does.
    """
    schema = pa.schema({"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = coder(model)
        first, last = (int(i).to_bytes(4, "little") for i in (pieces.begin, pieces.end))
        for part in (p for batch in batches for p in text_slices(batch, SLICE_BYTES)):
            counts, ids, texts = [], [], []
            for text in part.column("text"):
                packed = first + pieces.encode_bytes(text.as_py()) + last
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded = pieces.decode(np.frombuffer(packed, "<u4").tolist())
                texts.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
