"""Language identification of words, spans and documents.

Each word gets a score for every language from its character trigrams; the scripts that a language was seen with narrow
the candidates; and a Viterbi pass with a penalty for every change of language labels the words of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspan.llm.common import id_and_text, row_type, text_slices, words

UNKNOWN = "und"
# about so many labelled rows of each language are learned from, chosen by a hash (all of them if there are fewer)
SAMPLE_PER_LANGUAGE = 1500
SWITCH_PENALTY = 12.0
# a script counts as used by a language from this share of its letters
SCRIPT_SHARE = 0.01
IMPOSSIBLE = -1e4
SLICE_BYTES, TRAINING_SLICE_BYTES = 4 << 20, 1 << 20

# Letter ranges of scripts (first and last code point)
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "ethiopic": [(0x1200, 0x139F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point: 0 for no letter, else 2 + the number of its script, 1 for letters of other scripts."""
    table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
    for number, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            table[first : last + 1] *= 2 + number
    return table


@dataclass
class Features:
    """Trigrams of a list of words. Trigrams do not cross words; a blank stands for either end of one."""

    keys: np.ndarray
    word: np.ndarray  # the word of each trigram
    letters: np.ndarray  # letters of each word
    script: np.ndarray  # main script of each word


def features(texts: list[str]) -> Features:
    kinds = letter_table()
    joined = "\n".join(texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = points == 10
    word = np.cumsum(ends) - ends
    kind = kinds[points]
    keep = kind > 0
    points, word, kind = points[keep].astype(np.int64), word[keep], kind[keep]
    n = len(texts)
    letters = np.bincount(word, minlength=n)
    by_script = np.bincount(word * (len(SCRIPTS) + 2) + kind, minlength=n * (len(SCRIPTS) + 2)).reshape(n, -1)
    before = np.concatenate([[-1], word[:-1]]) == word
    after = np.concatenate([word[1:], [-1]]) == word
    left = np.where(before, np.concatenate([[0], points[:-1]]), 32)
    right = np.where(after, np.concatenate([points[1:], [0]]), 32)
    return Features(left << 42 | points << 21 | right, word, letters, by_script.argmax(1))


@dataclass
class LanguageModel:
    """Trigram log-probabilities and scripts of the learned languages. Its size is bounded by the training sample."""

    languages: list[str]
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    scripts: np.ndarray = field(default_factory=lambda: np.zeros((len(SCRIPTS) + 2, 0), bool))
    default: int = 0

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each word by language, letters of each word)."""
        f = features(texts)
        at = np.minimum(np.searchsorted(self.keys, f.keys), len(self.keys) - 1)
        logs = np.where((self.keys[at] == f.keys)[:, None], self.logs[at], self.unseen)
        scores = np.zeros((len(texts), len(self.languages)), np.float32)
        starts = np.flatnonzero(np.concatenate([[True], f.word[1:] != f.word[:-1]])) if len(f.word) else np.zeros(0, int)
        if len(starts):
            scores[f.word[starts]] = np.add.reduceat(logs, starts, axis=0)
        allowed = self.scripts[f.script]
        known = allowed.any(1)
        scores[known] = np.where(allowed[known], scores[known], IMPOSSIBLE * np.maximum(f.letters[known], 1)[:, None])
        return scores, f.letters


def labelled(docs: DataFrame, training: Column) -> DataFrame:
    """(text, lang) of about SAMPLE_PER_LANGUAGE training rows of each language, chosen by a hash of the row where they lie."""
    rows = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.select("text", "lang")
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, float(SAMPLE_PER_LANGUAGE) / n * (1 << 20))])
    return rows.filter(pick < shares[F.col("lang")]).select("text", "lang")


def fit(docs: DataFrame, training: Column) -> LanguageModel:
    """Learn from the text and lang of the rows of `docs` (doc_id, text, lang) where `training` holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in text_slices(batch, TRAINING_SLICE_BYTES)):
            langs = np.array(part.column("lang").to_pylist())
            flat, rows = words(part.column("text"))
            f = features(flat.to_pylist())
            for lang in np.unique(langs):
                own = (langs == lang)[rows]
                mine = own[f.word]
                keys, n = np.unique(f.keys[mine], return_counts=True)
                script = np.bincount(f.script[own], weights=f.letters[own], minlength=len(SCRIPTS) + 2)
                used = np.flatnonzero(script)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([str(lang)] * (len(keys) + len(used))),
                    "key": pa.array(np.concatenate([keys, -1 - used])),
                    "n": pa.array(np.concatenate([n, script[used]]).astype(np.int64)),
                })

    counted = labelled(docs, training).mapInArrow(count, "lang string, key long, n long")
    rows = counted.groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    grams = rows[rows["key"] >= 0]
    if grams.empty:
        return LanguageModel([])
    keys = np.unique(grams["key"].to_numpy())
    number = {lang: i for i, lang in enumerate(languages)}
    table = np.zeros((len(keys), len(languages)))
    table[np.searchsorted(keys, grams["key"]), grams["lang"].map(number)] = grams["n"]
    totals = table.sum(0) + 0.5 * (len(keys) + 1)
    scripts = np.zeros((len(SCRIPTS) + 2, len(languages)))
    for row in rows[rows["key"] < 0].itertuples():
        scripts[-1 - row.key, number[row.lang]] = row.n
    used = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(0), 1)
    used[0] = False
    logs = np.log((table + 0.5) / totals).astype(np.float32)
    return LanguageModel(languages, keys, logs, np.log(0.5 / totals).astype(np.float32), used, int(table.sum(0).argmax()))


def viterbi(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of every word of several texts at once: word by word, over all texts that are still going on."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = starts[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # texts with more words than t
    come_from = np.empty(scores.shape, np.int8 if scores.shape[1] < 128 else np.int32)
    labels = np.empty(len(scores), np.int32)
    best = scores[begin[: active[0]]].copy() if len(active) else None
    own = np.arange(scores.shape[1])
    for t in range(1, len(active)):
        n = active[t]
        now = best[:n]
        top = now.argmax(1)
        switched = now[np.arange(n), top][:, None] - penalty
        spot = begin[:n] + t
        come_from[spot] = np.where(now >= switched, own, top[:, None])
        best[:n] = np.maximum(now, switched) + scores[spot]
    if best is None:
        return labels
    last = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        spot = begin[:n] + t
        labels[spot] = last[:n]
        if t:
            last[:n] = come_from[spot, last[:n]]
    return labels


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; with `whole` also the input row as a struct `_row`.

    `spans` are the runs of words of one language: (lang, first, last) by word number, blank-separated words being counted
    from 0; words without letters belong to no span of their own. `lang_pred` is the language with the most letters (the
    first by name of several), `score` its share of the letters. A null text, or one without letters, is `und` with score
    0 and no spans, and so is every text if nothing was learned. Letters of a script that no learned language uses count
    for all languages alike. Repeated rows are labelled one by one.
    """
    span = pa.struct({"lang": pa.string(), "first": pa.int32(), "last": pa.int32()})
    names_out = ["doc_id", "lang_pred", "score", "spans"] + ["_row"] * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in text_slices(batch, SLICE_BYTES)):
            n, found = part.num_rows, [(UNKNOWN, 0.0, [])] * part.num_rows
            flat, rows = words(part.column("text"))
            if len(flat) and model.languages:
                coded = flat.dictionary_encode()
                scores, letters = model.word_scores(coded.dictionary.to_pylist())
                codes = coded.indices.to_numpy()
                spelled = letters[codes] > 0
                firsts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
                numbers = np.arange(len(rows)) - firsts[rows]
                codes, rows, numbers = codes[spelled], rows[spelled], numbers[spelled]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
                labels = viterbi(scores[codes], bounds[:-1], bounds[1:])
                width = len(model.languages)
                totals = np.bincount(rows * width + labels, weights=letters[codes], minlength=n * width).reshape(n, width)
                cut = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (labels[1:] != labels[:-1])])) if len(rows) else []
                stop = np.concatenate([cut[1:], [len(rows)]]) if len(rows) else []
                spans: list[list] = [[] for _ in range(n)]
                for a, b in zip(cut, stop):
                    spans[rows[a]].append((model.languages[labels[a]], int(numbers[a]), int(numbers[b - 1])))
                top, spelt = totals.argmax(1), totals.sum(1)
                found = [
                    (model.languages[top[i]], float(totals[i, top[i]] / spelt[i]), spans[i]) if spelt[i] else (UNKNOWN, 0.0, [])
                    for i in range(n)
                ]
            names, shares, runs = zip(*found) if found else ([], [], [])
            columns = [part.column("doc_id"), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(runs, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns + [part.column(c) for c in names_out[4:]], names=names_out)

    out = "doc_id long, lang_pred string, score double, spans array<struct<lang: string, first: int, last: int>>"
    return id_and_text(docs, id_col, text_col, whole).mapInArrow(run, out + f", _row {row_type(docs)}" * whole)
