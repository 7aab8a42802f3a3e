"""Personal data: values found by their form, and terms that give such values away.

A term discloses an entity (an address, a number) when the corpus shows that who reads the term can infer the entity: it
stands near the entity in several different contexts, most documents with the term hold the entity, and knowing the term
tells most of what there is to learn about the entity, which is the less the more documents hold it. Such terms are generalised in the documents that hold
the entity.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspan.llm.common import id_and_text, row_type, stored, text_slices, words

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"
# words on either side of a value that are its context
CONTEXT = 10
# different contexts in which a term must stand with the entity
MIN_CONTEXTS = 3
# share of a term's documents that hold the entity
MIN_POSTERIOR = 0.5
# gain of information, as a share of what is to be learned: -log2 of the share of all documents that hold the entity. For an
# entity in one of 32 documents or fewer, the posterior is the stricter condition
MIN_GAIN = 0.8
# bits by which all documents with the term together speak against chance (Chernoff's bound: a chance of 1 in 16). A term
# whose documents all hold an entity that a third of all documents hold has them with three documents
MIN_EVIDENCE = 4.0
SLICE_BYTES = 4 << 20

LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_other = re.compile(r"[^0-9]+")
_word = re.compile(r"[^\x20\x09-\x0D]+")
# what a term loses at its ends
EDGES = "\"'.,;:!?()[]{}<>|*_-+=/\\#"


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(x // 10 + x % 10 for x in (2 * int(d) for d in digits[-2::-2]))) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From sign to sign: the name before it as far back as it goes, then the domain. The same as looking from left to
    right for name, sign and domain, but linear in texts with long runs of letters."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL:
            first -= 1
        domain = _domain.match(text, at + 1) if first < at else None
        if domain:
            yield Span("email", first, domain.end())
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Values by their form, by kind and then by start."""
    found = list(emails(text)) if "@" in text else []
    for m in _ip.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            found.append(Span("ip", *m.span()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _other.sub("", m[0])) <= 19 and luhn(digits):
            found.append(Span("card", *m.span()))
    for m in _phone.finditer(text) if "+" in text else ():
        if 8 <= len(_other.sub("", m[0])) <= 15:
            found.append(Span("phone", *m.span()))
    return found


def entity(text: str, span: Span) -> str:
    """What makes two values the same: letters in lower case for addresses, the digits for numbers."""
    value = text[span.start : span.end]
    value = value.lower() if span.kind == "email" else _other.sub("." if span.kind == "ip" else "", value)
    return hashlib.sha256(f"{span.kind}:{value}".encode()).hexdigest()[:32]


def term_of(word: str) -> str:
    """The form in which terms are counted: any word with a letter or a digit, without what surrounds it. Empty for words
    that are no terms, addresses among them."""
    bare = word.strip(EDGES)
    return bare.lower() if "@" not in bare and any(map(str.isalnum, bare)) else ""


def contexts(text: str, spans: list[Span]) -> Iterator[tuple[list[str], list[str]]]:
    """For each value, the whole words just before and just after it."""
    places = [m.span() for m in _word.finditer(text)] if spans else []
    starts, ends = [a for a, _ in places], [b for _, b in places]
    for span in spans:
        before, after = bisect_right(ends, span.start), bisect_left(starts, span.end)
        yield [text[a:b] for a, b in places[max(0, before - CONTEXT) : before]], [text[a:b] for a, b in places[after : after + CONTEXT]]


def evidence(docs: DataFrame) -> DataFrame:
    """(entity, doc_id, context, terms): a row for every value in `docs` (doc_id, text), with the terms next to it, and for
    every document with values a row with all of its terms, of which entity and context are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_slices(b, SLICE_BYTES)):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                spans = base_spans(text)
                for span, (before, after) in zip(spans, contexts(text, spans)):
                    terms = sorted({t for w in before + after if (t := term_of(w))})
                    rows.append((entity(text, span), doc_id, hashlib.sha256(" ".join(before + ["@"] + after).encode("utf-8")).hexdigest()[:32], terms))
                if spans:
                    rows.append((None, doc_id, None, sorted({t for w in set(_word.findall(text)) if (t := term_of(w))})))
            columns = zip(*rows) if rows else [[]] * 4
            kinds = pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["entity", "doc_id", "context", "terms"])

    return docs.mapInArrow(run, "entity string, doc_id long, context string, terms array<string>")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, docs_with_term) over all of `docs` (doc_id, text), summed up within batches before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in text_slices(batch, SLICE_BYTES)):
            flat, rows = words(part.column("text"))
            coded = flat.dictionary_encode()
            terms: dict[str, int] = {"": 0}
            number = np.fromiter((terms.setdefault(term_of(w), len(terms)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            pairs = np.unique(rows.astype(np.int64) * len(terms) + number[coded.indices.to_numpy()]) if len(flat) else np.zeros(0, np.int64)
            counts = np.bincount(pairs % len(terms), minlength=len(terms))[1:]
            yield pa.RecordBatch.from_arrays([pa.array(list(terms)[1:], pa.string()), pa.array(counts, pa.int64())], names=["term", "n"])

    return docs.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("docs_with_term"))


def disclosures(docs: DataFrame) -> DataFrame:
    """(doc_id, terms): for every document with values, the terms that disclose one of them.

    A context that occurs again and again, as in copies, is one context. What stands near an entity is a candidate only;
    the documents that hold both are counted wherever the term stands in them. `docs` are (doc_id, text)."""
    seen = stored(evidence(holders(docs)), "evidence")
    found = seen.filter(F.col("entity").isNotNull())
    # salted by context through the first grouping, so that a value that a third of all documents hold is spread
    near = found.select("entity", "context", F.explode("terms").alias("term")).groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    several = near.groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= MIN_CONTEXTS)
    candidates = stored(several.select("entity", "term"), "disclosure-candidates")
    corpus = term_counts(docs).join(candidates.select("term").distinct().hint("merge"), "term", "left_semi")
    holding = found.select("entity", "doc_id").distinct().groupBy("entity").agg(F.count("*").alias("docs_with_entity"))
    # not more documents can hold both than hold the entity
    possible = F.col("docs_with_entity") >= MIN_POSTERIOR * F.col("docs_with_term")
    judged = stored(candidates.join(corpus, "term").join(holding, "entity").filter(possible), "disclosure-pairs")
    wanted = judged.select("term").distinct().hint("merge")
    words_of = seen.filter(F.col("entity").isNull()).select("doc_id", F.explode("terms").alias("term"))
    # by document from here on, which spreads entities and terms however many documents hold them
    present = words_of.join(wanted, "term", "left_semi").repartition("doc_id").distinct()
    held = found.select("entity", "doc_id").distinct()
    open_ = held.join(judged.select("entity").distinct().hint("merge"), "entity", "left_semi")
    together = present.join(open_.hint("merge"), "doc_id").groupBy("entity", "term").agg(F.count("*").alias("together"))
    posterior = F.col("together") / F.col("docs_with_term")
    judged = judged.join(together.hint("merge"), ["entity", "term"])
    telling = stored(judged.filter(discloses(posterior, F.col("docs_with_entity") / F.lit(docs.count()))).select("entity", "term"), "disclosing-terms")
    told = held.join(telling.hint("merge"), "entity")
    return told.groupBy("doc_id").agg(F.collect_set("term").alias("terms"))


def discloses(posterior: Column, prior: Column) -> Column:
    """Whether a term tells of an entity that a share of `prior` of all documents holds. Where all of them hold it, there is
    nothing to tell."""
    gain = F.log2(posterior / prior)
    others = F.when(posterior < 1, (1 - posterior) * F.log2((1 - posterior) / (1 - prior))).otherwise(0.0)
    against_chance = F.col("docs_with_term") * (posterior * gain + others)
    return (prior < 1) & (posterior >= MIN_POSTERIOR) & (gain >= -MIN_GAIN * F.log2(prior)) & (against_chance >= MIN_EVIDENCE)


def holders(docs: DataFrame) -> DataFrame:
    """Documents that can hold a value at all: each kind has a digit or an at sign."""
    return docs.filter(F.col("text").rlike("[0-9@]"))


def term_spans(text: str, terms: list[str], base: list[Span]) -> list[Span]:
    """Places of the terms outside of the values."""
    if not terms:
        return []
    wanted, taken, found = set(terms), sorted((s.start, s.end) for s in base), []
    at = 0
    for m in _word.finditer(text):
        if term_of(m[0]) not in wanted:
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip(EDGES))
        end = m.end() - (len(m[0]) - len(m[0].rstrip(EDGES)))
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            found.append(Span(TERM, start, end))
    return found


def mask(text: str, spans: list[Span]) -> str:
    """`text` with every value or term replaced by its kind; overlapping spans become one, named after the first. Values
    that only come to light when their surroundings are masked are masked as well."""
    while spans:
        out, at = [], 0
        for span in sorted(spans, key=lambda s: (s.start, -s.end)):
            if span.start >= at:
                out += [text[at : span.start], f"<{span.kind.upper()}>"]
            at = max(at, span.end)
        text = "".join([*out, text[at:]])
        spans = base_spans(text)
    return text


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, spans, masked) of every row, and with `whole` the input row as a struct `_row`: all spans, values by kind and start and then the disclosing terms by
    start, as (kind, start, end) in code points, and the text with all of them masked.

    A null text counts as empty and has no spans. Rows that repeat a doc_id share its disclosing terms. Texts without a
    digit or an at sign go through unchanged and unshuffled.
    """
    rows = id_and_text(docs, id_col, text_col, whole)
    telling = stored(disclosures(rows.select("doc_id", "text")), "disclosures")
    row = ["_row"] * whole
    span = pa.struct({"kind": pa.string(), "start": pa.int32(), "end": pa.int32()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_slices(b, SLICE_BYTES)):
            spans, masked = [], []
            for text, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist()):
                base = base_spans(text)
                spans.append(base + term_spans(text, terms or [], base))
                masked.append(mask(text, spans[-1]))
            columns = [batch.column("doc_id"), pa.array(spans, pa.list_(span)), pa.array(masked, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in row], names=["doc_id", "spans", "masked", *row])

    schema = "doc_id long, spans array<struct<kind: string, start: int, end: int>>, masked string" + f", _row {row_type(docs)}" * whole
    searched = holders(rows).join(telling, "doc_id", "left").select("doc_id", "text", "terms", *row).mapInArrow(run, schema)
    empty = F.from_json(F.lit("[]"), "array<struct<kind: string, start: int, end: int>>")
    others = rows.filter(~F.col("text").rlike("[0-9@]")).select("doc_id", empty.alias("spans"), F.col("text").alias("masked"), *row)
    return searched.unionByName(others)
