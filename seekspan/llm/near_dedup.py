"""Near-duplicate groups by SuperMinHash signatures, banding and verification on the full shingle sets.

Texts with the same shingle set are one class, represented by the smallest doc_id; only representatives are compared. In
each bucket (equal band of a signature) a centre is compared with all other members, which is linear in the bucket, and
members that end up in one component need no further comparison. Buckets that still hold several components after the
rounds of centres are finished exactly, in blocks of members against blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspan.llm.common import id_and_text, mix64, stored, text_slices, words
from seekspan.llm.components import components

SHINGLE = 5
# similarity of linked sets, in hundredths
LEVEL = 75
# a pair at similarity 0.75 shares none of the bands with probability (1 - 0.75^4)^32 < 0.00001, more similar pairs far less
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
ROUNDS = 2
BLOCK = 256
GOLD = np.uint64(0x9E3779B97F4A7C15)
STEPS = np.arange(1, SLOTS + 1, dtype=np.uint64) * GOLD
CHUNK = 150_000
# keys of documents without an id begin here
NO_ID = 1 << 62


def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as 64-bit hashes. Texts of fewer words are one shingle as a whole; without
    words the set is empty."""
    flat, rows = words(text)
    coded = flat.dictionary_encode()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = hashed[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    sizes = np.bincount(rows, minlength=len(text)) if len(flat) else np.zeros(len(text), np.int64)
    ends = np.cumsum(sizes)
    rolled = np.zeros(max(len(word) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * GOLD + word[k : k + len(rolled)]
    rolled = mix64(rolled)
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist()):
        if size >= SHINGLE:
            out.append(np.unique(rolled[end - size : end - SHINGLE + 1]))
        elif size:
            whole = np.array([size], np.uint64)
            for w in word[end - size : end]:
                whole = whole * GOLD + w
            out.append(mix64(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures, one row of SLOTS values per non-empty set.

    Each element carries a random permutation of the slots, drawn step by step (Fisher-Yates), and puts the value j + r_j
    with a random fraction r_j into the slot of step j; a slot keeps the smallest value. Steps are taken by all elements of
    all sets together, and a set stops as soon as its largest value lies below the next step. Values are step * 2^32 plus
    a 32-bit fraction.
    """
    sizes = np.array([len(s) for s in sets])
    signature = np.full((len(sets), SLOTS), SLOTS << 32, np.uint64)
    flat, owner = np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), sizes)
    order = np.zeros((0, 0), np.uint8)
    cells = signature.reshape(-1)
    for step in range(SLOTS):
        draw = mix64(flat + STEPS[step])
        pick = (step + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - step) >> np.uint64(32))).astype(np.int64)
        if step == 0:
            slot = pick
        else:
            each = np.arange(len(flat))
            slot = order[each, pick].astype(np.int64)
            order[each, pick] = order[:, step]
        np.minimum.at(cells, owner * SLOTS + slot, np.uint64(step << 32) | draw >> np.uint64(32))
        open_ = signature.max(1) >= np.uint64((step + 1) << 32)
        going = open_[owner]
        if not going.any():
            break
        if step == 0:
            flat, owner, pick = flat[going], owner[going], pick[going]
            order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(flat), 1))
            order[np.arange(len(flat)), pick] = 0
        elif not going.all():
            flat, owner, order = flat[going], owner[going], order[going]
    return signature


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    bands = signature.reshape(len(signature), BANDS, ROWS)
    for row in range(ROWS):
        keys = mix64(keys * GOLD + bands[:, :, row])
    return keys.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, low, high, bands) of `docs` (doc_id, text); low and high are a 128-bit digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in text_slices(batch)):
            sets = shingle_sets(part.column("text"))
            sizes = np.array([len(s) for s in sets])
            keys: list = [None] * len(sets)
            full = np.flatnonzero(sizes)
            total = np.cumsum(sizes[full])
            at = 0
            while at < len(full):
                base = total[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(total, base + CHUNK, side="right")))
                for i, row in zip(full[at:stop].tolist(), band_keys(superminhash([sets[j] for j in full[at:stop]]))):
                    keys[i] = row
                at = stop
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2) if digest else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "low", "high", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, low long, high long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(rep, shingles) of `docs` (doc_id, text): the sorted 64-bit hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in text_slices(batch)):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return docs.mapInArrow(run, "rep long, shingles binary")


def linked(a: bytes, b: bytes) -> bool:
    """Whether the sets are similar enough: 100 x intersection >= LEVEL x union."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < LEVEL * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= LEVEL * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of `pairs` (a, b), checked row by row on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = pa.array([linked(p.as_py(), q.as_py()) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    b_sets = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    a_sets = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    # merge joins: adaptive execution splits the rows of a centre with very many members
    joined = pairs.join(b_sets.hint("merge"), "b").join(a_sets.hint("merge"), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def star_pairs(unsettled: DataFrame, turn: int) -> DataFrame:
    """(a, b): in each bucket the member with the turn-th largest weight as centre a, with the members of other components.

    The weight of a member, the number of its neighbours over all buckets, favours the middle of a group."""
    rank = F.struct("weight", (-F.col("rep")).alias("negative"), "component")
    best = unsettled.groupBy("key").agg(F.max(rank).alias("first"))
    for _ in range(turn):
        left = unsettled.join(best, "key").filter(rank < F.col("first"))
        best = left.groupBy("key").agg(F.max(rank).alias("first"))
    centres = best.select("key", (-F.col("first.negative")).alias("a"), F.col("first.component").alias("home"))
    pairs = unsettled.join(centres, "key").filter((F.col("rep") != F.col("a")) & (F.col("component") != F.col("home")))
    return pairs.select("a", F.col("rep").alias("b")).distinct()


def block_links(unsettled: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): all further links within the unsettled buckets, members against members in blocks of BLOCK.

    Blocks are dealt out by a hash, from counts alone: those of a large component have no other members, and two blocks of
    one component need no comparison; members of small components share blocks. Only links come out, and a pair that
    shares several bands is compared in the first of them only."""
    counts = unsettled.groupBy("key", "component").agg(F.count("*").alias("n"))
    few = counts.filter(F.col("n") < BLOCK).groupBy("key").agg(F.sum("n").alias("few"))
    sized = unsettled.join(counts.join(few, "key", "left").hint("merge"), ["key", "component"])
    large = F.col("n") >= BLOCK
    share = F.pmod(F.xxhash64("rep"), F.ceil(F.when(large, F.col("n")).otherwise(F.col("few")) / BLOCK))
    placed = sized.withColumn("block", F.xxhash64(F.when(large, F.col("component")), share)).drop("n", "few")
    shape = placed.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    other = shape.select("key", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    same = (F.col("low") == F.col("high")) & (F.col("low2") == F.col("high2")) & (F.col("low") == F.col("low2"))
    tasks = shape.join(other, "key").filter((F.col("block") <= F.col("block2")) & ~same).select("key", "block", "block2")
    first = tasks.join(placed, ["key", "block"]).select("key", "block", "block2", "rep", "component", F.lit(0).alias("side"))
    second = placed.withColumnRenamed("block", "block2")
    second = tasks.filter("block <> block2").join(second, ["key", "block2"]).select("key", "block", "block2", "rep", "component", F.lit(1).alias("side"))
    members = first.unionByName(second).join(sets.hint("merge"), "rep")

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("side", "rep", "component", "shingles", "bands"))))
        single = table.column("block")[0] == table.column("block2")[0]
        left = [r for r in rows if r[0] == 0]
        right = left if single else [r for r in rows if r[0] == 1]
        found = []
        for _, rep, component, shingles, bands in left:
            for _, rep2, component2, shingles2, bands2 in right:
                if component == component2 or (single and rep >= rep2):
                    continue
                if next(x for x, y in zip(bands, bands2) if x == y) == key and linked(shingles, shingles2):
                    found.append((rep, rep2))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return members.groupBy("key", "block", "block2").applyInArrow(run, "a long, b long")


def key(doc_id: Column, text: Column) -> Column:
    """A key for each document: its doc_id, or without one a number beyond all ids (2^62 and more) drawn from its text, so that
    equal texts without ids are one document."""
    drawn = F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    return F.coalesce(doc_id.cast("long"), drawn)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Documents are linked when 100 x intersection >= LEVEL x union of their shingle sets; `component_id` is the smallest
    doc_id that can be reached over links, and that document is kept. A null text, or one without words, has no shingles,
    is linked with nothing and kept. A doc_id names one document: rows that repeat it are in one group. Rows without a
    doc_id are linked like all others; a group in which no row has one has no component_id, and its first text is kept. Ids
    are less than 2^62. An empty table gives none.
    """
    rows = id_and_text(docs, id_col, text_col)
    found = grouped(rows.withColumn("doc_id", key(F.col("doc_id"), F.col("text"))))
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return found.select(known("doc_id"), "n_shingles", known("component_id"), "kept")


def grouped(rows: DataFrame) -> DataFrame:
    """`groups` of rows (doc_id, text) without nulls, by their keys."""
    signed = stored(sign(rows), "signatures")
    own = ["n_shingles", "low", "high"]
    classes = signed.filter("n_shingles > 0").groupBy(*own).agg(F.min(F.struct("doc_id", "bands")).alias("first"))
    classes = stored(classes.select(*own, F.col("first.doc_id").alias("rep"), F.col("first.bands").alias("bands")), "classes")
    spread = classes.select("rep", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(spread.join(shared.hint("merge"), "key"), "bucket-members")
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    members = stored(members.join(weights.hint("merge"), "rep").select("key", "rep", "weight"), "weighted-members")
    involved = weights.select("rep").join(classes.select("rep", "bands"), "rep")
    texts = rows.join(involved.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = stored(full_sets(texts).dropDuplicates(["rep"]).join(involved, "rep"), "shingle-sets")

    names: DataFrame | None = None
    links: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        if names is None:
            open_ = members.withColumn("component", F.col("rep"))
        else:
            known = names.select(F.col("node").alias("rep"), "component")
            labelled = members.join(known.hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
            several = labelled.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high")
            open_ = stored(labelled.join(several.select("key").hint("merge"), "key", "left_semi"), "unsettled")
        if turn < ROUNDS:
            found = verify(stored(star_pairs(open_, turn), "pairs"), sets)
        else:
            found = block_links(open_, sets)
        found = stored(found, "found-links")
        links = found if links is None else links.unionByName(found)
        names = components(links)

    joined = signed.join(classes.select(*own, "rep").hint("merge"), own, "left")
    named = joined.join(names.select(F.col("node").alias("rep"), F.col("component").alias("_name")).hint("merge"), "rep", "left")
    component = F.coalesce("_name", "rep", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
