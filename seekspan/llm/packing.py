"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so an instance of any size is described by how many pieces there are of each
length. The reduction and the best-fit work on that table of at most `capacity` rows and yield patterns ("so many
sequences filled like this"); the pieces themselves stay distributed and look their place up by length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspan.llm.bpe import SLICE_BYTES, coder
from seekspan.llm.common import buckets, id_and_text, stored, text_slices

CAPACITY = 1024
END_ID = 2

Pattern = tuple[int, list[tuple[int, int]]]  # (number of sequences, [(length, pieces of it in each)])


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its token ids and one end id, cut into pieces of
    `capacity` tokens when they are more than that; the first piece takes the odd rest. A null or empty text is the end id
    alone. Repeated rows are cut one by one."""
    schema = pa.schema({"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        end = np.array([END_ID], "<u4")
        for part in (p for batch in batches for p in text_slices(batch, SLICE_BYTES)):
            flat, ends = bpe.encode_all(part.column("text"))
            rows = []
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                ids = np.concatenate([flat[a:b], end])
                first = (len(ids) - 1) % capacity + 1
                starts = [0, *range(first, len(ids), capacity)]
                for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((doc_id, k, s, e - s, zlib.crc32(ids[s:e])))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_dominated(stock: dict[int, int], capacity: int) -> list[Pattern]:
    """Martello-Toth reduction: fix sets that provably dominate every other way to fill the sequence of a piece.

    For a piece of length s, by how many further pieces can go with it at most:
    none: it stays alone. One: the longest that fits dominates. Any number: a single piece that fills the sequence exactly
    dominates. Two: the longest single piece dominates if no feasible pair is longer than it; and it dominates together
    with a second piece if that is as long as any second piece can be. `stock` (length to number) is shrunk in place.
    """
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for s in sorted(stock, reverse=True):
            while stock.get(s):
                choice = _dominating(stock, s, capacity)
                if choice is None:
                    break
                need: dict[int, int] = {}
                for x in choice:
                    need[x] = need.get(x, 0) + 1
                times = min(stock[x] // k for x, k in need.items())
                fixed.append((times, sorted(need.items(), reverse=True)))
                for x, k in need.items():
                    stock[x] -= times * k
                    if not stock[x]:
                        del stock[x]
                changed = True
    return fixed


def _dominating(stock: dict[int, int], s: int, capacity: int) -> list[int] | None:
    room = capacity - s
    rest = {x: n - (x == s) for x, n in stock.items() if x <= room and n > (x == s)}
    if not rest:
        return [s]
    lengths = sorted(rest)
    longest = lengths[-1]
    if longest == room:
        return [s, longest]
    smallest = [x for x in lengths[:3] for _ in range(min(3, rest[x]))][:3]
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return [s, longest]
    if len(smallest) > 2 and sum(smallest) <= room:
        return None
    # at most two more pieces: the best total of a pair, and the longest possible shorter piece of a pair
    best, second, j = 0, 0, len(lengths) - 1
    for i, x in enumerate(lengths):
        while j >= 0 and x + lengths[j] > room:
            j -= 1
        if j < i or (j == i and rest[x] < 2 and j == 0):
            break
        partner = lengths[j] if j > i or rest[x] > 1 else None
        if partner is not None:
            best, second = max(best, x + partner), max(second, x)
    if best <= longest:
        return [s, longest]
    if second and second != longest and longest + second <= room:
        return [s, longest, second]
    return None


def best_fit(stock: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit by decreasing length. Sequences filled alike are kept together: each piece goes where it leaves the least
    room, and since that sequence is then the tightest, it takes as many pieces of that length as fit."""
    open_: dict[int, list[Pattern]] = {}
    for s in sorted(stock, reverse=True):
        left = stock[s]
        while left:
            room = min((r for r in open_ if r >= s), default=None)
            if room is None:
                room, count, items = capacity, -(-left // (capacity // s)), []
            else:
                count, items = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            each = room // s
            full = min(count, left // each)
            if full:
                open_.setdefault(room - each * s, []).append((full, [*items, (s, each)]))
                left, count = left - full * each, count - full
            if left and count:
                open_.setdefault(room - left * s, []).append((1, [*items, (s, left)]))
                left, count = 0, count - 1
            if count and items:
                open_.setdefault(room, []).append((count, items))
    return [p for patterns in open_.values() for p in patterns]


def plan_patterns(stock: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that together take exactly the pieces of `stock`."""
    stock = {s: n for s, n in stock.items() if n}
    fixed = reduce_dominated(stock, capacity)
    return fixed + best_fit(stock, capacity)


def place_table(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, pieces per sequence, offset of the first of them) sorted by length
    and rank: where the n-th piece of a length goes. Its size follows the number of lengths, not of pieces."""
    rows, taken, sequence = [], {}, 0
    for count, items in patterns:
        offset = 0
        for s, k in items:
            rows.append((s, taken.get(s, 0), sequence, k, offset))
            taken[s] = taken.get(s, 0) + count * k
            offset += s * k
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (stored; with doc_id, piece, length) with sequence_id and offset.

    Every piece gets a rank among those of its length: lengths are split by a hash of the piece into as many parts as there
    are shuffle partitions, so that a length that a third of all pieces share is ranked in many tasks. An empty table
    gives an empty table.
    """
    spark = pieces.sparkSession
    parts = buckets(spark)
    salted = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = stored(salted.groupBy("length", "_part").agg(F.count("*").alias("_n")), "packing-counts")
    # at most `capacity` rows
    stock = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = place_table(plan_patterns(stock, capacity))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(bases.hint("merge"), ["length", "_part"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_rank")).alias("_rank"))
    lengths, first = table[:, 0], table[:, 1]
    names = pieces.columns
    step = int(first.max()) + 1 + sum(stock.values()) if len(table) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lengths * step + first
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            _, start, sequence, each, offset = table[np.searchsorted(keys, length * step + rank, side="right") - 1].T
            turn = rank - start
            columns = {c: batch.column(c) for c in names}
            columns |= {"sequence_id": pa.array(sequence + turn // each), "offset": pa.array(offset + turn % each * length)}
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id long", "offset long"])
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack all documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(stored(cut_documents(docs, vocabulary, capacity, id_col, text_col), "packing-pieces"), capacity)
