"""Conversation structure repair by a run-length dynamic programme.

Rows of a conversation are symbols: the first letter of the role, and whether the row must be deleted or is truncated. Equal
consecutive symbols form runs. Four states (nothing yet, after s, u, a) make each symbol a 4 x 4 matrix over (min, +); its
binary powers are kept, so a run of n rows is passed in log n steps. Choices are then unrolled from the left along the costs
that remain.

Nothing holds a whole conversation: equal rows are counted before they are sorted, rows are dealt out by ranges of their
order, so a large conversation lies in many partitions, and each partition's part of it is one matrix. Only these matrices,
at most one for each partition, meet in one task; the audit is unrolled part by part, and the hash, which has an order,
is taken over a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspan.llm.common import buckets, prepare, stored

DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1
# rows and bytes of text of one segment, which is one row of the intermediate table
SEGMENT_ROWS, SEGMENT_BYTES = 512, 512 << 10
BLANKS = r"\x20\x09-\x0D"

INF = 1 << 60
START, S, U, A = range(4)
ROLES = {U: "user", A: "assistant"}
# which state follows the emission of s, u, a
FOLLOWS = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
MUST_DELETE = "D"
Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def times(m: Matrix, v: Vector) -> Vector:
    return tuple(min(a + b for a, b in zip(row, v)) for row in m)


def product(m: Matrix, n: Matrix) -> Matrix:
    columns = list(zip(*n))
    return tuple(tuple(min(min(a + b for a, b in zip(row, c)), INF) for c in columns) for row in m)


ONE: Matrix = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))


def _inserts() -> Matrix:
    """Cheapest insertions that lead from one state to another; two are enough for any pair."""
    step = [[0 if i == j else INF for j in range(4)] for i in range(4)]
    for letter in "ua":
        for x, y in FOLLOWS[letter].items():
            step[x][y] = INSERT_COST
    once = tuple(map(tuple, step))
    return product(once, once)


INSERTS = _inserts()
END: Vector = tuple(min(row[START], row[A]) for row in INSERTS)


def choices(symbol: str) -> list[tuple[str, int, dict[int, int]]]:
    """Edits of a row in the order of their letters, with cost and moves. A symbol is 'D', or the letter of the role (a space
    for any other) and 't' if the row is truncated."""
    stay = {x: x for x in range(4)}
    out = [("D", DELETE_COST, stay)]
    if symbol != MUST_DELETE:
        late = TRUNCATED_COST if symbol.endswith("t") else 0
        if symbol[0] in FOLLOWS:
            out.append(("K", late, FOLLOWS[symbol[0]]))
        out.append(("R", REROLE_COST + late, {**FOLLOWS["u"], **FOLLOWS["a"]}))
    return out


CHOICES = {s: choices(s) for s in (MUST_DELETE, "s", "u", "a", " ", "st", "ut", "at", " t")}
SYMBOLS = list(CHOICES)


@lru_cache(maxsize=1024)
def power(symbol: str, k: int) -> Matrix:
    """Matrix of 2^k equal rows, insertions before each of them included."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    rows = [[INF] * 4 for _ in range(4)]
    for _, cost, moves in CHOICES[symbol]:
        for x, y in moves.items():
            rows[x][y] = min(rows[x][y], cost)
    return product(INSERTS, tuple(map(tuple, rows)))


def before(symbol: str, n: int, after: Vector) -> Vector:
    """Least costs before n equal rows, from those after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = times(power(symbol, k), after)
    return after


def matrix(runs: list[tuple[str, int]]) -> Matrix:
    out = ONE
    for symbol, n in runs:
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = product(out, power(symbol, k))
    return out


def inserted(state: int, costs: Vector, out: list[str]) -> int:
    """Insertions due at this place, the least letters first."""
    following = U if state != U else A
    if INSERT_COST + costs[following] == costs[state]:
        out.append("I")
        return following
    return state


def unroll(runs: list[tuple[str, int]], state: int, after: Vector) -> tuple[str, int]:
    """Least audit of these rows among the cheapest ones, and the state behind them; `after` is what is to be paid then."""
    ends = [after]
    for symbol, n in reversed(runs):
        ends.append(before(symbol, n, ends[-1]))
    ends.reverse()
    out: list[str] = []
    for (symbol, n), end in zip(runs, ends[1:]):
        if symbol == MUST_DELETE:  # deletion is cheapest now, and its letter is the least
            out.append("D" * n)
            continue
        costs = [end]
        for _ in range(n):
            costs.append(times(power(symbol, 0), costs[-1]))
        for i in range(n, 0, -1):
            here, rest = costs[i], costs[i - 1]
            while True:
                deletes, *others = CHOICES[symbol]
                if deletes[1] + rest[state] == here[state]:
                    out.append("D")
                    break
                moved = inserted(state, here, out)
                if moved != state:
                    state = moved
                    continue
                letter, state = next((c, m[state]) for c, cost, m in others if state in m and cost + rest[m[state]] == here[state])
                out.append(letter)
                break
    return "".join(out), state


# rows of the table


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the test damage: by crc32 of `conv_id:turn` modulo 20, 0 drops a row, 1 empties its text, 2 takes the
    marks .!? out of it, 3 repeats it, 4 makes the role user. Nulls in role, text and hashed names count as one space."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.pmod(F.crc32(named.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind > 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


ORDER = ["conv", "placed", "at", "role", "digest"]


def _name(conv_id: Column) -> Column:
    """A key without nulls."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _counted(rows: DataFrame) -> DataFrame:
    """Different rows with their number, and whether no earlier row has their role and text."""
    keyed = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        _name(F.col("conv_id")).alias("conv"),
        F.col("turn").isNotNull().alias("placed"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.md5(F.col("text").cast("binary")))
    each = keyed.groupBy(*ORDER).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"), F.first("conv_id").alias("conv_id"))
    first = keyed.groupBy("conv", "role", "digest").agg(F.min(F.struct("placed", "at")).alias("f"))
    first = first.select("conv", "f.placed", "f.at", "role", "digest", F.lit(True).alias("new"))
    return each.join(first, ORDER, "left")


_SEGMENT = (
    "conv string, conv_id bigint, part int, seq int, symbols array<int>, numbers array<bigint>, roles array<string>,"
    " texts array<string>, copies array<bigint>, faults array<bigint>, letters array<string>, illegal bigint, turns array<bigint>"
)


def _segments(counted: DataFrame, size: int, max_bytes: int) -> DataFrame:
    """Runs of consecutive rows of one conversation: bounded pieces of the sorted table."""
    spaces = f"[{BLANKS}]"
    facts = counted.select(
        *ORDER,
        "conv_id",
        "text",
        "n",
        F.coalesce("new", F.lit(False)).alias("new"),
        (~F.col("text").rlike(f"[^{BLANKS}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?]{spaces}*\z")).alias("truncated"),
    )
    laid = facts.repartitionByRange(buckets(counted.sparkSession), *ORDER).sortWithinPartitions(*ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, weight = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and (row["conv"] != held[0]["conv"] or len(held) >= size or weight >= max_bytes):
                    out.append(_segment(held, part, seq))
                    seq, held, weight = seq + 1, [], 0
                held.append(row)
                weight += len(row["text"])
            if out:
                yield _batch(out)
        if held:
            yield _batch([_segment(held, part, seq)])

    return laid.mapInArrow(run, _SEGMENT)


def _segment(rows: list[dict], part: int, seq: int) -> dict:
    runs: list[list] = []
    faults, illegal, turns = [0, 0, 0], 0, 0
    letters = [r["role"][:1] if r["role"][:1] in FOLLOWS else " " for r in rows]

    def add(symbol: str, n: int) -> None:
        if runs and runs[-1][0] == symbol:
            runs[-1][1] += n
        elif n:
            runs.append([symbol, n])

    for i, (r, letter) in enumerate(zip(rows, letters)):
        n = r["n"]
        fresh = int(r["new"] and not r["blank"])
        faults[0 if r["blank"] else 1] += n - fresh
        faults[2] += fresh and r["truncated"]
        if fresh:
            add(letter + ("t" if r["truncated"] else ""), 1)
        add(MUST_DELETE, n - fresh)
        illegal += n - 1 + (i > 0 and letters[i - 1] + letter not in ("su", "ua", "au"))
        turns += r["placed"] and (i == 0 or not rows[i - 1]["placed"] or rows[i - 1]["at"] != r["at"])
    placed = [r["at"] for r in rows if r["placed"]]
    return {
        "conv": rows[0]["conv"], "conv_id": rows[0]["conv_id"], "part": part, "seq": seq,
        "symbols": [SYMBOLS.index(s) for s, _ in runs], "numbers": [n for _, n in runs],
        "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows], "copies": [r["n"] for r in rows],
        "faults": faults, "letters": [letters[0], letters[-1]], "illegal": illegal,
        "turns": [placed[0], placed[-1], turns] if placed else [],
    }


_ARROW = pa.schema(
    {
        "conv": pa.string(), "conv_id": pa.int64(), "part": pa.int32(), "seq": pa.int32(), "symbols": pa.list_(pa.int32()),
        "numbers": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "copies": pa.list_(pa.int64()),
        "faults": pa.list_(pa.int64()), "letters": pa.list_(pa.string()), "illegal": pa.int64(), "turns": pa.list_(pa.int64()),
    }
)


def _batch(rows: list[dict], schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _runs(row: dict) -> list[tuple[str, int]]:
    return [(SYMBOLS[s], n) for s, n in zip(row["symbols"], row["numbers"])]


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Consecutive rows of equal keys; only small rows go this way."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _chunks(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _audits(segments: DataFrame) -> DataFrame:
    """(conv, part, seq, audit) of every segment. A conversation has one matrix in each partition that holds a part of it."""
    spark = segments.sparkSession
    n = buckets(spark)
    light = segments.select("conv", "part", "seq", "symbols", "numbers")
    laid = light.repartition(n, "conv", "part").sortWithinPartitions("conv", "part", "seq")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for group in _groups(batches, "conv", "part"):
                whole = matrix([run for row in group for run in _runs(row)])
                yield {"conv": group[0]["conv"], "part": group[0]["part"], "matrix": [x for row in whole for x in row]}

        yield from _chunks(rows(), pa.schema({"conv": pa.string(), "part": pa.int32(), "matrix": pa.list_(pa.int64())}))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for group in _groups(batches, "conv"):
                after = [END]
                for row in reversed(group):
                    m = tuple(tuple(row["matrix"][i : i + 4]) for i in range(0, 16, 4))
                    after.append(times(m, after[-1]))
                for row, costs in zip(group, reversed(after[:-1])):
                    yield {"conv": row["conv"], "part": row["part"], "after": list(costs)}

        yield from _chunks(rows(), pa.schema({"conv": pa.string(), "part": pa.int32(), "after": pa.list_(pa.int64())}))

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for group in _groups(batches, "conv", "part"):
                ends = [tuple(group[0]["after"])]
                for row in reversed(group):
                    costs = ends[-1]
                    for symbol, k in reversed(_runs(row)):
                        costs = before(symbol, k, costs)
                    ends.append(costs)
                ends.reverse()
                # the state in which a part is entered is not known yet: one audit for each of the four
                states = list(range(4))
                for i, row in enumerate(group):
                    found = [unroll(_runs(row), state, ends[i + 1]) for state in states]
                    states = [s for _, s in found]
                    yield {"conv": row["conv"], "part": row["part"], "seq": row["seq"], "audits": [a for a, _ in found], "states": states}

        yield from _chunks(
            rows(),
            pa.schema({"conv": pa.string(), "part": pa.int32(), "seq": pa.int32(), "audits": pa.list_(pa.string()), "states": pa.list_(pa.int32())}),
            256,
        )

    whole = laid.mapInArrow(matrices, "conv string, part int, matrix array<bigint>")
    after = whole.repartition(n, "conv").sortWithinPartitions("conv", "part").mapInArrow(borders, "conv string, part int, after array<bigint>")
    joined = light.join(after, ["conv", "part"]).repartition(n, "conv", "part").sortWithinPartitions("conv", "part", "seq")
    return joined.mapInArrow(audits, "conv string, part int, seq int, audits array<string>, states array<int>")


class _Report:
    """One conversation, put together from its segments in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        # the state in which the current part was entered, the one behind its segments so far, and the one of the lines told
        self.part, self.entry, self.exit, self.state = None, START, START, START
        self.last = None
        self.faults, self.illegal, self.cost, self.audit = [0, 0, 0], 0, 0, []
        self.turns: list[int] | None = None
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8"))
        self.lines += 1

    def insert(self) -> None:
        self.state = U if self.state != U else A
        self.cost += INSERT_COST
        self.line(ROLES[self.state], "")

    def add(self, row: dict) -> None:
        self.conv_id = row["conv_id"]
        first, last = row["letters"]
        self.illegal += row["illegal"] + (self.last is not None and self.last + first not in ("su", "ua", "au"))
        self.last = last
        self.faults = [a + b for a, b in zip(self.faults, row["faults"])]
        if row["turns"]:
            low, high, n = row["turns"]
            self.turns = [low, high, n] if self.turns is None else [self.turns[0], high, self.turns[2] + n - (self.turns[1] == low)]
        if row["part"] != self.part:
            self.part, self.entry = row["part"], self.exit
        audit, at = row["audits"][self.entry], 0
        self.exit = row["states"][self.entry]
        self.audit.append(audit)
        truncated = _first_of_each(row)
        for role, text, n, (fresh, late) in zip(row["roles"], row["texts"], row["copies"], truncated):
            if fresh:
                while audit[at] == "I":
                    self.insert()
                    at += 1
                edit, at, n = audit[at], at + 1, n - 1
                if edit == "D":
                    self.cost += DELETE_COST
                else:
                    self.cost += late * TRUNCATED_COST
                    if edit == "K":
                        self.state = FOLLOWS[role[0]][self.state]
                        self.line(role, text)
                    else:
                        self.cost += REROLE_COST
                        self.state = U if self.state != U else A
                        self.line(ROLES[self.state], text)
            self.cost += n * DELETE_COST
            at += n

    def finish(self) -> dict:
        end: list[str] = []
        while inserted(self.state, END, end) != self.state:
            self.insert()
        blank, duplicate, truncated = self.faults
        low, high, n = self.turns or (0, 0, 1)
        return {
            "conv_id": self.conv_id, "gaps": high - low + 1 - n, "blank": blank, "duplicate": duplicate, "truncated": truncated,
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit + end), "repaired_sha256": self.hash.hexdigest(),
            "n_rows": self.lines,
        }


def _first_of_each(row: dict) -> Iterator[tuple[bool, bool]]:
    """For each different row of a segment: whether its first copy may stay, and whether that is truncated."""
    runs = iter(_runs(row))
    symbol, left = next(runs, ("", 0))
    for n in row["copies"]:
        fresh = symbol != MUST_DELETE
        yield fresh, symbol.endswith("t")
        while n:
            taken = min(n, left)
            n, left = n - taken, left - taken
            if not left:
                symbol, left = next(runs, ("", 0))


_OUT = pa.schema(
    {
        "conv_id": pa.int64(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(),
        "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(), "n_rows": pa.int64(),
    }
)


def repair(rows: DataFrame, ids: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Faults of every conversation and its cheapest repair, from rows (conv_id, turn, role, text): (conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows).

    Rows are taken by turn, those without one first, rows of one turn by role and then by the MD5 of their text. Equal rows
    count one by one; the later ones are duplicates. Nulls in role and text count as one space; rows without a conv_id
    are a conversation of their own. `ids` lists conversations that are reported even if they have no rows: with zeros, no
    audit, and the hash of nothing. An empty table gives no rows; other columns are not read. A long conversation is worked
    on in segments; its audit and hash are put together from a stream of them.
    """
    spark = rows.sparkSession
    prepare(spark)
    segments = stored(_segments(_counted(rows), segment_rows, segment_bytes), "conversation-segments")
    audits = _audits(segments)
    no_audit = [F.lit(None).cast("array<string>").alias("audits"), F.lit(None).cast("array<int>").alias("states")]
    heavy = segments.select("*", F.lit(1).alias("kind"), *no_audit)
    empty = lambda c: F.lit(None).cast(segments.schema[c].dataType).alias(c)
    given = {"conv", "part", "seq"}
    light = audits.select(*[F.col(c) if c in given else empty(c) for c in segments.columns], F.lit(0).alias("kind"), "audits", "states")
    wanted = (rows if ids is None else ids).select("conv_id").groupBy("conv_id").agg(F.lit(-1).alias("part"))
    named = {"conv": _name(F.col("conv_id")), "conv_id": F.col("conv_id").cast("long"), "part": F.col("part"), "seq": F.lit(0)}
    stubs = wanted.select(
        *[named[c].alias(c) if c in named else empty(c) for c in segments.columns],
        F.lit(0).alias("kind"),
        *no_audit,
    )
    together = heavy.unionByName(light).unionByName(stubs)
    laid = together.repartition(buckets(spark), "conv").sortWithinPartitions("conv", "part", "seq", "kind")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            now, name, audit = None, None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    if row["conv"] != name:
                        if now:
                            yield now.finish()
                        name, now = row["conv"], _Report(row["conv_id"])
                    if row["part"] < 0:
                        continue
                    if row["kind"] == 0:
                        audit = row
                    else:
                        now.add({**row, "audits": audit["audits"], "states": audit["states"]})
            if now:
                yield now.finish()

        yield from _chunks(out(), _OUT, 1024)

    return laid.mapInArrow(
        report,
        "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
        " audit string, repaired_sha256 string, n_rows bigint",
    )
