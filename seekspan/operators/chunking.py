"""Chunking: 1 file -> n chunks (C1-C5, W1, W4), without a shuffle for windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspan.functions import fixed, paths, text

_PIECE = "struct<start_line:int,end_line:int,content:string,raw:binary>"


def _sizes(target: int, overlap: int, cpt: float) -> tuple[int, int]:
    window, back = int(target * cpt), int(overlap * cpt)
    if window <= 0 or back >= window:
        raise ValueError("the overlap must be smaller than the window")
    return window, window - back


def _char_windows(content: Column, window: int, step: int) -> Column:
    """Overlapping windows in one left-to-right pass: each match consumes `step` characters and captures `window`.

    Slicing with `substring` would rescan the text from its start for every window.
    """
    cut = F.regexp_extract_all(content, F.lit(rf"(?s)(?=(.{{1,{window}}})).{{1,{step}}}"), F.lit(1))
    count = F.greatest(F.lit(1), F.ceil((F.length(content) - (window - step)) / F.lit(step))).cast("int")
    return F.slice(cut, F.lit(1), count)


def _byte_windows(content: Column, window: int, step: int) -> Column:
    raw = F.encode(content, "UTF-8")
    count = F.greatest(F.lit(1), F.ceil((F.octet_length(content) - (window - step)) / F.lit(step))).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(raw, i * step + 1, F.lit(window)))


def running_total(counts: Column, size: int = 256) -> Column:
    """1 plus the sum of all numbers before each one.

    Arrays are folded in blocks, since each step of a fold copies the array it has made so far: blocks of `size` numbers,
    and the sums of the blocks, are short even for a file of very many windows."""
    blocks = F.when(F.size(counts) > 0, F.sequence(F.lit(0), F.floor((F.size(counts) - 1) / size).cast("int")))
    parts = F.transform(blocks, lambda b: F.slice(counts, b * size + 1, F.lit(size)))

    def before(numbers: Column, first: Column) -> Column:
        zero = F.struct(first.alias("sum"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + x).cast("int").alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out"))
        return F.aggregate(numbers, zero, step, lambda acc: acc["out"])

    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: (s + x).cast("int")))
    return F.coalesce(F.flatten(F.zip_with(parts, before(sums, F.lit(1)), before)), F.array().cast("array<int>"))


def _with_windows(
    files: DataFrame, wanted: Column, target: int, overlap: int, cpt: float, byte: bool, true_lines: bool = False
) -> DataFrame:
    """`files` with the columns that `_windows` puts together to the windows of each text where `wanted` holds.

    Each step is a column of its own, so that the cuts are made once per text however often they are referred to."""
    window, step = _sizes(target, overlap, cpt)
    content = F.col("content")
    cuts = (_byte_windows if byte else _char_windows)(content, window, step)

    def newlines(piece: Column) -> Column:
        as_text = piece.cast("string") if byte else piece
        return text.newline_count(as_text)

    def counts(piece: Column) -> Column:
        """Newlines, and those of the part that the next window does not repeat."""
        whole = newlines(piece)
        head = newlines(F.substr(piece, F.lit(1), F.lit(step))) if true_lines else whole
        return F.struct(whole.alias("whole"), head.alias("head"))

    return (
        files.withColumn("__cuts", F.when(wanted & (F.length(content) > 0), cuts))
        .withColumn("__counts", F.transform("__cuts", counts))
        .withColumn("__heads", F.transform("__counts", lambda c: c["head"]))
        .withColumn("__starts", running_total(F.col("__heads")))
        .drop("__heads")
    )


def _windows(byte: bool) -> Column:
    """The windows as an array of _PIECE.

    Explode this expression, not a column that holds it: of a bare column the optimizer asks first whether it is empty, and
    that filter takes all the steps above along, below the scan's repartition."""

    def item(piece: Column, place: Column) -> Column:
        return F.struct(
            place["start"].alias("start_line"),
            (place["start"] + place["whole"]).cast("int").alias("end_line"),
            (F.make_valid_utf8(piece.cast("string")) if byte else piece).alias("content"),
            (piece if byte else F.lit(None).cast("binary")).alias("raw"),
        )

    def place(count: Column, start: Column) -> Column:
        return F.struct(start.alias("start"), count["whole"].alias("whole"))

    return F.zip_with("__cuts", F.zip_with("__counts", "__starts", place), item)


def window_chunks(
    files: DataFrame,
    target: int = fixed.TARGET_TOKENS,
    overlap: int = fixed.OVERLAP_TOKENS,
    cpt: float = fixed.CHARS_PER_TOKEN,
    unit: str = "char",
    true_lines: bool = False,
) -> DataFrame:
    """C1 + W1: sliding windows with line numbers.

    A chunk starts at the line the previous one ended on, counting the overlap twice (`true_lines=True` gives the real
    start line instead). The running line number is summed up inside the row, so no per-file window, sort or shuffle is
    needed. `unit='byte'` cuts UTF-8 bytes, keeps them in `raw` for hashing, and repairs cut code points in `content`.
    """
    byte = unit == "byte"
    rest = [c for c in files.columns if c != "content"]
    cut = _with_windows(files.filter(F.length("content") > 0), F.lit(True), target, overlap, cpt, byte, true_lines)
    out = (
        cut.select(*rest, F.posexplode(_windows(byte)).alias("chunk_index", "p"))
        .select(*rest, "chunk_index", "p.*")
    )
    size = F.octet_length("raw") if byte else F.length("content")
    out = (
        out.withColumn("chunk_tokens", F.floor(size / F.lit(cpt)).cast("int"))
        .withColumn("symbol_name", F.lit(None).cast("string"))
        .withColumn("symbol_kind", F.lit("window"))
        .withColumn("parent_name", F.lit(None).cast("string"))
        .withColumn("is_split", F.lit(False))
        .withColumn("split_index", F.lit(None).cast("int"))
        .withColumn("method", F.lit("window"))
    )
    return out if byte else out.drop("raw")


def pack_lines(lengths: np.ndarray, target_chars: int, overlap: int = fixed.SPLIT_OVERLAP_LINES) -> list[tuple[int, int]]:
    """C4 boundaries: greedy runs of lines as [first, end), each at least one line, stepping back `overlap` lines."""
    n = len(lengths)
    before = np.concatenate(([0], np.cumsum(lengths + 1)))
    # total[j] is the packed size once line j is taken; it grows with j, so each run end is one binary search
    total = before[:-1] + lengths
    runs, first = [], 0
    while first < n:
        end = max(int(np.searchsorted(total, target_chars + before[first], side="right")), first + 1)
        runs.append((first, end))
        first = end - overlap if end - overlap > first else end
    return runs


def _line_packer(target_chars: int, overlap: int, byte: bool):
    @F.pandas_udf("array<struct<first:int,size:int,chars:int>>")
    def pack(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, counts in batches:
            out = []
            for content, count in zip(contents, counts):
                if content is None:
                    out.append(None)
                    continue
                sizes = [len(s.encode()) if byte else len(s) for s in content.split("\n")]
                sizes += [0] * (int(count) - len(sizes))
                lengths = np.array(sizes, dtype=np.int64)
                out.append(
                    [
                        {"first": a, "size": b - a, "chars": int(lengths[a:b].sum()) + (b - a)}
                        for a, b in pack_lines(lengths, target_chars, overlap)
                    ]
                )
            yield pd.Series(out, dtype=object)

    return pack


def symbol_chunks(
    files: DataFrame,
    symbols: DataFrame,
    target: int = fixed.TARGET_TOKENS,
    cpt: float = fixed.CHARS_PER_TOKEN,
    overlap_lines: int = fixed.SPLIT_OVERLAP_LINES,
    significant: tuple[str, ...] = fixed.SIGNIFICANT_KINDS,
    unit: str = "char",
) -> DataFrame:
    """One chunk per symbol, oversize symbols split by lines.

    Symbols are gathered per file before the join, so each file's text is shuffled and split into lines once, whatever
    the number of its symbols. A nested symbol is kept when its kind is significant and no ancestor was split.
    """
    rest = [c for c in files.columns if c != "content"]
    joined = files.join(_symbols_per_file(symbols), ["repo_id", "file_path"])
    return _cut_joined(joined, rest, target, cpt, overlap_lines, significant, unit).drop("raw")


_SYMBOL = ("start_line", "depth", "symbol_id", "end_line", "name", "kind", "parent_name", "ancestor_ids")


def _symbols_per_file(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo_id", "file_path").agg(F.collect_list(F.struct(*_SYMBOL)).alias("__symbols"))


def _cut_joined(
    joined: DataFrame,
    rest: list[str],
    target: int,
    cpt: float,
    overlap_lines: int,
    significant: tuple[str, ...],
    unit: str,
    windows: Column | None = None,
) -> DataFrame:
    """Chunks of files with their `__symbols`; files without symbols (null) are cut into `windows`, inside the same row."""
    limit = 2 * target
    # lines are only needed, and only split, where there are symbols
    joined = joined.withColumn("__lines", F.when(F.col("__symbols").isNotNull(), F.split("content", "\n")))

    def body(s: Column) -> Column:
        first = F.greatest(s["start_line"], F.lit(1))
        last = F.least(s["end_line"], F.size("__lines"))
        return F.array_join(F.slice(F.col("__lines"), first, F.greatest(last - first + 1, F.lit(0))), "\n")

    cut = F.transform(
        F.array_sort("__symbols"),
        lambda s: F.struct(*[s[f].alias(f) for f in _SYMBOL], body(s).alias("content"), F.lit(None).cast("binary").alias("raw")),
    )
    if windows is not None:
        empty = F.lit(None)
        as_symbol = F.transform(
            windows,
            lambda w: F.struct(
                w["start_line"].alias("start_line"),
                empty.cast("int").alias("depth"),
                empty.cast("string").alias("symbol_id"),
                w["end_line"].alias("end_line"),
                empty.cast("string").alias("name"),
                F.lit("window").alias("kind"),
                empty.cast("string").alias("parent_name"),
                empty.cast("array<string>").alias("ancestor_ids"),
                w["content"].alias("content"),
                w["raw"].alias("raw"),
            ),
        )
        cut = F.when(F.col("__symbols").isNotNull(), cut).otherwise(as_symbol)
    tokens = lambda c: text.estimate_tokens(c, cpt, unit)
    oversize = F.transform(F.filter("__cut", lambda s: tokens(s["content"]) > limit), lambda s: s["symbol_id"])
    kept = F.filter(
        "__cut",
        lambda s: s["symbol_id"].isNull()
        | (
            ((s["depth"] == 0) | s["kind"].isin(list(significant)))
            & ~F.coalesce(F.arrays_overlap(s["ancestor_ids"], F.col("__oversize")), F.lit(False))
        ),
    )
    size = F.octet_length("raw") if unit == "byte" else F.length("content")
    is_symbol = F.col("symbol_id").isNotNull()
    rows = (
        joined.select(*rest, cut.alias("__cut"))
        .withColumn("__oversize", oversize)
        .select(*rest, F.posexplode(kept).alias("__pos", "s"))
        .select(*rest, "__pos", "s.*")
        .withColumn("chunk_tokens", F.when(is_symbol, tokens(F.col("content"))).otherwise(F.floor(size / F.lit(cpt))).cast("int"))
    )
    # Only oversize texts travel to Python, and only line counts come back; the parts are cut here from the same row.
    big = is_symbol & (F.col("chunk_tokens") > limit)
    pack = _line_packer(int(target * cpt), overlap_lines, unit == "byte")
    span = F.col("end_line") - F.col("start_line") + 1
    rows = rows.withColumn("__runs", pack(F.when(big, F.col("content")), F.when(big, span).otherwise(F.lit(0))))
    lines = F.split("content", "\n")
    whole = F.array(
        F.struct(
            F.col("start_line").alias("start_line"),
            F.col("end_line").alias("end_line"),
            F.col("content").alias("content"),
            F.col("chunk_tokens").alias("chunk_tokens"),
            F.col("name").alias("symbol_name"),
            F.lit(None).cast("int").alias("split_index"),
        )
    )
    parts = F.transform(
        "__runs",
        lambda r, i: F.struct(
            (F.col("start_line") + r["first"]).cast("int").alias("start_line"),
            (F.col("start_line") + r["first"] + r["size"] - 1).cast("int").alias("end_line"),
            F.array_join(
                F.concat(
                    F.slice(lines, r["first"] + 1, r["size"]),
                    # lines past the end of the text count as empty ones
                    F.array_repeat(F.lit(""), F.least(r["size"], F.greatest(r["first"] + r["size"] - F.size(lines), F.lit(0)))),
                ),
                "\n",
            ).alias("content"),
            F.floor(r["chars"] / F.lit(cpt)).cast("int").alias("chunk_tokens"),
            F.concat(F.col("name"), F.lit(" (part "), (i + 1).cast("string"), F.lit(")")).alias("symbol_name"),
            (i + 1).cast("int").alias("split_index"),
        ),
    )
    out = rows.select(
        *rest,
        "__pos",
        F.posexplode(F.when(F.col("__runs").isNull(), whole).otherwise(parts)).alias("__part", "p"),
        F.col("kind").alias("symbol_kind"),
        "parent_name",
        "raw",
        is_symbol.alias("__symbol"),
    )
    # order within the file: symbol, then part; windows are numbered as such
    number = F.when(F.col("__symbol"), F.col("__pos").cast("bigint") * F.lit(2**31) + F.col("__part")).otherwise(F.col("__pos"))
    return out.select(
        *rest,
        number.cast("bigint").alias("chunk_index"),
        "p.start_line",
        "p.end_line",
        "p.content",
        "p.chunk_tokens",
        "p.symbol_name",
        "symbol_kind",
        "parent_name",
        F.col("p.split_index").isNotNull().alias("is_split"),
        "p.split_index",
        F.when(F.col("__symbol"), "symbol").otherwise("window").alias("method"),
        "raw",
    )


def hybrid_chunks(
    files: DataFrame,
    symbols: DataFrame,
    force_window: bool = False,
    target: int = fixed.TARGET_TOKENS,
    overlap: int = fixed.OVERLAP_TOKENS,
    cpt: float = fixed.CHARS_PER_TOKEN,
    unit: str = "char",
) -> DataFrame:
    """Symbol chunks for files of a parser group that have symbols, windows for all others.

    Adds `display_language` and `fallback_reason` ('forced', 'no_parser', 'no_symbols'; null for symbol chunks).
    """
    files = files.withColumn("display_language", paths.detect_language("file_path"))
    if force_window:
        return window_chunks(files.withColumn("fallback_reason", F.lit("forced")), target, overlap, cpt, unit)
    # one left join: each text is shuffled once at most, and symbols or windows are chosen inside the row
    parser = paths.parser_language("file_path") != ""
    joined = files.join(_symbols_per_file(symbols), ["repo_id", "file_path"], "left")
    joined = joined.withColumn("__symbols", F.when(parser, F.col("__symbols"))).withColumn(
        "fallback_reason", F.when(~parser, "no_parser").when(F.col("__symbols").isNull(), "no_symbols")
    )
    rest = [c for c in files.columns if c != "content"] + ["fallback_reason"]
    joined = _with_windows(joined, F.col("__symbols").isNull(), target, overlap, cpt, unit == "byte")
    joined = joined.withColumn("__windows", _windows(unit == "byte"))
    windows = F.col("__windows")
    cut = _cut_joined(joined, rest, target, cpt, fixed.SPLIT_OVERLAP_LINES, fixed.SIGNIFICANT_KINDS, unit, windows)
    return cut if unit == "byte" else cut.drop("raw")
