"""Token counts and re-splitting of chunks above the token limit."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspan.functions import fixed, text
from seekspan.session import small_batches

# A counter takes texts and returns one token count per text; it runs on executors, a batch at a time.
Counter = Callable[[Sequence[str]], Sequence[int]]

_PATTERN = re.compile(text.TOKEN_PATTERN)


def pattern_counter(texts: Sequence[str]) -> list[int]:
    """The default counter outside the JVM; agrees with `functions.text.count_tokens`."""
    return [len(_PATTERN.findall(t)) + text.SPECIAL_TOKENS for t in texts]


def count_tokens(df: DataFrame, counter: Counter | None = None, column: str = "content", out: str = "tokens") -> DataFrame:
    """Token count of each text."""
    if counter is None:
        return df.withColumn(out, text.count_tokens(column))
    small_batches(df.sparkSession)

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(counter(texts.tolist())), dtype="int32")

    return df.withColumn(out, run(F.col(column)))


def count_tokens_once(
    df: DataFrame, counter: Counter | None = None, column: str = "content", out: str = "tokens"
) -> DataFrame:
    """Count each distinct text once and join the counts back by MD5. Worth it for expensive counters.

    Adaptive execution splits the rows of a text with very many copies."""
    keyed = df.drop(out).withColumn("__key", text.content_md5(column))
    counts = count_tokens(keyed.select("__key", column).dropDuplicates(["__key"]), counter, column, out)
    return keyed.join(counts.select("__key", out), "__key", "left").drop("__key")


def resplit(content, tokens: int, max_tokens: int, counter: Counter) -> list[dict]:
    """Windows of a too-long text, refined until each one fits.

    Works on str or bytes. Every entry has its text, its token count and the newlines that precede it; newlines of
    overlaps are counted in both windows.
    """
    newline = b"\n" if isinstance(content, bytes) else "\n"
    decode = (lambda b: b.decode("utf-8", "replace")) if isinstance(content, bytes) else (lambda s: s)
    done: list[dict] = []
    # explicit stack of (text, tokens, lines before it); the last entry is handled next
    todo = [(content, tokens, 0)]
    while todo:
        piece, n, before = todo.pop()
        if n <= max_tokens:
            done.append({"content": piece, "tokens": n, "before": before})
            continue
        # single precision, so that sizes agree to the last character
        per_token = np.float32(len(piece)) / np.float32(n)
        size = max(fixed.MIN_RESPLIT_WINDOW, int(np.float32(max_tokens) * per_token * np.float32(fixed.RESPLIT_FILL)))
        step = size - size // 10
        windows = [piece[:size]]
        while (len(windows) - 1) * step + size < len(piece):
            start = len(windows) * step
            windows.append(piece[start : start + size])
        if len(windows) == 1:
            # one window covers the text and still does not fit: it cannot be made smaller
            done.append({"content": piece, "tokens": n, "before": before})
            continue
        counts = counter([decode(w) for w in windows])
        nested = []
        for w, c in zip(windows, counts):
            nested.append((w, int(c), before))
            before += w.count(newline)
        todo.extend(reversed(nested))
    return done


def fit_tokens(
    chunks: DataFrame, max_tokens: int = fixed.MAX_TOKENS, counter: Counter | None = None, cached: bool = False
) -> DataFrame:
    """Real token counts; chunks above the limit are cut again until they fit.

    One pass and no shuffle: only over-limit texts are handed to Python, where the whole refinement of a chunk happens
    in one call. Chunks with a `raw` column (byte windows) are cut by bytes.
    """
    small_batches(chunks.sparkSession)
    byte = "raw" in chunks.columns
    counted = (count_tokens_once if cached else count_tokens)(chunks, counter, out="chunk_tokens")
    run = counter or pattern_counter
    item = "struct<content:string,raw:binary,tokens:int,before:int>"

    @F.pandas_udf(f"array<{item}>")
    def refine(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, totals in batches:
            out = []
            for content, total in zip(contents, totals):
                if content is None:
                    out.append(None)
                    continue
                rows = resplit(bytes(content) if byte else content, int(total), max_tokens, run)
                for row in rows:
                    row["raw"] = row["content"] if byte else None
                    row["content"] = row["content"].decode("utf-8", "replace") if byte else row["content"]
                out.append(rows)
            yield pd.Series(out, dtype=object)

    over = F.col("chunk_tokens") > max_tokens
    source = F.col("raw" if byte else "content")
    whole = F.array(
        F.struct(
            F.col("content").alias("content"),
            (F.col("raw") if byte else F.lit(None).cast("binary")).alias("raw"),
            F.col("chunk_tokens").alias("tokens"),
            F.lit(None).cast("int").alias("before"),
        )
    ).cast(f"array<{item}>")
    parts = refine(F.when(over, source), F.when(over, F.col("chunk_tokens")).otherwise(F.lit(0)))
    replaced = {"content", "raw", "chunk_tokens", "start_line", "end_line"}
    rest = [c for c in counted.columns if c not in replaced]
    piece_text = F.col("p.raw").cast("string") if byte else F.col("p.content")
    cut = F.col("p.before").isNotNull()
    start = F.when(cut, F.col("start_line") + F.col("p.before")).otherwise(F.col("start_line")).cast("int")
    end = F.when(cut, start + text.newline_count(piece_text)).otherwise(F.col("end_line")).cast("int")
    out = (
        counted.withColumn("__parts", parts)
        .select(*rest, "start_line", "end_line", F.posexplode(F.coalesce("__parts", whole)).alias("fit_index", "p"))
        .select(
            *rest,
            "fit_index",
            start.alias("start_line"),
            end.alias("end_line"),
            F.col("p.content").alias("content"),
            F.col("p.raw").alias("raw"),
            F.col("p.tokens").alias("chunk_tokens"),
        )
    )
    return out if byte else out.drop("raw")
