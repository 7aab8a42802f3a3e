"""Building and refreshing the chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspan.functions import fixed, paths, text
from seekspan.functions.times import Moment, moment
from seekspan.operators import changes as ch
from seekspan.operators import lifecycle
from seekspan.operators.chunking import hybrid_chunks, window_chunks
from seekspan.operators.embedding import DEFAULT_MODEL, Embedder, embed, embed_distinct
from seekspan.operators.filters import ACTIVE, DELETED
from seekspan.operators.reports import chunk_counts
from seekspan.operators.tokens import Counter, fit_tokens
from seekspan.operators.topk import first_per_key
from seekspan.schemas import CHUNKS, conform
from seekspan.session import materialize
from seekspan.sources.vectors import VectorCache

FILE = ["repo_id", "file_path"]


def with_identifiers(chunks: DataFrame) -> DataFrame:
    """P6-P8 columns; byte windows are hashed over their bytes."""
    body = F.col("raw") if "raw" in chunks.columns else F.col("content")
    return chunks.withColumns(
        {
            "content_md5": text.content_md5(body),
            "content_hash": text.content_hash(body),
            "chunk_id": text.chunk_id(
                F.col("repo_id"), F.col("file_path"), F.col("start_line"), F.col("end_line"), body
            ),
        }
    )


def with_metadata(chunks: DataFrame, model_id: str, now: Moment) -> DataFrame:
    """P10: lifecycle and model columns of new chunks."""
    return chunks.withColumns(
        {
            "model_id": F.lit(model_id),
            "indexed_at": moment(now),
            "status": F.lit(ACTIVE),
            "deleted_at": F.lit(None).cast("timestamp"),
            "deleted_in_commit": F.lit(None).cast("string"),
        }
    )


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """First occurrence of each chunk id, in file order."""
    return first_per_key(chunks, ["chunk_id"], [F.col("chunk_index"), F.col("fit_index")])


def build_chunks(
    files: DataFrame,
    now: Moment,
    symbols: DataFrame | None = None,
    model_id: str = DEFAULT_MODEL,
    max_tokens: int = fixed.MAX_TOKENS,
    counter: Counter | None = None,
    target: int = fixed.TARGET_TOKENS,
    overlap: int = fixed.OVERLAP_TOKENS,
    unit: str = "char",
) -> DataFrame:
    """Chunk, fit to the token limit, identify, dedupe. Everything before the dedupe is one scan without a shuffle
    (symbols add the join of files with their symbols)."""
    if symbols is None:
        cut = window_chunks(files, target, overlap, unit=unit)
    else:
        cut = hybrid_chunks(files, symbols, target=target, overlap=overlap, unit=unit)
    fitted = fit_tokens(cut, max_tokens, counter)
    return conform(dedupe_chunks(with_metadata(with_identifiers(fitted), model_id, now)), CHUNKS)


def embedded(built: DataFrame, embedder: Embedder | None, cache: VectorCache | None = None) -> DataFrame:
    """Vectors for new chunks: the built-in model runs in place, a plug-in model sees each distinct content once, and with a
    `cache` only contents that no earlier run has seen, such as those of files that did not just move."""
    if cache is not None:
        return conform(cache.embed(built, embedder), CHUNKS)
    if embedder is None:
        return conform(embed(built.drop("embedding")), CHUNKS)
    return conform(embed_distinct(built, embedder), CHUNKS)


def full_index(
    files: DataFrame,
    now: Moment,
    symbols: DataFrame | None = None,
    existing: DataFrame | None = None,
    prune: bool = False,
    repos: DataFrame | None = None,
    embedder: Embedder | None = None,
    model_id: str = DEFAULT_MODEL,
    cache: VectorCache | None = None,
    **options,
) -> DataFrame:
    """All files chunked, embedded and upserted. `prune=True` tombstones stored chunks that were not rebuilt, of the
    repositories in `files`, or of `repos` if given, which can name one whose last file is gone.

    The new chunks are needed several times (distinct contents, vectors, ids to replace), so they are written once to
    the shared scratch area and read back column by column.
    """
    built = materialize(build_chunks(files, now, symbols, model_id, **options), "chunks")
    batch = embedded(built, embedder, cache)
    if existing is None:
        return batch
    if prune:
        listed = (files if repos is None else repos).select("repo_id").distinct().withColumn("__hit", F.lit(True))
        hit = F.col("__hit").isNotNull()
        alive = F.col("status").isNull() | (F.col("status") != DELETED)
        stamp = F.when(hit & alive, F.date_trunc("second", moment(now))).otherwise(F.col("deleted_at"))
        marked = {"deleted_at": stamp, "status": F.when(hit, DELETED).otherwise(F.col("status"))}
        existing = existing.join(listed, "repo_id", "left").withColumns(marked).select(*existing.columns)
    return lifecycle.upsert(existing, batch, built, FILE)


def incremental_index(
    changes: DataFrame,
    files: DataFrame,
    chunks: DataFrame,
    now: Moment,
    commit: str | None = None,
    symbols: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    renames: str | None = "split",
    embedder: Embedder | None = None,
    model_id: str = DEFAULT_MODEL,
    cache: VectorCache | None = None,
    **options,
) -> DataFrame:
    """Tombstone chunks of deleted and modified files, then index added and modified ones; a rebuilt chunk with the
    same id comes back active.

    The change list and the new chunks are used several times and are therefore written once to the shared scratch area; without
    `renames`, the caller has expanded and stored the change list already.
    `symbols` may be a function that gives the symbols of the listed files, so that those of all others need not be made.
    Stored chunks are shuffled by file at most once: both the tombstones and the replaced ids are joined on the file key.
    """
    flat = changes if renames is None else materialize(ch.expand_renames(changes, renames), "changes")
    retired = lifecycle.tombstone(chunks, ch.files_to_retire(flat), now, commit)
    listed = ch.files_to_index(flat)
    todo = files.join(listed, FILE, "left_semi")
    if callable(symbols):
        symbols = symbols(listed)
    elif symbols is not None:
        symbols = symbols.join(listed, FILE, "left_semi")
    built = materialize(build_chunks(todo, now, symbols, model_id, **options), "chunks")
    return lifecycle.upsert(retired, embedded(built, embedder, cache), built, FILE)


def build_manifest(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """M1: one row per file with its chunk count and content hash. The hash is taken before the join, so file texts are
    not shuffled."""
    rows = files.select(
        *FILE, "language", F.col("lines").alias("line_count"), "mtime", text.content_hash("content").alias("content_hash")
    )
    alive = chunks.filter(F.coalesce(F.col("status"), F.lit(ACTIVE)) != DELETED) if "status" in chunks.columns else chunks
    return rows.join(chunk_counts(alive), FILE, "left").select(
        *FILE, "language", "line_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "mtime", "content_hash"
    )


def build_project(
    repos: DataFrame, chunks: DataFrame, now: Moment, commit: str | None = None
) -> DataFrame:
    """M2: project rows with counters taken from the chunk table. `repos` has repo_path and, optionally, project_name."""
    name = F.col("project_name") if "project_name" in repos.columns else paths.base_name("repo_path")
    gone = F.coalesce(F.col("status") == DELETED, F.lit(False))
    counts = chunks.groupBy("repo_id").agg(
        F.count_if(~gone).alias("active_chunk_count"), F.count_if(gone).alias("deleted_chunk_count")
    )
    rid = F.col("repo_id") if "repo_id" in repos.columns else paths.repo_id("repo_path")
    return (
        repos.select(rid.alias("repo_id"), name.alias("project_name"), "repo_path")
        .join(counts, "repo_id", "left")
        .select(
            "repo_id",
            "project_name",
            "repo_path",
            F.lit(commit).cast(T.StringType()).alias("last_indexed_commit"),
            moment(now).alias("indexed_at"),
            F.coalesce("active_chunk_count", F.lit(0)).alias("active_chunk_count"),
            F.coalesce("deleted_chunk_count", F.lit(0)).alias("deleted_chunk_count"),
        )
    )
