"""Corpus sources: file trees (S1) and document tables."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspan.functions import fixed, paths, text
from seekspan.schemas import FILES
from seekspan.sources import trees


def scan_trees(
    spark: SparkSession,
    repos: Iterable[tuple[str, str, str]],
    extensions: Iterable[str] = tuple(fixed.INDEX_LANGUAGES),
    skipped: Iterable[str] = fixed.SKIP_DIRS,
) -> DataFrame:
    """Raw files of several source trees, given as (repo_id, project_name, root), with what could not be read as rows with an
    `error`. Roots are folders that all machines see, or URIs of a store."""
    roots = [(rid, name, root if "://" in root else os.path.abspath(root)) for rid, name, root in repos]
    return trees.read_files(trees.list_trees(spark, roots, tuple(extensions), frozenset(skipped)))


def scan_repos(
    spark: SparkSession,
    repos: Iterable[tuple[str, str, str]],
    extensions: Iterable[str] = tuple(fixed.INDEX_LANGUAGES),
    skipped: Iterable[str] = fixed.SKIP_DIRS,
) -> DataFrame:
    """`files` rows of several source trees, given as (repo_id, project_name, root), in one scan.

    Content that is not valid UTF-8 is repaired. Unreadable files are left out; `scan_trees` reports them.
    """
    tree = scan_trees(spark, repos, extensions, skipped).filter(F.col("error").isNull())
    content = F.make_valid_utf8(F.col("raw").cast("string"))
    return tree.select(
        "repo_id",
        "project_name",
        "file_path",
        paths.index_language("file_path").alias("language"),
        "size",
        text.line_count(content).alias("lines"),
        "mtime",
        content.alias("content"),
    )


def scan_repo(spark: SparkSession, root: str, repo: str | None = None, project: str | None = None, **options) -> DataFrame:
    """S1 for one source tree; id and project name default to those derived from its absolute path."""
    root = os.path.abspath(root)
    if repo is None:
        repo = hashlib.sha256(root.encode()).hexdigest()[:12]
    return scan_repos(spark, [(repo, project or os.path.basename(root), root)], **options)


def scan_documents(df: DataFrame, mapping: Mapping[str, Column]) -> DataFrame:
    """`files` rows from a document table.

    `mapping` gives repo_id, project_name, file_path, mtime and content; language, size and lines are derived.
    """
    base = df.select(*[mapping[c].alias(c) for c in ("repo_id", "project_name", "file_path", "mtime", "content")])
    return base.select(
        "repo_id",
        "project_name",
        "file_path",
        paths.index_language("file_path").alias("language"),
        F.octet_length("content").cast("bigint").alias("size"),
        text.line_count("content").alias("lines"),
        "mtime",
        "content",
    ).to(FILES)
