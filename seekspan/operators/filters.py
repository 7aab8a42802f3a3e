"""Row filters (F1-F15). All of them are plain predicates that Spark can push into the scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspan.functions import fixed, paths

ACTIVE = "active"
DELETED = "deleted"


def code_files(df: DataFrame, path: str = "file_path") -> DataFrame:
    """keep indexable source files."""
    return df.filter(paths.index_language(path) != paths.UNKNOWN)


def skip_dirs(df: DataFrame, names: Iterable[str] = fixed.SKIP_DIRS, path: str = "file_path") -> DataFrame:
    """drop files below a skipped or dotted directory."""
    return df.filter(~paths.in_directory(path, names, dotted=True))


def all_patterns(languages: Iterable[str] | None = None) -> list[str]:
    """Distinct ignore patterns of the given languages (all by default)."""
    table = fixed.IGNORE_PATTERNS
    return sorted(set(chain.from_iterable(table.get(name, []) for name in (languages or table))))


def ignore_patterns(df: DataFrame, patterns: Iterable[str] | None = None, path: str = "file_path") -> DataFrame:
    """drop files matching an ignore pattern."""
    chosen = all_patterns() if patterns is None else patterns
    return df.filter(~paths.matches_patterns(path, chosen))


def drop_ignored(df: DataFrame, ignored: DataFrame) -> DataFrame:
    """drop files the version control system ignores.

    `ignored(repo_id, path)` lists files, and directories with a trailing '/'. A file is looked up under its own path
    and under each of its parent directories, so both cases are equi-joins on narrow rows; the wide rows take part in
    a single anti join on the file key.
    """
    key = ["repo_id", "file_path"]
    parts = F.split("file_path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n < F.size(parts), "/").otherwise("")),
    )
    hits = (
        df.select(*key, F.explode(prefixes).alias("path"))
        .join(ignored.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
        .select(*key)
        .distinct()
    )
    return df.join(hits, key, "left_anti")


def standard_files(df: DataFrame, patterns: Iterable[str] | None = None, vcs_ignored: DataFrame | None = None) -> DataFrame:
    """The discovery filters in order: code files, directories, then the VCS list or else the language patterns."""
    kept = skip_dirs(code_files(df))
    return drop_ignored(kept, vcs_ignored) if vcs_ignored is not None else ignore_patterns(kept, patterns)


def language_filter(languages: str | Sequence[str], column: str = "language") -> Column:
    """language in a list; a comma list is accepted."""
    names = languages.split(",") if isinstance(languages, str) else list(languages)
    return F.col(column) == names[0] if len(names) == 1 else F.col(column).isin(names)


def status_filter(include_deleted: bool = False, deleted_only: bool = False) -> Column:
    """F8: active only by default; `deleted_only` wins over `include_deleted`. A missing status is never 'active'."""
    if deleted_only:
        return F.col("status") == DELETED
    return F.lit(True) if include_deleted else F.col("status") == ACTIVE


def path_contains(text: str) -> Column:
    """F10."""
    return F.col("file_path").contains(text)


def path_prefix(prefix: str) -> Column:
    """F11."""
    return F.col("file_path").startswith(prefix)


def exclude_path(pattern: str) -> Column:
    """the regular expression is found nowhere in the path."""
    return ~F.col("file_path").rlike(pattern)


def metadata_filter(schema: T.StructType, conditions: Mapping[str, str]) -> Column:
    """equality on text metadata; `file_path` means 'contains'.

    Values are text, so a key that is unknown or not a text field matches nothing.
    """
    text = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}

    def one(key: str, value: str) -> Column:
        if key == "file_path":
            return path_contains(value)
        return F.col(key) == value if key in text else F.lit(False)

    return and_all([one(k, v) for k, v in conditions.items()])


def and_all(conditions: Iterable[Column]) -> Column:
    """conjunction; true when empty."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def scope(
    chunks: DataFrame,
    repo_ids: str | Sequence[str] | None = None,
    names: Sequence[str] | None = None,
    projects: DataFrame | None = None,
) -> DataFrame:
    """one collection, several, or all; by id (partition pruning) or by project name through `projects`.

    The name join carries no hint: the project rows that match are few, and the optimizer broadcasts them after
    checking their size.
    """
    if repo_ids:
        wanted = [repo_ids] if isinstance(repo_ids, str) else list(repo_ids)
        return chunks.filter(F.col("repo_id").isin(wanted))
    if names:
        if projects is None:
            raise ValueError("names need a projects table")
        chosen = projects.filter(F.col("project_name").isin(list(names))).select("repo_id")
        return chunks.join(chosen, "repo_id", "left_semi")
    return chunks


def same_dim(df: DataFrame, n: int, column: str = "embedding") -> DataFrame:
    """keep vectors of the query's dimension."""
    return df.filter(F.size(column) == n)
