"""Path columns: extensions, languages, directories, containment, repository ids."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspan.functions import fixed

UNKNOWN = "unknown"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, table: Mapping) -> Column:
    """Literal-map lookup; null when the key is absent. Folds to a constant map, so no join is planned."""
    return F.element_at(F.expr("map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items()) + ")"), key)


def literal(value: str | int) -> str:
    """SQL literal; one parsed expression is much cheaper to build than one call per element."""
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def extension(path: Column | str) -> Column:
    """Text from the last dot of the last path segment, or ''."""
    return F.regexp_extract(col(path), r"([.][^./]*)$", 1)


def index_language(path: Column | str, table: Mapping = fixed.INDEX_LANGUAGES) -> Column:
    """Language of an indexable file, case-sensitive; 'unknown' otherwise."""
    return F.coalesce(lookup(extension(path), table), F.lit(UNKNOWN))


def detect_language(path: Column | str, table: Mapping = fixed.DISPLAY_LANGUAGES) -> Column:
    """Language from the lower-cased extension over the wide map."""
    return F.coalesce(lookup(F.lower(extension(path)), table), F.lit(UNKNOWN))


def parser_language(path: Column | str, table: Mapping = fixed.PARSER_LANGUAGES) -> Column:
    """Symbol-parser group of a file, '' when there is none."""
    return F.coalesce(lookup(F.lower(extension(path)), table), F.lit(""))


def parent_dirs(path: Column | str) -> Column:
    """Directory segments of a path, the file name left out."""
    parts = F.split(col(path), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def in_directory(path: Column | str, names: Iterable[str], dotted: bool = False) -> Column:
    """True when a directory on the path has one of the names (or starts with a dot)."""
    names = list(names)

    def hit(segment: Column) -> Column:
        test = segment.isin(names)
        return test | segment.startswith(".") if dotted else test

    return F.exists(parent_dirs(path), hit)


def matches_patterns(path: Column | str, patterns: Iterable[str]) -> Column:
    """F3 predicate: 'dir/' anywhere on the path, '*.ext' or a plain name as a suffix.

    The fixed pattern list becomes one directory test and one compiled regular expression, so the filter stays in the
    scan stage instead of becoming a non-equi join.
    """
    patterns = sorted(set(patterns))
    dirs = [p[:-1] for p in patterns if p.endswith("/")]
    tails = [p[1:] if p.startswith("*.") else p for p in patterns if not p.endswith("/")]
    test = F.lit(False)
    if dirs:
        test = test | in_directory(path, dirs)
    if tails:
        test = test | col(path).rlike("(?:" + "|".join(re.escape(t) for t in tails) + ")$")
    return test


def normalize_path(path: Column | str) -> Column:
    """Absolute path with '.', '..' and empty segments resolved."""
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    segments = F.aggregate(
        F.split(col(path), "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", up(acc)).otherwise(F.array_append(acc, s)),
    )
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def within_root(path: Column | str, root: Column | str) -> Column:
    """path strictly below root after resolving '..'; 'a/bc' is not below 'a/b'. `root` may be a literal column."""
    return F.startswith(normalize_path(path), F.concat(normalize_path(root), F.lit("/")))


def repo_id(path: Column | str) -> Column:
    """First 12 hex digits of SHA-256 of the absolute repository path."""
    return F.substring(F.sha2(col(path), 256), 1, 12)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def join_location(repo_path: Column | str, file_path: Column | str) -> Column:
    """Absolute location of a file below its repository."""
    return F.concat_ws("/", F.regexp_replace(col(repo_path), "/+$", ""), col(file_path))
