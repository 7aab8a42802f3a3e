"""Text columns: counts, hashes, identifiers, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspan.functions import fixed
from seekspan.functions.paths import col

# A token is a run of ASCII word characters or one other non-blank character; two specials per text.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f]"
SPECIAL_TOKENS = 2


def newline_count(text: Column | str) -> Column:
    t = col(text)
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))


def line_count(text: Column | str) -> Column:
    """Newlines + 1."""
    return (newline_count(text) + 1).cast("int")


def estimate_tokens(text: Column | str, cpt: float = fixed.CHARS_PER_TOKEN, unit: str = "char") -> Column:
    """P5: floor(length / chars per token); `unit='byte'` measures UTF-8 bytes."""
    size = F.octet_length(col(text)) if unit == "byte" else F.length(col(text))
    return F.floor(size / F.lit(cpt)).cast("int")


def content_md5(content: Column | str) -> Column:
    """P6."""
    return F.md5(col(content))


def content_hash(content: Column | str) -> Column:
    """SHA-256 in hex."""
    return F.sha2(col(content), 256)


def chunk_id(repo: Column, path: Column, start: Column, end: Column, content: Column) -> Column:
    """First 16 hex digits of SHA-256('repo:path:start-end:content'). `content` may be binary."""
    head = F.concat(repo, F.lit(":"), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"))
    joined = F.concat(head.cast("binary"), content.cast("binary"))
    return F.substring(F.sha2(joined, 256), 1, 16)


def metadata_json(*fields: str) -> Column:
    """Metadata as JSON; null fields are absent."""
    return F.to_json(F.struct(*fields))


def count_tokens(text: Column | str, pattern: str | None = None, specials: int = SPECIAL_TOKENS) -> Column:
    """E1 default counter: tokens plus the special tokens, evaluated inside the JVM.

    Instead of listing all matches of `TOKEN_PATTERN`, each token is cut down to one character and blanks are dropped in
    one replacement; what is left is counted. Another pattern is counted match by match.
    """
    if pattern is not None:
        return (F.regexp_count(col(text), F.lit(pattern)) + specials).cast("int")
    word, blank = "[A-Za-z0-9_]", r"[ \t\n\r\f]"
    marks = F.regexp_replace(col(text), f"({word}){word}*{blank}*|{blank}+", "$1")
    return (F.length(marks) + specials).cast("int")


# anything but blanks of Unicode
SHOWN = r"[^\p{IsWhite_Space}]"


def content_preview(content: Column | str, n: int = 4, width: int = 100) -> Column:
    """First n lines after leading blank ones, '...' when there are more, long lines cut; ['(empty)'] if blank."""
    lines = F.split(col(content), "\n")
    first = F.array_position(F.transform(lines, lambda s: s.rlike(SHOWN)), True).cast("int")
    body = F.slice(lines, first, F.size(lines))
    cut = F.transform(
        F.slice(body, 1, n),
        lambda s: F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("..."))).otherwise(s),
    )
    more = F.when(F.size(body) > n, F.array_append(cut, F.lit("..."))).otherwise(cut)
    # slice() rejects position 0, so blank content is settled before the body is looked at
    blank = ~F.coalesce(col(content), F.lit("")).rlike(SHOWN)
    return F.when(blank, F.array(F.lit("(empty)"))).otherwise(more)


def symbol_preview(content: Column | str, width: int = 100) -> Column:
    """One-line preview, newlines shown as an arrow."""
    c = col(content)
    cut = F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)
    return F.replace(cut, F.lit("\n"), F.lit("↵"))


def shorten_query(text: Column | str, limit: int = fixed.QUERY_TEXT_LIMIT) -> Column:
    """Query text longer than the limit is cut and ends in '...'."""
    t = col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def valid_commit(c: Column | str) -> Column:
    """7 to 64 lower-case hex digits."""
    return col(c).rlike(r"\A[0-9a-f]{7,64}\z")
