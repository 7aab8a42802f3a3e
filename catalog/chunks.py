"""Chunking, tokens, embeddings and their reports (C, W1, W4, W5, E1, E2, E8, J2-J5, U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import corpus
from catalog.base import block, query, quoted, sql
from catalog.derive import KEY
from seekspan.functions import fixed, text
from seekspan.operators import embedding, reports, tokens
from seekspan.operators.chunking import hybrid_chunks, symbol_chunks, window_chunks
from seekspan.plans.indexing import build_chunks, dedupe_chunks, with_identifiers
from seekspan.session import materialize, scratch_dir
from seekspan.sources.symbols import flatten_symbols
from seekspan.sources.vectors import VectorCache

NEWLINES = corpus.NEWLINES_SQL
PART = ["repo_id", "file_path", "start_line", "end_line", "symbol_name", "symbol_kind", "parent_name", "chunk_tokens"]
PART_SQL = ", ".join(PART) + ", md5(content) AS md5"


def parts(df, *more):
    return df.select(*PART, *more, F.md5("content").alias("md5"))


@query(
    "c1_window_chunks",
    sql(
        """SELECT repo_id, file_path, i AS chunk_index, start_line, end_line, chunk_tokens, content_md5 AS md5
  FROM windows""",
        "windows",
    ),
)
def c1(spark, d):
    return window_chunks(corpus.files(spark, d)).select(
        *KEY,
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        "start_line",
        "end_line",
        "chunk_tokens",
        F.md5("content").alias("md5"),
    )


block(
    "byte_pieces",
    """SELECT repo_id, file_path, i, array_slice(raw, i * 1000 + 1, least(i * 1000 + 1200, octet_length(raw))) AS piece
  FROM (SELECT repo_id, file_path, encode(content) AS raw,
          unnest(range(greatest(1, ceil((octet_length(encode(content)) - 200) / 1000.0))::BIGINT)) AS i
        FROM files WHERE length(content) > 0)""",
    "files",
)


@query(
    "c1_window_chunks_bytes",
    sql(
        """SELECT repo_id, file_path, i AS chunk_index, octet_length(piece)::INT AS bytes, md5(piece) AS md5,
  floor(octet_length(piece) / 4)::INT AS chunk_tokens FROM byte_pieces""",
        "byte_pieces",
    ),
)
def c1_bytes(spark, d):
    return window_chunks(corpus.files(spark, d), unit="byte").select(
        *KEY,
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.octet_length("raw").alias("bytes"),
        F.md5("raw").alias("md5"),
        "chunk_tokens",
    )


@query(
    "w1_chunk_lines",
    sql(
        f"""SELECT chunk_id, start_line, end_line,
  (1 + length(before) - length(replace(before, chr(10), '')))::INT AS true_start
  FROM (SELECT w.*, substring(f.content, 1, (w.i * 1000)::BIGINT) AS before FROM windows w
        JOIN files f USING (repo_id, file_path))""",
        "windows",
        "files",
    ),
)
def w1(spark, d):
    """Both line numberings of the same windows."""
    f = corpus.files(spark, d)
    true = window_chunks(f, true_lines=True).select(*KEY, "chunk_index", F.col("start_line").alias("true_start"))
    return (
        with_identifiers(window_chunks(f))
        .select(*KEY, "chunk_index", "chunk_id", "start_line", "end_line")
        .join(true, [*KEY, "chunk_index"])
        .select("chunk_id", "start_line", "end_line", "true_start")
    )


@query(
    "w5_dedupe_chunks",
    sql(
        """SELECT chunk_id, min(origin) AS origin, count(*) AS copies FROM
  (SELECT chunk_id, 0 AS origin FROM windows UNION ALL SELECT chunk_id, 1 FROM windows) GROUP BY chunk_id""",
        "windows",
    ),
)
def w5(spark, d):
    """Every chunk arrives twice (and some ids repeat within a file); the first arrival is kept."""
    w = corpus.windows(spark, d)
    twice = w.withColumn("fit_index", F.lit(0)).unionByName(w.withColumn("fit_index", F.lit(1)))
    kept = dedupe_chunks(twice).select("chunk_id", F.col("fit_index").alias("origin"))
    copies = twice.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("copies"))
    return kept.join(copies, "chunk_id")


# --- symbols -----------------------------------------------------------------------------------------------------------

block(
    "lines",
    """SELECT repo_id, file_path, unnest(string_split(content, chr(10))) AS line,
  unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM files WHERE lines >= 3""",
    "files",
)
block(
    "bodies",
    f"""SELECT s.*, b.content, floor(length(b.content) / 4)::INT AS tokens,
    floor(length(b.content) / 4)::INT > {2 * fixed.TARGET_TOKENS} AS big
  FROM symbols s JOIN (
    SELECT s.repo_id, s.file_path, s.symbol_id, string_agg(line, chr(10) ORDER BY n) AS content
    FROM symbols s JOIN lines l ON l.repo_id = s.repo_id AND l.file_path = s.file_path
      AND l.n BETWEEN s.start_line AND s.end_line GROUP BY ALL) b USING (repo_id, file_path, symbol_id)""",
    "symbols",
    "lines",
)
block(
    "kept_symbols",
    f"""SELECT s.* FROM bodies s WHERE (depth = 0 OR kind IN ({quoted(fixed.SIGNIFICANT_KINDS)}))
  AND NOT EXISTS (SELECT 1 FROM bodies a WHERE a.big AND a.repo_id = s.repo_id AND a.file_path = s.file_path
    AND list_contains(string_split(s.ancestors, ' '), a.symbol_id))""",
    "bodies",
)
TARGET_CHARS = int(fixed.TARGET_TOKENS * fixed.CHARS_PER_TOKEN)
# running size of the lines of each oversize symbol; `before` and `total` bound the greedy packing
block(
    "packing",
    """SELECT s.repo_id, s.file_path, s.symbol_id, s.start_line, s.end_line, n, line, length(line) AS len,
    sum(length(line) + 1) OVER w - length(line) - 1 AS before, sum(length(line) + 1) OVER w - 1 AS total
  FROM kept_symbols s JOIN lines l ON s.big AND l.repo_id = s.repo_id AND l.file_path = s.file_path
    AND l.n BETWEEN s.start_line AND s.end_line
  WINDOW w AS (PARTITION BY s.repo_id, s.file_path, s.symbol_id ORDER BY n)""",
    "kept_symbols",
    "lines",
)
# one greedy run of lines for every possible first line
block(
    "runs",
    f"""SELECT a.repo_id, a.file_path, a.symbol_id, a.start_line, a.n AS first_line,
    greatest(a.n, coalesce(max(b.n), a.n)) AS last_line
  FROM packing a LEFT JOIN packing b ON b.repo_id = a.repo_id AND b.file_path = a.file_path
    AND b.symbol_id = a.symbol_id AND b.n >= a.n AND b.total - a.before <= {TARGET_CHARS}
  GROUP BY a.repo_id, a.file_path, a.symbol_id, a.start_line, a.n""",
    "packing",
)
block(
    "run_chain",
    """SELECT repo_id, file_path, symbol_id, first_line, last_line, 1 AS part FROM runs WHERE first_line = start_line
  UNION ALL
  SELECT r.repo_id, r.file_path, r.symbol_id, r.first_line, r.last_line, c.part + 1
  FROM run_chain c JOIN runs r ON r.repo_id = c.repo_id AND r.file_path = c.file_path AND r.symbol_id = c.symbol_id
    AND r.first_line = CASE WHEN c.last_line - 2 > c.first_line THEN c.last_line - 2 ELSE c.last_line + 1 END""",
    "runs",
)
block(
    "symbol_parts",
    """SELECT s.repo_id, s.file_path, s.start_line, s.end_line, s.name AS symbol_name, s.kind AS symbol_kind, s.parent_name,
    s.tokens AS chunk_tokens, NULL::INT AS split_index, s.content FROM kept_symbols s WHERE NOT s.big
  UNION ALL
  SELECT s.repo_id, s.file_path, c.first_line::INT, c.last_line::INT, s.name || ' (part ' || c.part || ')', s.kind,
    s.parent_name, floor((length(p.content) + 1) / 4)::INT, c.part, p.content
  FROM kept_symbols s JOIN run_chain c USING (repo_id, file_path, symbol_id)
  JOIN (SELECT c.repo_id, c.file_path, c.symbol_id, c.part, string_agg(line, chr(10) ORDER BY n) AS content
        FROM run_chain c JOIN lines l ON l.repo_id = c.repo_id AND l.file_path = c.file_path
          AND l.n BETWEEN c.first_line AND c.last_line GROUP BY ALL) p USING (repo_id, file_path, symbol_id, part)""",
    "kept_symbols",
    "run_chain",
)


def symbols(spark, d):
    return flatten_symbols(corpus.symbol_dumps(spark, d))


def symbols_of(spark, d):
    """As a function of listed files: only their dumps are flattened."""
    return lambda listed: flatten_symbols(corpus.symbol_dumps(spark, d).join(listed, KEY, "left_semi"))


@query(
    "s7_symbols",
    sql(
        """SELECT repo_id, file_path, symbol_id, parent_id, ancestors, depth, name, kind, parent_name, start_line, end_line
  FROM symbols""",
        "symbols",
    ),
)
def s7(spark, d):
    return symbols(spark, d).withColumn("ancestors", F.array_join("ancestor_ids", " ")).drop("ancestor_ids")


@query(
    "c2_symbol_chunks",
    sql(f"SELECT {PART_SQL}, split_index FROM symbol_parts", "symbol_parts"),
)
def c2(spark, d):
    """Symbol chunks, the oversize ones in parts."""
    return parts(symbol_chunks(corpus.files(spark, d), symbols(spark, d)), "split_index")


DEEP = 12


def deep_dumps(spark, d):
    """A dump per file, as JSON text: a chain of DEEP functions, each inside the one before, all on the first line."""
    point = '"range":{"start":{"line":0,"character":0},"end":{"line":0,"character":0}}'
    heads = "".join(f'{{"name":"deep{i}","kind":12,{point},"children":[' for i in range(DEEP))
    return corpus.files(spark, d).select("repo_id", "file_path", F.lit(f"[{heads}{']}' * DEEP}]").alias("symbols"))


block(
    "deep_symbols",
    f"""SELECT repo_id, file_path, '0' || repeat('.0', n::INT) AS symbol_id, n::INT AS depth, 'deep' || n AS name,
    CASE WHEN n > 0 THEN 'deep' || (n - 1) END AS parent_name, split_part(content, chr(10), 1) AS content
  FROM (SELECT *, unnest(range({DEEP})) AS n FROM files)""",
    "files",
)


@query(
    "s7_deep_symbols",
    sql(
        "SELECT repo_id, file_path, symbol_id, depth, name, parent_name, 1 AS start_line, 1 AS end_line FROM deep_symbols",
        "deep_symbols",
    ),
)
def s7_deep(spark, d):
    """S7 with more levels than a fixed schema would have."""
    return flatten_symbols(deep_dumps(spark, d)).select(
        "repo_id", "file_path", "symbol_id", "depth", "name", "parent_name", "start_line", "end_line"
    )


@query(
    "c2_deep_symbols",
    sql(
        f"""SELECT repo_id, file_path, 1 AS start_line, 1 AS end_line, name || CASE WHEN big THEN ' (part 1)' ELSE '' END AS symbol_name,
  'function' AS symbol_kind, parent_name, floor((length(content) + CASE WHEN big THEN 1 ELSE 0 END) / 4)::INT AS chunk_tokens,
  md5(content) AS md5 FROM (SELECT *, floor(length(content) / 4)::INT > {2 * fixed.TARGET_TOKENS} AS big FROM deep_symbols)
  WHERE NOT big OR depth = 0""",
        "deep_symbols",
    ),
)
def c2_deep(spark, d):
    """Chunks of deeply nested symbols; a split one takes its descendants with it."""
    return parts(symbol_chunks(corpus.files(spark, d), flatten_symbols(deep_dumps(spark, d))))


@query(
    "c3_nested_symbols",
    sql(
        f"""SELECT {PART_SQL} FROM (SELECT repo_id, file_path, start_line, end_line, name AS symbol_name,
  kind AS symbol_kind, parent_name, tokens AS chunk_tokens, content FROM kept_symbols WHERE depth > 0 AND NOT big)""",
        "kept_symbols",
    ),
)
def c3(spark, d):
    """Nested symbols that get a chunk of their own."""
    rows = symbol_chunks(corpus.files(spark, d), symbols(spark, d))
    return parts(rows.filter(F.col("parent_name").isNotNull() & ~F.col("is_split")))


@query(
    "c4_split_symbols",
    sql(f"SELECT {PART_SQL}, split_index FROM symbol_parts WHERE split_index IS NOT NULL", "symbol_parts"),
)
def c4(spark, d):
    rows = symbol_chunks(corpus.files(spark, d), symbols(spark, d))
    return parts(rows.filter("is_split"), "split_index")


block(
    "hybrid_files",
    """SELECT *, regexp_matches(file_path, '[.](go|py|ts|tsx|js|jsx|rs|java|swift|ml|mli)$') AS parser FROM files""",
    "files",
)
block(
    "hybrid",
    """SELECT p.*, 'symbol' AS method, NULL::VARCHAR AS fallback_reason FROM symbol_parts p
    JOIN hybrid_files h USING (repo_id, file_path) WHERE h.parser
  UNION ALL
  SELECT w.repo_id, w.file_path, w.start_line, w.end_line, NULL::VARCHAR, 'window', NULL::VARCHAR, w.chunk_tokens,
    NULL::INT, w.content, 'window', CASE WHEN h.parser THEN 'no_symbols' ELSE 'no_parser' END
    FROM windows w JOIN hybrid_files h USING (repo_id, file_path) WHERE NOT h.parser OR h.lines < 3""",
    "symbol_parts",
    "windows",
    "hybrid_files",
)


@query("c5_hybrid_chunks", sql(f"SELECT {PART_SQL}, method, fallback_reason FROM hybrid", "hybrid"))
def c5(spark, d):
    """Both branches united."""
    return parts(hybrid_chunks(corpus.files(spark, d), symbols(spark, d)), "method", "fallback_reason")


@query(
    "c5_forced_windows",
    sql("SELECT repo_id, file_path, 'forced' AS fallback_reason, count(*) AS chunks FROM windows GROUP BY ALL", "windows"),
)
def c5_forced(spark, d):
    rows = hybrid_chunks(corpus.files(spark, d), symbols(spark, d), force_window=True)
    return rows.groupBy(*KEY, "fallback_reason").agg(F.count(F.lit(1)).alias("chunks"))


# --- tokens ------------------------------------------------------------------------------------------------------------

TOKENS_SQL = r"(len(regexp_extract_all({c}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f]')) + 2)::INT"
LIMIT = 220


@query("e1_count_tokens", f"SELECT doc_id, {TOKENS_SQL.format(c='text')} AS tokens FROM documents")
def e1(spark, d):
    return tokens.count_tokens(corpus.table(spark, d, "documents"), column="text").select("doc_id", "tokens")


@query("e1_count_tokens_plugin", f"SELECT doc_id, {TOKENS_SQL.format(c='text')} AS tokens FROM documents")
def e1_plugin(spark, d):
    """The same counts from a batch function on the executors."""
    docs = corpus.table(spark, d, "documents")
    return tokens.count_tokens(docs, tokens.pattern_counter, column="text").select("doc_id", "tokens")


@query("j5_token_cache", f"SELECT doc_id, {TOKENS_SQL.format(c='text')} AS tokens FROM documents")
def j5(spark, d):
    """Each distinct text is counted once; contents with more than two copies count as hot and are spread."""
    docs = corpus.table(spark, d, "documents")
    counted = tokens.count_tokens_once(docs, tokens.pattern_counter, column="text")
    return counted.select("doc_id", "tokens")


# Re-splitting: each level cuts the pieces that are still too long; sizes are computed in single precision.
SIZE_SQL = f"""greatest({fixed.MIN_RESPLIT_WINDOW}, trunc({{limit}}::FLOAT * (length(content)::FLOAT / tokens::FLOAT)
  * {fixed.RESPLIT_FILL}::FLOAT)::BIGINT)"""
block(
    "fit_levels",
    f"""SELECT chunk_id AS root, repo_id, file_path, '' AS spot, start_line, end_line, content,
    {TOKENS_SQL.format(c="content")} AS tokens FROM windows
  UNION ALL
  SELECT root, repo_id, file_path, spot || '.' || lpad(k::VARCHAR, 4, '0'),
    (start_line + coalesce(sum(nl) OVER (PARTITION BY root, spot ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT,
    (start_line + sum(nl) OVER (PARTITION BY root, spot ORDER BY k))::INT, content,
    {TOKENS_SQL.format(c="content")}
  FROM (SELECT root, repo_id, file_path, spot, start_line, k, piece AS content,
          {NEWLINES.format(c="piece")} AS nl
        FROM (SELECT root, repo_id, file_path, spot, start_line, k,
                substring(content, k * (size - size // 10) + 1, size) AS piece
              FROM (SELECT *, unnest(range(greatest(1, ceil((length(content) - size // 10)
                      / (size - size // 10)::DOUBLE))::BIGINT)) AS k
                    FROM (SELECT *, {SIZE_SQL.format(limit=LIMIT)} AS size FROM fit_levels WHERE tokens > {LIMIT}))))""",
    "windows",
)
# the same for symbol-aligned chunks and the usual limit
block(
    "hybrid_levels",
    f"""SELECT row_number() OVER () AS root, repo_id, file_path, method, '' AS spot, start_line, end_line, content,
    {TOKENS_SQL.format(c="content")} AS tokens FROM hybrid
  UNION ALL
  SELECT root, repo_id, file_path, method, spot || '.' || lpad(k::VARCHAR, 4, '0'),
    (start_line + coalesce(sum(nl) OVER (PARTITION BY root, spot ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT,
    (start_line + sum(nl) OVER (PARTITION BY root, spot ORDER BY k))::INT, content,
    {TOKENS_SQL.format(c="content")}
  FROM (SELECT root, repo_id, file_path, method, spot, start_line, k, piece AS content,
          {NEWLINES.format(c="piece")} AS nl
        FROM (SELECT root, repo_id, file_path, method, spot, start_line, k,
                substring(content, k * (size - size // 10) + 1, size) AS piece
              FROM (SELECT *, unnest(range(greatest(1, ceil((length(content) - size // 10)
                      / (size - size // 10)::DOUBLE))::BIGINT)) AS k
                    FROM (SELECT *, {SIZE_SQL.format(limit=fixed.MAX_TOKENS)} AS size FROM hybrid_levels
                      WHERE tokens > {fixed.MAX_TOKENS}))))""",
    "hybrid",
)
block(
    "hybrid_fitted",
    f"""SELECT *, substr(sha256(repo_id || ':' || file_path || ':' || start_line || '-' || end_line || ':' || content), 1, 16) AS chunk_id
  FROM hybrid_levels WHERE tokens <= {fixed.MAX_TOKENS}""",
    "hybrid_levels",
)
block("fitted", f"SELECT * FROM fit_levels WHERE tokens <= {LIMIT}", "fit_levels")


@query(
    "c6_fit_tokens",
    sql(
        "SELECT repo_id, file_path, start_line, end_line, tokens AS chunk_tokens, md5(content) AS md5 FROM fitted",
        "fitted",
    ),
)
def c6(spark, d):
    """A limit below the usual chunk size, so that many chunks are cut again."""
    fitted = tokens.fit_tokens(window_chunks(corpus.files(spark, d)), LIMIT)
    return fitted.select(*KEY, "start_line", "end_line", "chunk_tokens", F.md5("content").alias("md5"))


@query(
    "c7_build_chunks",
    sql(
        """SELECT DISTINCT substr(sha256(repo_id || ':' || file_path || ':' || start_line || '-' || end_line || ':' || content),
    1, 16) AS chunk_id, repo_id, file_path, start_line, end_line, tokens AS chunk_tokens,
  sha256(content) AS content_hash, 'active' AS status FROM fitted""",
        "fitted",
    ),
)
def c7(spark, d):
    built = build_chunks(corpus.files(spark, d), corpus.stamp(corpus.NOW), max_tokens=LIMIT)
    return built.select("chunk_id", *KEY, "start_line", "end_line", "chunk_tokens", "content_hash", "status")


@query(
    "c8_chunk_report",
    sql(
        """SELECT repo_id, file_path, i + 1 AS number, start_line, end_line, length(content)::INT AS chars,
  chunk_tokens AS tokens, substr(content_md5, 1, 8) || '...' AS hash FROM windows""",
        "windows",
    ),
)
def c8(spark, d):
    return reports.chunk_report(corpus.windows(spark, d)).withColumn("number", F.col("number").cast("bigint"))


@query(
    "c9_symbol_outline",
    sql(
        """SELECT repo_id, file_path, start_line, depth, symbol_id,
  repeat('  ', depth) || '• ' || name || ' (' || kind || ') [L' || start_line || '-' || end_line || ']' AS line
  FROM symbols""",
        "symbols",
    ),
)
def c9(spark, d):
    return reports.symbol_outline(symbols(spark, d))


@query(
    "t4_chunk_head",
    sql(
        """SELECT repo_id, file_path, (i + 1)::INT AS number, 'window-' || (i + 1) AS name, 'window' AS symbol_kind, start_line,
  end_line, chunk_tokens, greatest(count(*) OVER (PARTITION BY repo_id, file_path) - 5, 0) AS more
  FROM windows QUALIFY i < 5""",
        "windows",
    ),
)
def t4(spark, d):
    return reports.chunk_head(window_chunks(corpus.files(spark, d)))


@query(
    "p17_symbol_listing",
    sql(
        """SELECT repo_id, file_path, symbol_name, symbol_kind, parent_name, start_line, end_line,
  replace(CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END, chr(10), '↵') AS preview
  FROM hybrid""",
        "hybrid",
    ),
)
def p17(spark, d):
    return reports.symbol_listing(hybrid_chunks(corpus.files(spark, d), symbols(spark, d)))


# --- embeddings --------------------------------------------------------------------------------------------------------


# cells of the built-in model: words by the first four hex digits of their MD5
WORD_CELL_SQL = "('0x' || substr(md5(word), 1, 4))::INT % 64"
block(
    "cell_counts",
    f"""SELECT chunk_id, {WORD_CELL_SQL} AS cell, count(*) AS n FROM (
    SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS word
    FROM (SELECT DISTINCT chunk_id, content FROM windows)) GROUP BY ALL""",
    "windows",
)


@query(
    "e2_embed_texts",
    sql(
        """SELECT w.chunk_id, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY c.cell) AS counts
  FROM (SELECT DISTINCT chunk_id FROM windows) w CROSS JOIN (SELECT unnest(range(64)) AS cell) c
  LEFT JOIN cell_counts k ON k.chunk_id = w.chunk_id AND k.cell = c.cell GROUP BY w.chunk_id""",
        "cell_counts",
    ),
)
def e2(spark, d):
    """The built-in model before scaling: hashed word counts of every window."""
    rows = embedding.hash_embed(corpus.windows(spark, d).dropDuplicates(["chunk_id"]), unit=False)
    return rows.select("chunk_id", F.array_join(F.col("embedding").cast("array<int>"), ",").alias("counts"))


def letter_profile(texts):
    """A tiny plug-in model: how often a, e, i, o and u occur."""
    return [[float(t.count(c)) for c in "aeiou"] for t in texts]


PROFILE_SQL = "(length({c}) - length(replace({c}, '{v}', '')))::DOUBLE"


@query(
    "e2_embed_plugin",
    sql(
        "SELECT chunk_id, "
        + ", ".join(f"{PROFILE_SQL.format(c='content', v=v)} AS {v}" for v in "aeiou")
        + " FROM windows",
        "windows",
    ),
)
def e2_plugin(spark, d):
    rows = embedding.embed(corpus.windows(spark, d), letter_profile)
    values = [F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate("aeiou")]
    return rows.select("chunk_id", *values)


@query(
    "e8_embed_distinct",
    sql(
        "SELECT chunk_id, content_hash, "
        + ", ".join(f"{PROFILE_SQL.format(c='content', v=v)} AS {v}" for v in "aeiou")
        + " FROM windows",
        "windows",
    ),
)
def e8(spark, d):
    """Contents with more than two copies count as hot and are spread in the join back."""
    stored = materialize(corpus.windows(spark, d).select("chunk_id", "content", "content_hash"), "windows")
    rows = embedding.embed_distinct(stored, letter_profile)
    values = [F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate("aeiou")]
    return rows.select("chunk_id", "content_hash", *values)


@query(
    "e8_embed_cached",
    sql(
        "SELECT chunk_id, content_hash, "
        + ", ".join(f"{PROFILE_SQL.format(c='content', v=v)} AS {v}" for v in "aeiou")
        + " FROM windows",
        "windows",
    ),
)
def e8_cached(spark, d):
    """Two runs with a stored cache of vectors: every other chunk first, then all of them."""
    stored = materialize(corpus.windows(spark, d).select("chunk_id", "content", "content_hash"), "windows")
    cache = VectorCache(spark, scratch_dir(spark, "vectors"), "letters")
    cache.embed(stored.filter(F.crc32("chunk_id") % 2 == 0), letter_profile)
    rows = cache.embed(stored, letter_profile)
    values = [F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate("aeiou")]
    return rows.select("chunk_id", "content_hash", *values)


@query(
    "j4_attach_embeddings",
    """SELECT d.doc_id, e.vec_id, round(e.embedding[1]::DOUBLE, 6) AS first
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def j4(spark, d):
    """Documents and vectors are paired by a common content key (here the hash of the id)."""
    key = lambda c: text.content_hash(F.col(c).cast("string"))
    docs = corpus.table(spark, d, "documents").select("doc_id", key("doc_id").alias("content_hash"))
    vecs = corpus.table(spark, d, "embeddings").select(
        F.col("vec_id"), key("vec_id").alias("content_hash"), "embedding"
    )
    joined = embedding.attach_embeddings(docs, vecs)
    return joined.select(
        "doc_id",
        F.col("doc_id").alias("vec_id"),
        F.round(F.col("embedding")[0].cast("double"), 6).alias("first"),
    )


