"""Row-level derivations and filters over the derived corpus (P, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import corpus
from catalog.base import case, query, quoted, sql
from seekspan.functions import fixed, paths, scoring, text, times
from seekspan.operators import filters
from seekspan.plans.indexing import with_metadata

FILE = "repo_id, file_path"
KEY = ["repo_id", "file_path"]
EXT = corpus.EXT_SQL


def _state_text(column: str = "ts") -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def _as_text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query("p1_index_language", sql(f"SELECT {FILE}, {corpus.LANGUAGE_SQL} AS language FROM named_files", "named_files"))
def p1(spark, d):
    return corpus.files(spark, d).select(*KEY, paths.index_language("file_path").alias("language"))


@query(
    "p2_detect_language",
    sql(
        f"SELECT {FILE}, {case(f'lower({EXT})', fixed.DISPLAY_LANGUAGES, quoted(['unknown']))} AS language FROM named_files",
        "named_files",
    ),
)
def p2(spark, d):
    return corpus.files(spark, d).select(*KEY, paths.detect_language("file_path").alias("language"))


@query(
    "p3_parser_language",
    sql(
        f"SELECT {FILE}, {case(f'lower({EXT})', fixed.PARSER_LANGUAGES, quoted(['']))} AS parser FROM named_files",
        "named_files",
    ),
)
def p3(spark, d):
    return corpus.files(spark, d).select(*KEY, paths.parser_language("file_path").alias("parser"))


@query(
    "p4_line_count",
    f"SELECT doc_id, ({corpus.NEWLINES_SQL.format(c='text')} + 1)::INT AS lines FROM documents",
)
def p4(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", text.line_count("text").alias("lines"))


@query(
    "p5_estimate_tokens",
    "SELECT doc_id, floor(length(text) / 4)::INT AS tokens, floor(strlen(text) / 4)::INT AS byte_tokens FROM documents",
)
def p5(spark, d):
    return corpus.table(spark, d, "documents").select(
        "doc_id",
        text.estimate_tokens("text").alias("tokens"),
        text.estimate_tokens("text", unit="byte").alias("byte_tokens"),
    )


@query("p6_content_md5", "SELECT doc_id, md5(text) AS md5 FROM documents")
def p6(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", text.content_md5("text").alias("md5"))


@query("p7_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def p7(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", text.content_hash("text").alias("content_hash"))


@query("p8_chunk_id", sql("SELECT chunk_id, repo_id, file_path, start_line, end_line FROM windows", "windows"))
def p8(spark, d):
    return corpus.windows(spark, d).select("chunk_id", *KEY, "start_line", "end_line")


@query(
    "p9_repo_id",
    "SELECT page_id, substr(sha256('/' || url), 1, 12) AS repo_id FROM pages",
)
def p9(spark, d):
    return corpus.table(spark, d, "pages").select(
        "page_id", paths.repo_id(F.concat(F.lit("/"), F.col("url"))).alias("repo_id")
    )


@query(
    "p10_chunk_metadata",
    sql(
        f"""SELECT chunk_id, repo_id, project_name, file_path, language, start_line, end_line, content_hash, chunk_tokens,
  'fixture' AS model_id, '{corpus.NOW}' AS indexed_at, 'active' AS status, false AS is_split FROM windows""",
        "windows",
    ),
)
def p10(spark, d):
    rows = with_metadata(corpus.windows(spark, d), corpus.MODEL, corpus.stamp(corpus.NOW))
    return rows.select(
        "chunk_id", "repo_id", "project_name", "file_path", "language", "start_line", "end_line", "content_hash",
        "chunk_tokens", "model_id", _as_text("indexed_at").alias("indexed_at"), "status", "is_split",
    )


@query(
    "p11_metadata_json",
    sql(
        """SELECT chunk_id, '{"file_path":"' || file_path || '","start_line":' || start_line || ',"end_line":' || end_line
  || coalesce(',"status":"' || status || '"', '') || coalesce(',"deleted_in_commit":"' || deleted_in_commit || '"', '')
  || '}' AS metadata FROM states""",
        "states",
    ),
)
def p11(spark, d):
    return corpus.states(spark, d).select(
        "chunk_id",
        text.metadata_json("file_path", "start_line", "end_line", "status", "deleted_in_commit").alias("metadata"),
    )


DISTANCE = "list_distance(embedding::DOUBLE[], (SELECT query_vec FROM mean_vector))"


@query(
    "p12_similarity",
    sql(
        f"SELECT chunk_id, round(1 / (1 + {DISTANCE}), 6) AS similarity FROM vectors", "vectors", "mean_vector"
    ),
)
def p12(spark, d):
    distance = scoring.vector_distance("embedding", corpus.mean_vector(spark, d))
    return corpus.vectors(spark, d).select("chunk_id", F.round(scoring.similarity(distance), 6).alias("similarity"))


@query(
    "p13_similarity_band",
    """SELECT event_id, CASE WHEN s >= 0.9 THEN 'excellent' WHEN s >= 0.75 THEN 'good' WHEN s >= 0.6 THEN 'moderate'
  ELSE 'weak' END AS band FROM (SELECT event_id, 1 / (1 + value / 10) AS s FROM events)""",
)
def p13(spark, d):
    score = scoring.similarity(F.col("value") / 10)
    return (
        corpus.table(spark, d, "events")
        .select("event_id", score.alias("s"))
        .select("event_id", scoring.similarity_band("s").alias("band"))
    )


PREVIEW_SQL = r"""CASE WHEN NOT regexp_matches({c}, '[^\x09-\x0D \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]') THEN '(empty)' ELSE (
  SELECT string_agg(CASE WHEN length(l) > 100 THEN substr(l, 1, 100) || '...' ELSE l END, '{sep}' ORDER BY n)
    || CASE WHEN count(*) FILTER (WHERE true) = 4 AND max(total) > max(first) + 3 THEN '{sep}...' ELSE '' END
  FROM (SELECT l, n, first, total FROM (
    SELECT unnest(string_split({c}, chr(10))) AS l, unnest(range(1, len(string_split({c}, chr(10))) + 1)) AS n,
      len(string_split({c}, chr(10))) AS total,
      list_position([regexp_matches(x, '[^\x09-\x0D \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]') for x in string_split({c}, chr(10))], true) AS first)
    WHERE n >= first AND n < first + 4)) END"""


@query(
    "p14_content_preview",
    f"SELECT doc_id, {PREVIEW_SQL.format(c='text', sep=' | ')} AS preview FROM documents",
)
def p14(spark, d):
    return corpus.table(spark, d, "documents").select(
        "doc_id", F.array_join(text.content_preview("text"), " | ").alias("preview")
    )


def relative_sql(ts: str, now: str) -> str:
    age = f"epoch_us({now}) - epoch_us({ts})"
    return f"""CASE WHEN {age} < 60000000 THEN 'just now'
  WHEN {age} < 3600000000 THEN (({age}) // 60000000) || ' min ago'
  WHEN {age} < 86400000000 THEN (({age}) // 3600000000) || ' hours ago'
  WHEN {age} < 2592000000000 THEN (({age}) // 86400000000) || ' days ago'
  ELSE strftime({ts}, '%Y-%m-%d') END"""


@query(
    "p15_relative_time",
    f"SELECT event_id, {relative_sql('ts', '(SELECT max(ts) FROM events)')} AS age FROM events",
)
def p15(spark, d):
    events = corpus.table(spark, d, "events")
    # the age is taken from the newest event, so that every unit occurs
    newest = events.agg(F.max(F.col("ts").cast("timestamp")).alias("now")).first()["now"]
    now = F.timestamp_micros(F.lit(round(newest.timestamp() * 1_000_000)))
    return events.select("event_id", times.relative_time("ts", now).alias("age"))


@query(
    "p17_symbol_preview",
    sql(
        """SELECT chunk_id, replace(CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END,
  chr(10), '↵') AS preview FROM windows""",
        "windows",
    ),
)
def p17(spark, d):
    return corpus.windows(spark, d).select("chunk_id", text.symbol_preview("content").alias("preview"))


@query(
    "p18_deleted_date",
    sql("SELECT chunk_id, coalesce(strftime(deleted_at, '%Y-%m-%d'), 'unknown') AS deleted FROM states", "states"),
)
def p18(spark, d):
    return corpus.states(spark, d).select("chunk_id", times.stamp_date("deleted_at").alias("deleted"))


# --- filters ---------------------------------------------------------------------------------------------------------


@query("f1_code_files", sql(f"SELECT {FILE}, language FROM files WHERE language <> 'unknown'", "files"))
def f1(spark, d):
    return filters.code_files(corpus.files(spark, d)).select(*KEY, "language")


SKIPPED_SQL = f"""len([s for s in string_split(file_path, '/')[:-2]
  if s IN ({quoted(fixed.SKIP_DIRS)}) OR starts_with(s, '.')]) > 0"""


@query("f2_skip_dirs", sql(f"SELECT {FILE} FROM files WHERE NOT {SKIPPED_SQL}", "files"))
def f2(spark, d):
    return filters.skip_dirs(corpus.files(spark, d)).select(*KEY)


def pattern_sql(column: str = "file_path") -> str:
    tests = []
    for p in filters.all_patterns():
        if p.endswith("/"):
            tests.append(f"contains({column}, '/{p}') OR starts_with({column}, '{p}')")
        else:
            tests.append(f"ends_with({column}, '{p.removeprefix('*')}')")
    return "(" + " OR ".join(tests) + ")"


@query("f3_ignore_patterns", sql(f"SELECT {FILE} FROM files WHERE NOT {pattern_sql()}", "files"))
def f3(spark, d):
    return filters.ignore_patterns(corpus.files(spark, d)).select(*KEY)


def _ignored(files):
    """Ignored by version control: the whole tests directory, and each markdown file by name."""
    p = F.col("file_path")
    path = F.when(p.startswith("tests/"), "tests/").when(p.endswith(".md"), p)
    return files.select("repo_id", path.alias("path")).filter(F.col("path").isNotNull()).distinct()


@query(
    "f4_vcs_ignored",
    sql(
        f"SELECT {FILE} FROM files WHERE NOT starts_with(file_path, 'tests/') AND NOT ends_with(file_path, '.md')",
        "files",
    ),
)
def f4(spark, d):
    f = corpus.files(spark, d)
    return filters.drop_ignored(f, _ignored(f)).select(*KEY)


@query(
    "f5_within_root",
    sql(
        """SELECT repo_id, file_path, language,
  CASE language WHEN 'go' THEN true WHEN 'python' THEN false WHEN 'java' THEN false WHEN 'swift' THEN true ELSE true END
    AS inside FROM files""",
        "files",
    ),
)
def f5(spark, d):
    """Paths below, beside and outside their root, written with '.' and '..' segments."""
    f = corpus.files(spark, d)
    p, language = F.col("file_path"), F.col("language")
    full = (
        F.when(language == "go", F.concat(F.lit("/repos/a/x/../"), p))
        .when(language == "python", F.concat(F.lit("/repos/a/../"), p))
        .when(language == "java", F.concat(F.lit("/repos/ab/"), p))
        .when(language == "swift", F.concat(F.lit("/repos/b/../a/./"), p))
        .otherwise(F.concat(F.lit("/repos//a/"), p))
    )
    return f.select(*KEY, "language", paths.within_root(full, F.lit("/repos/a")).alias("inside"))


@query(
    "f6_valid_commit",
    """SELECT doc_id, regexp_matches(c, '^[0-9a-f]{7,64}$') AS valid FROM (
  SELECT doc_id, CASE lang WHEN 'de' THEN upper(sha256(text)) WHEN 'es' THEN substr(sha256(text), 1, 6)
    WHEN 'fr' THEN sha256(text) || 'a' ELSE substr(sha256(text), 1, 7 + (n_chars % 58)::INT) END AS c FROM documents)""",
)
def f6(spark, d):
    h, lang = text.content_hash("text"), F.col("lang")
    c = (
        F.when(lang == "de", F.upper(h))
        .when(lang == "es", F.substring(h, 1, 6))
        .when(lang == "fr", F.concat(h, F.lit("a")))
        .otherwise(F.substr(h, F.lit(1), (7 + F.col("n_chars") % 58).cast("int")))
    )
    return corpus.table(spark, d, "documents").select("doc_id", text.valid_commit(c).alias("valid"))


@query(
    "f7_language_filter",
    sql("SELECT chunk_id, language FROM states WHERE language IN ('go', 'python')", "states"),
)
def f7(spark, d):
    return corpus.states(spark, d).filter(filters.language_filter("go,python")).select("chunk_id", "language")


@query(
    "f8_status_filter",
    sql(
        """SELECT 'default' AS mode, chunk_id, status FROM states WHERE status = 'active'
  UNION ALL SELECT 'include', chunk_id, status FROM states
  UNION ALL SELECT 'only', chunk_id, status FROM states WHERE status = 'deleted'""",
        "states",
    ),
)
def f8(spark, d):
    s = corpus.states(spark, d)
    modes = {"default": {}, "include": {"include_deleted": True}, "only": {"include_deleted": True, "deleted_only": True}}
    rows = [
        s.filter(filters.status_filter(**flags)).select(F.lit(mode).alias("mode"), "chunk_id", "status")
        for mode, flags in modes.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "f9_metadata_filter",
    sql(
        "SELECT chunk_id, file_path FROM states WHERE language = 'python' AND project_name = 'src1' AND contains(file_path, 'internal')",
        "states",
    ),
)
def f9(spark, d):
    s = corpus.states(spark, d)
    test = filters.metadata_filter(s.schema, {"language": "python", "project_name": "src1", "file_path": "internal"})
    return s.filter(test).select("chunk_id", "file_path")


@query("f10_path_contains", sql("SELECT chunk_id FROM states WHERE contains(file_path, 'doc_1')", "states"))
def f10(spark, d):
    return corpus.states(spark, d).filter(filters.path_contains("doc_1")).select("chunk_id")


@query("f11_path_prefix", sql("SELECT chunk_id FROM states WHERE starts_with(file_path, 'src/')", "states"))
def f11(spark, d):
    return corpus.states(spark, d).filter(filters.path_prefix("src/")).select("chunk_id")


@query(
    "f12_exclude_path",
    sql("SELECT chunk_id FROM states WHERE NOT regexp_matches(file_path, 'vendor|tests?/|_1.*[.]py$')", "states"),
)
def f12(spark, d):
    return corpus.states(spark, d).filter(filters.exclude_path("vendor|tests?/|_1.*[.]py$")).select("chunk_id")


@query(
    "f13_conjunction",
    sql(
        "SELECT chunk_id FROM states WHERE status = 'active' AND language = 'go' AND starts_with(file_path, 'src/')",
        "states",
    ),
)
def f13(spark, d):
    tests = [filters.status_filter(), filters.language_filter(["go"]), filters.path_prefix("src/")]
    return corpus.states(spark, d).filter(filters.and_all(tests)).select("chunk_id")


@query(
    "f14_scope",
    sql(
        """SELECT 'ids' AS mode, chunk_id, repo_id FROM states WHERE repo_id = substr(sha256('src1'), 1, 12)
  UNION ALL SELECT 'names', chunk_id, repo_id FROM states WHERE project_name IN ('src0', 'src2')
  UNION ALL SELECT 'all', chunk_id, repo_id FROM states""",
        "states",
    ),
)
def f14(spark, d):
    s, p = corpus.states(spark, d), corpus.projects(spark, d)
    one = spark.range(1).select(paths.repo_id(F.lit("src1"))).first()[0]
    parts = {
        "ids": filters.scope(s, one),
        "names": filters.scope(s, names=["src0", "src2"], projects=p),
        "all": filters.scope(s),
    }
    rows = [df.select(F.lit(mode).alias("mode"), "chunk_id", "repo_id") for mode, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "f15_same_dimension",
    sql("SELECT chunk_id, len(embedding)::INT AS dim FROM vectors WHERE language <> 'go'", "vectors"),
)
def f15(spark, d):
    """Go rows are cut to three dimensions first."""
    v = corpus.vectors(spark, d)
    mixed = v.withColumn(
        "embedding", F.when(F.col("language") == "go", F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    )
    return filters.same_dim(mixed, 64).select("chunk_id", F.size("embedding").alias("dim"))


@query(
    "standard_file_filters",
    sql(
        f"SELECT {FILE}, language FROM files WHERE language <> 'unknown' AND NOT {SKIPPED_SQL} AND NOT {pattern_sql()}",
        "files",
    ),
)
def standard(spark, d):
    return filters.standard_files(corpus.files(spark, d)).select(*KEY, "language")
