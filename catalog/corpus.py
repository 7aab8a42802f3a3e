"""Canonical tables derived from the given ones, once as DataFrames and once as SQL blocks.

Every derivation covers the whole table. Paths, languages and states are computed columns, so that all branches of the
operators occur; no rows are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import block, case, quoted
from seekspan.functions import fixed, paths, text
from seekspan.operators.chunking import window_chunks
from seekspan.plans.indexing import with_identifiers
from seekspan.schemas import CHUNKS, conform
from seekspan.sources.files import scan_documents

DIRS = ["src", "internal", "vendor", "node_modules", "tests", "build", ".github", "lib"]
EXTS = [".go", ".py", ".ts", ".tsx", ".js", ".jsx", ".java", ".swift", ".md", ".rs"]
NOW = "2024-03-10 12:00:00"
CUTOFF = "2024-03-01 00:00:00"
MODEL = "fixture"
INPUT_PARTITIONS = "spark.seekspan.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # benchmark and tests read tables of one row group, which Spark cannot split, and ask for more partitions
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts), df.columns[0]) if parts else df


def stamp(literal: str):
    return F.lit(literal).cast("timestamp")


def pick(values: list[str], n) -> F.Column:
    return F.element_at(F.expr(f"array({quoted(values)})"), (n % len(values) + 1).cast("int"))


def file_path(n, stem: str) -> F.Column:
    return F.concat(pick(DIRS, n), F.lit(f"/{stem}_"), n.cast("string"), pick(EXTS, n))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return scan_documents(
        table(spark, sf_dir, "documents"),
        {
            "repo_id": paths.repo_id("source"),
            "project_name": F.col("source"),
            "file_path": file_path(n, "doc"),
            "mtime": F.timestamp_seconds(F.unix_timestamp(stamp("2024-01-01 00:00:00")) + n * 60),
            "content": F.col("text"),
        },
    )


EXT_SQL = r"regexp_extract(file_path, '([.][^./]*)$', 1)"
PATH_SQL = (
    f"([{quoted(DIRS)}])[({{n}} % {len(DIRS)})::INT + 1] || '/{{stem}}_' || {{n}}"
    f" || ([{quoted(EXTS)}])[({{n}} % {len(EXTS)})::INT + 1]"
)
LANGUAGE_SQL = case(EXT_SQL, fixed.INDEX_LANGUAGES, "'unknown'")
NEWLINES_SQL = "(length({c}) - length(replace({c}, chr(10), '')))"

block(
    "named_files",
    f"""SELECT substr(sha256(source), 1, 12) AS repo_id, source AS project_name,
  {PATH_SQL.format(n="doc_id", stem="doc")} AS file_path,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS mtime, text AS content FROM documents""",
)
block(
    "files",
    f"""SELECT repo_id, project_name, file_path, {LANGUAGE_SQL} AS language, strlen(content)::BIGINT AS size,
  ({NEWLINES_SQL.format(c="content")} + 1)::INT AS lines, mtime, content FROM named_files""",
    "named_files",
)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per source; the commit and time tell when it was last indexed."""
    name = F.col("project_name")
    return (
        files(spark, sf_dir)
        .select("repo_id", "project_name")
        .distinct()
        .select(
            "repo_id",
            "project_name",
            F.concat(F.lit("/repos/"), name).alias("repo_path"),
            F.when(~name.endswith("3"), F.substring(F.sha2(name, 256), 1, 40)).alias("last_indexed_commit"),
            F.when(~name.endswith("3"), stamp("2024-02-20 08:30:00")).alias("indexed_at"),
        )
    )


block(
    "projects",
    """SELECT repo_id, project_name, '/repos/' || project_name AS repo_path,
  CASE WHEN NOT ends_with(project_name, '3') THEN substr(sha256(project_name), 1, 40) END AS last_indexed_commit,
  CASE WHEN NOT ends_with(project_name, '3') THEN TIMESTAMP '2024-02-20 08:30:00' END AS indexed_at
  FROM (SELECT DISTINCT repo_id, project_name FROM files)""",
    "files",
)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_identifiers(window_chunks(files(spark, sf_dir)))


block(
    "pieces",
    """SELECT repo_id, project_name, file_path, language, i, substring(content, i * 1000 + 1, 1200) AS content
  FROM (SELECT *, unnest(range(greatest(1, ceil((length(content) - 200) / 1000.0))::BIGINT)) AS i
        FROM files WHERE length(content) > 0)""",
    "files",
)
block(
    "windows",
    f"""SELECT *, start_line + nl AS end_line, md5(content) AS content_md5, sha256(content) AS content_hash,
  floor(length(content) / 4)::INT AS chunk_tokens,
  substr(sha256(repo_id || ':' || file_path || ':' || start_line || '-' || (start_line + nl) || ':' || content), 1, 16)
    AS chunk_id
  FROM (SELECT *, (1 + coalesce(sum(nl) OVER (PARTITION BY repo_id, file_path ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start_line
        FROM (SELECT *, {NEWLINES_SQL.format(c="content")}::INT AS nl FROM pieces))""",
    "pieces",
)

# Lifecycle states by language: swift is deleted, java has no status, the rest is active. Deleted rows are stamped by
# their length, except below lib/.
STATUS_SQL = "CASE language WHEN 'swift' THEN 'deleted' WHEN 'java' THEN NULL ELSE 'active' END"


def with_states(df: DataFrame) -> DataFrame:
    language = F.col("language")
    gone = language == "swift"
    days = F.length("content") % 60
    return df.withColumns(
        {
            "status": F.when(gone, "deleted").when(language != "java", "active"),
            "deleted_at": F.when(
                gone & ~F.col("file_path").startswith("lib/"),
                F.timestamp_seconds(F.unix_timestamp(stamp("2024-02-01 00:00:00")) + days * 86400),
            ),
            "deleted_in_commit": F.when(gone, F.substring("content_hash", 1, 8)),
        }
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = windows(spark, sf_dir).withColumns({"model_id": F.lit(MODEL), "indexed_at": stamp("2024-01-31 00:00:00")})
    return conform(with_states(base), CHUNKS)


block(
    "states",
    f"""SELECT *, {STATUS_SQL} AS status,
  CASE WHEN language = 'swift' AND NOT starts_with(file_path, 'lib/')
    THEN TIMESTAMP '2024-02-01' + to_days((length(content) % 60)::INT) END AS deleted_at,
  CASE WHEN language = 'swift' THEN substr(content_hash, 1, 8) END AS deleted_in_commit FROM windows""",
    "windows",
)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier snapshot of `files`: java files were modified since, go files lay under another path."""
    f = files(spark, sf_dir)
    language = F.col("language")
    return f.select(
        "repo_id",
        F.when(language == "go", F.concat(F.lit("old/"), F.col("file_path"))).otherwise(F.col("file_path")).alias("file_path"),
        "language",
        F.col("lines").alias("line_count"),
        F.lit(0).cast("bigint").alias("chunk_count"),
        F.timestamp_seconds(
            F.unix_timestamp("mtime") - F.when(language == "java", 3600).otherwise(0) + F.lit(0.25)
        ).alias("mtime"),
        F.when(language == "java", text.content_hash(F.lit(""))).otherwise(text.content_hash("content")).alias("content_hash"),
    )


block(
    "manifest",
    """SELECT repo_id, CASE WHEN language = 'go' THEN 'old/' || file_path ELSE file_path END AS file_path, language,
  lines AS line_count, mtime - CASE WHEN language = 'java' THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END
    + INTERVAL 250 MILLISECOND AS mtime,
  CASE WHEN language = 'java' THEN sha256('') ELSE sha256(content) END AS content_hash FROM files""",
    "files",
)


def name_status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change line per file (by directory), including blank lines and unknown statuses."""
    p = F.col("file_path")
    kind = F.split(p, "/")[0]
    renamed = F.concat(F.lit("lib/renamed "), F.element_at(F.split(p, "/"), -1))
    line = (
        F.when(kind == "src", F.concat(F.lit("A\t"), p))
        .when(kind == "internal", F.concat(F.lit("M\t"), p))
        .when(kind == "vendor", F.concat(F.lit("D\t"), p))
        .when(kind == "lib", F.concat(F.lit("R100\t"), p, F.lit("\t"), renamed))
        .when(kind == "tests", F.concat(F.lit("R087\t"), p, F.lit("\t"), renamed, F.lit(".txt")))
        .when(kind == "build", F.concat(F.lit("C75\t"), p))
        .when(kind == ".github", F.lit(""))
        .otherwise(F.lit("M"))
    )
    return files(spark, sf_dir).select("repo_id", line.alias("line"))


block(
    "name_status_lines",
    r"""SELECT repo_id, CASE split_part(file_path, '/', 1)
    WHEN 'src' THEN 'A' || chr(9) || file_path
    WHEN 'internal' THEN 'M' || chr(9) || file_path
    WHEN 'vendor' THEN 'D' || chr(9) || file_path
    WHEN 'lib' THEN 'R100' || chr(9) || file_path || chr(9) || 'lib/renamed ' || split_part(file_path, '/', 2)
    WHEN 'tests' THEN 'R087' || chr(9) || file_path || chr(9) || 'lib/renamed ' || split_part(file_path, '/', 2) || '.txt'
    WHEN 'build' THEN 'C75' || chr(9) || file_path
    WHEN '.github' THEN '' ELSE 'M' END AS line FROM files""",
    "files",
)
block(
    "name_status",
    """SELECT repo_id, split_part(line, chr(9), 1) AS status, split_part(line, chr(9), 2) AS file_path,
  CASE WHEN len(string_split(line, chr(9))) > 2 THEN split_part(line, chr(9), 3) END AS new_path
  FROM name_status_lines WHERE len(string_split(line, chr(9))) >= 2""",
    "name_status_lines",
)


def symbol_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested symbol dump of every file of at least three lines: one symbol per ten lines, alternately a function and
    a class; a class has a method, with a local function inside, and a field. Swift files come in the flat form."""
    f = files(spark, sf_dir).filter(F.col("lines") >= 3)
    block_no = F.sequence(F.lit(0), F.floor((F.col("lines") - 1) / F.lit(10)).cast("int"))

    def span(first, last):
        point = lambda line: F.struct(line.cast("int").alias("line"), F.lit(0).alias("character"))
        end = F.least(last, F.col("lines") - 1)
        return F.struct(point(first).alias("start"), point(end).alias("end"))

    def node(name, kind, first, last, *children):
        where = span(first, last)
        flat = F.col("language") == "swift"
        empty = F.lit(None)
        fields = [
            name.alias("name"),
            kind.cast("int").alias("kind"),
            F.when(~flat, where).alias("range"),
            F.when(flat, F.struct(F.lit("file:///x").alias("uri"), where.alias("range"))).alias("location"),
        ]
        return F.struct(*fields, *(c.alias("children") for c in children))

    def top(b):
        first = b * 10
        odd = b % 2 == 1
        label = b.cast("string")
        inner = node(F.concat(F.lit("inner"), label), F.lit(12), first + 2, first + 3)
        method = node(F.concat(F.lit("method"), label), F.lit(6), first + 1, first + 4, F.array(inner))
        # the field has no children; the array needs one shape, so it gets an empty list
        field = node(F.concat(F.lit("field"), label), F.lit(8), first + 5, first + 9, F.filter(F.array(inner), lambda x: F.lit(False)))
        children = F.when(odd & (F.col("language") != "swift") & (F.col("lines") > first + 5), F.array(method, field))
        return node(
            F.concat(F.when(odd, "Class").otherwise("func"), label),
            F.when(odd, 5).otherwise(12),
            first,
            first + 9,
            children,
        )

    return f.select("repo_id", "file_path", F.transform(block_no, top).alias("symbols"))


block(
    "blocks",
    """SELECT repo_id, file_path, language, lines, unnest(range(((lines - 1) // 10 + 1)::BIGINT)) AS b
  FROM files WHERE lines >= 3""",
    "files",
)
block(
    "symbols",
    """SELECT repo_id, file_path, b::VARCHAR AS symbol_id, NULL::VARCHAR AS parent_id, ''::VARCHAR AS ancestors, 0 AS depth,
    CASE WHEN b % 2 = 1 THEN 'Class' ELSE 'func' END || b AS name,
    CASE WHEN b % 2 = 1 THEN 'class' ELSE 'function' END AS kind, NULL::VARCHAR AS parent_name,
    (b * 10 + 1)::INT AS start_line, least(b * 10 + 10, lines)::INT AS end_line FROM blocks
  UNION ALL
  SELECT repo_id, file_path, b || '.0', b::VARCHAR, b::VARCHAR, 1, 'method' || b, 'method', 'Class' || b,
    (b * 10 + 2)::INT, least(b * 10 + 5, lines)::INT FROM blocks
    WHERE b % 2 = 1 AND language <> 'swift' AND lines > b * 10 + 5
  UNION ALL
  SELECT repo_id, file_path, b || '.1', b::VARCHAR, b::VARCHAR, 1, 'field' || b, 'field', 'Class' || b,
    (b * 10 + 6)::INT, least(b * 10 + 10, lines)::INT FROM blocks
    WHERE b % 2 = 1 AND language <> 'swift' AND lines > b * 10 + 5
  UNION ALL
  SELECT repo_id, file_path, b || '.0.0', b || '.0', b || ' ' || b || '.0', 2, 'inner' || b, 'function', 'method' || b,
    (b * 10 + 3)::INT, least(b * 10 + 4, lines)::INT FROM blocks
    WHERE b % 2 = 1 AND language <> 'swift' AND lines > b * 10 + 5""",
    "blocks",
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as a chunk table with one collection per label."""
    n = F.col("vec_id")
    base = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.lpad(n.cast("string"), 10, "0")).alias("chunk_id"),
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("repo_id"),
        F.concat(F.lit("project"), F.col("label").cast("string")).alias("project_name"),
        file_path(n, "v").alias("file_path"),
        F.concat(F.lit("vector "), n.cast("string")).alias("content"),
        F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"),
        F.lit(MODEL).alias("model_id"),
        stamp("2024-01-31 00:00:00").alias("indexed_at"),
        "embedding",
    )
    named = base.withColumn("language", paths.index_language("file_path")).withColumn(
        "content_hash", text.content_hash("content")
    )
    return conform(with_states(named), CHUNKS)


block(
    "named_vectors",
    f"""SELECT 'v' || lpad(vec_id::VARCHAR, 10, '0') AS chunk_id, 'label' || label AS repo_id,
  'project' || label AS project_name, {PATH_SQL.format(n="vec_id", stem="v")} AS file_path,
  'vector ' || vec_id AS content, embedding FROM embeddings""",
)
block(
    "vectors",
    f"""SELECT *, {STATUS_SQL} AS status,
  CASE WHEN language = 'swift' AND NOT starts_with(file_path, 'lib/')
    THEN TIMESTAMP '2024-02-01' + to_days((length(content) % 60)::INT) END AS deleted_at
  FROM (SELECT *, {LANGUAGE_SQL} AS language FROM named_vectors)""",
    "named_vectors",
)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per collection: the mean of its vectors, rounded so that both engines agree on it."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("label").agg(ordered.alias("v")).select(
        F.concat(F.lit("q"), F.col("label").cast("string")).alias("query_id"),
        F.transform("v", lambda s: s["x"]).alias("query_vec"),
    )


def mean_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """Mean of all vectors: the query vector of the single-query searches."""
    cells = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    return [r["x"] for r in means.orderBy("pos").collect()]


block(
    "cells",
    """SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings""",
)
block(
    "centroids",
    """SELECT 'q' || label AS query_id, list(x ORDER BY pos) AS query_vec
  FROM (SELECT label, pos, round(avg(x), 6) AS x FROM cells GROUP BY label, pos) GROUP BY label""",
    "cells",
)
block(
    "mean_vector",
    "SELECT list(x ORDER BY pos) AS query_vec FROM (SELECT pos, round(avg(x), 6) AS x FROM cells GROUP BY pos)",
    "cells",
)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed attempts: the error events, keyed by user."""
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select(
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


block("attempts", "SELECT '10.0.0.' || user_id AS ip, ts, event_id FROM events WHERE event_type = 'error'")

OPS = {"view": "QUERY", "click": "INDEX", "purchase": "DELETE", "signup": "CLEANUP", "error": "AUTH_FAIL"}


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        paths.lookup(F.col("event_type"), OPS).alias("op"),
        F.concat(F.lit("src"), (user % 10).cast("string")).alias("repo"),
        (n % 7).alias("files"),
        F.when(user % 3 != 0, F.concat(F.lit("u "), user.cast("string"))).alias("user"),
    )


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines of all events; some carry an unknown operation, no fields, or are cut off."""
    from seekspan.operators.audit import format_audit

    lines = format_audit(audit_events(spark, sf_dir), ["repo", "files", "user"])
    line = (
        F.when(F.col("files") == 5, F.regexp_replace("line", r"\] \[[A-Z_]+\]", "] [REBUILD]"))
        .when(F.col("files") == 6, F.substring("line", 1, 12))
        .when(F.col("files") == 0, F.regexp_replace("line", r"\] repo=.*$", "] "))
        .otherwise(F.col("line"))
    )
    return lines.select("ts", line.alias("line"))


block(
    "audit_events",
    f"""SELECT ts, {case("event_type", OPS, "NULL")} AS op, 'src' || (user_id % 10) AS repo, event_id % 7 AS files,
  CASE WHEN user_id % 3 <> 0 THEN 'u ' || user_id END AS "user" FROM events""",
)
block(
    "audit_full",
    """SELECT *, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || op || '] repo=' || repo || ' files=' || files
  || coalesce(' user="' || "user" || '"', '') AS line FROM audit_events""",
    "audit_events",
)
block(
    "audit_lines",
    r"""SELECT ts, CASE files WHEN 5 THEN regexp_replace(line, '\] \[[A-Z_]+\]', '] [REBUILD]')
    WHEN 6 THEN substr(line, 1, 12) WHEN 0 THEN regexp_replace(line, '\] repo=.*$', '] ') ELSE line END AS line
  FROM audit_full""",
    "audit_full",
)
block(
    "audit_parsed",
    r"""SELECT line, CASE WHEN ok THEN regexp_extract(line, '^\[([0-9: -]{19})\]', 1) END AS stamp,
    CASE WHEN ok THEN regexp_extract(line, '\] \[([A-Z_]+)\]', 1) END AS op,
    nullif(regexp_extract(line, 'repo=(\S+)', 1), '') AS repo, nullif(regexp_extract(line, 'files=(\S+)', 1), '') AS files,
    nullif(regexp_extract(line, 'user="([^"]*)"', 1), '') AS "user"
  FROM (SELECT line, regexp_matches(line, '^\[[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\] \[[A-Z_]+\]') AS ok
        FROM audit_lines)""",
    "audit_lines",
)
