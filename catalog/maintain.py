"""Sources, change detection, manifests, lifecycle and statistics (S, D, M, L, A, R1, R4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import corpus
from catalog.base import block, query, settings, sql, state_partitions
from catalog.chunks import letter_profile, symbols, symbols_of
from catalog.derive import KEY
from seekspan.functions import paths
from seekspan.operators import changes, lifecycle, reports
from seekspan.operators.chunking import hybrid_chunks
from seekspan.plans.indexing import build_chunks, build_manifest, build_project, full_index, incremental_index
from seekspan.schemas import CHUNKS, FILES
from seekspan.session import scratch_dir, small_batches
from seekspan.sources import tables
from seekspan.sources.name_status import read_name_status
from seekspan.sources.files import scan_repos
from seekspan.sources.symbols import read_symbols
from seekspan.sources.trees import write_file
from seekspan.sources.versions import VersionedChunks
from seekspan.streaming import index as live

NOW_SQL = f"TIMESTAMP '{corpus.NOW}'"
CUTOFF_SQL = f"TIMESTAMP '{corpus.CUTOFF}'"


def shown(column: str, alias: str | None = None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(alias or column)


def shown_sql(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {alias or column}"


# --- sources -----------------------------------------------------------------------------------------------------------


@query(
    "s1_scan_tree",
    sql(
        "SELECT repo_id, project_name, file_path, language, size, lines, sha256(content) AS content_hash FROM files"
        " WHERE language <> 'unknown' AND NOT regexp_matches(file_path, '^(vendor|node_modules|build|[.]github)/')",
        "files",
    ),
)
def s1(spark, d):
    """The corpus written out as one file tree per project and scanned again."""
    root = scratch_dir(spark, "trees")

    def spill(batches):
        import pandas as pd

        for batch in batches:
            for rid, path, content in zip(batch["repo_id"], batch["file_path"], batch["content"]):
                write_file(f"{root}/{rid}/{path}", content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    f = corpus.files(spark, d)
    small_batches(spark)
    f.select("repo_id", "file_path", "content").mapInPandas(spill, "n bigint").agg(F.sum("n")).collect()
    repos = [
        (r["repo_id"], r["project_name"], f"{root}/{r['repo_id']}")
        for r in f.select("repo_id", "project_name").distinct().collect()
    ]
    trees = scan_repos(spark, repos)
    return trees.select(
        "repo_id", "project_name", "file_path", "language", "size", "lines", F.sha2("content", 256).alias("content_hash")
    )


@query(
    "s2_scan_documents",
    sql(f"SELECT repo_id, project_name, file_path, language, size, lines, {shown_sql('mtime')} FROM files", "files"),
)
def s2(spark, d):
    return corpus.files(spark, d).select("repo_id", "project_name", "file_path", "language", "size", "lines", shown("mtime"))


@query(
    "s3_manifest_table",
    sql(f"SELECT repo_id, file_path, language, line_count, content_hash, {shown_sql('mtime')} FROM manifest", "manifest"),
)
def s3(spark, d):
    path = scratch_dir(spark, "manifest")
    tables.write_manifest(corpus.manifest(spark, d), path)
    return tables.read_manifest(spark, path).select(
        "repo_id", "file_path", "language", "line_count", "content_hash", shown("mtime")
    )


@query(
    "s3_manifest_json",
    sql(
        f"""SELECT repo_id, project_name, repo_path, last_indexed_commit, {shown_sql('indexed_at')}, file_path, line_count,
  content_hash, {shown_sql("mtime")} FROM projects JOIN manifest USING (repo_id)""",
        "projects",
        "manifest",
    ),
)
def s3_json(spark, d):
    """Exchange form: four JSON documents for each repository."""
    path = scratch_dir(spark, "manifests")
    tables.export_manifest_json(corpus.projects(spark, d), corpus.manifest(spark, d), path, parts=4)
    projects, files = tables.import_manifest_json(spark, path)
    return projects.join(files, "repo_id").select(
        "repo_id", "project_name", "repo_path", "last_indexed_commit", shown("indexed_at"), "file_path", "line_count",
        "content_hash", shown("mtime"),
    )


@query(
    "s4_chunk_table",
    sql("SELECT repo_id, chunk_id, status FROM states WHERE project_name IN ('src1', 'src3')", "states"),
)
def s4(spark, d):
    """Written by collection, read back for two collections and three columns."""
    path = scratch_dir(spark, "chunks")
    s = corpus.states(spark, d)
    tables.write_chunks(s, path)
    wanted = [r[0] for r in spark.range(1).select(paths.repo_id(F.lit("src1"))).union(
        spark.range(1).select(paths.repo_id(F.lit("src3")))).collect()]
    return tables.read_chunks(spark, path, wanted, ["repo_id", "chunk_id", "status"])


@query(
    "s6_name_status",
    sql("SELECT repo_id, status, file_path, new_path FROM name_status", "name_status"),
)
def s6(spark, d):
    return read_name_status(corpus.name_status_lines(spark, d))


@query(
    "s7_symbol_dump_files",
    sql("SELECT repo_id, file_path, symbol_id, depth, name, kind, start_line, end_line FROM symbols", "symbols"),
)
def s7_files(spark, d):
    """Dumps written as JSON files and read with the fixed schema."""
    path = scratch_dir(spark, "dumps")
    corpus.symbol_dumps(spark, d).write.json(path)
    return read_symbols(spark, path).select(
        "repo_id", "file_path", "symbol_id", "depth", "name", "kind", "start_line", "end_line"
    )


# --- changes -----------------------------------------------------------------------------------------------------------

block(
    "changes",
    """SELECT repo_id, file_path, CASE WHEN m.content_hash IS NULL THEN 'added' WHEN f.content IS NULL THEN 'deleted'
    WHEN date_trunc('second', f.mtime) <> date_trunc('second', m.mtime) THEN 'modified' END AS change
  FROM files f FULL JOIN manifest m USING (repo_id, file_path)""",
    "files",
    "manifest",
)


@query("d1_snapshot_diff", sql("SELECT * FROM changes WHERE change IS NOT NULL", "changes"))
def d1(spark, d):
    """D1, J1, U2, F16."""
    return changes.diff_snapshot(corpus.files(spark, d), corpus.manifest(spark, d)).drop("new_path")


@query(
    "d1_snapshot_diff_hash",
    sql(
        """SELECT repo_id, file_path, CASE WHEN m.content_hash IS NULL THEN 'added' WHEN f.content IS NULL THEN 'deleted'
    ELSE 'modified' END AS change FROM files f FULL JOIN manifest m USING (repo_id, file_path)
  WHERE sha256(f.content) IS DISTINCT FROM m.content_hash""",
        "files",
        "manifest",
    ),
)
def d1_hash(spark, d):
    return changes.diff_snapshot(corpus.files(spark, d), corpus.manifest(spark, d), by="hash").drop("new_path")


CODE_SQL = "regexp_matches({c}, '[.](go|py|ts|tsx|js|jsx|java|swift)$')"
block(
    "named_changes",
    f"""SELECT repo_id, file_path, CASE WHEN status = 'A' THEN 'added' WHEN status = 'M' THEN 'modified'
    WHEN status = 'D' THEN 'deleted' ELSE 'renamed' END AS change,
    CASE WHEN starts_with(status, 'R') THEN new_path END AS new_path
  FROM name_status WHERE {CODE_SQL.format(c="file_path")} AND (status IN ('A', 'M', 'D')
    OR (starts_with(status, 'R') AND {CODE_SQL.format(c="new_path")}))""",
    "name_status",
)


@query("d2_name_status_diff", sql("SELECT * FROM named_changes", "named_changes"))
def d2(spark, d):
    return changes.diff_name_status(read_name_status(corpus.name_status_lines(spark, d)))


@query(
    "d2_renames_split",
    sql(
        """SELECT repo_id, file_path, change FROM named_changes WHERE change <> 'renamed'
  UNION SELECT repo_id, file_path, 'deleted' FROM named_changes WHERE change = 'renamed'
  UNION SELECT repo_id, new_path, 'added' FROM named_changes WHERE change = 'renamed'""",
        "named_changes",
    ),
)
def d2_split(spark, d):
    return changes.expand_renames(changes.diff_name_status(read_name_status(corpus.name_status_lines(spark, d))))


@query(
    "u1_files_to_index",
    sql("SELECT repo_id, file_path FROM changes WHERE change IN ('added', 'modified')", "changes"),
)
def u1(spark, d):
    return changes.files_to_index(changes.diff_snapshot(corpus.files(spark, d), corpus.manifest(spark, d)))


@query(
    "d3_refresh_plan",
    sql(
        """SELECT repo_id, added, modified, deleted, renamed, CASE WHEN coalesce(last_indexed_commit, '') = '' THEN 'full'
    WHEN added + modified + deleted + renamed = 0 THEN 'none' ELSE 'incremental' END AS plan FROM (
  SELECT p.repo_id, p.last_indexed_commit, (count(*) FILTER (change = 'added'))::INT AS added,
    (count(*) FILTER (change = 'modified'))::INT AS modified, (count(*) FILTER (change = 'deleted'))::INT AS deleted,
    (count(*) FILTER (change = 'renamed'))::INT AS renamed
  FROM projects p LEFT JOIN changes c USING (repo_id) GROUP BY ALL)""",
        "projects",
        "changes",
    ),
)
def d3(spark, d):
    found = changes.diff_snapshot(corpus.files(spark, d), corpus.manifest(spark, d))
    return changes.plan_refresh(found, corpus.projects(spark, d))


STATE = ["chunk_id", "repo_id", "file_path", "status", "deleted_in_commit"]
STATE_SQL = "chunk_id, repo_id, file_path, status, deleted_in_commit"


@query(
    "d4_full_index",
    sql(
        "SELECT DISTINCT chunk_id, content_hash, 'active' AS status, 'letters' AS model_id, "
        "(length(content) - length(replace(content, 'e', '')))::DOUBLE AS e FROM windows",
        "windows",
    ),
)
def d4(spark, d):
    """Every file chunked and embedded by a plug-in model, each distinct content once."""
    index = full_index(
        corpus.files(spark, d), corpus.stamp(corpus.NOW), embedder=letter_profile, model_id="letters", max_tokens=2000
    )
    return index.select("chunk_id", "content_hash", "status", "model_id", F.col("embedding")[1].cast("double").alias("e"))


# chunks of an earlier run: those of the files in the manifest, each as one whole-file chunk
block(
    "stored",
    f"""SELECT substr(sha256(repo_id || ':' || file_path), 1, 16) AS chunk_id, repo_id, file_path, 'active' AS status,
    NULL::VARCHAR AS deleted_in_commit FROM manifest""",
    "manifest",
)


def stored(spark, d):
    """Chunk table of the earlier snapshot: one chunk per file of the manifest, plus unchanged windows of typescript."""
    rows = corpus.manifest(spark, d).select(
        F.substring(F.sha2(F.concat("repo_id", F.lit(":"), "file_path"), 256), 1, 16).alias("chunk_id"),
        "repo_id",
        "file_path",
        "language",
        F.lit("active").alias("status"),
    )
    return corpus.conform(rows, CHUNKS)


@query(
    "d4_full_index_prune",
    sql(
        f"""SELECT DISTINCT chunk_id, repo_id, 'active' AS status, NULL::VARCHAR AS deleted_at,
    (length(content) - length(replace(content, 'e', '')))::DOUBLE AS e FROM windows
  UNION ALL SELECT chunk_id, repo_id, 'deleted', '{corpus.NOW}', NULL FROM stored
    WHERE chunk_id NOT IN (SELECT chunk_id FROM windows)""",
        "windows",
        "stored",
    ),
)
def d4_prune(spark, d):
    index = full_index(
        corpus.files(spark, d), corpus.stamp(corpus.NOW), existing=stored(spark, d), prune=True,
        embedder=letter_profile, max_tokens=2000,
    )
    return index.select("chunk_id", "repo_id", "status", shown("deleted_at"), letter_e())


# `e`, the second number of the vector, is the count of that letter: the new chunks are really embedded
INCREMENTAL_SQL = """SELECT s.chunk_id, s.repo_id, s.file_path,
    CASE WHEN c.change IN ('deleted', 'modified') THEN 'deleted' ELSE 'active' END AS status,
    CASE WHEN c.change IN ('deleted', 'modified') THEN 'abc1234' END AS deleted_in_commit, NULL::DOUBLE AS e
  FROM stored s LEFT JOIN changes c USING (repo_id, file_path)
  UNION ALL SELECT DISTINCT w.chunk_id, w.repo_id, w.file_path, 'active', NULL,
    (length(w.content) - length(replace(w.content, 'e', '')))::DOUBLE FROM windows w
    JOIN changes c USING (repo_id, file_path) WHERE c.change IN ('added', 'modified')"""


def letter_e():
    return F.col("embedding")[1].cast("double").alias("e")


@query("d5_incremental_index", sql(INCREMENTAL_SQL, "stored", "changes", "windows"))
def d5(spark, d):
    f = corpus.files(spark, d)
    found = changes.diff_snapshot(f, corpus.manifest(spark, d))
    index = incremental_index(
        found, f, stored(spark, d), corpus.stamp(corpus.NOW), "abc1234", embedder=letter_profile, max_tokens=2000
    )
    return index.select(*STATE, letter_e())


@query(
    "d4_symbol_index",
    sql(
        """SELECT DISTINCT chunk_id, sha256(content) AS content_hash, method, tokens AS chunk_tokens, 'active' AS status,
    (length(content) - length(replace(content, 'e', '')))::DOUBLE AS e FROM hybrid_fitted""",
        "hybrid_fitted",
    ),
)
def d4_symbols(spark, d):
    """The index as users build it: symbols where a file has them, the usual token limit, vectors of a plug-in model."""
    index = full_index(corpus.files(spark, d), corpus.stamp(corpus.NOW), symbols(spark, d), embedder=letter_profile)
    return index.select("chunk_id", "content_hash", "method", "chunk_tokens", "status", letter_e())


SYMBOL_REFRESH_SQL = f"""SELECT s.chunk_id, s.repo_id, s.file_path, NULL::VARCHAR AS method,
    CASE WHEN c.change IN ('deleted', 'modified') THEN 'deleted' ELSE 'active' END AS status, NULL::DOUBLE AS e
  FROM stored s LEFT JOIN changes c USING (repo_id, file_path)
  UNION ALL SELECT DISTINCT w.chunk_id, w.repo_id, w.file_path, w.method, 'active',
    (length(w.content) - length(replace(w.content, 'e', '')))::DOUBLE FROM hybrid_fitted w
    JOIN changes c USING (repo_id, file_path) WHERE c.change IN ('added', 'modified')"""


@query("d5_symbol_index", sql(SYMBOL_REFRESH_SQL, "stored", "changes", "hybrid_fitted"))
def d5_symbols(spark, d):
    """The refresh as users run it, with symbols and the usual token limit, on a table of versions."""
    f = corpus.files(spark, d)
    found = changes.diff_snapshot(f, corpus.manifest(spark, d))
    table = versioned(spark, stored(spark, d))
    table.refresh(found, f, corpus.stamp(corpus.NOW), symbols=symbols_of(spark, d), embedder=letter_profile)
    return table.read().select("chunk_id", "repo_id", "file_path", "method", "status", letter_e())


def versioned(spark, chunks):
    """The chunks as a table of versions with few buckets."""
    return VersionedChunks.create(spark, scratch_dir(spark, "versions"), chunks, buckets=8)


@query("d5_versions", sql(INCREMENTAL_SQL, "stored", "changes", "windows"))
def d5_versions(spark, d):
    """The refresh as one more version of a stored table, applied twice under the same batch number."""
    f = corpus.files(spark, d)
    found = changes.diff_snapshot(f, corpus.manifest(spark, d))
    table = versioned(spark, stored(spark, d))
    for _ in range(2):
        table.refresh(found, f, corpus.stamp(corpus.NOW), "abc1234", embedder=letter_profile, max_tokens=2000, batch=("refresh", 1))
    return table.read().select(*STATE, letter_e())


@query(
    "m1_manifest",
    sql(
        f"""SELECT f.repo_id, f.file_path, f.language, f.lines AS line_count, coalesce(w.n, 0) AS chunk_count,
  {shown_sql("f.mtime", "mtime")}, sha256(f.content) AS content_hash FROM files f LEFT JOIN (
    SELECT repo_id, file_path, count(*) AS n FROM states WHERE status IS DISTINCT FROM 'deleted' GROUP BY ALL) w
  USING (repo_id, file_path)""",
        "files",
        "states",
    ),
)
def m1(spark, d):
    """M1, A5."""
    rows = build_manifest(corpus.files(spark, d), corpus.states(spark, d))
    return rows.withColumn("mtime", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss"))


@query(
    "m2_project",
    sql(
        f"""SELECT p.repo_id, p.project_name, p.repo_path, 'abc1234' AS last_indexed_commit, '{corpus.NOW}' AS indexed_at,
  count(s.chunk_id) FILTER (s.status IS DISTINCT FROM 'deleted') AS active_chunk_count,
  count(s.chunk_id) FILTER (s.status = 'deleted') AS deleted_chunk_count
  FROM projects p LEFT JOIN states s USING (repo_id) GROUP BY ALL""",
        "projects",
        "states",
    ),
)
def m2(spark, d):
    repos = corpus.projects(spark, d).select("repo_id", "project_name", "repo_path")
    rows = build_project(repos, corpus.states(spark, d), corpus.stamp(corpus.NOW), "abc1234")
    return rows.withColumn("indexed_at", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss"))


# --- lifecycle ---------------------------------------------------------------------------------------------------------

# A batch that rebuilds the go and java chunks: java ids are known, go ids are new.
block(
    "batch",
    """SELECT CASE language WHEN 'go' THEN substr(sha256(chunk_id), 1, 16) ELSE chunk_id END AS chunk_id, repo_id, file_path,
    'active' AS status, NULL::VARCHAR AS deleted_in_commit FROM states WHERE language IN ('go', 'java', 'swift')""",
    "states",
)


def batch(spark, d):
    new_id = F.when(F.col("language") == "go", F.substring(F.sha2("chunk_id", 256), 1, 16)).otherwise(F.col("chunk_id"))
    s = corpus.states(spark, d).filter(F.col("language").isin("go", "java", "swift")).dropDuplicates(["chunk_id"])
    return s.withColumns(
        {
            "chunk_id": new_id,
            "status": F.lit("active"),
            "deleted_at": F.lit(None).cast("timestamp"),
            "deleted_in_commit": F.lit(None).cast("string"),
        }
    )


@query(
    "l1_upsert",
    sql(
        f"""SELECT {STATE_SQL} FROM states WHERE chunk_id NOT IN (SELECT chunk_id FROM batch)
  UNION ALL SELECT DISTINCT {STATE_SQL} FROM batch""",
        "states",
        "batch",
    ),
)
def l1(spark, d):
    """L1, J8; tombstoned rows come back active."""
    return lifecycle.upsert(corpus.states(spark, d), batch(spark, d)).select(*STATE)


@query(
    "l1_versions",
    sql(
        f"""SELECT {STATE_SQL} FROM states WHERE chunk_id NOT IN (SELECT chunk_id FROM batch)
  UNION ALL SELECT DISTINCT {STATE_SQL} FROM batch""",
        "states",
        "batch",
    ),
)
def l1_versions(spark, d):
    """The upsert as a delta of a stored table, folded into its base afterwards."""
    table = versioned(spark, corpus.states(spark, d))
    table.upsert(batch(spark, d))
    table.compact(deltas=1)
    return table.read().select(*STATE)


@query(
    "l1_upsert_counts",
    sql(
        """SELECT repo_id, count(*) AS accepted, count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM states)) AS inserted,
  count(*) FILTER (chunk_id IN (SELECT chunk_id FROM states)) AS updated
  FROM (SELECT DISTINCT repo_id, chunk_id FROM batch) GROUP BY repo_id""",
        "states",
        "batch",
    ),
)
def l1_counts(spark, d):
    s = corpus.states(spark, d).dropDuplicates(["chunk_id"])
    return lifecycle.upsert_counts(s, batch(spark, d))


def changed_files(spark, d):
    """Files below src/ and, twice, those below tests/."""
    f = corpus.files(spark, d)
    src, tests = f.filter(F.col("file_path").startswith("src/")), f.filter(F.col("file_path").startswith("tests/"))
    return src.unionByName(tests).unionByName(tests).select(*KEY)


HIT_SQL = "regexp_matches(file_path, '^(src|tests)/')"
MARKED = ["chunk_id", "file_path", "status", "deleted_in_commit"]


@query(
    "l2_tombstone",
    sql(
        f"""SELECT chunk_id, file_path, CASE WHEN {HIT_SQL} THEN 'deleted' ELSE status END AS status,
  CASE WHEN {HIT_SQL} THEN 'c0ffee1' ELSE deleted_in_commit END AS deleted_in_commit,
  CASE WHEN {HIT_SQL} THEN '{corpus.NOW}' ELSE strftime(deleted_at, '%Y-%m-%d %H:%M:%S') END AS deleted_at FROM states""",
        "states",
    ),
)
def l2(spark, d):
    """L2, J6."""
    rows = lifecycle.tombstone(corpus.states(spark, d), changed_files(spark, d), corpus.stamp(corpus.NOW), "c0ffee1")
    return rows.select(*MARKED, shown("deleted_at"))


@query(
    "l2_versions",
    sql(
        f"""SELECT chunk_id, file_path, CASE WHEN {HIT_SQL} THEN 'deleted' ELSE status END AS status,
  CASE WHEN {HIT_SQL} THEN 'c0ffee1' ELSE deleted_in_commit END AS deleted_in_commit,
  CASE WHEN {HIT_SQL} THEN '{corpus.NOW}' ELSE strftime(deleted_at, '%Y-%m-%d %H:%M:%S') END AS deleted_at FROM states""",
        "states",
    ),
)
def l2_versions(spark, d):
    """Tombstones as a delta of a stored table."""
    table = versioned(spark, corpus.states(spark, d))
    table.tombstone(changed_files(spark, d), corpus.stamp(corpus.NOW), "c0ffee1")
    return table.read().select(*MARKED, shown("deleted_at"))


@query(
    "l3_restore",
    sql(
        """SELECT chunk_id, file_path, CASE WHEN language = 'swift' THEN 'active' ELSE status END AS status,
  NULL::VARCHAR AS deleted_in_commit, NULL::VARCHAR AS deleted_at FROM states""",
        "states",
    ),
)
def l3(spark, d):
    """All swift files come back."""
    f = corpus.files(spark, d).filter(F.col("language") == "swift")
    return lifecycle.restore(corpus.states(spark, d), f).select(*MARKED, shown("deleted_at"))


@query(
    "l4_soft_delete",
    sql(
        f"""SELECT f.repo_id, f.file_path, count(s.chunk_id) AS deleted_count FROM files f
  LEFT JOIN states s USING (repo_id, file_path) WHERE {HIT_SQL} GROUP BY ALL""",
        "files",
        "states",
    ),
)
def l4(spark, d):
    _, counts = lifecycle.soft_delete(corpus.states(spark, d), changed_files(spark, d), corpus.stamp(corpus.NOW))
    return counts


OLD_SQL = f"status = 'deleted' AND NOT coalesce(deleted_at > {CUTOFF_SQL}, false)"


@query(
    "l5_purge",
    sql(f"SELECT chunk_id, file_path, status FROM states WHERE NOT coalesce({OLD_SQL}, false)", "states"),
)
def l5(spark, d):
    kept, _ = lifecycle.purge(corpus.states(spark, d), corpus.stamp(corpus.CUTOFF))
    return kept.select("chunk_id", "file_path", "status")


@query(
    "l5_versions",
    sql(f"SELECT chunk_id, file_path, status FROM states WHERE NOT coalesce({OLD_SQL}, false)", "states"),
)
def l5_versions(spark, d):
    """The purge of a stored table, from ids and stamps alone."""
    table = versioned(spark, corpus.states(spark, d))
    table.purge(corpus.stamp(corpus.CUTOFF))
    return table.read().select("chunk_id", "file_path", "status")


@query(
    "l5_purge_dry_run",
    sql(
        f"""SELECT repo_id, count(*) AS chunks_found, 0::BIGINT AS chunks_removed, count(DISTINCT file_path) AS files
  FROM states WHERE {OLD_SQL} GROUP BY repo_id""",
        "states",
    ),
)
def l5_dry(spark, d):
    _, report = lifecycle.purge(corpus.states(spark, d), corpus.stamp(corpus.CUTOFF), dry_run=True)
    return lifecycle.purge_summary(report, dry_run=True)


@query(
    "a3_deleted_files",
    sql(
        f"""SELECT repo_id, file_path, count(*) AS chunk_count, {shown_sql("min(deleted_at)", "deleted_at")}
  FROM states WHERE status = 'deleted' GROUP BY repo_id, file_path""",
        "states",
    ),
)
def a3(spark, d):
    rows = lifecycle.deleted_files(corpus.states(spark, d))
    return rows.withColumn("deleted_at", F.date_format("deleted_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "l6_clear",
    sql(
        """SELECT 'kept' AS part, repo_id, count(*) AS rows, NULL::VARCHAR AS status FROM states
    WHERE project_name NOT IN (SELECT source FROM documents WHERE lang = 'de' GROUP BY source) GROUP BY repo_id
  UNION ALL SELECT DISTINCT 'status', substr(sha256(source), 1, 12), NULL, 'deleted' FROM documents WHERE lang = 'de'
  UNION ALL SELECT DISTINCT 'status', substr(sha256('none' || source), 1, 12), NULL, 'not_found' FROM documents""",
        "states",
    ),
)
def l6(spark, d):
    """Clears every project with German documents, and unknown ones."""
    docs = corpus.table(spark, d, "documents")
    known = docs.filter(F.col("lang") == "de").select(paths.repo_id("source").alias("repo_id"))
    unknown = docs.select(paths.repo_id(F.concat(F.lit("none"), F.col("source"))).alias("repo_id"))
    kept, status = lifecycle.clear(corpus.states(spark, d), known.union(unknown))
    counted = kept.groupBy("repo_id").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.lit("kept").alias("part"), "repo_id", "rows", F.lit(None).cast("string").alias("status")).union(
        status.select(F.lit("status"), "repo_id", F.lit(None).cast("bigint"), "status")
    )


@query(
    "l7_purge_report",
    sql(
        f"""SELECT repo_id, file_path, '  - ' || file_path || ' (' || count(*) || ' chunks, deleted '
    || coalesce(strftime(min(deleted_at), '%Y-%m-%d'), 'unknown') || ')' AS line
  FROM states WHERE {OLD_SQL} GROUP BY repo_id, file_path""",
        "states",
    ),
)
def l7(spark, d):
    return lifecycle.purge_report(lifecycle.deleted_files(corpus.states(spark, d), corpus.stamp(corpus.CUTOFF)))


@query(
    "l7_purge_headline",
    sql(f"SELECT repo_id, 'Removed ' || count(*) || ' chunks' AS headline FROM states WHERE {OLD_SQL} GROUP BY repo_id", "states"),
)
def l7_headline(spark, d):
    _, report = lifecycle.purge(corpus.states(spark, d), corpus.stamp(corpus.CUTOFF))
    return lifecycle.purge_headline(lifecycle.purge_summary(report))


# --- statistics --------------------------------------------------------------------------------------------------------


@query(
    "a1_collection_stats",
    sql(
        """SELECT *, overhead_percent > 15 AS cleanup_advised FROM (
  SELECT repo_id, count(*) FILTER (status IS DISTINCT FROM 'deleted') AS active_chunks,
    count(*) FILTER (status = 'deleted') AS deleted_chunks, count(*) AS total_chunks,
    round(count(*) FILTER (status = 'deleted') / count(*) * 100, 1) AS overhead_percent FROM states GROUP BY repo_id)""",
        "states",
    ),
)
def a1(spark, d):
    """A1, A2."""
    return reports.collection_stats(corpus.states(spark, d))


@query(
    "a4_list_files",
    sql(
        """SELECT language, count(*) AS files, sum(size)::BIGINT AS bytes, round(sum(size) / 1048576.0, 2)::DOUBLE AS megabytes
  FROM files GROUP BY ROLLUP (language)""",
        "files",
    ),
)
def a4(spark, d):
    """A4, A11."""
    return reports.list_files(corpus.files(spark, d))


@query(
    "t3_file_listing",
    sql(
        "SELECT repo_id, language, file_path, lines, round(size / 1024.0, 2)::DOUBLE AS kilobytes FROM files", "files"
    ),
)
def t3(spark, d):
    return reports.file_listing(corpus.files(spark, d))


@query("a5_chunk_counts", sql("SELECT repo_id, file_path, count(*) AS chunk_count FROM windows GROUP BY ALL", "windows"))
def a5(spark, d):
    return reports.chunk_counts(corpus.windows(spark, d))


@query(
    "a6_list_projects",
    sql(
        """SELECT project_name, substr(repo_id, 1, 12) AS repo_id,
  count(chunk_id) FILTER (status IS DISTINCT FROM 'deleted') AS active_chunks,
  coalesce(strftime(any_value(p.indexed_at), '%Y-%m-%d'), 'unknown') AS indexed_at
  FROM projects p LEFT JOIN (SELECT repo_id, chunk_id, status FROM states) s USING (repo_id) GROUP BY project_name, repo_id""",
        "projects",
        "states",
    ),
)
def a6(spark, d):
    """A6, P19."""
    return reports.list_projects(corpus.projects(spark, d), corpus.states(spark, d))


@query(
    "a7_method_stats",
    sql(
        "SELECT method, count(DISTINCT (repo_id, file_path)) AS files, count(*) AS chunks FROM hybrid GROUP BY method", "hybrid"
    ),
)
def a7(spark, d):
    return reports.method_stats(hybrid_chunks(corpus.files(spark, d), symbols(spark, d)))


@query(
    "a8_index_summary",
    sql("SELECT repo_id, count(DISTINCT file_path) AS files, count(*) AS chunks FROM states GROUP BY repo_id", "states"),
)
def a8(spark, d):
    return reports.index_summary(corpus.states(spark, d))


@query("a9_collections", sql("SELECT DISTINCT repo_id FROM vectors", "vectors"))
def a9(spark, d):
    return reports.list_collections(corpus.vectors(spark, d))


@query("a10_collection_size", sql("SELECT repo_id, count(*) AS chunks FROM vectors GROUP BY repo_id", "vectors"))
def a10(spark, d):
    return reports.collection_count(corpus.vectors(spark, d))


# --- streams -----------------------------------------------------------------------------------------------------------


@query("r1_stream_index", sql(INCREMENTAL_SQL, "stored", "changes", "windows"))
def r1(spark, d):
    """D5 as a stream: the changes arrive as Parquet files, and the chunk table is updated per micro-batch."""
    table, inbox = scratch_dir(spark, "table"), scratch_dir(spark, "inbox")
    tables.write_chunks(stored(spark, d), table)
    f = corpus.files(spark, d)
    found = changes.diff_snapshot(f, corpus.manifest(spark, d)).drop("new_path")
    rows = found.join(f, KEY, "left").select(*FILES.names, "change")
    rows.write.parquet(inbox)
    stream = live.file_stream(spark, inbox, rows, "*.parquet", files_per_trigger=2)
    live.stream_index(
        stream, table, scratch_dir(spark, "progress"), corpus.stamp(corpus.NOW), commit="abc1234", embedder=letter_profile,
        max_tokens=2000,
    ).awaitTermination()
    return tables.read_chunks(spark, table).select(*STATE, letter_e())


@query("r1_stream_versions", sql(INCREMENTAL_SQL, "stored", "changes", "windows"))
def r1_versions(spark, d):
    """The same on a table of versions: each micro-batch is one more version."""
    inbox = scratch_dir(spark, "inbox")
    table = versioned(spark, stored(spark, d))
    f = corpus.files(spark, d)
    found = changes.diff_snapshot(f, corpus.manifest(spark, d)).drop("new_path")
    rows = found.join(f, KEY, "left").select(*FILES.names, "change")
    rows.write.parquet(inbox)
    stream = live.file_stream(spark, inbox, rows, "*.parquet", files_per_trigger=2)
    live.stream_versions(
        stream, table, scratch_dir(spark, "progress"), corpus.stamp(corpus.NOW), commit="abc1234", embedder=letter_profile,
        max_tokens=2000,
    ).awaitTermination()
    return table.read().select(*STATE, letter_e())


@query("r4_stream_dedupe", sql("SELECT DISTINCT chunk_id, content_hash FROM windows", "windows"))
def r4(spark, d):
    """All windows arrive twice, in many files; each id leaves once."""
    inbox, out = scratch_dir(spark, "inbox"), scratch_dir(spark, "out")
    rows = build_chunks(corpus.files(spark, d), corpus.stamp(corpus.NOW), max_tokens=2000).select(
        "chunk_id", "content_hash", "indexed_at"
    )
    rows.write.mode("append").parquet(inbox)
    rows.write.mode("append").parquet(inbox)
    stream = live.stream_dedupe(live.file_stream(spark, inbox, rows, "*.parquet", files_per_trigger=4))
    with settings(spark, **state_partitions(spark)):
        stream.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", scratch_dir(spark, "progress")
        ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("chunk_id", "content_hash")
