"""Vector search, ranking, pages and result reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import corpus
from catalog.base import block, query, sql
from catalog.chunks import WORD_CELL_SQL
from catalog.derive import DISTANCE, relative_sql
from seekspan.functions import scoring
from seekspan.operators import reports
from seekspan.operators.embedding import embed
from seekspan.operators.cells import fit_cells, knn_cells, knn_join, probes_for, read_index, write_index
from seekspan.operators.search import LSH_BITS, LSH_TABLES, knn, knn_batch, knn_lsh, knn_per_collection, lsh_index
from seekspan.operators.topk import global_top_k, paginate
from seekspan.plans.request import SearchRequest
from seekspan.plans.searching import search, search_all, search_batch, search_project, search_text, search_text_batch
from seekspan.session import scratch_dir
from seekspan.sources.tables import read_chunks, save_results, write_chunks

block("scored", f"SELECT *, {DISTANCE} AS distance FROM vectors", "vectors", "mean_vector")
RANKED = "row_number() OVER (PARTITION BY repo_id ORDER BY distance, chunk_id)"


def scores():
    return F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity")


SCORES_SQL = "round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity"


def hits(df, *columns):
    return df.select("rank", "repo_id", "chunk_id", "file_path", "content", *scores(), *columns)


def search_sql(where: str = "true", after: str = "true", k: int = 10, page: int = 1, size: int = 20) -> str:
    """Per-collection top-k of the filtered rows, then `after`, the global cut and one page."""
    return sql(
        f"""SELECT rank::INT AS rank, repo_id, chunk_id, file_path, content, {SCORES_SQL}, total::INT AS total_count FROM (
  SELECT *, count(*) OVER () AS total FROM (
    SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM (
      SELECT * FROM (SELECT *, {RANKED} AS place FROM scored WHERE {where}) WHERE place <= {k})
    WHERE {after}) WHERE rank <= {k})
  WHERE rank > {(page - 1) * size} AND rank <= {page * size}""",
        "scored",
    )


@query(
    "e3_nearest",
    sql(f"SELECT chunk_id, repo_id, {SCORES_SQL} FROM scored ORDER BY distance, chunk_id LIMIT 10", "scored"),
)
def e3(spark, d):
    rows = knn(corpus.vectors(spark, d), corpus.mean_vector(spark, d), 10)
    return rows.select("chunk_id", "repo_id", *scores())


METRIC_SQL = """1 - list_inner_product(embedding::DOUBLE[], (SELECT query_vec FROM mean_vector))
  / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])
    * list_inner_product((SELECT query_vec FROM mean_vector), (SELECT query_vec FROM mean_vector)))"""


@query(
    "e3_metrics",
    sql(
        f"""SELECT chunk_id, round(distance, 6) AS l2, round(distance * distance, 6) AS l2sq,
  round({METRIC_SQL}, 6) AS cosine FROM scored""",
        "scored",
        "mean_vector",
    ),
)
def e3_metrics(spark, d):
    v = corpus.mean_vector(spark, d)
    return corpus.vectors(spark, d).select(
        "chunk_id", *[F.round(scoring.vector_distance("embedding", v, m), 6).alias(m) for m in scoring.METRICS]
    )


@query(
    "w3_top_k_per_collection",
    sql(
        f"SELECT repo_id, chunk_id, round(distance, 6) AS distance FROM (SELECT *, {RANKED} AS place FROM scored) WHERE place <= 5",
        "scored",
    ),
)
def w3(spark, d):
    rows = knn_per_collection(corpus.vectors(spark, d), corpus.mean_vector(spark, d), 5)
    return rows.select("repo_id", "chunk_id", F.round("distance", 6).alias("distance"))


block(
    "batch_scored",
    """SELECT q.query_id, v.repo_id, v.chunk_id, v.language, v.status, v.file_path,
  list_distance(v.embedding::DOUBLE[], q.query_vec) AS distance FROM vectors v, centroids q""",
    "vectors",
    "centroids",
)


@query(
    "e4_nearest_batch",
    sql(
        """SELECT query_id, repo_id, chunk_id, round(distance, 6) AS distance FROM batch_scored
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 10""",
        "batch_scored",
    ),
)
def e4(spark, d):
    """Ten neighbours of every collection's centroid."""
    found = knn_batch(corpus.vectors(spark, d), corpus.centroids(spark, d), 10)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "e4_nearest_batch_blocks",
    sql(
        """SELECT query_id, repo_id, chunk_id, round(distance, 6) AS distance FROM batch_scored
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 10""",
        "batch_scored",
    ),
)
def e4_blocks(spark, d):
    """The same with query blocks of at most four vectors."""
    found = knn_batch(corpus.vectors(spark, d), corpus.centroids(spark, d), 10, block=4)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "e4_nearest_many",
    sql(
        """SELECT query_id, count(*) AS found, round(min(distance), 6) AS nearest, round(max(distance), 6) AS farthest FROM (
    SELECT q.vec_id AS query_id, v.chunk_id, list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
    FROM vectors v, embeddings q WHERE q.vec_id % 20 = 0
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 10) GROUP BY query_id""",
        "vectors",
    ),
)
def e4_many(spark, d):
    """Ten neighbours of every twentieth vector among all vectors."""
    rows = corpus.table(spark, d, "embeddings").filter(F.col("vec_id") % 20 == 0)
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vec"))
    found = knn_batch(corpus.vectors(spark, d), queries, 10)
    return found.groupBy("query_id").agg(
        F.count("*").alias("found"), F.round(F.min("distance"), 6).alias("nearest"), F.round(F.max("distance"), 6).alias("farthest")
    )


@query(
    "e4_search_batch",
    sql(
        f"""SELECT query_id, repo_id, chunk_id, {SCORES_SQL} FROM batch_scored
  WHERE language IN ('go', 'python') AND status = 'active' AND NOT regexp_matches(file_path, '^vendor/')
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 7""",
        "batch_scored",
    ),
)
def e4_search(spark, d):
    request = SearchRequest(top_k=7, languages="go,python", exclude_path="^vendor/")
    found = search_batch(corpus.vectors(spark, d), corpus.centroids(spark, d), request, path_filter="pre")
    return found.select("query_id", "repo_id", "chunk_id", *scores())


@query(
    "e4_search_batch_post",
    sql(
        f"""SELECT query_id, repo_id, chunk_id, row_number() OVER w AS rank, {SCORES_SQL} FROM (
    SELECT * FROM batch_scored WHERE status = 'active'
    QUALIFY row_number() OVER (PARTITION BY query_id, repo_id ORDER BY distance, chunk_id) <= 9)
  WHERE starts_with(file_path, 'src/') WINDOW w AS (PARTITION BY query_id ORDER BY distance, chunk_id)
  QUALIFY row_number() OVER w <= 9""",
        "batch_scored",
    ),
)
def e4_search_post(spark, d):
    """Path filters after the ranking within collections, as in a single search."""
    request = SearchRequest(top_k=9, path_prefix="src/")
    found = search_batch(corpus.vectors(spark, d), corpus.centroids(spark, d), request)
    return found.select("query_id", "repo_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), *scores())


block(
    "planes",
    f"""SELECT t, b, i, CASE WHEN substr(md5(t || ':' || b || ':' || (i - 1)), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS sign
  FROM range({LSH_TABLES}) AS x(t), range({LSH_BITS}) AS y(b), range(1, 65) AS z(i)""",
)
block(
    "lsh_rows",
    """SELECT chunk_id, t, sum(CASE WHEN dot > 0 THEN 1 << b ELSE 0 END) AS bucket FROM (
    SELECT chunk_id, t, b::INT AS b, sum(x * sign) AS dot
    FROM (SELECT chunk_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM vectors) JOIN planes USING (i) GROUP BY ALL)
  GROUP BY ALL""",
    "vectors",
    "planes",
)
block(
    "lsh_query",
    """SELECT t, sum(CASE WHEN dot > 0 THEN 1 << b ELSE 0 END) AS bucket FROM (
    SELECT t, b::INT AS b, sum(x * sign) AS dot
    FROM (SELECT unnest(query_vec)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM mean_vector) JOIN planes USING (i) GROUP BY ALL)
  GROUP BY ALL""",
    "mean_vector",
    "planes",
)


@query(
    "e5_nearest_approximate",
    sql(
        f"""SELECT chunk_id, repo_id, {SCORES_SQL} FROM scored
  WHERE chunk_id IN (SELECT chunk_id FROM lsh_rows JOIN lsh_query USING (t, bucket)) ORDER BY distance, chunk_id LIMIT 10""",
        "scored",
        "lsh_rows",
        "lsh_query",
    ),
)
def e5(spark, d):
    """From a stored index, of which only the query's buckets are read."""
    path = scratch_dir(spark, "lsh")
    lsh_index(corpus.vectors(spark, d), 64).write.partitionBy("bucket").parquet(path)
    rows = knn_lsh(spark.read.parquet(path), corpus.mean_vector(spark, d), 10)
    return rows.select("chunk_id", "repo_id", *scores())


def _index(spark, d):
    """An inverted-file index of all vectors, stored and read again."""
    path = scratch_dir(spark, "cells")
    vectors = corpus.vectors(spark, d)
    write_index(vectors, fit_cells(vectors, 64), path)
    return read_index(spark, path)


def _twentieth(spark, d, rest=0):
    rows = corpus.table(spark, d, "embeddings").filter(F.col("vec_id") % 20 == rest)
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vec"))


@query(
    "e4_nearest_join",
    sql(
        """SELECT q.vec_id AS query_id, v.repo_id, v.chunk_id, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance
    FROM vectors v, embeddings q WHERE q.vec_id % 20 = 0
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), v.chunk_id) <= 10""",
        "vectors",
    ),
)
def e4_join(spark, d):
    """Ten exact neighbours of every twentieth vector, through the index: cells and rings too far off are never looked at."""
    found = knn_join(*_index(spark, d), _twentieth(spark, d), 10)
    return found.withColumn("distance", F.round("distance", 6))


@query("e5_inverted_file")
def e5_inverted_file(spark, d):
    """Ten approximate neighbours of every twentieth vector, with as many probes as a sample of other vectors needs."""
    cells, rings = _index(spark, d)
    probes = probes_for(cells, rings, _twentieth(spark, d, rest=7).limit(100), 10)
    found = knn_cells(cells, rings, _twentieth(spark, d), 10, probes)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "e5_recall",
    "SELECT count(*) AS queries, 10 * count(*) AS neighbours, true AS nine_of_ten FROM embeddings WHERE vec_id % 20 = 0",
)
def e5_recall(spark, d):
    """Whether the approximate search finds nine of ten true neighbours, measured against the exact join over all vectors."""
    cells, rings = _index(spark, d)
    queries = _twentieth(spark, d)
    true = knn_join(cells, rings, queries, 10).select("query_id", "chunk_id")
    probes = probes_for(cells, rings, _twentieth(spark, d, rest=7).limit(100), 10)
    found = knn_cells(cells, rings, queries, 10, probes).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return true.join(found, ["query_id", "chunk_id"], "left").agg(
        F.count_distinct("query_id").alias("queries"),
        F.count(F.lit(1)).alias("neighbours"),
        (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("nine_of_ten"),
    )


@query("e6_search", search_sql("status = 'active'"))
def e6(spark, d):
    rows = search(corpus.vectors(spark, d), SearchRequest(), corpus.mean_vector(spark, d))
    return hits(rows, "total_count")


@query(
    "e6_search_post_filter",
    search_sql(
        "status = 'active' AND language IN ('go', 'python', 'typescript')",
        "starts_with(file_path, 'src/') AND NOT regexp_matches(file_path, '_1[0-9]*[.]')",
        25, 1, 5,
    ),
)
def e6_post(spark, d):
    request = SearchRequest(
        top_k=25, languages=["go", "python", "typescript"], path_prefix="src/", exclude_path="_1[0-9]*[.]", page_size=5
    )
    return hits(search(corpus.vectors(spark, d), request, corpus.mean_vector(spark, d)), "total_count")


@query(
    "e6_search_pre_filter",
    search_sql("status = 'active' AND starts_with(file_path, 'src/') AND NOT regexp_matches(file_path, '_1[0-9]*[.]')"),
)
def e6_pre(spark, d):
    request = SearchRequest(path_prefix="src/", exclude_path="_1[0-9]*[.]")
    rows = search(corpus.vectors(spark, d), request, corpus.mean_vector(spark, d), path_filter="pre")
    return hits(rows, "total_count")


@query("e6_search_deleted", search_sql("status = 'deleted'", k=30, page=2, size=7))
def e6_deleted(spark, d):
    request = SearchRequest(top_k=30, deleted_only=True, page=2, page_size=7)
    return hits(search(corpus.vectors(spark, d), request, corpus.mean_vector(spark, d)), "total_count")


@query("e6_search_metadata", search_sql("language = 'go' AND contains(file_path, 'src')"))
def e6_metadata(spark, d):
    request = SearchRequest(include_deleted=True, filters={"language": "go", "file_path": "src"})
    return hits(search(corpus.vectors(spark, d), request, corpus.mean_vector(spark, d)), "total_count")


@query("e6_search_names", search_sql("status = 'active' AND project_name IN ('project2', 'project5')", k=12))
def e6_names(spark, d):
    v = corpus.vectors(spark, d)
    projects = v.select("repo_id", "project_name").distinct()
    request = SearchRequest(top_k=12, projects=("project2", "project5"))
    return hits(search(v, request, corpus.mean_vector(spark, d), projects), "total_count")


block(
    "text_query",
    f"""SELECT {WORD_CELL_SQL} AS cell, count(*)::DOUBLE AS n FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word
    FROM (SELECT text FROM benchmark ORDER BY length(text) DESC, item_id LIMIT 1)) GROUP BY ALL""",
)
# unit vectors in single precision, as they are stored
block(
    "text_scored",
    """SELECT c.chunk_id, sqrt(sum((c.x - coalesce(q.x, 0)) ** 2) + (SELECT sum(x ** 2) FROM unit_query)
    - coalesce(sum(q.x ** 2), 0)) AS distance
  FROM (SELECT chunk_id, cell, (n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)))::FLOAT::DOUBLE AS x FROM cell_counts) c
  LEFT JOIN unit_query q USING (cell) GROUP BY c.chunk_id""",
    "cell_counts",
    "unit_query",
)
block("unit_query", "SELECT cell, (n / sqrt(sum(n * n) OVER ()))::FLOAT::DOUBLE AS x FROM text_query", "text_query")


@query(
    "e6_search_text",
    sql(
        """SELECT row_number() OVER (ORDER BY distance, chunk_id)::INT AS rank, repo_id, chunk_id, file_path, content,
  round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity
  FROM text_scored JOIN (SELECT DISTINCT repo_id, chunk_id, file_path, content, status FROM states) USING (chunk_id)
  WHERE status = 'active' ORDER BY distance, chunk_id LIMIT 10""",
        "text_scored",
        "states",
    ),
)
def e6_text(spark, d):
    """Text search: the longest benchmark item against a stored table of all windows, embedded by the built-in model."""
    longest = corpus.table(spark, d, "benchmark").orderBy(F.length("text").desc(), "item_id").first()["text"]
    path = scratch_dir(spark, "chunks")
    write_chunks(embed(corpus.states(spark, d).dropDuplicates(["chunk_id"]).drop("embedding")), path)
    return hits(search_text(read_chunks(spark, path), SearchRequest(text=longest)))


block(
    "text_queries",
    f"""SELECT item_id, cell, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS u FROM (
    SELECT item_id, {WORD_CELL_SQL} AS cell, count(*)::DOUBLE AS n
    FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM benchmark) GROUP BY ALL)""",
)
block(
    "text_batch",
    """SELECT q.item_id, c.chunk_id, sqrt(greatest(0, c.total + q.total - 2 * coalesce(p.dot, 0))) AS distance
  FROM (SELECT item_id, sum(u::FLOAT::DOUBLE ** 2) AS total FROM text_queries GROUP BY ALL) q
  CROSS JOIN (SELECT chunk_id, sum(x ** 2) AS total FROM chunk_units GROUP BY ALL) c
  LEFT JOIN (SELECT item_id, chunk_id, sum(u::FLOAT::DOUBLE * x) AS dot FROM text_queries JOIN chunk_units USING (cell) GROUP BY ALL) p
    USING (item_id, chunk_id)""",
    "text_queries",
    "chunk_units",
)
block(
    "chunk_units",
    """SELECT chunk_id, cell, (n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)))::FLOAT::DOUBLE AS x FROM cell_counts""",
    "cell_counts",
)


@query(
    "e6_search_text_batch",
    sql(
        """SELECT item_id AS query_id, round(min(distance), 6) AS nearest, round(max(distance), 6) AS farthest, count(*) AS found FROM (
    SELECT item_id, distance FROM text_batch JOIN (SELECT DISTINCT chunk_id, status FROM states) USING (chunk_id)
    WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY distance, chunk_id) <= 5) GROUP BY ALL""",
        "text_batch",
        "states",
    ),
)
def e6_text_batch(spark, d):
    """Text search for all benchmark items at once: the distances of each item's five best windows."""
    path = scratch_dir(spark, "chunks")
    write_chunks(embed(corpus.states(spark, d).dropDuplicates(["chunk_id"]).drop("embedding")), path)
    items = corpus.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = search_text_batch(read_chunks(spark, path), items, SearchRequest(top_k=5))
    return found.groupBy("query_id").agg(
        F.round(F.min("distance"), 6).alias("nearest"), F.round(F.max("distance"), 6).alias("farthest"), F.count("*").alias("found")
    )


@query("e7_search_all", search_sql("status = 'active'", k=15))
def e7_all(spark, d):
    return hits(search_all(corpus.vectors(spark, d), corpus.mean_vector(spark, d), 15), "total_count")


@query("e7_search_project", search_sql("status = 'active' AND repo_id = 'label4'"))
def e7_project(spark, d):
    return hits(search_project(corpus.vectors(spark, d), corpus.mean_vector(spark, d), "label4"), "total_count")


# --- ranking over other tables -----------------------------------------------------------------------------------------


@query(
    "t1_global_ranking",
    "SELECT event_id, round(value, 6) AS value FROM events ORDER BY value DESC, event_id LIMIT 100",
)
def t1(spark, d):
    events = corpus.table(spark, d, "events")
    return global_top_k(events, [F.col("value").desc(), F.col("event_id")], 100).select(
        "event_id", F.round("value", 6).alias("value")
    )


@query(
    "t2_page",
    """SELECT event_id, rank::INT AS rank, 95::INT AS total_count, 3 AS page, 10 AS page_size, 10 AS total_pages FROM (
  SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank > 20 AND rank <= 30""",
)
def t2(spark, d):
    """Third page of a result of 95 rows; ranks go on over the pages."""
    order = [F.col("value").desc(), F.col("event_id")]
    best = global_top_k(corpus.table(spark, d, "events"), order, 95)
    return paginate(best, order, 3, 10).select("event_id", "rank", "total_count", "page", "page_size", "total_pages")


# --- results -----------------------------------------------------------------------------------------------------------

block(
    "results",
    """SELECT *, row_number() OVER (ORDER BY distance, chunk_id)::INT AS rank, 1 / (1 + distance) AS similarity,
  TIMESTAMP '2024-01-31' AS indexed_at FROM scored QUALIFY rank <= 50""",
    "scored",
)


def results(spark, d):
    request = SearchRequest(top_k=50, page_size=50, include_deleted=True)
    return search(corpus.vectors(spark, d), request, corpus.mean_vector(spark, d))


@query(
    "p16_format_results",
    sql(
        f"""SELECT rank, '[' || rank || '] ' || file_path || ':1-1 (similarity: '
    || trunc(similarity::FLOAT * 100::FLOAT)::INT || '%)' AS title,
  '    [' || substr(repo_id, 1, 8) || '] ' || project_name || ' | ' || language
    || CASE WHEN status = 'deleted' THEN ' [DELETED ' || coalesce(strftime(deleted_at, '%Y-%m-%d'), '') || ']' ELSE '' END
    AS origin,
  '    ' || content AS preview, '    indexed: ' || {relative_sql('indexed_at', f"TIMESTAMP '{corpus.NOW}'")} AS indexed
  FROM results""",
        "results",
    ),
)
def p16(spark, d):
    return reports.format_results(results(spark, d), corpus.stamp(corpus.NOW))


@query(
    "s5_saved_results",
    sql(
        "SELECT chunk_id AS id, repo_id, file_path, 1::BIGINT AS start_line, 1::BIGINT AS end_line, content, language FROM results",
        "results",
    ),
)
def s5(spark, d):
    """Saved as JSON and read back."""
    path = scratch_dir(spark, "results")
    save_results(results(spark, d), path)
    schema = "id string, repo_id string, file_path string, start_line bigint, end_line bigint, content string, language string"
    return spark.read.schema(schema).json(path)


@query(
    "j9_known_projects",
    sql(
        """SELECT DISTINCT repo_id FROM (SELECT substr(sha256(source), 1, 12) AS repo_id FROM documents
  UNION SELECT substr(sha256('none' || source), 1, 12) FROM documents) JOIN projects USING (repo_id)""",
        "projects",
    ),
)
def j9(spark, d):
    source = corpus.table(spark, d, "documents").select("source").distinct()
    rid = lambda c: F.substring(F.sha2(c, 256), 1, 12).alias("repo_id")
    asked = source.select(rid(F.col("source"))).union(source.select(rid(F.concat(F.lit("none"), F.col("source")))))
    return reports.known_projects(asked, corpus.projects(spark, d))


@query(
    "j10_locate_results",
    sql(
        """SELECT w.chunk_id, p.repo_path || '/' || w.file_path AS location FROM states w JOIN projects p USING (repo_id)""",
        "states",
        "projects",
    ),
)
def j10(spark, d):
    return reports.locate(corpus.states(spark, d), corpus.projects(spark, d)).select("chunk_id", "location")


@query(
    "j11_pick_result",
    sql(
        """SELECT 'rank' AS how, rank, chunk_id FROM results WHERE rank = 7
  UNION ALL SELECT 'id', rank, chunk_id FROM (SELECT * FROM results WHERE starts_with(chunk_id, 'v00') ORDER BY rank LIMIT 1)""",
        "results",
    ),
)
def j11(spark, d):
    r = results(spark, d)
    by_rank = reports.pick_result(r, "7").select(F.lit("rank").alias("how"), "rank", "chunk_id")
    return by_rank.union(reports.pick_result(r, "v00").select(F.lit("id").alias("how"), "rank", "chunk_id"))
