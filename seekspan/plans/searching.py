"""Complete searches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspan.functions import scoring
from seekspan.operators import filters
from seekspan.operators.embedding import Embedder, embed, embed_query
from seekspan.operators.search import knn_batch_per_collection
from seekspan.operators.topk import global_top_k, paginate, top_k_per_group
from seekspan.plans.request import SearchRequest

ORDER = ("distance", "chunk_id")


def candidates(chunks: DataFrame, request: SearchRequest, projects: DataFrame | None = None) -> DataFrame:
    """Scope and metadata filters; partition and column predicates that reach the scan."""
    scoped = filters.scope(chunks, request.collection, request.projects, projects)
    tests = []
    if request.languages:
        tests.append(filters.language_filter(request.languages))
    tests.append(filters.status_filter(request.include_deleted, request.deleted_only))
    if request.filters:
        tests.append(filters.metadata_filter(chunks.schema, request.filters))
    if request.model_id is not None:
        tests.append(F.col("model_id") == request.model_id)
    return scoped.filter(filters.and_all(tests))


def path_filters(df: DataFrame, request: SearchRequest) -> DataFrame:
    if request.path_prefix:
        df = df.filter(filters.path_prefix(request.path_prefix))
    if request.exclude_path:
        df = df.filter(filters.exclude_path(request.exclude_path))
    return df


def search(
    chunks: DataFrame,
    request: SearchRequest,
    vector: Sequence[float],
    projects: DataFrame | None = None,
    path_filter: str = "post",
    metric: str = "l2",
) -> DataFrame:
    """Filters, top-k per collection, path filters, global cut, page.

    With `path_filter='post'` the path filters see only the per-collection winners, so fewer than top_k results can
    remain; `'pre'` filters first. Ranking runs on ids and distances alone, when the search is called; the wide columns are
    then read for the rows of the page, at most `MAX_TOP_K`, from the files that can hold them.
    """
    top_k, page, page_size = request.window()
    order = [F.col(c) for c in ORDER]
    pool = filters.same_dim(candidates(chunks, request, projects), len(vector))
    if path_filter == "pre":
        pool = path_filters(pool, request)
    scored = pool.select(
        "repo_id", "chunk_id", "file_path", scoring.vector_distance("embedding", vector, metric).alias("distance")
    )
    best = top_k_per_group(scored, ["repo_id"], order, top_k)
    if path_filter == "post":
        best = path_filters(best, request)
    ranked = paginate(global_top_k(best, order, top_k), order, page, page_size)
    hits = ranked.drop("file_path").withColumn("similarity", scoring.similarity("distance"))
    # a page has at most MAX_TOP_K rows: their ids become predicates that prune collections, files and row groups
    found = hits.collect()
    repos, ids = ({r[c] for r in found} for c in ("repo_id", "chunk_id"))
    wide = chunks.drop("embedding").filter(F.col("repo_id").isin(list(repos)) & F.col("chunk_id").isin(list(ids)))
    page_rows = chunks.sparkSession.createDataFrame(found, hits.schema)
    return wide.join(F.broadcast(page_rows), ["repo_id", "chunk_id"]).orderBy("rank")


def search_text(
    chunks: DataFrame,
    request: SearchRequest,
    embedder: Embedder | None = None,
    projects: DataFrame | None = None,
    path_filter: str = "post",
    metric: str = "l2",
) -> DataFrame:
    """E6 for the request's own text, embedded with the model of the corpus."""
    vector = embed_query(chunks.sparkSession, request.text, embedder)
    return search(chunks, request, vector, projects, path_filter, metric)


def search_all(chunks: DataFrame, vector: Sequence[float], top_k: int = 10, **options) -> DataFrame:
    """Search every collection."""
    return search(chunks, SearchRequest(top_k=top_k, **options), vector)


def search_project(chunks: DataFrame, vector: Sequence[float], repo_id: str, top_k: int = 10, **options) -> DataFrame:
    """Search one collection."""
    return search(chunks, replace(SearchRequest(**options), collection=repo_id, top_k=top_k), vector)


def search_batch(
    chunks: DataFrame,
    queries: DataFrame,
    request: SearchRequest,
    projects: DataFrame | None = None,
    path_filter: str = "post",
    metric: str = "l2",
) -> DataFrame:
    """E4 with the filters of a request: ranked ids per query. `path_filter` works as in `search`."""
    top_k, _, _ = request.window()
    pool = candidates(chunks, request, projects)
    if path_filter == "pre":
        pool = path_filters(pool, request)
    best = knn_batch_per_collection(pool, queries, top_k, metric, carry=["file_path"])
    if path_filter == "post":
        best = path_filters(best, request)
    order = [F.col(c) for c in ORDER]
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top_k).withColumn("similarity", scoring.similarity("distance"))


def search_text_batch(
    chunks: DataFrame,
    texts: DataFrame,
    request: SearchRequest,
    embedder: Embedder | None = None,
    path_filter: str = "post",
) -> DataFrame:
    """E6 for a table of texts (query_id, text), embedded with the model of the corpus on the executors."""
    queries = embed(texts.select("query_id", F.col("text").alias("content")), embedder)
    return search_batch(chunks, queries.select("query_id", F.col("embedding").alias("query_vec")), request, path_filter=path_filter)
