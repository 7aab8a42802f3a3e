import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspan.operators.search import _candidates, knn, knn_batch, knn_lsh, lsh_index
from seekspan.plans.request import SearchRequest
from seekspan.plans.searching import search, search_project, search_text
from seekspan.schemas import CHUNKS, conform


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        # a third of all vectors are copies of one, all in one collection
        v = [1.0] * 8 if i % 3 == 0 else rng.normal(size=8).round(3).tolist()
        repo = "hot" if i % 3 == 0 else f"r{i % 5}"
        lang = "go" if i % 2 else "python"
        status = {0: "deleted", 1: None}.get(i % 11, "active")
        rows.append((f"c{i:04d}", repo, f"p-{repo}", f"src/{i}.go" if i % 4 else f"lib/{i}.py", lang, status, f"text {i}", v))
    df = spark.createDataFrame(
        rows,
        "chunk_id string, repo_id string, project_name string, file_path string, language string, status string,"
        " content string, embedding array<float>",
    )
    return conform(df, CHUNKS).cache()


def brute(rows, vector, k, where=lambda r: True, after=lambda r: True):
    vector = np.array(vector)
    groups = {}
    for r in filter(where, rows):
        dist = float(np.sqrt(((np.array(r.embedding, dtype=float) - vector) ** 2).sum()))
        groups.setdefault(r.repo_id, []).append((dist, r.chunk_id, r))
    best = [x for g in groups.values() for x in sorted(g, key=lambda x: x[:2])[:k]]
    return [x[1] for x in sorted((x for x in best if after(x[2])), key=lambda x: x[:2])[:k]]


QUERY = [0.9, 1.1, 1.0, 0.8, 1.0, 1.0, 1.2, 0.5]


def test_post_and_pre_path_filters(table):
    rows = table.collect()
    request = SearchRequest(top_k=12, path_prefix="src/", exclude_path="7")
    path_ok = lambda r: r.file_path.startswith("src/") and "7" not in r.file_path
    active = lambda r: r.status == "active"
    post = [r.chunk_id for r in search(table, request, QUERY).collect()]
    assert post == brute(rows, QUERY, 12, active, path_ok)
    pre = [r.chunk_id for r in search(table, request, QUERY, path_filter="pre").collect()]
    assert pre == brute(rows, QUERY, 12, lambda r: active(r) and path_ok(r))
    assert len(pre) == 12 > 0 and post != pre


def test_pages_continue_the_ranking(table):
    whole = search(table, SearchRequest(top_k=30, page_size=30), QUERY).collect()
    pages = []
    for page in (1, 2, 3, 4, 5):
        pages += search(table, SearchRequest(top_k=30, page=page, page_size=7), QUERY).collect()
    assert [r.chunk_id for r in pages] == [r.chunk_id for r in whole]
    assert [r["rank"] for r in pages] == list(range(1, 31))
    assert {(r.total_count, r.total_pages) for r in pages} == {(30, 5)}
    assert search(table, SearchRequest(top_k=30, page=6, page_size=7), QUERY).count() == 0


def test_status_and_scope(table):
    count = lambda **kw: search(table, SearchRequest(top_k=1000, page_size=1000, **kw), QUERY).count()
    assert count() == table.filter("status = 'active'").count()
    assert count(include_deleted=True) == table.count()
    assert count(deleted_only=True, include_deleted=True) == table.filter("status = 'deleted'").count()
    assert count(collection=["r1", "r2"]) == table.filter("status = 'active' and repo_id in ('r1', 'r2')").count()
    assert count(languages="go", filters={"language": "python"}) == 0
    projects = table.select("repo_id", "project_name").distinct()
    named = search(table, SearchRequest(projects=["p-r1"]), QUERY, projects)
    assert {r.repo_id for r in named.collect()} == {"r1"}
    assert {r.repo_id for r in search_project(table, QUERY, "r3").collect()} == {"r3"}


def test_other_dimensions_are_skipped(table):
    assert search(table, SearchRequest(), QUERY[:5]).count() == 0


def test_limits():
    assert SearchRequest(top_k=0, page=0, page_size=0).window() == (10, 1, 20)
    for bad in ({"top_k": 1001}, {"top_k": -1}, {"page": -1}, {"page_size": -5}):
        with pytest.raises(ValueError):
            SearchRequest(**bad).window()


@pytest.mark.parametrize("metric", ["l2", "l2sq", "cosine"])
def test_batch_equals_single(spark, table, metric):
    rng = np.random.default_rng(2)
    vectors = {f"q{i}": rng.normal(size=8).tolist() for i in range(7)} | {"copy": [1.0] * 8}
    queries = spark.createDataFrame(list(vectors.items()), "query_id string, query_vec array<double>")
    for block in (1024, 3):
        got = {}
        for r in knn_batch(table, queries, 9, metric, block).collect():
            got.setdefault(r.query_id, []).append((round(r.distance, 9), r.chunk_id))
        for name, vector in vectors.items():
            single = [(round(r.distance, 9), r.chunk_id) for r in knn(table, vector, 9, metric).collect()]
            assert sorted(got[name]) == single


def test_candidates_keep_ties():
    rows = np.vstack([np.ones((50, 4)), np.zeros((50, 4))])
    qi, xi, dist = _candidates(np.ones((1, 4)), rows, 5, "l2")
    assert set(xi) == set(range(50)) and not dist.any()


def test_lsh_finds_the_nearest(table):
    rows = table.filter("repo_id <> 'hot'")
    vector = [float(x) for x in rows.filter("chunk_id = 'c0001'").first().embedding]
    assert knn_lsh(lsh_index(rows, 8), vector, 5).first().chunk_id == "c0001"


def test_text_search(spark):
    from seekspan.operators.embedding import embed_distinct

    texts = ["parse the json manifest", "open a socket connection", "compute sha hashes of files"]
    df = spark.createDataFrame([(f"c{i}", "r", "active", t) for i, t in enumerate(texts)], "chunk_id string, repo_id string, status string, content string")
    chunks = conform(embed_distinct(df), CHUNKS)
    best = search_text(chunks, SearchRequest(text="json manifest parse")).first()
    assert best.content == texts[0] and best["rank"] == 1
    norms = chunks.select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).collect()
    assert all(r[0] == pytest.approx(1.0, abs=1e-5) for r in norms)
