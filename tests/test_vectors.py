"""The cache of vectors: a content is embedded once, whatever runs and files it comes in."""

import datetime as dt
import os
import uuid

import numpy as np

from seekspan.plans.indexing import full_index, incremental_index
from seekspan.schemas import FILES
from seekspan.sources.vectors import VectorCache

NOW = dt.datetime(2024, 3, 10, 12)


def counting(folder):
    """An embedder that leaves a file for every text it is given."""

    def run(texts):
        for _ in texts:
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return np.array([[len(t), t.count("e")] for t in texts], dtype=np.float32)

    return run


def files(spark, rows):
    full = [("r", "p", name, "go", len(t), t.count("\n") + 1, NOW, t) for name, t in rows]
    return spark.createDataFrame(full, FILES)


def seen(folder):
    return len(os.listdir(folder))


def test_second_run_and_renames(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    embedder, cache = counting(str(calls)), VectorCache(spark, str(tmp_path / "cache"), "m")
    first = files(spark, [(f"src/f{i}.go", f"text {i}\n" * 20) for i in range(6)] + [("src/copy.go", "text 0\n" * 20)])
    index = full_index(first, NOW, embedder=embedder, cache=cache, model_id="m").cache()
    assert index.count() == 7 and seen(calls) == 6
    assert all(r.embedding == [float(len(r.content)), float(r.content.count("e"))] for r in index.collect())

    # the whole corpus again, with one new file: one call
    more = first.unionByName(files(spark, [("src/new.go", "something new")]))
    assert full_index(more, NOW, embedder=embedder, cache=cache, model_id="m").count() == 8 and seen(calls) == 7

    # a moved file: new ids, old vectors, no call
    moved = files(spark, [("lib/moved.go", "text 3\n" * 20)])
    changes = spark.createDataFrame([("r", "src/f3.go", "renamed", "lib/moved.go")], "repo_id string, file_path string, change string, new_path string")
    rows = incremental_index(changes, moved, index, NOW, embedder=embedder, cache=cache, model_id="m").collect()
    assert seen(calls) == 7
    (new,) = [r for r in rows if r.file_path == "lib/moved.go"]
    (old,) = [r for r in rows if r.file_path == "src/f3.go"]
    assert new.embedding == old.embedding and new.chunk_id != old.chunk_id and (new.status, old.status) == ("active", "deleted")

    # a batch that was appended twice counts once, another model starts anew
    spark.read.parquet(str(tmp_path / "cache")).write.mode("append").partitionBy("model_id", "part").parquet(str(tmp_path / "cache"))
    assert cache.read().count() == 7 and VectorCache(spark, str(tmp_path / "cache"), "other").read().count() == 0
