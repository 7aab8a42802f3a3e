import datetime as dt

import pytest
from pyspark.sql import functions as F

from seekspan.functions import paths, scoring, text, times
from seekspan.operators import filters


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "index", "display", "parser"),
    [
        ("a/b.go", "go", "go", "go"),
        ("a/b.GO", "unknown", "go", "go"),
        ("x.tar.tsx", "typescript", "typescript", "typescript/javascript"),
        ("Makefile", "unknown", "unknown", ""),
        (".env", "unknown", "unknown", ""),
        ("a.b/readme", "unknown", "unknown", ""),
        ("lib/x.mli", "unknown", "ocaml", "ocaml"),
        ("q.sql", "unknown", "sql", ""),
    ],
)
def test_languages(spark, path, index, display, parser):
    df = spark.createDataFrame([(path,)], ["p"])
    row = df.select(paths.index_language("p"), paths.detect_language("p"), paths.parser_language("p")).first()
    assert tuple(row) == (index, display, parser)


@pytest.mark.parametrize(
    ("path", "inside"),
    [
        ("/base/file.go", True),
        ("/base/sub/file.go", True),
        ("/base", False),
        ("/base/../escape.go", False),
        ("/basebar/file.go", False),
        ("/etc/passwd", False),
        ("/base/a/../../base/b", True),
        ("/../base/x", True),
    ],
)
def test_containment(spark, path, inside):
    assert one(spark, paths.within_root("p", F.lit("/base")), p=path) is inside


@pytest.mark.parametrize(
    ("commit", "valid"),
    [
        ("a3f1b2c4d5e6f7a8b9c0d1e2f3a4b5c6d7e8f9a0", True),
        ("abc1234", True),
        ("", False),
        ("A3F1B2C4D5E6F7A8", False),
        ("abc1234; ls", False),
        ("abc1234 HEAD", False),
        ("abc1234|cat", False),
        ("abc123", False),
        ("a" * 65, False),
        ("abc1234\n", False),
    ],
)
def test_commits(spark, commit, valid):
    assert one(spark, text.valid_commit("c"), c=commit) is valid


def test_identifiers(spark):
    import hashlib

    value = one(spark, text.chunk_id(F.lit("r"), F.lit("a.go"), F.lit(1), F.lit(2), F.lit("héllo")))
    assert value == hashlib.sha256("r:a.go:1-2:héllo".encode()).hexdigest()[:16]
    assert one(spark, paths.repo_id(F.lit("/x"))) == hashlib.sha256(b"/x").hexdigest()[:12]


def test_preview(spark):
    preview = lambda c: one(spark, text.content_preview("c"), c=c)
    assert preview("\n  \na\nb") == ["a", "b"]
    assert preview("a\nb\nc\nd\ne") == ["a", "b", "c", "d", "..."]
    assert preview(" \n\t\n") == ["(empty)"]
    assert preview("") == ["(empty)"]
    assert preview("x" * 101) == ["x" * 100 + "..."]


def test_token_counts_agree(spark):
    from seekspan.operators.tokens import pattern_counter

    samples = ["", "a b", "foo_bar(1, 'x')\n\n", "naïve café", "汉字 mix_1", "🙂🙂 ok", "\t\f\r"]
    df = spark.createDataFrame([(s,) for s in samples], ["c"])
    fast = [r[0] for r in df.select(text.count_tokens("c")).collect()]
    listed = [r[0] for r in df.select(text.count_tokens("c", text.TOKEN_PATTERN)).collect()]
    assert fast == listed == pattern_counter(samples)


def test_relative_time(spark):
    now = dt.datetime(2024, 3, 1, 12, 0, 0)
    ages = {
        dt.timedelta(seconds=-5): "just now",
        dt.timedelta(seconds=59): "just now",
        dt.timedelta(minutes=61): "1 hours ago",
        dt.timedelta(minutes=3): "3 min ago",
        dt.timedelta(days=29, hours=23): "29 days ago",
        dt.timedelta(days=30): "2024-01-31",
    }
    for age, shown in ages.items():
        assert one(spark, times.relative_time("t", F.lit(now)), t=now - age) == shown


def test_bands_and_distance(spark):
    bands = [one(spark, scoring.similarity_band(F.lit(s))) for s in (0.9, 0.89, 0.75, 0.6, 0.1)]
    assert bands == ["excellent", "good", "good", "moderate", "weak"]
    vector = F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")
    assert one(spark, scoring.vector_distance(vector, [4.0, 6.0])) == 5.0
    assert one(spark, scoring.vector_distance(vector, [4.0, 6.0], "l2sq")) == 25.0
    assert one(spark, scoring.vector_distance(vector, [2.0, 4.0], "cosine")) == pytest.approx(0.0, abs=1e-12)


def test_file_filters(spark):
    names = ["src/a.go", "vendor/a.go", ".x/a.go", "a/pkg/b.py", "pkg.py", "x.min.js", "dist/a.js", "a.egg-info/b.py", "n.md"]
    df = spark.createDataFrame([("r", n) for n in names], ["repo_id", "file_path"])
    kept = {r.file_path for r in filters.standard_files(df).collect()}
    assert kept == {"src/a.go", "pkg.py", "a.egg-info/b.py"}
    ignored = spark.createDataFrame([("r", "src/"), ("r", "pkg.py"), ("other", "a.egg-info/")], ["repo_id", "path"])
    kept = {r.file_path for r in filters.standard_files(df, vcs_ignored=ignored).collect()}
    assert kept == {"x.min.js", "a.egg-info/b.py"}


def test_metadata_filter_types(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "language string, start_line int")
    count = lambda cond: df.filter(filters.metadata_filter(df.schema, cond)).count()
    assert count({"language": "a"}) == 1
    assert count({"start_line": "1"}) == 0
    assert count({"nothing": "1"}) == 0
