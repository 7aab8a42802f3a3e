"""What Python tasks get at once is bounded by bytes."""

from pyspark.sql import functions as F

from seekspan.operators.tokens import count_tokens
from seekspan.sources.files import scan_trees

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_a_counter(spark):
    """8000 texts of 5 kB are no batch of 40 MB."""
    spark.conf.unset(BYTES)
    texts = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("content"))
    found = count_tokens(texts, lambda batch: [sum(map(len, batch))] * len(batch))
    assert found.agg(F.max("tokens")).first()[0] <= 10 << 20


def test_folder_of_many_files(spark, tmp_path):
    """A folder is listed in pieces, and files reach the reader in small batches."""
    spark.conf.unset(BYTES)
    for i in range(10_050):
        (tmp_path / f"f{i}.go").touch()
    assert scan_trees(spark, [("r", "p", str(tmp_path))]).agg(F.count_distinct("file_path")).first()[0] == 10_050
    assert spark.conf.get(BYTES) == "8m"
