"""Cleaning of a document table in five stages; each stage's result is written as Parquet and reread by the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekspan.llm import language, line_dedup, near_dedup, packing, privacy
from seekspan.llm.common import documents, prepare, stored
from seekspan.llm.queries import VOCABULARY

# a document goes if less than this share of its letters is in its main language
MIN_LANGUAGE_SHARE = 0.5


def with_text(rows: DataFrame, row: str, columns: list[str], text: Column) -> DataFrame:
    """The columns of the input rows, with a new text and its length."""
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[changed.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letters, or are of no prevailing language; the labelled rows are learned from."""
    prepare(spark)
    model = language.fit(docs, F.lit(True))
    labelled = language.identify(docs, model, whole=True)
    return labelled.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SHARE)).select("_row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts boilerplate lines of each source out of the texts. Copies count once, so that they go to the next stage whole. All
    rows stay, a null text as it is, a null source as a source of its own; an empty table gives none."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = line_dedup.drop_boilerplate(docs.select(row.alias("_row"), "source", "text"), copies_once=True)
    shorter = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))
    changed = {"text": F.col("text"), "n_chars": shorter}
    return out.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group, one row of it if the row is repeated. Without any doc_id in a
    group one of its rows stays; rows without words or text are in no group, and stay. An empty table gives none."""
    prepare(spark)
    name = near_dedup.key(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), name.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = near_dedup.grouped(rows.select("doc_id", "text")).filter("kept")
    kept = found.groupBy("doc_id").agg(F.max("n_shingles").alias("_words"))
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    left = rows.join(kept.hint("merge"), "doc_id").withColumn("_again", again)
    return left.filter((F.col("_again") == 1) | ((F.col("doc_id") >= near_dedup.NO_ID) & (F.col("_words") == 0))).select("_row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and disclosing terms by their kind. All rows stay; a null text becomes an empty one, equal rows are
    masked alike, texts of any length are masked whole; an empty table gives none."""
    prepare(spark)
    return with_text(privacy.find(docs, whole=True), "_row", docs.columns, F.col("masked"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; one row per piece. An empty or null text is its end token; longer texts
    than a sequence are cut; repeated rows are packed one by one; an empty table gives none."""
    prepare(spark)
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]
# groups of similar texts and token ids are beyond SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows of the last one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
