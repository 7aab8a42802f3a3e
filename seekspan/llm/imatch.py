"""I-Match fingerprints from randomised lexicons, with DataFrame functions only.

The lexicon holds the terms whose inverse document frequency lies in a band. A text's distinct lexicon terms are sorted and
hashed, once for the whole lexicon and once for each of several random subsets of it. The subsets are of several sizes, so
that for long and short texts alike some hold only a few of their terms; the share of subsets on which two texts agree is
then a graded likeness. For a text without any lexicon term, all of its own terms stand in for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspan.llm.common import buckets, id_and_text, stored

# band of document frequencies relative to the corpus: idf from ln(1 / 0.15) to ln(1 / 0.001). With so many terms at least
# in a thousandth of all documents, the lexicon has at most 1000 x (mean distinct terms of a document) entries
MIN_SHARE, MAX_SHARE = 0.001, 0.15
# random subsets of the lexicon: each family looks at bits of its own in a term's key, and takes a term into its subset of
# 1 / 2^level of the lexicon if that many of the bits are zero
FAMILIES, LEVELS = 6, (2, 5, 7, 9)

# the masks of each family, the widest subset first; the others of a family are parts of it
MASKS = [[((1 << level) - 1) << (10 * family) for level in LEVELS] for family in range(FAMILIES)]


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def lexicon(texts: DataFrame) -> DataFrame:
    """(term, key) for the terms of the band, from all of `texts` (text). Stored, and small whatever the corpus."""
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = F.lit(texts.count())
    band = counts.filter((F.col("df") >= F.ceil(MIN_SHARE * total)) & (F.col("df") <= F.greatest(MAX_SHARE * total, F.lit(1))))
    return stored(band.select("term", F.xxhash64("term").alias("key")), "lexicon")


def chosen(found: str, text: str) -> Column:
    """Sorted keys that stand for a text: those `found` in the lexicon, or of all its own terms if that is null."""
    own = F.array_sort(F.transform(terms(F.col(text)), lambda t: F.xxhash64(t)))
    return F.when(F.col(found).isNotNull(), F.array_distinct(found)).otherwise(own)


def hashes(keys: Column) -> Column:
    """One hash for each subset, over the sorted keys in it; null where it holds none of them."""
    def within(chosen: Column, mask: Column) -> Column:
        return F.filter(chosen, lambda k: k.bitwiseAND(mask) == 0)

    def one(chosen: Column) -> Column:
        return F.when(F.size(chosen) > 0, F.xxhash64(chosen))

    families = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks]) for masks in MASKS])
    # the smaller subsets of a family are looked for in its widest one only
    widest = F.transform(families, lambda masks: F.struct(masks.alias("masks"), within(keys, masks[0]).alias("chosen")))
    found = F.transform(widest, lambda f: F.transform(f["masks"], lambda m: one(within(f["chosen"], m))))
    return F.concat(F.array(one(keys)), F.flatten(found))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either text has terms in; 1 for two texts without any term."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit(""))), "-")


def fingerprint_terms(texts: DataFrame, lexicon_terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., terms) with the sorted lexicon keys of every row of `texts` (keys..., words) that has any. If `texts` is
    partitioned by the keys, no row is shuffled. The lexicon's bound allows to broadcast it."""
    found = texts.select(*keys, F.explode("words").alias("term")).join(F.broadcast(lexicon_terms), "term")
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list("key")).alias("terms"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row, hashes in hexadecimal joined by '-', empty where a subset has none of its
    terms. Null counts as empty; rows equal in doc_id and text give one row; an empty table gives none."""
    rows = id_and_text(docs, id_col, text_col)
    lex = lexicon(rows)
    base = rows.select("doc_id", F.xxhash64("text").alias("version"), terms(F.col("text")).alias("words"))
    found = fingerprint_terms(base, lex, ["doc_id", "version"])
    plain = rows.select("doc_id", F.xxhash64("text").alias("version"), "text").dropDuplicates(["doc_id", "version"])
    joined = plain.join(found, ["doc_id", "version"], "left").select("doc_id", chosen("terms", "text").alias("keys"))
    return joined.select("doc_id", as_text(hashes(F.col("keys"))).alias("fingerprint"))


def successors(rows: DataFrame) -> DataFrame:
    """(doc_id, version, n_chars, next_id, next_version) of every distinct row of `rows` (doc_id, version, n_chars): the
    row that follows in descending order, and the first one for the last.

    The rows are written in sorted ranges; each file is linked by a window of its own, and the ends of the files by one
    window over a row per file.
    """
    spark = rows.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("version").desc()]
    distinct = rows.distinct().repartitionByRange(buckets(spark), *order).sortWithinPartitions(*order)
    ranges = stored(distinct, "sorted-ids")
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    placed = ranges.select("*", part.alias("part"))
    me = F.struct("doc_id", "version")
    within = Window.partitionBy("part").orderBy(*order)
    linked = placed.withColumns({"next": F.lead(me).over(within), "rank": F.row_number().over(within)})
    firsts = linked.filter(F.col("rank") == 1).select("part", me.alias("first"))
    ends = Window.orderBy("part")  # one row per file
    whole = ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(ends), F.first("first").over(whole)).alias("after"))
    joined = linked.join(after, "part").withColumn("next", F.coalesce("next", "after"))
    return joined.select("doc_id", "version", "n_chars", F.col("next.doc_id").alias("next_id"), F.col("next.version").alias("next_version"))


def edit_test(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, whose second half is the beginning of the next document.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Documents follow
    each other by descending doc_id (null last), those with one doc_id by a hash of the text; rows equal in both are one
    document. Null counts as empty; a document that is alone is its own successor; an empty table gives none.
    """
    rows = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    rows = rows.withColumn("version", F.xxhash64("text", "no_id"))
    lex = lexicon(rows.select("text"))
    key = ["doc_id", "version"]
    links = stored(successors(rows.select("doc_id", "version", F.length("text").cast("long").alias("n_chars"))), "successors")
    before = links.select(
        F.col("next_id").alias("doc_id"), F.col("next_version").alias("version"),
        F.col("doc_id").alias("prev_id"), F.col("version").alias("prev_version"), F.floor(F.col("n_chars") / 2).cast("int").alias("take"),
    )
    # the texts are shuffled once; what goes to the preceding document is only as much as it takes
    texts = rows.select(*key, "text").join(before.hint("merge"), key)
    sent = texts.select(F.col("prev_id").alias("doc_id"), F.col("prev_version").alias("version"), F.substr("text", F.lit(1), F.col("take")).alias("head"))
    heads = sent.groupBy(*key).agg(F.first("head").alias("head"))
    length = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), (length - F.floor(length / 2)).cast("int")), "head")
    both = texts.select(*key, "text").join(heads.hint("merge"), key).select(*key, "text", edited.alias("edited"))
    words = both.select(*key, F.explode(F.array(
        F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("t")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("t"))
    )).alias("x")).select(*key, "x.is_edited", terms(F.col("x.t")).alias("words"))
    found = fingerprint_terms(words, lex, [*key, "is_edited"])
    plain = found.groupBy(*key).agg(
        F.first(F.when(~F.col("is_edited"), F.col("terms")), True).alias("terms"),
        F.first(F.when(F.col("is_edited"), F.col("terms")), True).alias("edited_terms"),
    )
    # the texts are still at hand where it is known which of them have no lexicon term
    facts = both.dropDuplicates(key).join(plain, key, "left").select(
        *key, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        chosen("terms", "text").alias("keys"), chosen("edited_terms", "edited").alias("edited_keys"),
    )
    made = facts.join(links.select(*key, "next_id", "next_version"), key).select(
        *key, "n_chars", "edited_sha256", "next_id", "next_version",
        hashes(F.col("keys")).alias("fingerprint"), hashes(F.col("edited_keys")).alias("edited_fingerprint"),
    )
    made = stored(made, "fingerprints")
    following = made.select(F.col("doc_id").alias("next_id"), F.col("version").alias("next_version"), F.col("fingerprint").alias("next_fingerprint"))
    return made.join(following.hint("merge"), ["next_id", "next_version"]).select(
        F.when((F.col("doc_id") != -(1 << 63)), F.col("doc_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
