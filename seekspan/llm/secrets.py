"""Secrets in texts, with DataFrame functions only: forms that secrets are known by, and strings that look random.

Candidates for the second kind are long runs of the letters of common encodings. Each distinct one is tested for being an
independent draw from the alphabet of its inferred encoding (chi-squared tests of letters and of letter classes, runs test,
serial correlation). How far down the combined p-value may go is decided by length: in each band of lengths the true
random strings, whose p-values are uniform, are told from the others by the upper half of the p-values, and the cut is put
where the others are an estimated MAX_FALSE of what is reported.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspan.llm.common import id_and_text, stored

# Kinds in their order, and their patterns as (prefix, value)
KINDS = ["assign", "access", "hex"]
RANDOM = "random"
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?)""", r"([A-Za-z0-9+/_.=-]+)"),
    "access": ("()", r"(AKIA[A-Z0-9]{12,}+)"),
    "hex": ("()", r"((?<![0-9a-f])[0-9a-f]{32,}+)"),
    RANDOM: ("()", r"((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+)"),
}
MIN_ASSIGNED = 8
# shares of false discoveries aimed at, and the finest step of p-values
MAX_FALSE, BINS = 0.05, 100
# lower ends of the length bands
BANDS = [20, 24, 28, 32, 40, 48, 64, 128]

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# alphabets of encodings, and the sizes of their classes: lower case, upper case, all other
ENCODINGS = {
    "hex": (DIGITS + LOWER[:6], (6, 0, 10)),
    "base32": (UPPER + "234567", (0, 26, 6)),
    "base36": (DIGITS + LOWER, (26, 0, 10)),
    "base64": (UPPER + LOWER + DIGITS + "+/", (26, 26, 12)),
}
MATCH = "array<struct<kind: string, gap: int, prefix: int, value: string>>"


def matches(text: Column, kind: str) -> Column:
    """Matches of one kind from left to right: how many characters lie between the end of the match before and this one,
    the length of the prefix, and the value. The characters U+0001 and U+0002 mark matches, and are exchanged beforehand
    for another one that no pattern knows either."""
    safe = F.when(text.rlike("[\x01\x02]"), F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)
    pieces = F.split(F.regexp_replace(safe, "".join(PATTERNS[kind]), "\x01$1\x02$2\x02"), "\x01", -1)

    # every step looks at its own piece only: an array named inside a lambda would be made again for each match
    parts = F.transform(pieces, lambda p: F.split(p, "\x02", -1))
    rests = F.transform(pieces, lambda p: F.length(F.element_at(F.split(p, "\x02", -1), -1)))

    def match(part: Column, before: Column) -> Column:
        # the rest of the piece before is the gap; the first piece is all gap
        return F.struct(F.lit(kind).alias("kind"), before.alias("gap"), F.length(part[0]).alias("prefix"), part[1].alias("value"))

    # the last rest has no match after it
    found = F.filter(F.zip_with(F.slice(parts, F.lit(2), F.lit(1 << 30)), rests, match), lambda m: m["value"].isNotNull())
    return F.when(safe.rlike("".join(PATTERNS[kind])), found)


def normal_tail(z: Column) -> Column:
    """P(Z > z), by the logistic approximation (error below 0.0002)."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def two_sided(z: Column) -> Column:
    return F.least(2 * normal_tail(F.abs(z)), F.lit(1.0))


def battery(values: DataFrame) -> DataFrame:
    """`values` (value, distinct) with its encoding, length n, and the p-value of being random."""
    bare = F.translate(F.rtrim(F.col("value")), "-_", "+/")
    encoding = (
        F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(bare.rlike("^[A-Z2-7]+$"), "base32")
        .when(bare.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .otherwise("base64")
    )
    folded = F.when(F.col("encoding").isin("hex", "base36"), F.lower("bare")).otherwise(F.col("bare"))

    def by_encoding(value) -> Column:
        out = None
        for name, spec in ENCODINGS.items():
            out = F.when(F.col("encoding") == name, value(*spec)) if out is None else out.when(F.col("encoding") == name, value(*spec))
        return out

    def number_of(letters: str) -> Column:
        return F.col("n") - F.length(F.translate("v", letters, ""))

    def classes(_, sizes) -> Column:
        terms = [F.pow(number_of(x), F.lit(2)) / s for x, s in zip((LOWER, UPPER, DIGITS + "+/"), sizes) if s]
        return sum(terms[1:], terms[0]) * sum(sizes) / F.col("n") - F.col("n")

    chars = F.split("v", "")
    coded = values.select("value", bare.alias("bare"), encoding.alias("encoding")).withColumn("v", folded)
    coded = coded.withColumns({
        "n": F.length("v").cast("double"),
        "k": by_encoding(lambda a, _: F.lit(float(len(a)))),
        "x": F.transform(F.filter(chars, lambda c: c != ""), lambda c: (F.instr(by_encoding(lambda a, _: F.lit(a)), c) - 1).cast("double")),
        "counts": by_encoding(lambda a, _: F.array(*[number_of(c).cast("double") for c in a])),
        "halves": by_encoding(lambda a, _: F.translate("v", a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2))),
        "class_square": by_encoding(classes),
        "class_freedom": by_encoding(lambda _, sizes: F.lit(float(sum(map(bool, sizes)) - 1))),
    })
    n, k = F.col("n"), F.col("k")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    measured = coded.withColumns({
        "square": total(F.transform("counts", lambda c: c * c)) * k / n - n,
        "sum_x": total(F.col("x")),
        "sum_xx": total(F.transform("x", lambda x: x * x)),
        "sum_xy": total(F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda a, b: a * b)),
        "ones": F.length(F.translate("halves", "0", "")).cast("double"),
        "runs": 1 + (2 * n - F.length(F.replace("halves", F.lit("01"), F.lit(""))) - F.length(F.replace("halves", F.lit("10"), F.lit("")))) / 2,
    })
    # letters: chi-squared with its exact variance; classes: the cube-root normal form for few degrees of freedom
    letters = normal_tail((F.col("square") - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)))
    freedom = F.col("class_freedom")
    cube = (F.pow(F.greatest(F.col("class_square"), F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    uniform = F.least(2 * F.least(letters, normal_tail(cube)), F.lit(1.0))
    mean = 1 + 2 * F.col("ones") * (n - F.col("ones")) / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = F.when(spread > 0, two_sided((F.col("runs") - mean) / F.sqrt(spread))).otherwise(0.0)
    variance = F.col("sum_xx") - F.pow(F.col("sum_x"), F.lit(2)) / n
    first, last = F.element_at("x", 1), F.element_at("x", -1)
    covariance = F.col("sum_xy") - F.col("sum_x") / n * (2 * F.col("sum_x") - first - last) + (n - 1) * F.pow(F.col("sum_x") / n, F.lit(2))
    serial = F.when(variance > 0, two_sided((covariance / variance + 1 / n) * F.sqrt(n))).otherwise(0.0)
    # Fisher's combination of three tests: the tail of chi-squared with six degrees of freedom
    half = -sum(F.log(F.greatest(p, F.lit(1e-12))) for p in (uniform, runs, serial))
    p = F.exp(-half) * (1 + half + half * half / 2)
    return measured.select("value", "encoding", F.col("n").cast("int").alias("n"), F.least(p, F.lit(1.0)).alias("p"))


def band(n: Column) -> Column:
    return sum((F.when(n >= low, 1).otherwise(0) for low in BANDS), F.lit(0))


def cuts(tested: DataFrame) -> DataFrame:
    """(band, cut): the smallest p-value, in steps of 1 / BINS, from which strings of a length are taken for random.

    In a band, twice the number of strings in the upper half of the p-values estimates the true random ones; what lies
    above a cut beyond their share is false. At most len(BANDS) x BINS rows are gathered per window."""
    bins = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int")
    counted = tested.groupBy(band(F.col("n")).alias("band"), bins.alias("bin")).agg(F.count("*").alias("m"))
    down = Window.partitionBy("band").orderBy(F.col("bin").desc())
    above = counted.withColumn("above", F.sum("m").over(down))
    above = above.withColumn("upper", F.max(F.when(F.col("bin") >= BINS // 2, F.col("above"))).over(Window.partitionBy("band")))
    expected = 2 * F.coalesce("upper", F.lit(0)) * (1 - F.col("bin") / BINS)
    # the estimate is a count: one standard deviation of leeway, so that a few strings in a band do not fail by chance
    fine = above.filter((F.col("bin") >= 1) & (F.col("above") - expected <= MAX_FALSE * F.col("above") + F.sqrt(expected)) & (expected > 0))
    return fine.groupBy("band").agg((F.min("bin") / BINS).alias("cut"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: spans are (start, end, kind) in code points, by start and then kind as listed.

    Spans of the known forms always stay; a random string is added if it overlaps none of them. A null text counts as empty
    and has no spans; rows are scanned one by one, repeated or not, while copies of a string are one string for the
    estimates; an empty table gives none."""
    text = F.col("text")
    scanned = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.concat(*[F.coalesce(matches(text, k), F.array().cast(MATCH)) for k in PATTERNS]).alias("matches")
    )
    scanned = stored(scanned, "secret-matches")
    each = scanned.select("row", F.posexplode("matches").alias("i", "m")).select("row", "i", "m.*")
    size = F.col("prefix") + F.length("value")
    ends = F.sum(F.col("gap") + size).over(Window.partitionBy("row", "kind").orderBy("i"))
    placed = each.withColumn("end", ends.cast("int")).withColumn("start", (F.col("end") - size).cast("int"))
    placed = placed.filter((F.col("kind") != "assign") | (F.length("value") >= MIN_ASSIGNED))
    placed = stored(placed.select("row", "kind", "start", "end", "value"), "secret-places")
    tested = stored(battery(placed.filter(F.col("kind") == RANDOM).select("value").distinct()), "secret-tests")
    passed = tested.join(cuts(tested), band(F.col("n")) == F.col("band")).filter(F.col("p") >= F.col("cut")).select("value")
    base = placed.filter(F.col("kind") != RANDOM)
    random = placed.filter(F.col("kind") == RANDOM).join(passed.hint("merge"), "value", "left_semi").select(*placed.columns)
    # a random string is dropped where a known span reaches into it: running ends of known spans by start, either way
    both = base.withColumn("known", F.lit(True)).unionByName(random.withColumn("known", F.lit(False)))
    by_start = Window.partitionBy("row").orderBy("start", F.col("known").desc())
    reach = F.max(F.when(F.col("known"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    # looked at from the end: a frame that reaches ahead is summed up anew for each row
    by_end = Window.partitionBy("row").orderBy(F.col("start").desc(), "known")
    ahead = F.min(F.when(F.col("known"), F.col("start"))).over(by_end.rowsBetween(Window.unboundedPreceding, 0))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.lit((1 << 31) - 1)) >= F.col("end"))
    kept = both.withColumn("free", free).filter("known OR free")
    rank = F.array_position(F.array(*[F.lit(k) for k in [*KINDS, RANDOM]]), F.col("kind"))
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    empty = F.array().cast("array<struct<start: int, end: int, kind: string>>")
    return scanned.select("doc_id", "row").join(spans.hint("merge"), "row", "left").select("doc_id", F.coalesce(plain, empty).alias("spans"))
