"""The registered queries of this package: thin applications of its operators to the whole `documents` table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspan.llm import bpe, conversations, exact_dedup, imatch, katz, language, line_dedup, near_dedup, packing, phrases, pieces, privacy, secrets
from seekspan.llm.common import documents, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("op4_pack")
def op4_pack(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), VOCABULARY)


@query("op5_bpe")
def op5_bpe(spark, sf_dir):
    """Encoding of every text and decoding of the ids."""
    return bpe.round_trip(documents(spark, sf_dir), VOCABULARY)


def _repair_sql() -> str:
    """The repair in SQL: rows in order, and for each state the cheapest audit so far as its cost in ten digits before the
    letters, so that the least string is the best one."""

    def plus(state: str, cost: str, letter: str) -> str:
        return f"printf('%010d', substr({state}, 1, 10)::BIGINT + {cost}) || substr({state}, 11) || '{letter}'"

    never = "'9000000000'"
    far = lambda s: f"CASE WHEN {s} >= {never} THEN {never} ELSE {s} END"
    # insertions: to u from all others, to a from u, then to u once more
    g_u = f"least(u, {plus('z', '2', 'I')}, {plus('s', '2', 'I')}, {plus('a', '2', 'I')})"
    g_a = f"least(a, {plus('u', '2', 'I')}, {plus('z', '4', 'II')}, {plus('s', '4', 'II')})"
    moves = {"z": [("D", "z", "3", "true")], "s": [("D", "s", "3", "true"), ("K", "z", "late", "free AND letter = 's'")], "u": [("D", "gu", "3", "true")], "a": [("D", "ga", "3", "true")]}
    for start in ("z", "s", "ga"):
        moves["u"] += [("K", start, "late", "free AND letter = 'u'"), ("R", start, "2 + late", "free")]
    moves["a"] += [("K", "gu", "late", "free AND letter = 'a'"), ("R", "gu", "2 + late", "free")]
    best = {
        x: far("least(" + ", ".join(f"CASE WHEN {test} THEN {plus(s, c, e)} ELSE {never} END" for e, s, c, test in some) + ")") for x, some in moves.items()
    }
    return rf"""WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS v FROM range(256) AS r(i) UNION ALL
      SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
    crcs AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
    named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    coded AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind FROM named, crcs),
    hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE kind > 0),
    placed AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
      CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE ' ' END AS letter,
      lag(CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE ' ' END) OVER w AS earlier
      FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
    faulty AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank,
      NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open FROM placed),
    facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
      count(*) FILTER (NOT blank AND again > 1) AS duplicate, count(*) FILTER (NOT blank AND again = 1 AND open) AS truncated,
      count(*) FILTER (earlier IS NOT NULL AND earlier || letter NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
    walk AS (SELECT conv_id, 0::BIGINT AS i, '0000000000' AS z, {never} AS s, {never} AS u, {never} AS a FROM facts UNION ALL
      SELECT conv_id, i, {best['z']}, {best['s']}, {best['u']}, {best['a']} FROM (
      SELECT w.conv_id, f.i, z, s, {g_u} AS gu, {g_a} AS ga, f.letter, NOT f.blank AND f.again = 1 AS free, f.open::INT AS late
      FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
    ends AS (SELECT conv_id, least(z, a, {plus('u', '2', 'I')}, {plus('s', '4', 'II')}) AS e, n
      FROM walk w JOIN facts f USING (conv_id) WHERE w.i = f.n),
    told AS (SELECT conv_id, substr(e, 1, 10)::BIGINT AS cost, substr(e, 11) AS audit FROM ends),
    edits AS (SELECT conv_id, audit[j] AS edit, j, (SELECT count(*) FROM range(1, j + 1) AS q(x) WHERE audit[x] <> 'I') AS i
      FROM told, unnest(range(1, len(audit) + 1)) AS r(j)),
    lines AS (SELECT e.conv_id, edit, j, f.role, f.text, f.letter,
      count(*) FILTER (edit <> 'D' AND NOT (edit = 'K' AND letter = 's')) OVER (PARTITION BY e.conv_id ORDER BY j) AS nth
      FROM edits e LEFT JOIN faulty f ON f.conv_id = e.conv_id AND f.i = e.i AND e.edit <> 'I'),
    mended AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE nth % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
      || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole FROM lines WHERE edit <> 'D' GROUP BY conv_id)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
      sha256(coalesce(whole, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations)
      LEFT JOIN facts USING (conv_id) LEFT JOIN told USING (conv_id) LEFT JOIN mended USING (conv_id)"""


@query("op11_conversations", _repair_sql())
def op11_conversations(spark, sf_dir):
    """Faults and cheapest repairs of all conversations after the test damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair(conversations.damaged(rows), rows.select("conv_id")).drop("n_rows")


@query(
    "op13_phrases",
    rf"""WITH parts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS part FROM documents),
    worded AS (SELECT lang, list_filter(regexp_split_to_array(part, '[ 	]+'), lambda x: x <> '') AS w FROM parts),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
    placed AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, range(1, {phrases.MAX_WORDS + 1}) AS r(m)),
    often AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM placed GROUP BY ALL
      HAVING count(*) >= {phrases.MIN_COUNT}),
    free AS (SELECT * FROM often c WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM often b WHERE b.lang = c.lang AND b.m > c.m
      AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * b.a >= 100 * c.a)),
    cuts AS (SELECT *, unnest(range(1, m)) AS k FROM free),
    sides AS (SELECT c.*, x.a AS l, y.a AS r, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score FROM cuts c
      JOIN totals USING (lang)
      JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
      JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')),
    least AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {phrases.TOP}""",
)
def op13_phrases(spark, sf_dir):
    """The best collocations of every language."""
    return phrases.phrases(documents(spark, sf_dir))


@query("op12_pieces")
def op12_pieces(spark, sf_dir):
    """Encoding of every text in pieces, with begin and end ids, and decoding of the ids."""
    return pieces.round_trip(documents(spark, sf_dir), PIECES)


@query(
    "op8_line_dedup",
    rf"""WITH pages AS (SELECT doc_id, source, text, coalesce(source, '') AS host, source IS NULL AS nohost,
      string_split(text, chr(10)) AS lines FROM documents),
    keyed AS (SELECT doc_id, host, nohost, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM pages),
    bare AS (SELECT *, regexp_replace(line, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS k FROM keyed),
    totals AS (SELECT host, nohost, count(*) AS total FROM pages WHERE text IS NOT NULL GROUP BY 1, 2),
    often AS (SELECT host, nohost, k FROM (SELECT host, nohost, k, count(DISTINCT doc_id) AS n FROM bare WHERE k <> '' GROUP BY 1, 2, 3)
      JOIN totals USING (host, nohost) WHERE n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.RATIO}::DOUBLE * total),
    marked AS (SELECT b.*, o.k IS NOT NULL AS gone FROM bare b LEFT JOIN often o USING (host, nohost, k)),
    joined AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
    SELECT p.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
      sha256(coalesce(j.text, '')) AS text_sha256 FROM pages p LEFT JOIN joined j USING (doc_id)""",
)
def op8_line_dedup(spark, sf_dir):
    """Boilerplate lines cut out of every document; its source is the host."""
    out = line_dedup.drop_boilerplate(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query(
    "op9_exact_dedup",
    r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
      text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)""",
)
def op9_exact_dedup(spark, sf_dir):
    """Groups of equal texts, found through a new digest index loaded in two batches."""
    return exact_dedup.dedupe(documents(spark, sf_dir))


def joined_spans(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


@query("op6_pii")
def op6_pii(spark, sf_dir):
    """Personal data and disclosing terms in every document."""
    found = privacy.find(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] != privacy.TERM)
    counts = {f"n_{kind}": number_of(kind) for kind in privacy.KINDS}
    return found.select(
        "doc_id",
        *[c.alias(n) for n, c in counts.items()],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


@query("op7_language")
def op7_language(spark, sf_dir):
    """Language of every document, learned from four fifths of them."""
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = language.fit(docs.select("doc_id", "text", "lang"), fold != 0)
    return language.identify(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "lang_pred",
        "score",
        F.size("spans").alias("n_spans"),
    )


@query("op10_imatch")
def op10_imatch(spark, sf_dir):
    """I-Match fingerprints of all texts and of their edited forms."""
    return imatch.edit_test(documents(spark, sf_dir))


@query("op2_near_dedup")
def op2_near_dedup(spark, sf_dir):
    """Groups of near-duplicate documents."""
    return near_dedup.groups(documents(spark, sf_dir))


@query("op1_katz")
def op1_katz(spark, sf_dir):
    """Katz backoff scores of all documents, learned from those of four folds."""
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    out = katz.train_and_score(docs, fold != 1, order=katz.ORDER)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_secrets")
def op3_secrets(spark, sf_dir):
    """Secrets of known forms and random strings in every document."""
    found = secrets.find(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] != secrets.RANDOM)
    return found.select(
        "doc_id",
        *[number_of(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )
