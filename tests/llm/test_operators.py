"""Every operator on a small table with odd rows, on an empty table, and against plain restatements."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import restated
from pyspark.sql import functions as F

import corpus_pipeline
from seekspan.llm import bpe, exact_dedup, imatch, katz, language, line_dedup, near_dedup, packing, privacy, secrets
from seekspan.llm.queries import QUERIES, VOCABULARY

def fold(n):
    return F.crc32(F.col("doc_id").cast("string")) % 5 != n


def test_empty_tables(nothing):
    assert katz.train_and_score(nothing, fold(1)).count() == 0
    assert near_dedup.groups(nothing).count() == 0
    assert secrets.find(nothing).count() == 0
    assert packing.pack_documents(nothing, VOCABULARY).count() == 0
    assert bpe.round_trip(nothing, VOCABULARY).count() == 0
    assert privacy.find(nothing).count() == 0
    assert language.identify(nothing, language.fit(nothing, fold(0))).count() == 0
    assert line_dedup.drop_boilerplate(nothing).count() == 0
    assert exact_dedup.dedupe(nothing).count() == 0
    assert imatch.edit_test(nothing).count() == 0


def test_katz(docs, rows):
    found = katz.train_and_score(docs, fold(1)).collect()
    assert len(found) == len(rows)
    texts = [(k, [*restated.words(t), "\n"]) for k, t, *_ in rows]
    single, pairs = Counter(), Counter()
    for k, tokens in texts:
        if zlib.crc32(str(k).encode()) % 5 != 1:
            single.update(tokens)
            pairs.update(zip(["^", *tokens], tokens))
    n, v = sum(single.values()), len(single)
    frequencies = lambda c: np.array([0] + [sum(x == r for x in c.values()) for r in range(1, katz.DISCOUNTED + 2)])
    by_word, by_pair = katz.discounts(frequencies(single)), katz.discounts(frequencies(pairs))
    less = lambda table, c: c * (table[c] if c <= katz.DISCOUNTED else 1.0)
    unknown = 1 - sum(less(by_word, c) for c in single.values()) / n
    alone = lambda w: less(by_word, single[w]) / n if w in single else unknown
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c
    total, weight = {}, {}
    for h, seen in after.items():
        count, kept = sum(seen.values()), sum(less(by_pair, c) for c in seen.values())
        total[h] = count + (kept > count - 1e-9)
        weight[h] = (1.0 if total[h] > count else count - kept) / total[h] / (1 - sum(map(alone, seen)))
        mass = sum(less(by_pair, c) for c in seen.values()) / total[h]
        rest = unknown + sum(alone(w) for w in single if w not in seen)
        assert math.isclose(mass + weight[h] * rest, 1, abs_tol=1e-9)  # exactly normalised
    expected = defaultdict(list)
    for k, tokens in texts:
        score = base = 0.0
        for h, w in zip(["^", *tokens], tokens):
            c = after.get(h, {}).get(w, 0)
            score += math.log10(less(by_pair, c) / total[h] if c else weight.get(h, 1.0) * alone(w))
            base += math.log10((single[w] + 0.5) / (n + 0.5 * (v + 1)))
        expected[k].append((len(tokens), sum(w in single for w in tokens), base, score))
    for r in found:
        length, known, base, score = expected[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (length, known, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


@pytest.mark.parametrize("order", [3, 4])
def test_katz_longer_histories(docs, order):
    """Histories of several words, each length backing off to the next shorter one, against a plain recursion."""
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.concat(F.lit("the "), "text")))
    texts = [(r["doc_id"], [*restated.words(r["text"]), "\n"]) for r in twice.select("doc_id", "text").collect()]
    trained = [t for k, t in texts if zlib.crc32(str(k).encode()) % 5 != 1]
    assert len(trained) < len(texts)
    padded = lambda t, n: ["^"] * (n - 1) + t
    counts = [Counter(tuple(p[i : i + n]) for t in trained for p in [padded(t, n)] for i in range(len(t))) for n in range(1, order + 1)]
    factors = [katz.discounts(np.array([0] + [sum(x == r for x in c.values()) for r in range(1, katz.DISCOUNTED + 2)])) for c in counts]
    less = lambda n, c: c * (factors[n - 1][c] if c <= katz.DISCOUNTED else 1.0)
    size = sum(counts[0].values())
    unknown = 1 - sum(less(1, c) for c in counts[0].values()) / size
    after = defaultdict(dict)
    for c in counts[1:]:
        for gram, n in c.items():
            after[gram[:-1]][gram[-1]] = n
    weights = {}

    def probability(history, word):
        if not history:
            return less(1, counts[0][word,]) / size if (word,) in counts[0] else unknown
        seen, n = after.get(history), len(history) + 1
        if not seen:
            return probability(history[1:], word)
        if history not in weights:
            count, kept = sum(seen.values()), sum(less(n, c) for c in seen.values())
            total = count + (kept > count - 1e-9)
            free = (1.0 if total > count else count - kept) / total
            weights[history] = total, free / (1 - sum(probability(history[1:], w) for w in seen))
        total, weight = weights[history]
        return less(n, seen[word]) / total if word in seen else weight * probability(history[1:], word)

    expected = defaultdict(list)
    for k, t in texts:
        p = padded(t, order)
        expected[k].append(sum(math.log10(probability(tuple(p[i : i + order - 1]), p[i + order - 1])) for i in range(len(t))))
    for history in [h for h in after if len(h) == order - 1][:40]:  # exactly normalised
        assert math.isclose(sum(probability(history, w) for w, in counts[0]) + probability(history, "\0"), 1, abs_tol=1e-9)
    found = katz.train_and_score(twice, fold(1), order=order).collect()
    assert len(found) == len(texts)
    for r in found:
        assert any(math.isclose(r["score"], x, rel_tol=1e-9) for x in expected[r["doc_id"]])
    plain = {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in katz.train_and_score(twice, fold(1)).collect()}
    assert plain == {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found}


def test_katz_query_has_histories_of_two_words():
    assert katz.ORDER >= 3


def test_katz_discounts_fall_back():
    assert katz.discounts(np.array([0, 0, 0, 0, 0, 0, 0]))[1] == 0.5
    assert katz.discounts(np.array([0, 5, 50, 1, 0, 0, 9]))[1] == 0.5
    usual = katz.discounts(np.array([0, 1000, 300, 150, 90, 60, 40]))
    assert ((usual[1:] > 0) & (usual[1:] < 1)).all()


def test_near_groups(docs, rows):
    found = {r["doc_id"]: r for r in near_dedup.groups(docs).collect()}
    component, size = restated.near_groups({k: t for k, t, *_ in rows}.items())
    assert {k: r["component_id"] for k, r in found.items()} == component
    assert {k: r["n_shingles"] for k, r in found.items()} == size
    assert all(r["kept"] == (k == component[k]) for k, r in found.items())


def test_near_groups_without_centres(docs, rows, monkeypatch):
    """The blocks alone find every link, also across blocks."""
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(docs).collect()}
    assert found == restated.near_groups({k: t for k, t, *_ in rows}.items())[0]


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 62, 600).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 100).astype(np.uint64)])) for _ in range(20)]
    same = [(near_dedup.superminhash([a, b]).T[:, 0] == near_dedup.superminhash([a, b]).T[:, 1]).mean() for a, b in zip(sets, sets[1:])]
    assert abs(np.mean(same) - 0.75) < 0.03
    small = near_dedup.superminhash([common[:3]])  # fewer elements than slots: steps go on until all are filled
    assert (small < near_dedup.SLOTS << 32).all()
    alone, together = near_dedup.superminhash([sets[0]]), near_dedup.superminhash([sets[1], sets[0], common[:2]])
    assert (alone[0] == together[1]).all()


def test_secrets(docs, rows):
    found = defaultdict(list)
    for r in secrets.find(docs).collect():
        found[r["doc_id"]].append([(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != secrets.RANDOM])
    for k, t, *_ in rows:
        assert found[k][0] == restated.secrets(t), k
    assert sum(map(len, found.values())) == len(rows)


def test_randomness_battery(spark):
    rng = random.Random(3)
    drawn = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(40)) for _ in range(200)]
    words_ = ["_".join(rng.choice(["request", "handler", "factory", "builder", "context", "manager"]) for _ in range(6)) for _ in range(50)]
    repeated = ["abab" * 10, "0" * 40, "0123456789" * 4]
    tested = secrets.battery(spark.createDataFrame([(x,) for x in {*drawn, *words_, *repeated}], "value string")).collect()
    p = {r["value"]: r["p"] for r in tested}
    assert max(p[x] for x in words_ + repeated) < 0.01
    assert np.mean([p[x] > 0.05 for x in drawn]) > 0.85
    docs = spark.createDataFrame([(i, f"see {x} there") for i, x in enumerate(drawn + words_)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.find(docs).collect()}
    assert sum(bool(spans[i]) for i in range(200)) > 150 and not any(spans[i] for i in range(200, 250))
    assert [(s["start"], s["end"]) for i in range(200) for s in spans[i]][0] == (4, 44)


def test_packing(docs, rows):
    pieces = packing.pack_documents(docs, VOCABULARY).collect()
    coder, by_doc, by_sequence = bpe.coder(VOCABULARY), defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for k, t, *_ in rows:
        ids = np.array([*coder.encode(t or ""), packing.END_ID], "<u4")
        parts = sorted(by_doc[k], key=lambda r: r["piece"])[:: 2 if k == rows[2][0] else 1]
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids)
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]])
        assert all(r["length"] == 1024 for r in parts[1:])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r["length"] for r in pieces) // 1024) + 1


def best_number(lengths, capacity):
    """Fewest sequences, by trying all ways."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[i]}:
            rest = list(rooms)
            rest.remove(room)
            place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(150):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        stock = dict(Counter(lengths))
        fixed = packing.reduce_dominated(stock, 20)
        rest = [x for x, n in stock.items() for _ in range(n)]
        used = Counter(rest)
        for count, items in fixed:
            assert sum(s * k for s, k in items) <= 20
            for s, k in items:
                used[s] += count * k
        assert used == Counter(lengths)
        assert sum(c for c, _ in fixed) + best_number(sorted(rest, reverse=True), 20) == best_number(lengths, 20)
        patterns = packing.plan_patterns(dict(Counter(lengths)), 20)
        assert sum(c for c, _ in patterns) <= best_number(lengths, 20) + 1


def test_byte_pairs(docs, rows):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(VOCABULARY)
    found = {r["doc_id"]: r for r in bpe.round_trip(docs, VOCABULARY).collect()}
    for k, t, *_ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert found[k]["n_tokens"] == len(ids) and found[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[k]["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(docs, VOCABULARY), VOCABULARY).collect()}
    assert texts == {k: t or "" for k, t, *_ in rows}


def test_byte_pairs_on_random_strings():
    from tokenizers import Tokenizer

    reference, coder, rng = Tokenizer.from_file(VOCABULARY), bpe.coder(VOCABULARY), random.Random(2)
    letters = [*"ab' \n\t xyz.,!0123é²½日本ßñ😀", "<|endoftext|>", "'s", "  ", "   ", " \n", *map(chr, range(1, 0x250))]
    texts = ["".join(rng.choices(letters[: 40 if i % 2 else None], k=rng.randint(0, 30))) for i in range(3000)] + ["ab" * 900, "字" * 700]
    ids, ends = coder.encode_all(pa.array(texts))
    for i, expected in enumerate(reference.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[i] : ends[i + 1]].tolist() == expected.ids
        assert coder.decode(ids[ends[i] : ends[i + 1]]) == reference.decode(expected.ids, skip_special_tokens=False)


def test_personal_data(docs, rows):
    found = {r["doc_id"]: r for r in privacy.find(docs, whole=True).collect()}
    for k, t, *_ in rows:
        spans = [(s["kind"], s["start"], s["end"]) for s in found[k]["spans"] if s["kind"] != privacy.TERM]
        assert spans == restated.pii(t), k
        assert found[k]["_row"]["text"] == t
    assert "<EMAIL>" in found[109]["masked"] and "<PHONE>" in found[109]["masked"]


def test_email_scan_is_the_leftmost_one():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choices("ab@.-_%1 ", k=rng.randint(0, 25)))
        assert [(s.start, s.end) for s in privacy.emails(text)] == [x[1:] for x in restated.pii(text) if x[0] == "email"], text


def test_disclosing_terms(spark):
    rng = random.Random(6)
    filler = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnop"]
    rows = [(i, " ".join(rng.choices(filler, k=30))) for i in range(200)]
    for i in range(200, 206):  # one address, always near the same odd name, in different surroundings
        rows.append((i, " ".join(rng.choices(filler, k=8)) + " Quillfeather jan@example.org " + " ".join(rng.choices(filler, k=8))))
    rows += [(300 + i, "Copied Wonderword jim@example.org copied text") for i in range(10)]  # copies are one context
    found = {r["doc_id"]: r for r in privacy.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(200, 206):
        kinds = [s["kind"] for s in found[i]["spans"]]
        assert kinds == ["email", "term"] and "<TERM> <EMAIL>" in found[i]["masked"]
    assert all(not found[i]["spans"] for i in range(200))
    assert all([s["kind"] for s in found[300 + i]["spans"]] == ["email"] for i in range(10))


def test_disclosing_terms_of_hot_entities(spark):
    """An address in a third of all documents has its name masked too; a word that is as frequent elsewhere stays."""
    rng = random.Random(7)
    filler = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnop"]
    some = lambda n: " ".join(rng.choices(filler, k=n))
    rows = [(i, f"{some(8)} Everyword {some(20)}") for i in range(200)]
    rows += [(200 + i, f"{some(8)} Everyword Quillfeather jan@example.org {some(8)}") for i in range(100)]
    found = {r["doc_id"]: r for r in privacy.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Everyword <TERM> <EMAIL>" in found[i]["masked"] for i in range(200, 300))
    assert sum(len(r["spans"]) for r in found.values()) == 200
    everywhere = spark.createDataFrame([(i, f"{some(8)} Name jan@example.org") for i in range(40)], "doc_id long, text string")
    assert all(len(r["spans"]) == 1 for r in privacy.find(everywhere).collect())


@pytest.mark.parametrize("name", ["Quillfeather", "Li", "O'Brien", "Jean-Luc", "jdoe42", "AC-77/3", "48213377"])
def test_disclosing_terms_away_from_the_value(spark, name):
    """Ten documents hold a name and an address, only four of them side by side; the ten words may be long."""
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choices([f"{a}{b}word" for a in "abcdefgh" for b in "klmnop"], k=n))
    rows = [(i, some(30)) for i in range(100)]
    for i in range(100, 104):
        rows.append((i, f"{some(8)} {name} {'long' * 120}{i} jan@example.org {some(8)}"))
    rows += [(i, f"{name} {some(30)} jan@example.org {some(8)}") for i in range(104, 110)]
    found = {r["doc_id"]: r for r in privacy.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(name not in found[i]["masked"] and "<TERM>" in found[i]["masked"] for i in range(100, 110))


def test_contexts_are_whole_words():
    text = "one two, mail:a.b@c.org; three 10.0.0.1 four"
    spans = privacy.base_spans(text)
    assert list(privacy.contexts(text, spans)) == [(["one", "two,"], ["three", "10.0.0.1", "four"]), (["one", "two,", "mail:a.b@c.org;", "three"], ["four"])]


def test_language(docs, rows):
    model = language.fit(docs.filter("doc_id < 60"), fold(9))
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(found[k]["lang_pred"] == lang for k, t, lang, _ in rows if k < 60)
    assert {found[k]["lang_pred"] for k in (100, 101, 102, 103)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_mixed_text_is_split(spark, docs, rows):
    model = language.fit(docs.filter("doc_id < 60"), fold(9))
    text = f"{rows[0][1]} {rows[1][1]} {rows[2][1]}"
    spans = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    assert spans[0]["first"] == 0 and spans[-1]["last"] == len(text.split()) - 1


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 6))
        scores = rng.normal(size=(n + 2, 3)).astype(np.float32)
        labels = language.viterbi(scores, np.array([0, 2]), np.array([2, n + 2]), 0.7)
        value = lambda path, s: sum(s[i, x] for i, x in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
        for a, b in ((0, 2), (2, n + 2)):
            paths = np.array(np.meshgrid(*[range(3)] * (b - a))).reshape(b - a, -1).T
            assert math.isclose(value(labels[a:b], scores[a:b]), max(value(p, scores[a:b]) for p in paths), abs_tol=1e-5)


def test_lines(docs, rows):
    found = sorted(line_dedup.drop_boilerplate(docs).select("doc_id", "text", "spans", "key").collect(), key=lambda r: r["doc_id"])
    expected = restated.boilerplate([(s, t) for _, t, _, s in rows], line_dedup.RATIO, line_dedup.MIN_PAGES)
    assert [(r["doc_id"], r["text"]) for r in found] == sorted(((r[0], t) for r, t in zip(rows, expected)), key=lambda r: r[0])
    assert any("All rights" in (r[1] or "") for r in rows) and not any("All rights" in (r["text"] or "") for r in found)
    clash = docs.withColumn("n_lines", F.lit(1)).withColumn("_host", F.lit(2)).withColumn("_keys", F.lit(3))
    assert line_dedup.drop_boilerplate(clash).filter("_host = 2 AND _keys = 3").count() == len(rows)


def test_exact(spark, docs, rows, tmp_path):
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[restated.BLANK.sub(" ", t or "")].append(k)
    found = exact_dedup.dedupe(docs).collect()
    assert len(found) == len(rows)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_text[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), r["doc_id"] == min(ids))


def test_digest_index_persists(spark, docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 3)
    digests = exact_dedup.digests(docs)
    index.append(digests.filter("doc_id < 50"))
    first = {bytes(r["digest"]): r["keep_id"] for r in index.read().collect()}
    index.drop()
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 3)  # the files alone are enough
    again.append(digests)
    again.append(digests)
    both = {bytes(r["digest"]): r["keep_id"] for r in again.read().collect()}
    assert again.read().count() == len(both) == digests.select("digest").distinct().count()
    assert all(both[d] == k for d, k in first.items())
    plan = again.spark._jvm.PythonSQLUtils.explainString(digests.join(again.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 1  # the index is not shuffled
    again.drop()


def test_fingerprints(docs, rows):
    found = {r["doc_id"]: r for r in imatch.edit_test(docs).collect()}
    ordered = sorted({k: t or "" for k, t, *_ in rows}.items(), reverse=True)
    for (k, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert found[k]["n_chars"] == len(t) and found[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[k]["near_edited"] <= 1 and 0 <= found[k]["near_next"] <= 1
    assert found[104]["fingerprint"] == found[105]["fingerprint"] != found[106]["fingerprint"]
    assert found[105]["near_next"] == 1.0  # 104 has the same text
    single = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs).collect()}
    assert single == {k: r["fingerprint"] for k, r in found.items()}


def test_fingerprints_without_lexicon_terms(spark):
    """Long texts whose terms are all too rare for the lexicon are like their copies only; the operator and the query agree."""
    own = [" ".join(f"{a}{n}" for n in range(1500)) for a in ("alpha", "beta", "gamma")]
    rows = [(i, "common words stand here") for i in range(2100)] + [(3000 + i, t) for i, t in enumerate([own[0], own[1], own[1], own[2]])]
    rows += [(4000, " ".join(f"delta{n}" for n in range(100))), (4001, "日本語の文章。別の文章"), (5000, "?!"), (5001, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in imatch.edit_test(table).collect() if r["doc_id"] >= 3000}
    prints = {k: r["fingerprint"] for k, r in found.items()}
    assert prints[3001] == prints[3002] and prints[5000] == prints[5001] == "-" * (imatch.FAMILIES * len(imatch.LEVELS))
    assert len({prints[k] for k in (3000, 3001, 3003, 4000, 4001, 5000)}) == 6
    assert found[3002]["near_next"] == found[5001]["near_next"] == 1.0
    assert all(found[k]["near_next"] < 0.5 for k in (3001, 3003, 4000, 4001, 5000)) and found[3001]["near_edited"] < 1
    single = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(table).filter("doc_id >= 3000").collect()}
    assert single == prints


def test_pipeline(spark, docs, rows):
    plain_docs = docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id < 106 OR doc_id > 107")
    state, results = plain_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        state = corpus_pipeline.stored(stage(spark, state, ""), f"test-{name}")
        results[name] = {r["doc_id"]: r.asDict() for r in state.collect()}
        if name != "packing":
            assert set(state.columns) == set(plain_docs.columns)
    before = {r["doc_id"]: r.asDict() for r in plain_docs.collect()}
    labelled = results["language"]
    assert set(before) - set(labelled) == {k for k, r in before.items() if not any(c.isalpha() for c in r["text"] or "")} | (set(before) - set(labelled)) & {111}
    assert all(labelled[k] == before[k] for k in labelled)
    rows_ = corpus_pipeline.stored(spark.createDataFrame(list(labelled.values()), plain_docs.schema), "t").collect()
    assert {k: r["text"] for k, r in results["lines"].items()}.keys() == labelled.keys()
    component, _ = restated.near_groups({k: r["text"] for k, r in results["lines"].items()}.items())
    assert set(results["near_duplicates"]) == {k for k in component if component[k] == k}
    for k, r in results["personal_data"].items():
        text = results["near_duplicates"][k]["text"]
        assert bool(restated.pii(text)) == (r["text"] != text) and not restated.pii(r["text"])
    assert set(results["packing"]) == set(results["personal_data"]) and rows_


def test_copies_are_not_boilerplate(spark):
    """A text whose copies are a third of a source goes through line removal; a line of many different pages does not."""
    rows = [(i, f"distinct page number {i} about nothing\nAll rights reserved.", "en", "s") for i in range(20)]
    rows += [(100 + i, "one text that stands here again and again\nand its second line", "en", "s") for i in range(10)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.stored(corpus_pipeline.drop_lines(spark, docs, ""), "t")
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert all(texts[k] == t for k, t, *_ in rows[20:]) and not any("rights" in t for t in texts.values())
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_near_duplicates(spark, lines, "").collect()}
    assert [(k, t) for k, t in kept.items() if k >= 100] == [(100, rows[20][1])]


def test_all_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_katz_scores_other_texts(spark, docs):
    """A model scores any blocks; on its own it gives what training and scoring in one go gives."""
    tokens = katz.blocks(docs.select("doc_id", "text", fold(1).alias("train")).na.fill({"text": ""}))
    apart = {(r["doc_id"], round(r["score"], 6)) for r in katz.score(tokens, katz.train(tokens)).collect()}
    assert apart == {(r["doc_id"], round(r["score"], 6)) for r in katz.train_and_score(docs, fold(1)).collect()}
