"""A small table with odd rows, shared by the tests of all operators."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, key int, terms double, _row string"


def make_rows():
    rng = random.Random(5)
    english = "the of and thing water house under night would about people little where great never again".split()
    german = "der die und nicht über straße wasser schön müssen zwischen größer mädchen heute würde ganz".split()
    russian = "это что вода дом ночь люди когда большой никогда снова между".split()

    def text(vocabulary, n):
        return " ".join(rng.choice(vocabulary) + (rng.choice("xyzqvw") * rng.randint(0, 3)) for _ in range(n))

    rows = []
    for i in range(60):
        lang, vocabulary = [("en", english), ("de", german), ("ru", russian)][i % 3]
        body = text(vocabulary, rng.randint(3, 120))
        if i % 4 == 0:
            body += "\nAll rights reserved.\n" + text(vocabulary, 20)
        rows.append((i, body, lang, f"s{i % 2}"))
    base = text(english, 200).split()
    for i in range(60, 90):  # near copies of one text, some further apart from each other than from it
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            copy[rng.randrange(len(copy))] = "edit" + str(rng.random())
        rows.append((i, " ".join(copy), "en", None if i % 5 == 0 else "s1"))
    rows += [
        (100, None, "en", "s1"), (101, "", "en", "s1"), (102, " \t\n ", None, "s0"), (103, "!!! ... ???", "en", "s0"), (104, "short", "en", "s0"),
        (105, "short", "en", "s1"), (106, "a" * 50_000, "en", "s1"), (107, text(english, 20_000), "en", "s1"), (108, "1" * 3000 + " " + "@" * 50, "en", "s0"),
        (109, 'write a.b+c@mail.example.org_x@y.org, call +49 (30) 123-4567 or 10.0.0.1.2.3.4.5 4539 1488 0343 6467 now', "en", "s1"),
        (110, 'password = "hunter2hunter2" token=secret=abc TOKEN: abcdefgh AKIAABCDEFGHIJKL12 ' + "0a" * 20 + " \x01\x02", "en", "s1"),
        (111, "tok 9f86d081884c7d659a2feaa0c55ad015 x 日本語のテキスト 😀 password: 12345678é", "en", None),
        (112, rows[1][1], "de", "s0"), (113, rows[1][1].replace(" ", "\t\t"), "de", "s0"), (114, "x  y   z <|endoftext|> a", None, "s0"),
    ]
    rows.append(rows[2])  # a repeated row
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(k, t, lang, source, None if t is None else len(t), "x", 1, 0.5, "r") for k, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
