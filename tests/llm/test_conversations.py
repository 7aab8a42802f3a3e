"""Repair of conversations against trying every edit."""

import hashlib
import random

import pytest
import restated
from hypothesis import given, settings
from hypothesis import strategies as st

from seekspan.llm import conversations as talk

SCHEMA = "conv_id long, turn long, role string, text string, conv string, n long, part int"
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def rows(n=70):
    rng = random.Random(6)
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", "agent", None]
    texts = ["Yes.", "no", "", " \t", "What?  ", "Yes.", "x!", None, "é\nü.\n"]
    out = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            text = rng.choice(texts) if rng.random() < 0.5 else f"Words {rng.randrange(30)}" + rng.choice([".", "", "!"])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            out.append((conv, rng.choice([turn, turn, turn * 2, None, turn // 2]), role, text))
    out += [(900, None, None, None)] * 5 + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, "tool", "x")]
    out += [(901, 3, "user", "same.")] * 400  # one row many times
    out += [(902, i, ("user", "assistant")[i % 2 if i % 7 else 0], f"Turn {i % 90}" + ".!  "[i % 4]) for i in range(1500)]
    out += [(903, 7, "user", f"text {i}.") for i in range(300)]  # one turn only
    out += [(904, 0, "user", "long " * 60_000 + "."), (904, 1, "assistant", "long " * 60_000)]
    return out


def told(df):
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in df.collect()}


def table(spark, some):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in some], SCHEMA).repartition(3)


@pytest.mark.parametrize("size, weight", [(512, 512 << 10), (3, 50), (1, 10**9)])
def test_repair(spark, size, weight):
    some = rows()
    found = talk.repair(table(spark, some), segment_rows=size, segment_bytes=weight)
    assert told(found) == restated.repaired(some)


def test_damage_and_lost_conversations(spark):
    some = rows(150)
    given_ = table(spark, some)
    hurt = restated.damaged(some)
    assert sorted(map(str, map(tuple, talk.damaged(given_).collect()))) == sorted(map(str, hurt))
    expected = {r[0]: NOTHING for r in some} | restated.repaired(hurt)
    found = told(talk.repair(talk.damaged(given_), given_.select("conv_id")))
    assert found == expected
    assert NOTHING in found.values()


def test_empty_table(spark):
    nothing = table(spark, [(1, 1, "user", "x")]).limit(0)
    assert talk.repair(nothing).count() == 0 and talk.repair(talk.damaged(nothing), nothing).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(talk.SYMBOLS), st.integers(1, 5)), max_size=8))
def test_runs(runs):
    """Powers of a run's matrix give what its rows give one by one, and the unrolled letters cost just that."""
    costs = talk.END
    for symbol, n in reversed(runs):
        for _ in range(n):
            costs = talk.times(talk.power(symbol, 0), costs)
    powers = talk.END
    for symbol, n in reversed(runs):
        powers = talk.before(symbol, n, powers)
    assert powers == costs == talk.times(talk.matrix(runs), talk.END)
    for state in range(4):
        audit, _ = talk.unroll(runs, state, talk.END)
        assert sum(c != "I" for c in audit) == sum(n for _, n in runs)


def test_a_run_of_any_length():
    costs = talk.before("u", 10**12, talk.END)
    # every second row becomes the assistant's
    assert costs[talk.START] == 10**12
