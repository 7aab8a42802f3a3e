"""Encoding in pieces against the library itself, on the odd rows, drawn texts and drawn lists of ids."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from seekspan.llm import pieces
from seekspan.llm.queries import PIECES

MARKS = st.text(alphabet="ab  \t\n▁日😀é\x00.the", max_size=40)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=400, deadline=None)
@given(st.one_of(MARKS, st.text(max_size=40)))
def test_any_text(text):
    coder = pieces.coder(PIECES)
    library = coder.__dict__.setdefault("library", sentencepiece.SentencePieceProcessor(model_file=PIECES))
    ids = coder.encode(text)
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert coder.decode(ids) == library.decode(ids)


def test_texts_of_pieces(library):
    """Pieces in any order, so that merges compete across their borders."""
    coder, rng = pieces.coder(PIECES), random.Random(3)
    names = [library.id_to_piece(i) for i in range(259, library.vocab_size())]
    for _ in range(3000):
        text = "".join(rng.choices(names, k=rng.randint(1, 20))).replace("▁", rng.choice(" ▁"))
        assert coder.encode(text) == library.encode(text, add_bos=True, add_eos=True), text


def test_tokens_are_what_merging_gives():
    coder, rng = pieces.coder(PIECES), random.Random(4)
    for _ in range(500):
        word = "▁" * rng.randint(0, 20) + "".join(rng.choices("thenigs", k=rng.randint(1, 25)))
        assert coder.split(word) == coder.merge(word), word


def test_decoding_of_any_ids(library):
    coder, rng = pieces.coder(PIECES), random.Random(5)
    some = [0, 1, 2, 259, 28705, *range(3, 259, 7), 229, 153, 132]
    for _ in range(3000):
        ids = [rng.choice(some) if rng.random() < 0.6 else rng.randrange(library.vocab_size()) for _ in range(rng.randint(0, 9))]
        assert coder.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 5_000, "ab" * 20_000, "日" * 3_000, "\n" * 3_000, "the " * 30_000])
def test_long_texts(library, text):
    coder = pieces.coder(PIECES)
    assert coder.encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_memory_is_bounded(monkeypatch):
    coder = pieces.PieceCoder(PIECES)
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 50)
    monkeypatch.setattr(pieces, "KNOWN_PAIRS", 50)
    for i in range(300):
        coder.encode(f"w{i}th the{i}")
    assert len(coder.known) <= 52 and len(coder.pairs) <= 50


def test_documents(spark, docs, rows, nothing, library):
    found = sorted(map(tuple, pieces.round_trip(docs, PIECES).collect()))
    expected = []
    for k, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        decoded = hashlib.sha256(library.decode(ids).encode()).hexdigest()
        expected.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), decoded))
    assert found == sorted(expected)
    encoded = pieces.encode_documents(docs, PIECES)
    texts = {r.doc_id: r.text for r in pieces.decode_documents(encoded, PIECES).collect()}
    assert texts == {k: (t or "").replace("▁", " ") for k, t, *_ in rows}
    assert pieces.round_trip(nothing, PIECES).count() == 0 and pieces.encode_documents(nothing, PIECES).count() == 0
    lost = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in pieces.round_trip(lost, PIECES).collect()) == [2, 4]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(PIECES, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceCoder(str(tmp_path / "m.model"))
