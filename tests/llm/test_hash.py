"""Texts that a polynomial hash modulo 2**64 can't tell apart."""

import numpy as np
import pytest

from wayfarer.llm import common, jaccard, packing, scoring

from . import cases as K


def two_words(a="a", b="b", order=10):
    """Thue-Morse words of 2**order letters: one, and the one with its letters exchanged."""
    word = a
    for _ in range(order):
        word += word.translate(str.maketrans(a + b, b + a))
    return word, word.translate(str.maketrans(a + b, b + a))


@pytest.mark.parametrize("order", [10, 11, 13])
def test_hashes_differ(order):
    x, y = two_words(order=order)
    raw = np.frombuffer((x + y).encode(), np.uint8)
    n = len(x)
    h = common.text_hash(raw, common.EXACT, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]


def test_a_word_has_one_hash_wherever_it_stands():
    text = "abc x abc\nABC " + "q" * 3000 + " abc"
    raw = np.frombuffer(text.encode(), np.uint8)
    w = common.Words(raw, np.array([0, len(raw)]))
    assert w.hash[0] == w.hash[2] == w.hash[3] == w.hash[5] and len(set(w.hash.tolist())) == 3
    other = common.Words(raw, np.array([0, len(raw)]), seed=1)
    assert other.hash[0] == other.hash[2] == other.hash[3] != w.hash[0]


def test_operators_keep_such_words_apart(spark):
    x, y = two_words()
    rows = [(1, x, None, "s"), (2, y, None, "s"), (3, f"{x} {x} {y}", None, "s"), (4, x, None, "s")]
    docs = K.documents(spark, rows)
    near = {r["doc_id"]: r["component_id"] for r in jaccard.similar(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 1}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    length = {}
    for r in packing.pack(docs).collect():
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
    assert length == {i: len(t.encode(text, add_special_tokens=False).ids) + 1 for i, text, *_ in rows}
    trained = {w for i, text, *_ in rows if K.remainder(i, 7) != 2 for w in K.words(text)}
    known = {r["doc_id"]: r["n_known"] for r in scoring.lm_score(docs).collect()}
    assert known == {i: 1 + sum(w in trained for w in K.words(text)) for i, text, *_ in rows}
