"""Words and their hashes."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import words

WORD = re.compile(r"[^\W_]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    batch = words.batch_words(pa.array(texts, type=pa.string()))
    got = [[] for _ in texts]
    for i, d in enumerate(batch.doc):
        got[d].append(batch.text(i))
    lower = [pa.compute.utf8_lower(pa.scalar(t or "")).as_py() for t in texts]
    assert got == [WORD.findall(t) for t in lower]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    batch = words.batch_words(pa.array(["alpha beta", "x" * 70_000 + " beta alpha", None, "", "beta"]))
    by = {}
    for i in range(len(batch.hashes)):
        by.setdefault(batch.text(i), set()).add(int(batch.hashes[i]))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_words_longer_than_a_chunk():
    a, b = "y" * 200_000, "y" * 199_999
    batch = words.batch_words(pa.array([f"{a} z", f"q {a}", b]))
    h = batch.hashes
    assert h[0] == h[3] and h[0] != h[4]


def test_grams_stay_inside_a_text():
    batch = words.batch_words(pa.array(["a b c", "a b", "", "x a b c"]))
    grams, at = words.doc_grams(batch, 3)
    assert [int(batch.doc[i]) for i in at] == [0, 3, 3]
    assert grams[0] == grams[2] and grams[0] != grams[1]
    assert len(words.gram_hashes(np.empty(0, np.uint64), 3)) == 0
