"""Problem 10: repeated words against brute force."""

import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import repetition as R

pytestmark = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/piece_bpe_32k.model"), reason="no vocabulary files")
_table = []


def table():
    if not _table:
        _table.append(R.PieceTable("/opt/tokenizers/piece_bpe_32k.model"))
    return _table[0]


def brute(text, run=8):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    seen, hit = set(), set()
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            hit.update(range(i, i + run))
        seen.add(g)
    return len(hit) / len(w) if w else 0.0


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d e f g h i j k".split()), max_size=80), max_size=6))
def test_shares_equal_brute_force_and_the_band_loses_nothing(docs):
    import pyarrow as pa

    texts = [" ".join(d) for d in docs]
    for reject in (False, True):
        out = R._measure(pa.array(texts, type=pa.string()), table(), R.SHARE, R.RUN, reject)
        for text, passed, share in zip(texts, out[-2].to_pylist(), out[-1].to_pylist()):
            true = brute(text)
            assert abs(share - true) < 1e-12 if not reject or passed else share is None or share == true
            if true >= R.SHARE:
                assert passed


def test_the_band_rejects_texts_without_repetition():
    import pyarrow as pa

    texts = [" ".join(f"word{i} of text" for i in range(60)), "one two three four five six seven eight nine " * 3]
    out = R._measure(pa.array(texts), table(), R.SHARE, R.RUN, True)
    assert out[-2].to_pylist() == [False, True]


def test_documents(spark):
    block = "one two three four five six seven eight nine ten"
    rows = [
        (1, f"{block}. {block}"), (2, block), (3, None), (4, ""), (5, " \n "), (6, f"{block} " * 50), (6, f"{block} " * 50), (7, "word " * 200_000),
        (8, " ".join(f"w{i}" for i in range(500)) + f" {block} {block}"), (None, f"{block}\n\n{block}"),
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_words int")
    assert sorted((r.doc_id for r in R.repeated_documents(docs).collect()), key=lambda x: x or 0) == [None, 1, 6, 7]
    measured = {r.doc_id: r for r in R.measure_repetition(docs).collect()}
    assert measured[3].n_words == 0 and measured[3].chars_per_token is None and measured[3].repeated_share == 0.0
    assert measured[1].repeated_share == 0.5 and measured[1].script == "latin" and measured[1].in_band
    assert R.repeated_documents(docs.limit(0)).count() == 0


def test_fertility_figures():
    import pyarrow as pa

    out = R._measure(pa.array(["привет мир это текст", "hello world", "数据被写入日志"], type=pa.string()), table(), R.SHARE, R.RUN, False)
    assert out[6].to_pylist() == ["cyrillic", "latin", "han"]
    tokens = [len(table().model.encode(w)) for w in ("hello", "world")]
    assert out[1].to_pylist()[1] == sum(tokens)
