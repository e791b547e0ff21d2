"""Problem 8: encoding equals the plain encoders, on any text."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import tokens

PATH = os.path.join(tokens.DEFAULT_TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.DEFAULT_TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = [
    "", " ", "\n", "\n\n\n", "a\n\nb", "a\nb", "x \n y", "a\r\nb\r\r\nc", "<|endoftext|> is text", "don't we'll I'M", "日本語のテキスト。" * 300,
    "word " * 2000, "line one\n" * 900, "tail  \n" * 700, "émigré ñandú ß\n" * 400, "🧩👩‍💻" * 500, "x" * 5000, "​ zero width\n" * 300, "a\n  b\n\tc\n" * 500,
]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_equals_plain_encoding(plain, k):
    enc = tokens.encoder(PATH)
    assert "".join(enc.fragments(TEXTS[k])) == TEXTS[k]
    assert enc.encode(TEXTS[k]) == plain(TEXTS[k])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", " b", "\n", "\n\n", "  ", "Ünd", "'s", " 12", ".", "日本", "\t", "x\n", "\r\n", "end of\nline "]), max_size=60))
def test_any_mixture_with_small_fragments(plain, parts):
    old, tokens.FRAGMENT = tokens.FRAGMENT, 8
    try:
        text = "".join(parts)
        assert tokens.encoder(PATH).encode(text) == plain(text)
    finally:
        tokens.FRAGMENT = old


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", None), (3, "hello world", None), (None, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # an extra column of the output's name
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode_corpus(docs).collect()), key=lambda x: (x[0] or 0, x[1]))
    enc = tokens.encoder(PATH).encode
    assert got == [(None, enc("a")), (1, []), (2, []), (3, enc("hello world")), (3, enc("hello world"))]
    empty = tokens.encode_corpus(docs.limit(0))
    assert empty.columns == ["doc_id", "ids"] and empty.count() == 0


def test_very_long_text(spark):
    text = "The quick brown fox\njumps over it. " * 60_000
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert len(tokens.encode_corpus(docs).first().ids) > 400_000


def test_round_trip(spark):
    texts = ["def f(x):\n    return x\n" * 400, "naïve 数据 <|endoftext|> \r\n\t", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(docs)).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
