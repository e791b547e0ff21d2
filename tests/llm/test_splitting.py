"""Problem 4: pieces of oversized items."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm.splitting import LIMIT, OVERLAP, split, split_items


def test_characters_that_belong_together_stay_together():
    text = "e\u0301" * 4000
    pieces = split(text)
    assert all(s % 2 == 0 for s, _ in pieces) and pieces[-1][1] == len(text) and all(e - s <= LIMIT for s, e in pieces)


def check(text, limit=LIMIT, overlap=OVERLAP):
    pieces = split(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e in pieces)
    for (s, e), (s2, e2) in zip(pieces, pieces[1:]):
        assert s < s2 <= e and e - s2 <= overlap and e2 > e
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["def f(x):\n", "    return x\n", "\n", "x" * 37, " ", "é", "word. ", "}\n", "\r\n", "\t"]), min_size=1, max_size=150), st.integers(20, 120))
def test_pieces_cover_the_text_within_the_limit(parts, limit):
    text = "".join(parts)
    check(text, limit, limit // 8)


def test_long_and_odd_texts():
    for text in ("x" * 10_000, "é" * 1501, "a b " * 5000, "line\r\n" * 3000, "\n" * 4000, "日" * 40_000, "é" * 3000):
        check(text)


def test_functions_stay_whole_where_they_fit():
    body = "def f{0}(x):\n" + "    y = compute(x)\n" * 25 + "    return y\n"
    text = "\n".join(body.format(i) for i in range(12))
    for s, _ in check(text)[1:]:
        assert text[s - 1] == "\n"
    ends = [e for _, e in check(text)[:-1]]
    assert sum(text[e:].startswith("def ") for e in ends) >= len(ends) - 1


def test_fewest_pieces_where_nothing_hinders():
    text = ("a" * 29 + "\n") * 100
    assert len(split(text, 1500, 0)) == 2


def test_table(spark):
    long = "line of text here\n" * 200
    rows = [(1, long, 5, "function"), (2, "x" * LIMIT, 1, "file"), (3, None, 1, "file"), (4, "", None, None), (5, long, None, None), (5, long, None, None)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "id bigint, content string, line_number int, chunk_type string, piece int")
    out = split_items(df).collect()
    assert {r.id for r in out} == {1, 5}
    first = sorted((r for r in out if r.id == 1), key=lambda r: r.piece)
    assert [r.piece for r in first] == list(range(1, first[0].pieces + 1)) and first[0].chunk_type == "function"
    for r in first:
        assert r.line_number == 5 + long[: r.start].count("\n") and long[r.start :].startswith(r.content)
    assert all(r.line_number is None for r in out if r.id == 5) and len([r for r in out if r.id == 5]) == 2 * len(first)
    assert split_items(df.limit(0)).count() == 0
