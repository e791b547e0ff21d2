"""Problem 9: leaked items against brute force, and the alignment."""

import random
import re
import unicodedata

import numpy as np

from tessel.llm import filters
from tessel.llm import leakage as L


def words(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").lower())


def brute(docs, items, n=13):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    stock = text(14)
    passages = [text(rng.randint(5, 60)) for _ in range(25)]
    items = [(i, " ".join((stock if i % 3 == 0 else []) + p)) for i, p in enumerate(passages)]
    items += [(90, items[0][1]), (91, None), (92, ""), (93, "too short to match anything at all"), (94, " ".join(passages[7] + text(9)))]
    docs = []
    for d in range(160):
        body = text(rng.randint(0, 80))
        p = passages[rng.randrange(25)]
        if d % 2:
            cut = rng.randint(0, max(0, len(p) - 10))
            piece = p[cut : cut + rng.randint(8, 40)]
            if d % 6 == 1 and len(piece) > 3:
                piece[len(piece) // 2] = "edited"
            sep = ["\n", " **", ", ", " — "][d % 4]
            body = body[:20] + [sep.join(piece).upper() if d % 5 == 0 else sep.join(piece)] + body[20:]
        docs.append((d, (" ".join(stock) + " " if d % 3 == 0 else "") + " ".join(body)))
    docs += [(500, None), (501, ""), (502, "ﬁ ① " + items[4][1].replace("w", "Ｗ")), (1, docs[1][1])]
    doc_df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, item_id string").repartition(5)
    item_df = spark.createDataFrame(items, "item_id bigint, text string")
    found = L.leaked_items(doc_df, item_df)
    rows = found.collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    got = {(r.doc_id, r.item_id) for r in rows if r.longest_run >= 13}
    assert got == brute(docs, items) and len(got) > 30


def test_edited_copies_are_scored(spark):
    passage = [f"p{i}" for i in range(40)]
    edited = passage[:16] + ["new"] + passage[17:30] + passage[31:]
    docs = spark.createDataFrame([(1, " ".join(["lead"] * 30 + edited))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(passage))], "item_id bigint, text string")
    row = L.leaked_items(docs, items).first()
    assert row.longest_run == 16 and row.equal_words == 38 and row.score == 38 * 2 - 2


def test_copies_edited_every_few_words_are_found(spark):
    passage = [f"p{i}" for i in range(60)]
    edited = [w if i % 8 else f"e{i}" for i, w in enumerate(passage)]
    apart = passage[:12] + ["z"] * 200 + passage[30:42]
    texts = [(1, " ".join(["lead"] * 30 + edited)), (2, " ".join(apart)), (3, "nothing of it here at all, sorry")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(passage))], "item_id bigint, text string")
    rows = {r.doc_id: r for r in L.leaked_items(docs, items, min_score=20).collect()}
    assert set(rows) == {1, 2} and rows[1].longest_run == 7 and rows[1].equal_words == 52
    assert rows[2].item_share == 24 / 60  # both stretches


def test_the_filter_holds_every_seed(spark):
    seeds = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    bits = filters.bit_map(spark.createDataFrame([(int(x),) for x in seeds], "seed bigint"))
    assert filters.passes(seeds, bits).all() and np.unpackbits(bits).sum() <= 500
    assert filters.passes(np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 1000), bits).sum() < 10


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "x")], "item_id bigint, text string")
    assert L.leaked_items(docs, items).count() == 0
    assert L.leaked_items(docs.limit(0), items).count() == 0
    assert L.leaked_items(docs, items.limit(0)).count() == 0


def test_alignment_equals_the_textbook_table():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(0, 14)), rng.integers(0, 6, rng.integers(0, 14))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert L.smith_waterman(a.astype(np.uint64), b.astype(np.uint64))[0] == h.max()
