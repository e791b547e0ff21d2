"""Problem 2: the permutation index against brute force."""

from datetime import datetime, timedelta

import numpy as np

from tessel.llm import neighbours as N

SCHEMA = "id bigint, namespace string, project_id string, chunk_id string, embedding array<float>, created_at timestamp, depth string, vhash int"


def brute(rows, k=5):
    """Directed answers among live usable rows, by the statement of the problem."""
    live = {}
    for r in rows:
        key = r[1:4]
        if key not in live or (r[5], r[0]) > (live[key][5], live[key][0]):
            live[key] = r
    groups = {}
    for r in live.values():
        e = r[4]
        if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e) and any(e):
            groups.setdefault(r[1:3], []).append((r[0], np.array(np.float32(e), dtype=float)))
    out = set()
    for members in groups.values():
        members.sort(key=lambda m: m[0])
        for i, x in members:
            sims = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), j) for j, y in members if j != i)
            out |= {(i, j) for _, j in sims[:k]}
    return out


def make(n, seed=1, groups=3):
    rng = np.random.default_rng(seed)
    t = datetime(2025, 1, 1)
    rows = []
    for i in range(n):
        v = rng.normal(size=64).astype(np.float32)
        if i % 9 == 0:
            v = np.ones(64, np.float32) * (1 + i % 2)  # equal directions: ties
        rows.append([i, "ns" if i % 7 else None, f"p{i % groups}", f"c{i}", [float(x) for x in v], t + timedelta(seconds=i), "x", 1])
    rows[3][4], rows[4][4], rows[5][4], rows[6][4] = None, [0.0] * 64, [1.0] * 63, [float("nan")] * 64
    rows.append([n, *rows[10][1:4], rows[11][4], t, "x", 1])  # an older delivery with a larger id
    rows.append([n + 1, *rows[12][1:4], rows[13][4], t + timedelta(days=9), "x", 1])  # a newer one
    return [tuple(r) for r in rows]


def directed(df):
    return {(r.id, r.neighbour) for r in df.collect()}


def test_small_groups_are_exact(spark):
    rows = make(200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert directed(N.similar_rows(df)) == brute(rows)
    pairs = {(r.id_a, r.id_b) for r in N.similar_pairs(df).collect()}
    assert pairs == {(min(p), max(p)) for p in brute(rows)}


def test_fewer_than_k_others_and_empty_tables(spark):
    rows = make(30, groups=10)
    df = spark.createDataFrame(rows, SCHEMA)
    assert directed(N.similar_rows(df)) == brute(rows)
    assert N.similar_rows(df.limit(0)).count() == 0


def recall_of(got, true):
    return len(got & true) / len(true)


def test_spread_groups_reach_the_recall(spark):
    rows = make(1500, groups=1)
    df = spark.createDataFrame(rows, SCHEMA)
    true = brute(rows)
    long_files = directed(N.similar_rows(df, block=200, density=30, wide_prefix=6))  # files of more than a block
    short_files = directed(N.similar_rows(df, block=700, density=12, wide_rerank=100))
    for got in (long_files, short_files):
        assert recall_of(got, true) > 0.9 and len(got) == len(true)


def test_rows_without_enough_candidates_are_compared_with_all(spark):
    rows = [r for r in make(60, groups=1) if r[1] == "ns"]
    df = spark.createDataFrame(rows, SCHEMA)
    got = directed(N.similar_rows(df, block=20, density=1, wide_prefix=1, max_pivots=60))
    assert len(got) == len(brute(rows))


def test_many_equal_vectors_keep_exact_answers(spark):
    rows = [list(r) for r in make(240, groups=2)]
    for r in rows:
        if r[0] % 3 == 0 and r[4] is not None and r[0] > 6:
            r[4] = rows[20][4]
    rows = [tuple(r) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert directed(N.similar_rows(df, copies=10)) == directed(N.similar_rows(df, copies=10**9)) == brute(rows)


def test_footrule_overlap_is_the_footrule():
    rng = np.random.default_rng(0)
    depth, pivots = 4, 9
    orders = np.array([rng.permutation(pivots)[:depth] for _ in range(20)], dtype=np.int32)

    def footrule(a, b):
        rank = lambda o, p: list(o).index(p) if p in o else depth
        return sum(abs(rank(a, p) - rank(b, p)) for p in range(pivots))

    files = N.inverted_files(orders)
    overlap = np.concatenate([N.footrule_overlap(files, 0, 7, 20), N.footrule_overlap(files, 7, 20, 20)])
    const = depth * (depth + 1)
    for i in range(20):
        for j in range(20):
            assert footrule(orders[i], orders[j]) == const - 2 * overlap[i, j]


def test_recall_of_one_task_and_above(spark):
    rng = np.random.default_rng(5)
    t = datetime(2025, 1, 1)
    x = rng.normal(size=(2049, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, "n", "p", f"c{i}", v.tolist(), t, "x", 1) for i, v in enumerate(x)], SCHEMA)
    everywhere = np.zeros((2049, 1), dtype=np.int32)
    a, b, _ = N.nearest(np.arange(2049), x.astype(float), 5, everywhere, rerank=4096)
    true = set(zip(a.tolist(), b.tolist()))
    assert len(true) == 5 * 2049
    for got in (directed(N.similar_rows(df)), directed(N.similar_rows(df, block=1024))):
        assert recall_of(got, true) > 0.9, recall_of(got, true)
