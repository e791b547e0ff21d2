"""The most similar vectors of every vector (problem 2).

Method: *permutation index*. Pivots are sampled; every vector is represented by its nearest pivots in order and
posted in the inverted file of each of them. Rows that share a posting are candidates; they are ranked by the
footrule distance of their pivot orders and the best ``rerank`` are reranked by the exact cosine, with all ties at
the border. Every group of rows (namespace, project) goes through the index; its layout follows from its size:

* up to ``block`` rows: pivots are rows of the group itself, half as many as rows (at most ``MAX_LOCAL_PIVOTS``), and
  its inverted files lie in one task;
* more: the inverted files are spread over the cluster. A group of n rows uses the first ``n / density`` pivots of one
  shared list (at most ``max_pivots``, the bound of the broadcast), so an inverted file holds about
  ``density * wide_prefix`` rows whatever n. Longer inverted files are cut in blocks, and each pair of blocks is a
  task of its own, so no task holds more than two blocks and no candidate is dropped. Rows that find fewer than
  ``k`` candidates are compared with all rows of their group, block by block.

Footrule with absent pivots at rank L is ``const - 2 * sum(L - max(rank_a, rank_b))`` over shared pivots, so ranking
by that sum is ranking by footrule; the sums are gathered from the inverted files. Equal vectors (a third of all rows
may be copies) never meet in one task: of a class of more than ``copies`` equal vectors only the six smallest ids are
posted, which decides the results of all its rows exactly. Equality is that of two 64-bit hashes of the vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.session import ensure_checkpoint_dir

GROUP = ["namespace", "project_id"]
K = 5
#: Nearest pivots a row of a group in one task is posted at, pivots of such a group, and candidates reranked.
PREFIX, MAX_LOCAL_PIVOTS, RERANK = 16, 512, 512
FEW_PIVOTS = 64


def live_rows(store: DataFrame, *payload: str) -> DataFrame:
    """The live row of each chunk: latest ``created_at``, then largest ``id``; nulls come last."""
    key = [*GROUP, "chunk_id"]
    latest = Window.partitionBy(*key).orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc_nulls_last())
    return (
        store.select(*key, "created_at", "id", *payload)
        .withColumn("__nth", F.row_number().over(latest))
        .where("__nth = 1")
        .drop("__nth", "created_at", "chunk_id")
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)


def pivot_orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Indices of the ``prefix`` nearest pivots of each row, nearest first."""
    sims = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    near = np.argpartition(-sims, prefix - 1, axis=1)[:, :prefix]
    order = np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1).astype(np.int32)


def inverted_files(orders: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pivot the rows that stand at it and their weights ``L - rank``."""
    n, depth = orders.shape
    present, flat = np.unique(orders, return_inverse=True)
    flat = flat.reshape(n, depth)
    by_pivot = np.argsort(flat, axis=None, kind="stable")
    ends = np.searchsorted(flat.ravel()[by_pivot], np.arange(len(present) + 1))
    rows, ranks = by_pivot // depth, (depth - by_pivot % depth).astype(np.int16)
    return [(rows[s:e], ranks[s:e]) for s, e in zip(ends[:-1], ends[1:])]


def footrule_overlap(files: list, lo: int, hi: int, n: int) -> np.ndarray:
    """``sum(L - max(rank_q, rank_x))`` over shared pivots of the rows from ``lo`` to before ``hi`` with all rows.

    Each inverted file adds the smaller of the two weights to the pairs that stand in it; larger is nearer.
    """
    out = np.zeros((hi - lo, n), dtype=np.int16)
    for rows, weight in files:
        a, b = np.searchsorted(rows, [lo, hi])
        if a < b:
            out[np.ix_(rows[a:b] - lo, rows)] += np.minimum.outer(weight[a:b], weight)
    return out


_SELF, _OUT = -2_000_000, -1_500_000


def nearest(ids: np.ndarray, x: np.ndarray, k: int, orders: np.ndarray, rerank: int = RERANK, side: np.ndarray | None = None, whole: bool = True):
    """The ``k`` nearest candidates of each row by rounded cosine, then smaller id: (query, row, similarity).

    Candidates share a pivot of ``orders``; of more than ``rerank`` the nearest by footrule count, ties at the border
    included. ``whole``: the rows are a whole group, so a row with fewer than ``k`` candidates takes all others.
    ``side``: only rows of different sides are compared.
    """
    n = len(ids)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    by_id = np.argsort(ids, kind="stable")
    ids, x, orders = ids[by_id], x[by_id], orders[by_id]
    side = None if side is None else side[by_id]
    norms = np.linalg.norm(x, axis=1)
    files = inverted_files(orders)
    take, place = min(k, n - 1), np.arange(n, dtype=np.int64)
    step = max(16, min(512, (1 << 22) // n))
    q_out, r_out, s_out = [], [], []
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        overlap = footrule_overlap(files, lo, hi, n)
        if side is not None:
            overlap[side[lo:hi, None] == side[None, :]] = 0
        overlap[np.arange(hi - lo), np.arange(lo, hi)] = 0
        if n > rerank:
            border = np.maximum(np.partition(overlap, n - rerank, axis=1)[:, n - rerank], 1)
        else:
            border = np.ones(hi - lo, dtype=np.int16)
        if whole:
            border[(overlap >= border[:, None]).sum(axis=1) < take] = 0
        sims = (x[lo:hi] @ x.T) / (norms[lo:hi, None] * norms[None, :])
        micro = np.rint(sims * 1e6).astype(np.int64)
        micro[overlap < border[:, None]] = _OUT
        micro[np.arange(hi - lo), np.arange(lo, hi)] = _SELF
        rank = (2_000_000 - micro) * n + place  # similarity first, then the smaller id
        best = np.argpartition(rank, take - 1, axis=1)[:, :take]
        got = np.take_along_axis(micro, best, axis=1)
        held = got > _OUT
        q_out.append(np.repeat(ids[lo:hi], take)[held.ravel()])
        r_out.append(ids[best][held])
        s_out.append(got[held] / 1e6)
    return np.concatenate(q_out), np.concatenate(r_out), np.concatenate(s_out)


def _scrambled(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def index_group(ids: np.ndarray, x: np.ndarray, k: int, prefix: int = PREFIX, rerank: int = RERANK):
    """Results of one group by its own pivots: every second row by a hash of the id, within fixed bounds.

    With few pivots a row is posted at more than half of them, so any two rows share one.
    """
    n = len(ids)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    m = min(n, MAX_LOCAL_PIVOTS, max(prefix, n // 2))
    pivots = np.unique(x[np.argsort(_scrambled(ids), kind="stable")[:m]], axis=0)
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    m = len(pivots)
    return nearest(ids, x, k, pivot_orders(x, pivots, min(m, max(prefix, m // 2 + 1 if m <= FEW_PIVOTS else 0))), rerank)


def _clean(group: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and places of the usable rows, each id once."""
    x = _matrix(group.column("embedding"), dim)
    keep = np.flatnonzero(_usable(x))
    ids, first = np.unique(group.column("id").to_numpy()[keep], return_index=True)
    return ids, x[keep][first], keep[first]


RESULT = "id bigint, neighbour bigint, similarity double"


def similar_rows(
    store: DataFrame,
    k: int = K,
    dim: int = 64,
    block: int = 4096,
    prefix: int = PREFIX,
    rerank: int = RERANK,
    wide_prefix: int = 12,
    wide_rerank: int = 2048,
    density: int = 128,
    max_pivots: int = 16_384,
    copies: int = 64,
) -> DataFrame:
    """``(id, neighbour, similarity)``: up to ``k`` rows per live row with a usable vector.

    Rows whose vector is null, of another length, all zero or not finite take no part. Ids are taken as
    unique; repeated rows of one id count once. Groups with fewer than ``k`` others give all of them.
    Null namespaces or projects form groups of their own. Extra columns are ignored; empty tables give
    empty tables.
    """
    right = F.col("embedding").isNotNull() & (F.size("embedding") == dim)
    # Sizes of groups and of classes of equal vectors, from pruned scans; upper bounds of the live ones.
    large = store.where(right).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    hot = (
        store.where(right).groupBy(*GROUP, *_identity()).count()
        .where(F.col("count") > copies).select(*GROUP, "h1", "h2", F.lit(True).alias("hot"))
    )
    rows = live_rows(store, "embedding").where(right)
    extras = None
    if not hot.isEmpty():
        rows, extras = _without_copies(rows, hot, k)
    spread = None
    if not large.isEmpty():
        marked = _null_safe_join(rows, large, GROUP)
        rows, spread = marked.where("size IS NULL").drop("size"), marked.where("size IS NOT NULL")

    def search(group: pa.Table) -> pa.Table:
        ids, x, _ = _clean(group, dim)
        a, b, s = index_group(ids, x, k, prefix, rerank)
        return pa.table({"id": a, "neighbour": b, "similarity": s})

    found = rows.groupBy(*GROUP).applyInArrow(search, RESULT)
    if spread is not None:
        found = found.unionByName(_spread_search(spread, k, dim, block, wide_rerank, wide_prefix, density, max_pivots))
    if extras is not None:
        found = found.unionByName(
            extras.join(found.withColumnRenamed("id", "model"), "model").select("id", "neighbour", "similarity")
        )
    return found


def _identity() -> list:
    return [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(17), "embedding").alias("h2")]


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the answers that several tasks gave to a row; one shuffle of at most k answers a task."""
    answer = F.struct((-F.col("similarity")).alias("s"), "neighbour")
    top = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(answer)), 1, k).alias("top"))
    return top.select("id", F.explode("top").alias("t")).select("id", "t.neighbour", (-F.col("t.s")).alias("similarity"))


def _spread_search(rows: DataFrame, k: int, dim: int, block: int, rerank: int, prefix: int, density: int, max_pivots: int) -> DataFrame:
    """Results of groups that no single task should hold; ``rows`` carry the ``size`` of their group."""
    ensure_checkpoint_dir(rows.sparkSession)
    total = rows.count()
    pivots = _fit_pivots(rows, min(max_pivots, max(4 * prefix, total // density)), dim)
    if not len(pivots):
        return rows.sparkSession.createDataFrame([], RESULT)
    ordered = _ordered(rows, pivots, dim, min(prefix, len(pivots)), density).checkpoint()
    posted = ordered.select(*GROUP, "id", "embedding", "pivots", F.explode("pivots").alias("posting"))
    post_key = [*GROUP, "posting"]
    cut = posted.groupBy(*post_key).count().where(F.col("count") > block)
    cut = cut.select(*post_key, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    split = _null_safe_join(posted, cut, post_key).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    tasks = split.select(*post_key, "id", "embedding", "pivots", "own", other)
    tasks = tasks.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def search(group: pa.Table) -> pa.Table:
        ids, x, at = _clean(group, dim)
        own = group.column("own").to_numpy()[at]
        orders = group.column("pivots").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)[at]
        a, b, s = nearest(ids, x, k, orders, rerank, own if len(np.unique(own)) > 1 else None, whole=False)
        return pa.table({"id": a, "neighbour": b, "similarity": s})

    found = _best(tasks.groupBy(*post_key, "i", "j").applyInArrow(search, RESULT), k).checkpoint()
    enough = found.groupBy("id").count().where(F.col("count") >= k).select("id")
    lone = ordered.join(enough, "id", "left_anti")
    if lone.isEmpty():
        return found
    scanned = _scan(lone, ordered, k, dim, block)
    return found.join(lone.select("id").distinct(), "id", "left_anti").unionByName(_best(scanned, k))


def _scan(queries: DataFrame, rows: DataFrame, k: int, dim: int, block: int) -> DataFrame:
    """Answers of a few query rows from all rows of their group, in blocks."""
    parts = rows.groupBy(*GROUP).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    asked = _null_safe_join(queries.select(*GROUP, "id", "embedding"), parts, GROUP)
    asked = asked.select(*GROUP, "id", "embedding", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = _null_safe_join(rows.select(*GROUP, "id", "embedding"), parts, GROUP)
    held = held.select(*GROUP, "id", "embedding", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        qid, q, _ = _clean(group.filter(pa.array(asks)), dim)
        rid, r, _ = _clean(group.filter(pa.array(~asks)), dim)
        out: list[list] = [[], [], []]
        unit = r / np.linalg.norm(r, axis=1, keepdims=True)
        for i, v in zip(qid, q):
            micro = np.rint(unit @ v / np.linalg.norm(v) * 1e6)
            order = np.lexsort((rid, -micro))[: k + 1]
            for j in order[rid[order] != i][:k]:
                for c, value in zip(out, (i, rid[j], micro[j] / 1e6)):
                    c.append(value)
        return pa.table({"id": pa.array(out[0], pa.int64()), "neighbour": pa.array(out[1], pa.int64()), "similarity": pa.array(out[2], pa.float64())})

    return asked.unionByName(held).groupBy(*GROUP, "part").applyInArrow(compare, RESULT)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*(F.col(c).alias(f"__{c}") for c in keys), *(c for c in right.columns if c not in keys))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return left.join(renamed, on, "left").drop(*(f"__{c}" for c in keys))


def _without_copies(rows: DataFrame, hot: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows to post, and ``(id, model)``: rows whose answer is that of ``model``.

    In a class of equal vectors the row after the k smallest ids has those among its candidates with
    similarity 1, and so has every later row; nothing else differs, hence their answers are the same.
    """
    same = [*GROUP, "h1", "h2"]
    marked = _null_safe_join(rows.select("*", *_identity()), hot, same)
    cold = marked.where(F.col("hot").isNull()).select(*GROUP, "id", "embedding")
    warm = marked.where(F.col("hot"))
    order = Window.partitionBy(*same).orderBy("id")
    # a filter on row_number is a group limit: at most k + 1 rows of a class leave each task
    firsts = warm.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    models = firsts.where(F.col("nth") == k + 1).select(*same, F.col("id").alias("model"))
    extras = _null_safe_join(warm.select(*same, "id"), models, same)
    extras = extras.where(F.col("id") > F.col("model")).select("id", "model")
    return cold.unionByName(firsts.select(*GROUP, "id", "embedding")), extras


def _fit_pivots(rows: DataFrame, n_pivots: int, dim: int) -> np.ndarray:
    """Unit vectors of at most ``n_pivots`` rows, the first by a hash of the id: the documented bound of the fit."""
    order = F.xxhash64("id", F.lit(17))
    sample = rows.select("embedding", order.alias("h")).orderBy("h").limit(n_pivots).toArrow()
    x = _matrix(sample.column("embedding"), dim) if sample.num_rows else np.zeros((0, dim))
    x = x[_usable(x)]
    _, first = np.unique(x, axis=0, return_index=True)
    x = x[np.sort(first)]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _ordered(rows: DataFrame, pivots: np.ndarray, dim: int, prefix: int, density: int) -> DataFrame:
    """``rows`` with the ``pivots`` each stands at, nearest first; larger groups use more of the shared list."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("embedding"), dim)
                keep = np.flatnonzero(_usable(x))
                part, x = part.take(pa.array(keep)), x[keep]
                used = np.clip(part.column("size").to_numpy() // density, min(4 * prefix, len(pivots)), len(pivots))
                orders = np.zeros((len(x), prefix), dtype=np.int32)
                for m in np.unique(used):
                    own = used == m
                    orders[own] = pivot_orders(x[own], pivots[:m], prefix)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(orders.ravel()), prefix).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*GROUP, "id", "embedding")), lists], names=[*GROUP, "id", "embedding", "pivots"])

    return rows.select(*GROUP, "id", "embedding", "size").mapInArrow(
        order,
        f"namespace {kinds['namespace']}, project_id {kinds['project_id']}, id {kinds['id']}, "
        f"embedding {kinds['embedding']}, pivots array<int>",
    )


def similar_pairs(store: DataFrame, k: int = K, **kw) -> DataFrame:
    """Unordered pairs where either row is among the ``k`` most similar of the other."""
    found = similar_rows(store, k, **kw)
    return found.select(
        F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")
    ).distinct()
