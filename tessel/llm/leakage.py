"""Evaluation texts leaking into training text (problem 9).

Method: *rare n-gram seeds, then Smith-Waterman alignment*.

1. Every run of ``SEED`` words of a test item is a possible seed. A bit map of their hashes, of fixed size whatever
   the collection, is all that the corpus scan needs; it counts how many texts hold each seed.
2. Of each window of ``window`` words of an item the rarest seed that the corpus holds is kept. If all seeds of the
   window occur, a text may hold the window itself, and the seed is kept however frequent: rarity removes work and
   never a case. If some seed is missing, only an edited copy is possible; there the seed is kept if it is rare, that
   is if at most ``rare_share`` of the texts (in small collections ``RARE_TEXTS``) hold it, so stock phrases alone join
   nothing.
3. A second scan takes the texts that hold a kept seed. Seeds join texts and items as rows; the words of each joined
   pair are aligned by Smith-Waterman over their whole length, equal texts once. Score, equal words, share of the item
   in common runs and longest exact run come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.filters import bit_map, passes
from tessel.llm.words import batch_words, doc_grams
from tessel.session import ensure_checkpoint_dir

SEED = 6
WINDOW = 13
#: Share of the corpus up to which a seed is rare.
RARE_SHARE = 0.001
RARE_TEXTS = 50
MATCH, MISMATCH, GAP = 2, -1, -1


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word arrays: its score and its number of equal words.

    Row by row; gaps along the row are resolved with a running maximum, so each row is a few array
    operations. The number of equal words is carried beside the score (score first, then equal words).
    """
    if not len(a) or not len(b):
        return 0, 0
    big = 1 << 20  # score and equal words in one integer
    steps = np.arange(len(b) + 1, dtype=np.int64) * (GAP * big)
    prev = np.zeros(len(b) + 1, dtype=np.int64)
    best = 0
    for x in a:
        cur = np.zeros(len(b) + 1, dtype=np.int64)
        diag = prev[:-1] + np.where(b == x, MATCH * big + 1, MISMATCH * big)
        cur[1:] = np.maximum(np.maximum(diag, prev[1:] + GAP * big), 0)
        cur = np.maximum.accumulate(cur - steps) + steps
        top = int(cur.max())
        best = max(best, top)
        prev = cur
    return best // big, best % big


def common_runs(a: np.ndarray, b: np.ndarray, least: int = SEED) -> tuple[int, int]:
    """The longest run of equal consecutive words, and how many words of ``a`` lie in common runs of ``least`` words."""
    longest, covered = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=bool)
    prev = np.zeros(len(b) + 1, dtype=np.int64)
    for i, x in enumerate(a):
        cur = np.zeros(len(b) + 1, dtype=np.int64)
        cur[1:] = np.where(b == x, prev[:-1] + 1, 0)
        longest[i] = cur.max()
        prev = cur
    for i in np.flatnonzero(longest >= least):
        covered[i - longest[i] + 1 : i + 1] = True
    return int(longest.max(initial=0)), int(covered.sum())


def _key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _item_rows(items: DataFrame, n: int) -> DataFrame:
    """``(item_id, item_key, words, seeds)`` of each different item; ``seeds[i]`` starts at word i."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch_words(batch.column(1), nfkc=True)
            grams, at = doc_grams(words, n)
            ends, first = np.cumsum(words.counts()), np.cumsum(np.bincount(words.doc[at], minlength=words.n_docs))
            own = [words.hashes[e - c : e] for e, c in zip(ends, words.counts())]
            seeds = [grams[e - c : e] for e, c in zip(first, np.diff(first, prepend=0))]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([_key(w) for w in own], pa.binary()),
                    pa.array([w.view(np.int64) for w in own], longs), pa.array([x.view(np.int64) for x in seeds], longs),
                ],
                names=["item_id", "item_key", "words", "seeds"],
            )

    one = items.select("item_id", "text").distinct()
    rows = one.mapInArrow(run, f"item_id {kind}, item_key binary, words array<bigint>, seeds array<bigint>")
    return rows.where("size(seeds) > 0")


def _hits(batch: pa.RecordBatch, bits: np.ndarray, n: int):
    """Words of a batch of texts, and the seeds that pass the filter with their text's row."""
    words = batch_words(batch.column(batch.num_columns - 1), nfkc=True)
    grams, at = doc_grams(words, n)
    hit = passes(grams, bits)
    return words, grams[hit], words.doc[at[hit]]


def leaked_items(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, min_score: int | None = None, seed: int = SEED, rare_share: float = RARE_SHARE
) -> DataFrame:
    """Pairs ``(doc_id, item_id)`` with ``score``, ``equal_words``, ``item_share`` and ``longest_run``.

    Every pair that shares ``window`` consecutive words (after NFKC, case-folded, punctuation and layout ignored) is
    returned, and every pair that shares a rare kept seed and aligns with ``min_score`` (default: a run of ``window``
    equal words). No repeated rows; repeated document rows count once. Items and texts that are null, empty or shorter
    than ``seed`` words match nothing. ``item_share`` sums all common runs of ``seed`` words. Extra columns are ignored.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    least = MATCH * window if min_score is None else min_score
    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    known = _item_rows(items, seed).checkpoint()
    places = known.groupBy("item_key").agg(F.any_value("seeds").alias("seeds")).select("item_key", F.posexplode("seeds").alias("at", "seed"))
    bits = spark.sparkContext.broadcast(bit_map(places.select("seed")))

    def count_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, grams, row = _hits(batch, bits.value, seed)
            pair = np.unique(np.stack([grams.view(np.int64), row]), axis=1) if len(grams) else np.empty((2, 0), np.int64)
            seeds, n = np.unique(pair[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(n, pa.int64())], names=["seed", "n"])

    counts = narrow.select("text").mapInArrow(count_map, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    rare = F.lit(max(float(RARE_TEXTS), rare_share * narrow.count()))
    following = Window.partitionBy("item_key").orderBy("at").rowsBetween(0, window - seed)
    seen = places.join(counts, "seed", "left").withColumn("held", F.when(F.col("n").isNotNull(), F.struct("n", "seed")))
    windows = seen.select(
        "item_key", F.min("held").over(following).alias("best"),
        (F.count("held").over(following) == window - seed + 1).alias("whole"),
    )
    kept = windows.where("best IS NOT NULL").where(F.col("whole") | (F.col("best.n") <= rare))
    kept = kept.select("item_key", "best.seed").distinct().checkpoint()
    chosen = spark.sparkContext.broadcast(bit_map(kept.select("seed")))

    def take_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, grams, row = _hits(batch, chosen.value, seed)
            ends, counted = np.cumsum(words.counts()), words.counts()
            rows, first = np.unique(row, return_index=True)
            own = [words.hashes[ends[r] - counted[r] : ends[r]] for r in rows]
            longs = pa.list_(pa.int64())
            seeds = [np.unique(x).view(np.int64) for x in np.split(grams, first[1:])] if len(rows) else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)), pa.array([_key(w) for w in own], pa.binary()),
                    pa.array([w.view(np.int64) for w in own], longs), pa.array(seeds, longs),
                ],
                names=["doc_id", "text_key", "text", "seeds"],
            )

    taken = narrow.mapInArrow(take_map, f"doc_id {kind}, text_key binary, text array<bigint>, seeds array<bigint>").checkpoint()
    texts = taken.groupBy("text_key").agg(F.any_value("text").alias("text"), F.any_value("seeds").alias("seeds"))
    pairs = texts.select("text_key", F.explode("seeds").alias("seed")).join(kept, "seed").select("text_key", "item_key").distinct()
    item_words = known.groupBy("item_key").agg(F.any_value("words").alias("words"))
    joined = pairs.join(texts.select("text_key", "text"), "text_key").join(item_words, "item_key")

    def align_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            index = []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].values.to_numpy().view(np.uint64)
                own = batch.column(3)[i].values.to_numpy().view(np.uint64)
                score, equal = smith_waterman(own, text)
                run, covered = common_runs(own, text, seed)
                if score >= least or run >= window:
                    index.append(i)
                    for c, v in zip(out, (score, equal, max(covered, equal) / len(own), run)):
                        c.append(v)
            held = batch.take(pa.array(index, pa.int64()))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [held.column(0), held.column(1), *(pa.array(c, t) for c, t in zip(out, kinds))],
                names=["text_key", "item_key", "score", "equal_words", "item_share", "longest_run"],
            )

    aligned = joined.select("text_key", "item_key", "text", "words").mapInArrow(
        align_map, "text_key binary, item_key binary, score bigint, equal_words bigint, item_share double, longest_run bigint"
    )
    named = aligned.join(taken.select("doc_id", "text_key").distinct(), "text_key").join(known.select("item_id", "item_key"), "item_key")
    return named.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "equal_words", "item_share", "longest_run")))
