"""Repetition inside a single document (problem 10).

Method: *tokeniser fertility*. Each document is measured by a public vocabulary with byte fallback: characters per
token, share of byte-fallback tokens and entropy of its tokens, the last over single tokens and over blocks of
``run`` consecutive tokens. Words are encoded one by one, so a repeated word always repeats its tokens; that makes the
band of the block entropy provable. A run of 8 words that starts again repeats at least 8 tokens, hence at least one
block of 8 tokens. If ``r`` words lie in runs that started earlier, these words have at least ``r`` tokens, each in some
block that occurred before, and a block covers 8 tokens: at least ``r / 8`` of the ``B`` blocks are repetitions, at most
``B - r / 8`` are different, and the entropy of the blocks is at most the logarithm of that. Documents above the band
cannot reach ``share`` and are rejected; an exact count of the repeated words follows for the rest.

Bands for characters per token are kept per script; they are judgements and not bounds, so they mark unusual texts in
the report (``in_band``) and reject nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.words import WordBatch, batch_words, doc_grams, mix

RUN = 8
SHARE = 0.3
#: Per script: characters per token below/above which a text is unusual for prose and code of it.
FERTILITY_BANDS = {
    "latin": (1.2, 6.5),
    "cyrillic": (0.9, 5.5),
    "han": (0.3, 2.5),
    "other": (0.3, 7.0),
}

_workers: dict[str, "PieceTable"] = {}

MEASURES = (
    "n_words bigint, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, block_entropy double, "
    "script string, in_band boolean, passed boolean, repeated_share double"
)


class PieceTable:
    """Tokens of single words by a public sentence-piece vocabulary, remembered per worker.

    It is emptied at ``limit`` words, so a worker's memory doesn't follow the corpus.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.fromiter(
            (self.model.is_byte(i) for i in range(self.model.get_piece_size())), dtype=bool
        )
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.bytes = np.empty(0, np.int32), np.empty(0, np.int64)
        self.sizes, self.begins = np.empty(0, np.int64), np.empty(0, np.int64)

    def rows(self, hashes: np.ndarray, first: np.ndarray, batch: WordBatch) -> np.ndarray:
        """The table's row of each hash; words not met before are encoded."""
        if len(self.known) > self.limit:
            self._clear()
        known, keys = self.known, hashes.tolist()
        fresh = [(h, i) for h, i in zip(keys, first.tolist()) if h not in known]
        if fresh:
            got = self.model.encode([batch.text(i) for _, i in fresh], num_threads=1)
            got = [x or [0] for x in got]  # a word is at least one token
            for h, _ in fresh:
                known[h] = len(known)
            sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            flat = np.fromiter((t for x in got for t in x), dtype=np.int32, count=int(sizes.sum()))
            begins = np.cumsum(sizes) - sizes
            byte = np.add.reduceat(self.is_byte[flat].astype(np.int64), begins)
            self.begins = np.concatenate([self.begins, begins + len(self.flat)])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            self.bytes = np.concatenate([self.bytes, byte])
        return np.fromiter(map(known.__getitem__, keys), dtype=np.int64, count=len(keys))


def repeated_counts(batch: WordBatch, run: int = RUN) -> np.ndarray:
    """Per text: how many words lie in a run of ``run`` words that also starts earlier in the text."""
    grams, at = doc_grams(batch, run)
    with np.errstate(over="ignore"):
        grams = mix(grams + batch.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    again = at[order[1:][ordered[1:] == ordered[:-1]]]
    edge = np.zeros(len(batch.hashes) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.subtract.at(edge, again + run, 1)
    return np.bincount(batch.doc[np.cumsum(edge)[:-1] > 0], minlength=batch.n_docs)


def _scripts(batch: WordBatch) -> np.ndarray:
    """The script of each text, by its words' first characters."""
    c = batch.points[batch.start] if len(batch.start) else np.empty(0, dtype=np.uint32)
    kinds = [(c >= 0x3040) & (c <= 0x9FFF), (c >= 0x400) & (c <= 0x52F), (c < 0x250) & (c > 57)]
    shares = [np.bincount(batch.doc[k], minlength=batch.n_docs) for k in kinds]
    shares[0] = shares[0] * 4  # a run of ideographs is one word
    total = np.maximum(1, sum(shares))
    best = np.argmax(np.stack(shares), axis=0)
    names = np.array(["han", "cyrillic", "latin"], dtype=object)[best]
    return np.where(np.stack(shares).max(axis=0) * 2 > total, names, "other")


def _entropy(owner: np.ndarray, key: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    """Entropy in bits, per owner, of keys that are already distinct between owners."""
    if not len(key):
        return np.zeros(n)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.add.reduceat(weight[order], heads).astype(float) if weight is not None else np.diff(np.append(heads, len(key))).astype(float)
    own = owner[heads]
    total = np.bincount(own, weights=times, minlength=n)[own]
    return np.bincount(own, weights=-(times / total) * np.log2(times / total), minlength=n)


def _measure(texts: pa.Array, table: PieceTable, share: float, run: int, reject: bool) -> list[np.ndarray]:
    batch = batch_words(texts)
    n, words, docs = batch.n_docs, batch.counts(), batch.doc
    known, first, inverse = np.unique(batch.hashes, return_index=True, return_inverse=True)
    which = table.rows(known, first, batch)[inverse]  # the table's row of each word
    sizes = table.sizes[which]
    n_tokens = np.bincount(docs, weights=sizes, minlength=n)
    byte = np.bincount(docs, weights=table.bytes[which], minlength=n)
    ends = np.cumsum(sizes)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    token = table.flat[np.repeat(table.begins[which], sizes) + within].astype(np.int64)
    owner = np.repeat(docs, sizes)
    entropy = _entropy(owner, owner * 65536 + token, None, n)
    # blocks of tokens: as many tokens as a run has words
    stream = WordBatch(mix(token.astype(np.uint64) + np.uint64(1)), owner, np.empty(0), np.empty(0), batch.points, n)
    blocks, at = doc_grams(stream, run)
    mine = owner[at]
    with np.errstate(over="ignore"):
        blocks = mix(blocks + mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    block_entropy = _entropy(mine, blocks, None, n)
    n_blocks = np.bincount(mine, minlength=n)
    chars = np.bincount(docs, weights=batch.end - batch.start, minlength=n)
    some = n_tokens > 0
    safe = np.where(some, n_tokens, 1)
    fertility, byte_share, script = chars / safe, byte / safe, _scripts(batch)
    low = np.array([FERTILITY_BANDS[s][0] for s in script])
    high = np.array([FERTILITY_BANDS[s][1] for s in script])
    # The provable band; the small slack covers rounding of the logarithms.
    limit = np.log2(np.maximum(1.0, n_blocks - np.ceil(share * words - 1e-9) / run))
    passed = (words > run) & (block_entropy <= limit + 1e-9)
    keep = passed[docs] if reject else np.ones(len(docs), dtype=bool)
    inner = WordBatch(batch.hashes[keep], docs[keep], batch.start[keep], batch.end[keep], batch.points, n)
    repeated = repeated_counts(inner, run) / np.maximum(1, words)
    no = lambda x: pa.array(x, mask=~some)
    return [
        pa.array(words.astype(np.int64)), pa.array(n_tokens.astype(np.int64)), no(fertility), no(byte_share),
        no(entropy), no(block_entropy), pa.array(script, type=pa.string()), no((fertility >= low) & (fertility <= high)),
        pa.array(passed), pa.array(repeated, mask=(~passed & (words > run)) if reject else None),
    ]


def measure_repetition(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizers: str = "/opt/tokenizers",
    share: float = SHARE,
    run: int = RUN,
    reject: bool = False,
) -> DataFrame:
    """Fertility figures of each document, whether the band lets it pass, and its share of repeated words.

    One output row per input row, by a narrow map. The share is 0 for null, empty and blank texts and texts of at most
    ``run`` words. With ``reject`` it is counted only inside the band and null where the band proves it to be below
    ``share``. Extra columns are ignored. Empty tables give empty tables.
    """
    path = os.path.join(tokenizers, "piece_bpe_32k.model")
    narrow = docs.select(id_col, text_col)
    kind = narrow.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = PieceTable(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                measured = _measure(part.column(1), _workers[path], share, run, reject)
                yield pa.RecordBatch.from_arrays([part.column(0), *measured], names=[id_col, *names])

    return narrow.mapInArrow(run_map, f"`{id_col}` {kind}, {MEASURES}")


def repeated_documents(docs: DataFrame, share: float = SHARE, **kw) -> DataFrame:
    """Ids of documents that the band does not reject and that have at least ``share`` of their words repeated."""
    found = measure_repetition(docs, share=share, reject=True, **kw).where(F.col("repeated_share") >= share)
    return found.select("doc_id").distinct()
