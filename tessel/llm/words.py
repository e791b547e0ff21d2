"""Words of whole columns of texts as integer arrays.

A word is a maximal run of letters or digits, in lower case. Words are cut and hashed for a whole Arrow
batch at once, so no Python object is made per word: characters become code points, their scrambled
values a prefix sum of a polynomial in an odd base, and each word's hash is the difference of two sums,
shifted to the word's start. The hash depends on the word's characters alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, hence invertible modulo 2**64
_CHUNK = 1 << 16

_alnum: np.ndarray | None = None
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MIX
        return x ^ (x >> np.uint64(29))


def _is_alnum() -> np.ndarray:
    global _alnum
    if _alnum is None:
        _alnum = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _alnum


def _power_table() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for positions inside a chunk."""
    global _powers
    if _powers is None:
        up, down = np.empty(_CHUNK + 1, np.uint64), np.empty(_CHUNK + 1, np.uint64)
        inverse, a, b = pow(_BASE, -1, 1 << 64), 1, 1
        for i in range(_CHUNK + 1):
            up[i], down[i] = a, b
            a, b = a * _BASE % (1 << 64), b * inverse % (1 << 64)
        _powers = up, down
    return _powers


@dataclass
class WordBatch:
    """Words of a batch of texts, in order; ``doc`` is the row a word belongs to."""

    hashes: np.ndarray  # uint64
    doc: np.ndarray  # int64
    start: np.ndarray  # code point positions in ``points``
    end: np.ndarray
    points: np.ndarray  # uint32
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def text(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")


def batch_words(texts: pa.Array, nfkc: bool = False) -> WordBatch:
    """All words of ``texts``; nulls have none. With ``nfkc`` texts are normalised first."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if nfkc:
        texts = pc.utf8_normalize(texts, form="NFKC")
    texts = pc.utf8_lower(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = raw.to_pybytes()[offsets[0] : offsets[-1]] if raw is not None and n else b""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    lead = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead, out=before[1:])
    at = before[offsets - offsets[0]] if n else np.zeros(1, dtype=np.int64)

    inside = _is_alnum()[points]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    if len(points):
        first = at[:-1][at[:-1] < at[1:]]
        opens[first] = inside[first]
        last = at[1:][at[:-1] < at[1:]] - 1
        closes[last] = inside[last]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    doc = np.searchsorted(at, start, side="right") - 1

    hashes = np.empty(len(start), dtype=np.uint64)
    up, down = _power_table()
    value = mix(points.astype(np.uint64) + np.uint64(0x1234567))
    with np.errstate(over="ignore"):
        at_word, pos = 0, 0
        while at_word < len(start):  # chunks keep the powers' table small
            pos = start[at_word]
            upto = np.searchsorted(end, pos + _CHUNK, side="right")
            if upto == at_word:  # one word longer than a chunk
                upto = at_word + 1
                s, e = start[at_word], end[at_word]
                total = np.uint64(0)
                for k in range(s, e, _CHUNK):
                    part = value[k : min(e, k + _CHUNK)]
                    total = mix(np.array([total + (part * up[: len(part)]).sum(dtype=np.uint64)]))[0]
                hashes[at_word] = total
            else:
                stop = end[upto - 1]
                sums = np.zeros(stop - pos + 1, dtype=np.uint64)
                np.cumsum(value[pos:stop] * up[: stop - pos], out=sums[1:])
                a, b = start[at_word:upto] - pos, end[at_word:upto] - pos
                hashes[at_word:upto] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
            at_word = upto
    return WordBatch(mix(hashes), doc, start, end, points, n)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, from the words' hashes; empty for fewer words."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        out = h[:m].copy()
        for k in range(1, n):
            out = mix(out) + h[k : k + m]
    return mix(out)


def doc_grams(batch: WordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n``-word runs that stay inside one text, and the index of their first word."""
    grams = gram_hashes(batch.hashes, n)
    if not len(grams):
        return grams, np.empty(0, dtype=np.int64)
    at = np.flatnonzero(batch.doc[: len(grams)] == batch.doc[n - 1 :])
    return grams[at], at
