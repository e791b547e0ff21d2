"""Splitting oversized items at natural boundaries (problem 4).

Method: *balanced targets*. The least number of pieces that can hold an item is computed, as many equal
targets are laid over it, and each is moved to the strongest boundary near it; if a piece breaks the
limit, one more piece is tried.

Boundaries by strength: a blank line before an unindented line, a blank line, a line whose indent falls
back to the outermost level, any line end, the end of a sentence or statement, a space, and last any
place that does not cut a CRLF or a base character from its combining marks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1500
OVERLAP = 200

_LINE = re.compile(r"\n")
_SOFT = re.compile(r"(?<=[.;!?。；！？]) |(?<=[,)\]}]) | ")
_TIE = re.compile(r"[^\S\n]*")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``text`` may be cut at a line start, and their strengths (3 to 6)."""
    starts = np.fromiter((m.end() for m in _LINE.finditer(text)), dtype=np.int64)
    starts = starts[starts < len(text)]
    power = np.full(len(starts), 3, dtype=np.int64)
    for i, s in enumerate(starts.tolist()):
        c = text[s]
        blank = s >= 2 and text[s - 2] == "\n" or text[max(0, s - 4) : s].endswith("\n\r\n")
        outer = not c.isspace() and c not in ")]}"
        power[i] = 6 if blank and outer else 5 if blank else 4 if outer else 3
    return starts, power


def _soft_cut(text: str, low: int, high: int, target: int) -> int:
    """A cut in (low, high] near ``target`` where no line ends: sentence, then space, then anywhere."""
    best, key = 0, None
    for m in _SOFT.finditer(text, low, high):
        strength = 2 if m.start() and text[m.start() - 1] in ".;!?。；！？" else 1
        k = (strength, -abs(m.end() - target))
        if key is None or k > key:
            best, key = m.end(), k
    if key is not None and low < best <= high:
        return best
    cut = min(max(target, low + 1), high)
    while cut > low + 1 and _joined(text, cut):
        cut -= 1
    return cut


def _joined(text: str, cut: int) -> bool:
    """Do the characters on both sides of ``cut`` belong together: a CRLF, a base with its marks, a joined emoji?"""
    return cut < len(text) and bool(unicodedata.combining(text[cut]) or text[cut - 1 : cut + 1] == "\r\n" or text[cut] == "\u200d" or text[cut - 1] == "\u200d")


def _place(n: int, count: int, limit: int, overlap: int, text: str, starts: np.ndarray, power: np.ndarray) -> list[tuple[int, int]] | None:
    """``count`` pieces with snapped ends, or None if some piece would break the limit."""
    pieces, start, reach = [], 0, 0
    for k in range(1, count + 1):
        if k == count:
            if n - start > limit:
                return None
            pieces.append((start, n))
            return pieces
        target = round(n * k / count)
        high = min(start + limit, n - 1)
        # the rest must still fit into the pieces that are left
        low = max(reach, start, n - (count - k) * (limit - overlap // 2) - 1)
        if low >= high:
            return None
        half = max(1, n // count // 2)
        near_low, near_high = max(low, target - half), min(high, target + half)
        a, b = np.searchsorted(starts, [near_low + 1, near_high + 1])
        if a < b:
            score = power[a:b] * 4.0 - np.abs(starts[a:b] - target) / half * 6.0
            end = int(starts[a + int(np.argmax(score))])
        else:
            end = _soft_cut(text, near_low if near_low < near_high else low, near_high if near_low < near_high else high, target)
        pieces.append((start, end))
        reach = end
        # the next piece repeats whole lines of at most ``overlap`` characters
        i = np.searchsorted(starts, max(end - overlap, start + 1))
        start = int(starts[i]) if i < len(starts) and starts[i] < end else end
    return pieces


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Half-open ranges of the pieces of ``text``: each within ``limit``, together covering it.

    More pieces than ``text`` needs at least come out where the least number could only be kept by cutting inside lines or
    by giving up the overlap: equal targets plus overlaps then exceed the limit. Neighbours have no overlap where the last
    line before the cut is longer than the overlap allows. Where no placing fits, pieces are equal but for the characters
    that belong together, which are cut only if they alone exceed a piece.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    starts, power = boundaries(text)
    least = -(-n // limit)
    for count in range(least, least * 2 + 2):
        got = _place(n, count, limit, overlap, text, starts, power)
        if got is not None:
            return got
    for count in range(least, least * 2 + 2):  # without an overlap more room is left
        got = _place(n, count, limit, 0, text, starts, power)
        if got is not None:
            return got
    size, pieces, at = -(-n // least), [], 0  # no boundary helps: equal pieces
    while n - at > limit:
        cut = at + size
        while cut > at + 1 and _joined(text, cut):
            cut -= 1
        cut = cut if cut > at + 1 else at + size
        pieces.append((at, cut))
        at = cut
    return [*pieces, (at, n)]


def split_items(
    items: DataFrame,
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    id_col: str = "id",
    text_col: str = "content",
    line_col: str = "line_number",
    type_col: str = "chunk_type",
) -> DataFrame:
    """Pieces ``(id, piece, pieces, chunk_type, line_number, start, content)`` of items over ``limit``.

    ``piece`` counts from 1, ``start`` is the piece's first character (from 0), ``line_number`` the item's
    own plus the line feeds before the piece, or null where the item's is null. Items within the limit,
    null and empty ones have no rows. Repeated rows are split each. The filter runs before Python, and
    the map is narrow. Extra columns are ignored.
    """
    big = items.where(F.length(text_col) > limit).select(id_col, text_col, line_col, type_col)
    kinds = {f.name: f.dataType.simpleString() for f in big.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, number, total, first, begin, body = [], [], [], [], [], []
                for i, (text, line) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    ranges = split(text, limit, overlap)
                    for k, (s, e) in enumerate(ranges, 1):
                        row.append(i)
                        number.append(k)
                        total.append(len(ranges))
                        begin.append(s)
                        first.append(None if line is None else line + text.count("\n", 0, s))
                        body.append(text[s:e])
                taken = part.take(pa.array(row, type=pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        taken.column(0), pa.array(number, pa.int32()), pa.array(total, pa.int32()), taken.column(3),
                        pa.array(first, pa.int32()), pa.array(begin, pa.int32()), pa.array(body, pa.string()),
                    ],
                    names=["id", "piece", "pieces", "chunk_type", "line_number", "start", "content"],
                )

    return big.mapInArrow(
        run,
        f"id {kinds[id_col]}, piece int, pieces int, chunk_type {kinds[type_col]}, line_number int, start int, content string",
    )
