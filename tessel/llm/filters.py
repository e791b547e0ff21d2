"""A filter of fixed size over hashes, so that a scan can skip what no join would keep."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, 8 million: one megabyte, whatever it is made of. More hashes than that make it pass more, never less.
FILTER_BITS = 1 << 23


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A bit for the low bits of each value in the only column of ``hashes``; at most ``FILTER_BITS`` bits come to the driver."""
    place = F.col(hashes.columns[0]).bitwiseAND(FILTER_BITS - 1)
    rows = (
        hashes.select(F.floor(place / 32768).alias("part"), (place % 32768).alias("bit"))
        .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    )
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for part, bits in rows:
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``hashes`` may be among those of the filter."""
    place = (hashes.view(np.uint64) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
