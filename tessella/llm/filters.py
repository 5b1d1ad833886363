"""Bit filters of bounded size, broadcast to let most rows pass a join by."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 28
PROBES = (0, 12, 24, 36)


def bit_filter(hashes: DataFrame, n: int) -> bytes:
    """Four bits per row of ``hashes`` (a column ``gram`` of 64-bit hashes, ``n`` of them), in 64 bits a row, but
    2 ** MOST_BITS (32 MB) at most: what is broadcast has that bound.

    Made as bitmaps of 4 kB by Spark. Of others 0.002 % pass by chance, 0.4 % with 20 million
    rows in it; that costs time in the exact join behind it, no results.
    """
    bits = min(MOST_BITS, max(16, (64 * max(n, 1)).bit_length()))
    mask = (1 << bits) - 1
    each = F.array(*[F.shiftrightunsigned("gram", k).bitwiseAND(mask) for k in PROBES])
    at = hashes.select(F.explode(each).alias("b")).withColumn("b", F.col("b") + 1)  # these maps count from 1
    maps = at.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    out = bytearray((1 << bits) // 8)
    for r in maps.collect():  # at most 2 ** MOST_BITS / 32768 rows
        start = (r.k - 1) * 4096
        out[start : start + 4096] = r.m[: len(out) - start]
    return bytes(out)


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be in the filter (its bytes)."""
    mask = np.uint64(len(bits) * 8 - 1)
    out = np.ones(len(hashes), bool)
    for k in PROBES:
        at = (hashes >> np.uint64(k)) & mask
        out &= ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return out


def may_hold(value: int, bits: bytes) -> bool:
    """``passes`` for one hash."""
    mask = len(bits) * 8 - 1
    for k in PROBES:
        at = (value >> k) & mask
        if not bits[at >> 3] >> (at & 7) & 1:
            return False
    return True
