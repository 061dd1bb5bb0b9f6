"""Bit filters of a fixed size that are broadcast in place of key sets of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of a filter, a power of two: 8 MB at most whatever the number of keys.
BITS = 1 << 26


def key_filter(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bits of the column ``key`` (long); a filter may let strangers pass and never keeps a key out.

    Bits are set on the executors; the driver receives ``bits`` of them at most, whatever the table's size.
    """
    p = F.pmod(F.col("key"), F.lit(bits)) + 1  # positions count from 1
    rows = keys.select(p.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
        at = (r["b"] - 1) * len(part)
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def passes(has: np.ndarray, keys: np.ndarray) -> np.ndarray:
    p = keys & np.int64(len(has) * 8 - 1)
    return (has[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
