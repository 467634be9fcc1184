"""Bitmaps of fixed size that tell which hashes may be in a set: never a false no.

The more members a set has, the more often another hash is taken for one; callers settle such rows
exactly afterwards, so a bitmap saves traffic and never decides a result.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, whatever the set: 16 MB.
BITS = 1 << 27


def bitmap(df: DataFrame, column: str) -> Broadcast:
    """Bitmap of the 64-bit hashes in a column; the driver gets at most BITS / 64 pairs of numbers."""
    slot = F.col(column).bitwiseAND(F.lit(BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = df.filter(F.col(column).isNotNull()).groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(BITS >> 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return df.sparkSession.sparkContext.broadcast(out)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes (signed) may be members."""
    slot = hashes & np.int64(BITS - 1)
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1
