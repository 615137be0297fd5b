"""A set of 64-bit hashes as a bit table of fixed size: it may let others pass and never loses a member."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BitTable:
    """Two bits a member. `bits` is a power of two; bits / 64 words reach the driver at most."""

    def __init__(self, hashes: DataFrame, bits: int):
        self.mask = bits - 1
        slot = hashes.select(F.explode(F.array(F.col("hash").bitwiseAND(self.mask), F.shiftrightunsigned("hash", 32).bitwiseAND(self.mask))).alias("slot"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))
        found = slot.groupBy(F.shiftrightunsigned("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
        self.words = np.zeros(bits // 64, dtype=np.uint64)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h), dtype=bool)
        for slot in (h & np.uint64(self.mask), h >> np.uint64(32) & np.uint64(self.mask)):
            hit &= (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return hit
