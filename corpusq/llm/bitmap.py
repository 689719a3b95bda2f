"""A filter of string keys that is small enough for every task, whatever the number of keys."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_of(key: str) -> int:
    """As Spark's xxhash64 of the string."""
    return xxhash.xxh64_intdigest(key, seed=42)


class Bitmap:
    """One bit a key, in blocks of 64 (a power of two of them); a false positive only costs a look, as an exact join follows."""

    def __init__(self, bits: np.ndarray):
        self.raw = bits.tobytes()
        self.last = len(self.raw) - 1

    def may_have(self, key: str) -> bool:
        h = xxhash.xxh64_intdigest(key, seed=42)
        return self.raw[(h >> 3) & self.last] >> (h & 7) & 1 == 1

    @staticmethod
    def of(hashes: DataFrame, blocks: int) -> Bitmap:
        """Of the one column of ``hashes`` (xxhash64 of the keys); at most ``blocks`` rows go to the driver."""
        h = F.col(hashes.columns[0])
        block = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(blocks - 1)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
        rows = hashes.groupBy(block.alias("block")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bits = np.zeros(blocks, "<u8")
        bits[rows.column(0).to_numpy()] = rows.column(1).to_numpy().astype(np.int64).view(np.uint64)
        return Bitmap(bits)
