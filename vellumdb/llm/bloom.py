"""Blocked Bloom filters as DataFrames.

A filter is a table (block, mask): a key's hash picks one 64-bit block and a second hash
sets ``BITS`` bits in it, so a probe is one look-up and one comparison.  Building is an
aggregation by block with map-side combining, probing a semi join whose build side is
the filter; both stay in generated JVM code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 6
BITS_PER_KEY = 12
#: Blocks of a filter that may be broadcast (16 bytes each).
BROADCAST_BLOCKS = 1_000_000


def mask_of(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(7919))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)])


@dataclass(frozen=True)
class BlockedBloom:
    blocks: DataFrame
    n_blocks: int

    @property
    def small(self) -> bool:
        return self.n_blocks <= BROADCAST_BLOCKS

    def possible(self, rows: DataFrame, key: Column) -> DataFrame:
        """Rows whose key may be in the filter: all whose key is, and few others.  Null
        keys do not pass."""
        return self.probed(rows.where(key.isNotNull()), key, "left_semi")

    def impossible(self, rows: DataFrame, key: Column) -> DataFrame:
        """The other rows."""
        return self.probed(rows, key, "left_anti")

    def probed(self, rows: DataFrame, key: Column, how: str) -> DataFrame:
        f = self.blocks.select(F.col("block").alias("_b"), F.col("mask").alias("_m"))
        on = (F.pmod(F.xxhash64(key), F.lit(self.n_blocks)) == F.col("_b")) & (F.col("_m").bitwiseAND(mask_of(key)) == mask_of(key))
        return rows.join(F.broadcast(f) if self.small else f, on, how)


def build(keys: DataFrame, key: Column, n_keys: int) -> BlockedBloom:
    n = max(1, math.ceil(n_keys * BITS_PER_KEY / 64))
    rows = keys.where(key.isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(n)).alias("block"), mask_of(key).alias("mask"))
    return BlockedBloom(rows.groupBy("block").agg(F.expr("bit_or(mask)").alias("mask")), n)
