"""Approximate membership: a Bloom filter in blocks, built and asked with built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import xxh64

#: Bits of a block, as bitmap_construct_agg has them; blocks that are broadcast (4 KB each).
BLOCK_BITS, BROADCAST_BLOCKS = 32_768, 8192


@dataclass
class Sketch:
    """``bits`` has a row (block, bits) for each block that holds a key."""

    bits: DataFrame
    blocks: int
    hashes: int

    def may_contain(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose key may have been put in: all that have been, and few others."""
        bits = F.broadcast(self.bits) if self.blocks <= BROADCAST_BLOCKS else self.bits

        def is_set(at: Column) -> Column:
            byte = F.conv(F.hex(F.substring("__bits", F.call_function("div", at, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

        asked = df.withColumn("__block", _block(self.blocks)).join(bits.select(F.col("block").alias("__block"), F.col("bits").alias("__bits")), "__block")
        for k in range(self.hashes):
            asked = asked.where(is_set(_place(k)))
        return asked.drop("__block", "__bits")


def _block(blocks: int) -> Column:
    return F.pmod(xxh64(F.col("key"), 0), F.lit(blocks))


def _place(k: int) -> Column:
    return F.pmod(xxh64(F.col("key"), k + 1), F.lit(BLOCK_BITS))


def membership_sketch(keys: DataFrame, bits_per_key: int = 12, hashes: int = 6) -> Sketch:
    """A sketch of the table's ``key`` column; ``bits_per_key`` is of the rows counted, repeated keys set no new bits."""
    blocks = max(1, -(-keys.count() * bits_per_key // BLOCK_BITS))
    places = keys.select(_block(blocks).alias("block"), F.explode(F.array(*map(_place, range(hashes)))).alias("place"))
    return Sketch(places.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits")), blocks, hashes)
