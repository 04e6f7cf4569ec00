"""Bloom filters as tables of a bounded number of rows.

A filter is a table of 64-bit blocks. A key's 64-bit hash picks one block and up
to four bits in it, so building is a grouped ``bit_or`` that combines before it
shuffles, and asking is an equality join with the blocks. There are at most
``spark.stowline.bloomBlocks`` blocks (8 bytes each), whatever the number of keys:
beyond 4 keys a block the filter lets more strangers through, and what
it lets through must be made exact afterwards. It never loses a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline import settings

KEYS_A_BLOCK = 4


def blocks_for(spark: SparkSession, keys: int) -> int:
    """A power of two, enough for ``keys`` keys but never more than the setting allows."""
    wanted = max(1, -(-keys // KEYS_A_BLOCK))
    return min(1 << (wanted - 1).bit_length(), settings.bloom_blocks(spark))


def block_of(key_hash: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(key_hash, 32).bitwiseAND(F.lit(blocks - 1)).cast("int")


def bits_of(key_hash: Column) -> Column:
    """The key's bits within its block: one for each six bits of the hash's lower half."""
    places = [F.shiftright(key_hash, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(4)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]
    return reduce(Column.bitwiseOR, bits)


def bloom_blocks(keys: DataFrame, key_hash: Column, blocks: int) -> DataFrame:
    """(block, bits) of the filter that holds every row of ``keys``; empty blocks have no row."""
    return keys.select(block_of(key_hash, blocks).alias("block"), bits_of(key_hash).alias("bits")).groupBy(
        "block").agg(F.bit_or("bits").alias("bits"))


def keep_possible(rows: DataFrame, key_hash: Column, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter, by a broadcast of at most ``blocks`` rows and no shuffle."""
    side = filter_blocks.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    wanted = bits_of(key_hash)
    return rows.join(F.broadcast(side), (block_of(key_hash, blocks) == F.col("_block"))
                     & (F.col("_bits").bitwiseAND(wanted) == wanted), "left_semi")
