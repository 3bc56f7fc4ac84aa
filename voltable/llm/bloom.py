"""Blocked Bloom filters as tables: a row per 64-bit block, a few bits per key, built and asked in DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of a filter at most: 2^20 rows of 12 bytes, whatever the number of keys. A full filter lets more keys pass.
BLOCKS = 1 << 20
#: Bits set in a block by one key.
BITS = 4


def pattern(key: Column) -> tuple[Column, Column]:
    """Block number and bits of a key."""
    place = F.xxhash64(key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(place, 20 + 6 * k).bitwiseAND(63).cast("int")) for k in range(BITS)]
    return place.bitwiseAND(BLOCKS - 1).cast("int"), reduce(Column.bitwiseOR, bits)


def merged(patterns: DataFrame) -> DataFrame:
    """`_block`, `_filter` of rows with `_block` and `_bits`; at most BLOCKS rows."""
    return patterns.groupBy("_block").agg(F.bit_or("_bits").alias("_filter"))


def filter_of(keys: DataFrame, key: str) -> DataFrame:
    block, bits = pattern(F.col(key))
    return merged(keys.select(block.alias("_block"), bits.alias("_bits")))


def repeated(keys: DataFrame, key: str) -> DataFrame:
    """A filter of the keys that more than one row has (a few others may pass)."""
    block, bits = pattern(F.col(key))
    seen = keys.select(block.alias("_block"), bits.alias("_bits")).groupBy("_block", "_bits").agg(F.count("*").alias("_n"))
    return merged(seen.where("_n > 1"))


def ask(rows: DataFrame, key: str, filter_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in the filter for certain not, rows whose key may be); null keys are not in it."""
    block, bits = pattern(F.col(key))
    asked = rows.withColumns({"_block": block, "_bits": bits}).join(F.broadcast(filter_rows), "_block", "left")
    hit = F.coalesce((F.col("_filter").bitwiseAND(F.col("_bits")) == F.col("_bits")) & F.col(key).isNotNull(), F.lit(False))
    return asked.where(~hit).select(*rows.columns), asked.where(hit).select(*rows.columns)
