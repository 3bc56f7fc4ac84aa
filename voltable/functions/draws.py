"""Reproducible random draws as integer-hash Columns.

`rand(seed)` depends on how rows are laid out over partitions, so a lost executor could change a
result. A draw here is a pure function of (seed, key, simulation, period).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import col_of

MASK32 = 0xFFFFFFFF
MIX_FACTOR = 0x45D9F3B  # fixed value: multiplier of the well-known 32-bit xor-shift-multiply hash


def _lit(x: int) -> Column:
    return F.lit(x).cast("bigint")


def mix32(x: Column) -> Column:
    """32-bit xor-shift-multiply mixing; every product stays below 2^63."""
    h = x.bitwiseAND(_lit(MASK32))
    for _ in range(2):
        h = (h.bitwiseXOR(F.shiftrightunsigned(h, 16)) * _lit(MIX_FACTOR)).bitwiseAND(_lit(MASK32))
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def key_code(*keys) -> Column:
    """A 32-bit integer for a textual key, computed once per key."""
    text = F.concat_ws("|", *[col_of(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def stream_code(seed: int, key: Column, sim: Column) -> Column:
    """State of one (key, simulation) stream; draws of all periods derive from it."""
    return mix32(mix32(key.bitwiseXOR(_lit(seed & MASK32))) + col_of(sim).cast("bigint") * _lit(2654435))


def draw32(stream: Column, period, lane: int = 0) -> Column:
    return mix32(stream + col_of(period).cast("bigint") * _lit(40503) + _lit(lane * 7919))
