"""Joins that broadcast a side only after its size was checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of at most so many bytes (counted over all its rows and values) is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def _width(field: T.StructField) -> Column:
    """Bytes of a value, roughly from above."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = 48 if isinstance(kind.elementType, (T.StructType, T.StringType)) else 8
        return F.greatest(F.size(c), F.lit(0)) * each + 24
    return F.lit(32 if isinstance(kind, T.StructType) else 8)


def join_checked(rows: DataFrame, side: DataFrame, on, how: str) -> DataFrame:
    """`rows` joined with `side` (a written table), whose size is measured first."""
    size = side.agg(F.sum(sum((_width(f) for f in side.schema), F.lit(16)).cast("bigint"))).first()[0] or 0
    return rows.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, on, how)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
