"""Join helpers that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_SALTS = 32
#: Rows of one key that a single task may well read.
HOT_ROWS = 500_000


def attach_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], spread: Column, salts: int = DEFAULT_SALTS,
                  how: str = "inner") -> DataFrame:
    """Join a one-row-per-key table back to its rows.

    The rows of one key spread over `salts` partitions by a hash of `spread`, the single summary row
    is repeated once per salt. Small summaries still become broadcast joins through Spark's own
    size-checked threshold.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def with_salts(per_key: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """`per_key` with `_salt`: a row per salt for the keys of `hot` (keys, `_salts`), one row for all others."""
    return per_key.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def attach_measured(rows: DataFrame, per_key: DataFrame, keys: list[str], spread: Column, salts: int = DEFAULT_SALTS, hot_rows: int = HOT_ROWS, how: str = "inner",
                    measured: DataFrame | None = None) -> DataFrame:
    """`attach_by_key` that counts the keys first: only rows of keys with more than `hot_rows` rows are spread over salts, and
    only the summaries of these keys are repeated; a cold key's summary stays one row.

    The hot keys are broadcast: there are at most rows / `hot_rows` of them. `rows` is read twice, so it should be a table
    or a cheap plan; where it is neither, `measured` (keys, `_rows`) tells how many rows a key has at most. Rows with a null key
    meet nothing.
    """
    measured = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")) if measured is None else measured
    hot = measured.filter(F.col("_rows") > hot_rows).select(*keys, F.lit(salts).alias("_salts"))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    return left.join(with_salts(per_key, hot, keys), [*keys, "_salt"], how).drop("_salt")


def align(a: DataFrame, b: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Inner alignment of two series with nulls dropped."""
    return a.join(b, on, "inner").dropna(subset=values)
