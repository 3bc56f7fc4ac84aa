"""Small Column helpers shared by the whole package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CONTRACT_MULTIPLIER = 100.0
TRADING_DAYS = 252.0
EPSILON = 1e-10


def col_of(x) -> Column:
    """A column name, a Column or a number as a Column (numbers become doubles)."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def is_call(option_type) -> Column:
    return F.lower(F.trim(col_of(option_type))).isin("call", "c")


def phi(option_type) -> Column:
    """+1 for a call, -1 for a put."""
    return F.when(is_call(option_type), F.lit(1.0)).otherwise(F.lit(-1.0))


def holds(cond: Column) -> Column:
    """A predicate whose unknown value counts as false."""
    return F.coalesce(cond, F.lit(False))


def finite(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Every double column rounded, negative zero removed, non-finite values as NULL."""
    out = []
    for name, dtype in df.dtypes:
        x = F.col(name)
        if dtype in ("double", "float"):
            x = (F.round(finite(x), places) + F.lit(0.0)).alias(name)
        out.append(x)
    return df.select(*out)


def fenced(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add computed columns that later filters are not pushed through.

    Catalyst substitutes a projected expression into every filter above it. For a price formula that
    multiplies the work and can exceed the size of a generated method, so the values leave through a
    one-element `inline`, which stays inside whole-stage code but is opaque to predicate pushdown.
    """
    return df.drop(*cols).select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
