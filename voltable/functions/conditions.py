"""Entry, exit and gating predicates (B04-B21) as boolean Columns.

Every predicate is three-valued-safe: a missing input makes it false, never an error.
User rules are ordinary Columns, so they combine with these through &, | and ~.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import col_of, holds

DAY_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
EVENT_TYPES = ("earnings", "fomc", "cpi", "jobs", "dividend", "expiration")
COMPARISONS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq}


def above(x, t) -> Column:
    return holds(col_of(x) > t)


def below(x, t) -> Column:
    return holds(col_of(x) < t)


def between(x, low, high) -> Column:
    return holds(col_of(x).between(low, high))


def iv_rank_above(t, iv_rank="iv_rank"):
    return above(iv_rank, t)


def iv_rank_below(t, iv_rank="iv_rank"):
    return below(iv_rank, t)


def iv_rank_between(low, high, iv_rank="iv_rank"):
    return between(iv_rank, low, high)


def vix_above(t, vix="vix"):
    return above(vix, t)


def vix_below(t, vix="vix"):
    return below(vix, t)


def vix_between(low, high, vix="vix"):
    return between(vix, low, high)


def is_vix_above_threshold(vix="vix", threshold=20.0):
    return above(vix, threshold)


def is_vix_below_threshold(vix="vix", threshold=15.0):
    return below(vix, threshold)


def is_vix_in_range(vix="vix", low=15.0, high=30.0):
    return between(vix, low, high)


def dte_above(t, dte="dte"):
    return above(dte, t)


def dte_below(t, dte="dte"):
    return below(dte, t)


def dte_between(low, high, dte="dte"):
    return between(dte, low, high)


def day_of_week(*names: str, date="d") -> Column:
    return holds(F.weekday(col_of(date)).isin([DAY_NAMES.index(n.lower()) for n in names]))


def profit_pct(pnl, premium) -> Column:
    """P&L over the absolute premium; NULL when there was no premium."""
    base = F.abs(col_of(premium))
    return F.when(base > 0, col_of(pnl) / base)


def has_reached_profit_target(pnl, premium, target=0.25) -> Column:
    return holds(profit_pct(pnl, premium) >= target)


def has_reached_stop_loss(pnl, premium, stop=-1.0) -> Column:
    return holds(profit_pct(pnl, premium) <= stop)


def profit_target(t, pnl_pct="pnl_pct") -> Column:
    return holds(col_of(pnl_pct) >= t)


def stop_loss(multiple, pnl_pct="pnl_pct") -> Column:
    return holds(col_of(pnl_pct) <= -multiple)


def fixed_stop_loss(dollars, pnl="pnl") -> Column:
    return holds(col_of(pnl) <= -dollars)


def running_peak(keys: list[str], date="d", pnl="pnl") -> Column:
    """W09. A position holds one row per day of its life, so the window is bounded by the calendar."""
    w = W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return F.max(col_of(pnl)).over(w)


def trailing_stop(pct, peak="peak_pnl", pnl="pnl") -> Column:
    give_back = (col_of(peak) - col_of(pnl)) / col_of(peak)
    return holds((col_of(peak) > 0) & (F.when(col_of(peak) > 0, give_back) >= pct))


def holding_period(days, entry_date="entry_date", date="d") -> Column:
    return holds(F.datediff(col_of(date), col_of(entry_date)) >= days)


def expiration_approaching(days, dte="dte") -> Column:
    return holds(col_of(dte) <= days)


def all_of(*conds: Column) -> Column:
    return reduce(operator.and_, map(holds, conds), F.lit(True))


def any_of(*conds: Column) -> Column:
    return reduce(operator.or_, map(holds, conds), F.lit(False))


def negate(cond: Column) -> Column:
    return ~holds(cond)


def always_true() -> Column:
    return F.lit(True)


def always_false() -> Column:
    return F.lit(False)


def threshold_condition(name: str, op: str, value) -> Column:
    return holds(COMPARISONS[op](F.col(name), F.lit(value)))


def range_condition(name: str, low, high, inclusive: bool = True) -> Column:
    x = F.col(name)
    return holds(x.between(low, high) if inclusive else (x > low) & (x < high))


def combine_conditions(conds: Iterable[Column], how: str = "and") -> Column:
    return all_of(*conds) if how == "and" else any_of(*conds)


negate_condition = negate


def check_position_limit(count, limit) -> Column:
    return holds(col_of(count) < limit)


def check_capital_limit(allocated, size, capital) -> Column:
    return holds(col_of(allocated) + col_of(size) <= col_of(capital))


def check_delta_limit(delta_sum, limit) -> Column:
    return holds(F.abs(col_of(delta_sum)) <= limit)


def regime(vix="vix", low=15.0, high=25.0) -> Column:
    v = col_of(vix)
    return F.when(v.isNull(), F.lit(None)).when(v < low, F.lit("LOW")).when(v > high, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def recommended_structure(regime_col="regime") -> Column:
    """Turbulent markets sell straddles, middling ones sell condors, calm ones buy straddles."""
    x = col_of(regime_col)
    return (
        F.when(x == "HIGH", F.lit("short_straddle")).when(x == "MEDIUM", F.lit("iron_condor"))
        .when(x == "LOW", F.lit("long_straddle"))
    )


def event_days(events: DataFrame, buffer_days: int = 1, types: list[str] | None = None) -> DataFrame:
    """The calendar days within +-buffer of an event, one row each: a range condition as an equi-join key."""
    ev = events.filter(F.col("event_type").isin(types)) if types else events
    span = F.sequence(F.date_sub("event_date", buffer_days), F.date_add("event_date", buffer_days))
    return ev.select(F.explode(span).alias("_event_day")).distinct()


def is_major_event_date(
    df: DataFrame, events: DataFrame, date: str = "d", buffer_days: int = 1,
    types: list[str] | None = None, keep: str = "near",
) -> DataFrame:
    """Rows near an event (`keep='near'`) or away from every event (`keep='away'`)."""
    how = "left_semi" if keep == "near" else "left_anti"
    return df.join(event_days(events, buffer_days, types), F.col(date) == F.col("_event_day"), how)


def upcoming_events(events: DataFrame, start, end, types: list[str] | None = None) -> DataFrame:
    ev = events.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if types:
        ev = ev.filter(F.col("event_type").isin(types))
    return ev.orderBy("event_date", "event_type")
