"""Ordered per-key computations.

Two grains occur. A *daily* series has one row per key and day, so a window over one key is bounded
by the calendar (about 250 rows a year) however large the job is. *Event-grained* tables (trades,
quotes of a day) have no such bound: there one key can hold a third of all rows, so `running_total`,
`sequence_number` and `longest_streaks` work in two levels - inside (key, day), then over one summary
row per (key, day) - and no task ever sees a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.common import TRADING_DAYS, finite

MIN_OBS = 30


def daily(keys: list[str], date: str = "d") -> W:
    return W.partitionBy(*keys).orderBy(date)


def running(keys: list[str], date: str = "d") -> W:
    return daily(keys, date).rowsBetween(W.unboundedPreceding, 0)


def trailing(keys: list[str], window: int, date: str = "d") -> W:
    return daily(keys, date).rowsBetween(1 - window, 0)


def _ratio(value: str, keys: list[str], date: str) -> Column:
    prev = F.lag(value).over(daily(keys, date))
    return F.when(prev != 0, F.col(value) / prev)


def simple_returns(df: DataFrame, keys, value="equity", date="d", out="r") -> DataFrame:
    """Pct change; the first row and a zero denominator give NULL."""
    return df.withColumn(out, finite(_ratio(value, keys, date) - 1.0))


def log_returns(df: DataFrame, keys, value="c", date="d", out="lr") -> DataFrame:
    q = _ratio(value, keys, date)
    return df.withColumn(out, F.when(q > 0, F.log(q)))


def drawdown_series(df: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """Running peak, drawdown as a fraction (<= 0) and in money."""
    return df.withColumn("peak", F.max(value).over(running(keys, date))).withColumns(
        {"dd": F.when(F.col("peak") != 0, (F.col(value) - F.col("peak")) / F.col("peak")),
         "dd_value": F.col(value) - F.col("peak")}
    )


def rolling_sharpe(
    df: DataFrame, keys, returns="r", date="d", window=63, risk_free=0.02, periods=TRADING_DAYS, out="rolling_sharpe"
) -> DataFrame:
    """NULL until the window holds `window` returns, and where the deviation vanishes."""
    w = trailing(keys, window, date)
    # each is one fold over the frame of every row, so none is written twice
    seen = df.withColumns({"_mean": F.avg(returns).over(w), "_std": F.stddev_samp(returns).over(w), "_n": F.count(returns).over(w)})
    value = (F.col("_mean") - risk_free / periods) / F.col("_std") * F.sqrt(F.lit(periods))
    return seen.withColumn(out, F.when((F.col("_n") == window) & (F.col("_std") > 0), value)).drop("_mean", "_std", "_n")


def historical_volatility(
    df: DataFrame, keys, price="c", date="d", window=20, annualize=True, out="hv"
) -> DataFrame:
    """Sample deviation of the last `window` log returns."""
    base = log_returns(df, keys, price, date, "_lr")
    w = trailing(keys, window, date)
    scale = TRADING_DAYS**0.5 if annualize else 1.0
    value = F.when(F.count("_lr").over(w) == window, F.stddev_samp("_lr").over(w) * scale)
    return base.withColumn(out, value).drop("_lr")


def iv_minmax_rank(
    df: DataFrame, keys, iv="iv", date="d", window=252, min_obs=MIN_OBS, out="iv_rank"
) -> DataFrame:
    """Position of today's IV between the window's extremes, 0-100; 50 when flat."""
    w = trailing(keys, window, date)
    lo, hi = F.min(iv).over(w), F.max(iv).over(w)
    value = F.when(hi - lo == 0, F.lit(50.0)).otherwise((F.col(iv) - lo) / (hi - lo) * 100.0)
    value = F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))
    return df.withColumn(out, F.when((F.count(iv).over(w) >= min_obs) & F.col(iv).isNotNull(), value))


def _share(df, keys, iv, date, window, min_obs, out, inclusive) -> DataFrame:
    w = trailing(keys, window, date)
    seen = df.withColumn("_win", F.collect_list(iv).over(w))
    test = "x <= `{0}`" if inclusive else "x < `{0}`"
    hits = F.expr(f"size(filter(_win, x -> {test.format(iv)}))")
    n = F.size("_win")
    value = F.when((n >= min_obs) & F.col(iv).isNotNull(), hits * 100.0 / n)
    return seen.withColumn(out, value).drop("_win")


def iv_pct_below(df, keys, iv="iv", date="d", window=252, min_obs=MIN_OBS, out="iv_pct_below") -> DataFrame:
    """Share of the window strictly below today's IV, times 100. The frame is bounded by `window`."""
    return _share(df, keys, iv, date, window, min_obs, out, False)


def iv_pct_le(df, keys, iv="iv", date="d", window=252, min_obs=1, out="iv_pct_le") -> DataFrame:
    """Share of the window at or below today's IV, times 100."""
    return _share(df, keys, iv, date, window, min_obs, out, True)


def regime_duration(df: DataFrame, keys, regime="regime", date="d", out="regime_days") -> DataFrame:
    """Consecutive observations in the current regime, today included."""
    turn = F.when(F.col(regime).eqNullSafe(F.lag(regime).over(daily(keys, date))), 0).otherwise(1)
    island = df.withColumn("_turn", turn)
    island = island.withColumn("_isl", F.sum("_turn").over(running(keys, date)))
    w = W.partitionBy(*keys, "_isl").orderBy(date)
    return island.withColumn(out, F.row_number().over(w)).drop("_turn", "_isl")


def peak_pnl(df: DataFrame, keys, pnl="pnl", date="d", out="peak_pnl") -> DataFrame:
    return df.withColumn(out, F.max(pnl).over(running(keys, date)))


def price_history(marks: DataFrame, keys, date="d", price="mark") -> DataFrame:
    """One leg's dated prices as an ordered array (bounded by the days of its life)."""
    pair = F.struct(F.col(date).alias("d"), F.col(price).alias("price"))
    return marks.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("history"))


# ---- event-grained tables -------------------------------------------------------------------

def _day_offsets(df: DataFrame, keys, day, measure: Column, name: str) -> DataFrame:
    per_day = df.groupBy(*keys, day).agg(measure.alias("_sum"))
    before = daily(keys, day).rowsBetween(W.unboundedPreceding, -1)
    return per_day.select(*keys, day, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(name))


def running_total(df: DataFrame, keys, day, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum in (day, order). Give `value` as DECIMAL for a sum free of rounding drift."""
    offsets = _day_offsets(df, keys, day, F.sum(value), "_off")
    w = W.partitionBy(*keys, day).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = df.withColumn("_in", F.sum(value).over(w))
    return inside.join(offsets, [*keys, day]).withColumn(out, F.col("_in") + F.col("_off")).drop("_in", "_off")


def sequence_number(df: DataFrame, keys, day, order: list[str], out: str) -> DataFrame:
    """Consecutive numbers from 1 in (day, order) per key."""
    offsets = _day_offsets(df, keys, day, F.count(F.lit(1)), "_off")
    w = W.partitionBy(*keys, day).orderBy(*order)
    inside = df.withColumn("_in", F.row_number().over(w))
    return inside.join(offsets, [*keys, day]).withColumn(out, F.col("_in") + F.col("_off")).drop("_in", "_off")


def longest_streaks(df: DataFrame, keys, day, order: list[str], flag: Column, out: str) -> DataFrame:
    """Longest run of rows with `flag` true, per key, in (day, order).

    Each day is reduced to (run before its first breaker, run after its last one, best run inside,
    row count if unbroken). Runs that cross days are then stitched on those one-row-per-day summaries.
    """
    in_day = W.partitionBy(*keys, day).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    hit = F.coalesce(flag, F.lit(False))
    marked = df.select(*keys, day, *[c for c in order if c != day], hit.alias("_hit"))
    islands = (
        marked.withColumn("_brk", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(in_day))
        .groupBy(*keys, day, "_brk")
        .agg(F.count_if("_hit").alias("_run"))
    )
    days = islands.groupBy(*keys, day).agg(
        F.max("_brk").alias("_breaks"),
        F.max("_run").alias("_best"),
        F.coalesce(F.max(F.when(F.col("_brk") == 0, F.col("_run"))), F.lit(0)).alias("_head"),
        F.max_by("_run", "_brk").alias("_tail"),
    )
    group = F.sum(F.when(F.col("_breaks") > 0, 1).otherwise(0)).over(running(keys, day))
    pieces = days.withColumn("_g", group).select(
        *keys, "_best",
        F.explode(
            F.when(
                F.col("_breaks") > 0,
                F.array(
                    F.struct((F.col("_g") - 1).alias("g"), F.col("_head").alias("n")),
                    F.struct(F.col("_g").alias("g"), F.col("_tail").alias("n")),
                ),
            ).otherwise(F.array(F.struct(F.col("_g").alias("g"), F.col("_head").alias("n"))))
        ).alias("_p"),
    )
    stitched = pieces.groupBy(*keys, F.col("_p.g").alias("_g")).agg(
        F.sum("_p.n").alias("_len"), F.max("_best").alias("_best")
    )
    return stitched.groupBy(*keys).agg(F.greatest(F.max("_len"), F.max("_best")).alias(out))


def streaks(df: DataFrame, keys, day, order: list[str], flags: dict[str, Column]) -> DataFrame:
    """Longest runs of rows for several flags at once, per key, in (day, order): one column per flag.

    A stretch of rows is (run before its first breaker, run after its last one, best run, length, whether it breaks); two
    stretches in a row make one again. A day's rows are folded in order, then a key's days (bounded by the calendar), so
    all flags share one pass over the rows and one over the days.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(*[x for f in flags for x in (zero.alias(f"{f}_head"), zero.alias(f"{f}_tail"), zero.alias(f"{f}_best"), F.lit(False).alias(f"{f}_broken"))])

    def longer(acc, row):
        fields = []
        for f in flags:
            tail = F.when(row[f], acc[f"{f}_tail"] + 1).otherwise(zero)
            broken = acc[f"{f}_broken"] | ~row[f]
            fields += [F.when(broken, acc[f"{f}_head"]).otherwise(tail).alias(f"{f}_head"), tail.alias(f"{f}_tail"), F.greatest(acc[f"{f}_best"], tail).alias(f"{f}_best"), broken.alias(f"{f}_broken")]
        return F.struct(*fields)

    def joined(acc, x):
        fields = []
        for f in flags:
            across = acc[f"{f}_tail"] + x[f"{f}_head"]
            fields += [F.when(acc[f"{f}_broken"], acc[f"{f}_head"]).otherwise(across).alias(f"{f}_head"), F.when(x[f"{f}_broken"], x[f"{f}_tail"]).otherwise(across).alias(f"{f}_tail"),
                       F.greatest(acc[f"{f}_best"], x[f"{f}_best"], across).alias(f"{f}_best"), (acc[f"{f}_broken"] | x[f"{f}_broken"]).alias(f"{f}_broken")]
        return F.struct(*fields)

    row = F.struct(*[F.col(c) for c in order if c != day], *[F.coalesce(x, F.lit(False)).alias(f) for f, x in flags.items()])
    per_day = df.groupBy(*keys, day).agg(F.array_sort(F.collect_list(row)).alias("_rows")).select(*keys, day, F.aggregate("_rows", start, longer).alias("_s"))
    per_key = per_day.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(day, "_s"))).alias("_days"))
    whole = per_key.select(*keys, F.aggregate("_days", start, lambda acc, x: joined(acc, x["_s"])).alias("_s"))
    return whole.select(*keys, *[F.col(f"_s.{f}_best").alias(f) for f in flags])
