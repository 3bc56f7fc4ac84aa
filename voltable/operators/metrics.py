"""Performance metrics per strategy key.

Curves are daily, so their windows are bounded by the calendar. Trade metrics are plain partial
aggregates except the streaks, which use the two-level form of `series.longest_streaks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.common import EPSILON, TRADING_DAYS, finite
from .quantiles import exact_quantiles
from .series import daily, drawdown_series, regime_duration, running, simple_returns, streaks

INF = float("inf")
RISK_FREE = 0.02
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


# ---- aggregate columns over a curve with columns (d, equity) and returns r -------------------

def first_equity(value="equity", date="d") -> Column:
    return F.min_by(value, date)


def last_equity(value="equity", date="d") -> Column:
    return F.max_by(value, date)


def total_return_agg(value="equity", date="d") -> Column:
    a, z = first_equity(value, date), last_equity(value, date)
    return F.when(a != 0, (z - a) / a * 100.0)


def annualized_return_agg(value="equity", date="d") -> Column:
    a, z, n = first_equity(value, date), last_equity(value, date), F.count(value)
    growth = F.pow(z / a, F.lit(TRADING_DAYS) / (n - 1)) - 1.0
    return F.when((n < 2) | (a <= 0), F.lit(None)).when(z <= 0, F.lit(-1.0)).otherwise(growth)


def sharpe_agg(r="r", risk_free=RISK_FREE, periods=TRADING_DAYS) -> Column:
    std = F.stddev_samp(r)
    value = (F.avg(r) - risk_free / periods) / std * F.sqrt(F.lit(periods))
    return F.when(F.count(r) >= 2, F.when(std < EPSILON, F.lit(0.0)).otherwise(value))


def sortino_agg(r="r", risk_free=RISK_FREE, periods=TRADING_DAYS) -> Column:
    excess = F.avg(r) - risk_free / periods
    down = F.sqrt(F.avg(F.pow(F.least(F.col(r), F.lit(0.0)), F.lit(2.0))))
    value = F.when(down < EPSILON, F.lit(0.0)).otherwise(excess / down * F.sqrt(F.lit(periods)))
    none_down = F.when(excess > 0, F.lit(INF)).otherwise(F.lit(0.0))
    return F.when(F.count(r) >= 2, F.when(F.count_if(F.col(r) < 0) < 1, none_down).otherwise(value))


def volatility_agg(r="r", periods=TRADING_DAYS) -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(periods))


def total_return(curve: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """F01, in percent."""
    return curve.groupBy(*keys).agg(total_return_agg(value, date).alias("total_return_pct"))


def annualized_return(curve: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """F02, as a fraction."""
    return curve.groupBy(*keys).agg(annualized_return_agg(value, date).alias("annualized_return"))


def sharpe_ratio(curve: DataFrame, keys, value="equity", date="d", risk_free=RISK_FREE) -> DataFrame:
    return simple_returns(curve, keys, value, date).groupBy(*keys).agg(sharpe_agg("r", risk_free).alias("sharpe_ratio"))


def sortino_ratio(curve: DataFrame, keys, value="equity", date="d", risk_free=RISK_FREE) -> DataFrame:
    return simple_returns(curve, keys, value, date).groupBy(*keys).agg(sortino_agg("r", risk_free).alias("sortino_ratio"))


def calmar(annual: Column, max_dd: Column) -> Column:
    flat = F.when(annual > 0, F.lit(INF)).when(annual < 0, F.lit(-INF)).otherwise(F.lit(0.0))
    return F.when(F.abs(max_dd) < EPSILON, flat).otherwise(annual / F.abs(max_dd))


def calmar_ratio(curve: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """F05."""
    both = drawdown_series(curve, keys, value, date).groupBy(*keys).agg(
        annualized_return_agg(value, date).alias("annualized_return"), F.min("dd").alias("max_drawdown")
    )
    return both.withColumn("calmar_ratio", calmar(F.col("annualized_return"), F.col("max_drawdown")))


def max_drawdown(curve: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """depth, peak, trough and recovery of the deepest drawdown (the earliest one on ties).

    The peak is the first day of the running maximum in force at the trough; it rides along the
    running window, so only the recovery needs a second pass, and that one reuses the partitioning.
    """
    w = running(keys, date)
    at_peak = F.max(F.struct(F.col(value).alias("v"), (-F.unix_date(date)).alias("nd"))).over(w)
    dd = drawdown_series(curve, keys, value, date).withColumn("_pk", at_peak)
    whole = W.partitionBy(*keys)
    worst = F.min(F.struct(F.col("dd"), F.col(date).alias("td"), F.col("dd_value").alias("ddv"),
                           F.col(value).alias("tv"), F.col("_pk"))).over(whole)
    located = dd.filter(F.col("dd").isNotNull()).withColumn("_t", worst)
    back = F.min(F.when((F.col(date) >= F.col("_t.td")) & (F.col(value) >= F.col("_t._pk.v")), F.col(date)))
    out = located.groupBy(*keys, "_t").agg(back.alias("recovery_date"))
    peak_date = F.date_from_unix_date((-F.col("_t._pk.nd")).cast("int"))
    return out.select(
        *keys, F.col("_t.dd").alias("max_drawdown_frac"), F.col("_t.ddv").alias("max_drawdown_value"),
        peak_date.alias("peak_date"), F.col("_t._pk.v").alias("peak_value"), F.col("_t.td").alias("trough_date"),
        F.col("_t.tv").alias("trough_value"), "recovery_date",
        F.datediff(F.col("_t.td"), peak_date).alias("duration_days"),
        F.datediff("recovery_date", F.col("_t.td")).alias("recovery_days"),
    )


def average_drawdown(curve: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """mean of the whole drawdown series, days at the peak included."""
    return drawdown_series(curve, keys, value, date).groupBy(*keys).agg(F.avg("dd").alias("average_drawdown"))


def ulcer_index(curve: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """F08."""
    return drawdown_series(curve, keys, value, date).groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer_index"))


# ---- aggregate columns over closed trades ----------------------------------------------------

def _wins(p):
    return F.when(F.col(p) > 0, F.col(p))


def _losses(p):
    return F.when(F.col(p) < 0, F.col(p))


def win_rate_agg(p="realized_pnl") -> Column:
    return F.when(F.count(p) > 0, F.count_if(F.col(p) > 0) * 100.0 / F.count(p))


def profit_factor_agg(p="realized_pnl") -> Column:
    gain, loss = F.coalesce(F.sum(_wins(p)), F.lit(0.0)), F.abs(F.coalesce(F.sum(_losses(p)), F.lit(0.0)))
    no_loss = F.when(gain > 0, F.lit(INF)).otherwise(F.lit(0.0))
    return F.when(F.count(p) > 0, F.when(loss < EPSILON, no_loss).when(gain < EPSILON, F.lit(0.0)).otherwise(gain / loss))


def average_win_agg(p="realized_pnl") -> Column:
    return F.avg(_wins(p))


def average_loss_agg(p="realized_pnl") -> Column:
    return F.avg(_losses(p))


def average_trade_agg(p="realized_pnl") -> Column:
    return F.avg(p)


def expectancy_agg(p="realized_pnl") -> Column:
    share = F.count_if(F.col(p) > 0) / F.count(p)
    win, loss = F.coalesce(F.avg(_wins(p)), F.lit(0.0)), F.abs(F.coalesce(F.avg(_losses(p)), F.lit(0.0)))
    return F.when(F.count(p) > 0, share * win - (F.lit(1.0) - share) * loss)


def payoff_ratio_agg(p="realized_pnl") -> Column:
    win, loss = F.avg(_wins(p)), F.avg(_losses(p))
    return F.when(win.isNull() | loss.isNull(), F.lit(0.0)).when(F.abs(loss) < EPSILON, F.lit(INF)).otherwise(F.abs(win / loss))


TRADE_AGGS = {
    "win_rate_pct": win_rate_agg, "profit_factor": profit_factor_agg, "average_win": average_win_agg,
    "average_loss": average_loss_agg, "average_trade": average_trade_agg, "expectancy": expectancy_agg,
    "payoff_ratio": payoff_ratio_agg,
}


def trade_metric(trades: DataFrame, keys, *names: str) -> DataFrame:
    """F09-F15 by name; open trades (NULL P&L) are ignored."""
    return trades.groupBy(*keys).agg(*[TRADE_AGGS[n]().alias(n) for n in names])


def win_loss_streaks(trades: DataFrame, keys, day="exit_date", order=("trade_id",), pnl="realized_pnl") -> DataFrame:
    """F16 and F17 together: the longest runs of winning and of losing closed trades."""
    closed = trades.filter(F.col(pnl).isNotNull())
    return streaks(closed, keys, day, list(order), {"max_consecutive_wins": F.col(pnl) > 0, "max_consecutive_losses": F.col(pnl) < 0})


def consecutive_wins(trades: DataFrame, keys, day="exit_date", order=("trade_id",), pnl="realized_pnl") -> DataFrame:
    """F16."""
    return win_loss_streaks(trades, keys, day, order, pnl).select(*keys, "max_consecutive_wins")


def consecutive_losses(trades: DataFrame, keys, day="exit_date", order=("trade_id",), pnl="realized_pnl") -> DataFrame:
    """F17."""
    return win_loss_streaks(trades, keys, day, order, pnl).select(*keys, "max_consecutive_losses")


def distribution_aggs(r="r") -> list[Column]:
    pct = [F.percentile(r, F.lit(p / 100.0)).alias(f"p{p}") for p in PERCENTILES]
    n = F.count(r)
    return [
        F.avg(r).alias("mean"), F.median(r).alias("median"), F.stddev_samp(r).alias("std"), F.var_samp(r).alias("variance"),
        F.when(n >= 3, F.skewness(r)).otherwise(F.lit(0.0)).alias("skewness"),
        F.when(n >= 4, F.kurtosis(r)).otherwise(F.lit(0.0)).alias("kurtosis"),
        F.min(r).alias("min"), F.max(r).alias("max"), (F.max(r) - F.min(r)).alias("range"), n.alias("count"), *pct,
    ]


def returns_distribution(curve: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """F18 over the daily returns of each curve."""
    return simple_returns(curve, keys, value, date).groupBy(*keys).agg(*distribution_aggs("r"))


def value_distribution(rows: DataFrame, keys, value: str) -> DataFrame:
    """F18 for groups without a size bound (trades): moments by partial aggregation, quantiles by ranks."""
    moments = rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.skewness(value).alias("skewness"),
        F.kurtosis(value).alias("kurtosis"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"),
    )
    return moments.join(exact_quantiles(rows, keys, value, {f"p{p}": p / 100.0 for p in PERCENTILES}), keys)


# ---- months -----------------------------------------------------------------------------------

def month_ends(curve: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """One row per key and month of the key's span; months without rows carry a NULL value."""
    have = curve.groupBy(*keys, F.trunc(date, "month").alias("month")).agg(F.max_by(value, date).alias("value"))
    span = have.groupBy(*keys).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    grid = span.select(*keys, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias("month"))
    return grid.join(have, [*keys, "month"], "left")


def monthly_returns(curve: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """F19 in long form: (year, month, return). An empty month holds the last value, as pct_change fills forward."""
    filled = F.last("value", ignorenulls=True).over(running(keys, "month"))
    months = month_ends(curve, keys, value, date).withColumn("value", filled)
    r = simple_returns(months, keys, "value", "month", "month_return")
    return r.select(*keys, F.year("month").alias("year"), F.month("month").alias("month"), "month_return")


def monthly_table(curve: DataFrame, keys, value="equity", date="d", percent=False) -> DataFrame:
    """Year x month with fixed columns."""
    scale = 100.0 if percent else 1.0
    long = monthly_returns(curve, keys, value, date)
    cells = [
        F.max(F.when(F.col("month") == i + 1, F.col("month_return") * scale)).alias(m) for i, m in enumerate(MONTH_NAMES)
    ]
    return long.groupBy(*keys, "year").agg(*cells)


def monthly_compounded(curve: DataFrame, keys, value="equity", date="d", how="compound") -> DataFrame:
    """product of daily growth less one, or the plain sum of daily returns, per month."""
    r = simple_returns(curve, keys, value, date).filter(F.col("r").isNotNull())
    grown = F.product(F.col("r") + 1.0) - 1.0 if how == "compound" else F.sum("r")
    return r.groupBy(*keys, F.trunc(date, "month").alias("month")).agg(grown.alias("month_return"))


# ---- combined ---------------------------------------------------------------------------------

def curve_metrics(curve: DataFrame, keys, value="equity", date="d", risk_free=RISK_FREE) -> DataFrame:
    """All single-pass curve metrics from one windowed frame and one aggregation."""
    frame = drawdown_series(simple_returns(curve, keys, value, date), keys, value, date)
    base = frame.groupBy(*keys).agg(
        total_return_agg(value, date).alias("total_return_pct"),
        annualized_return_agg(value, date).alias("annualized_return"),
        volatility_agg("r").alias("volatility"), sharpe_agg("r", risk_free).alias("sharpe_ratio"),
        sortino_agg("r", risk_free).alias("sortino_ratio"), F.min("dd").alias("max_drawdown_frac"),
        F.avg("dd").alias("average_drawdown"),
        F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer_index"),
        last_equity(value, date).alias("final_equity"), F.count(F.lit(1)).alias("days"),
    )
    return base.withColumn("calmar_ratio", calmar(F.col("annualized_return"), F.col("max_drawdown_frac")))


def all_metrics(curve: DataFrame, trades: DataFrame, keys, day="exit_date", order=("trade_id",)) -> DataFrame:
    """curve, trade and streak metrics side by side; a key without trades keeps NULLs there."""
    t = trades.groupBy(*keys).agg(*[TRADE_AGGS[n]().alias(n) for n in TRADE_AGGS], F.count("realized_pnl").alias("closed_trades"))
    return curve_metrics(curve, keys).join(t, keys, "left").join(win_loss_streaks(trades, keys, day, order), keys, "left")


REGIMES = ("LOW", "MEDIUM", "HIGH")
REGIME_BUCKET = 32  # days


def regime_intervals(regimes: DataFrame, as_of=None) -> DataFrame:
    """(regime, first_day, last_day, days): runs of consecutive rows of (d, regime) up to `as_of`. One row per calendar day goes in."""
    upto = regimes.filter(F.col("regime").isNotNull())
    upto = upto if as_of is None else upto.filter(F.col("d") <= F.lit(as_of).cast("date"))
    runs = regime_duration(upto.withColumn("_series", F.lit(0)), ["_series"])
    numbered = runs.withColumn("_run", F.sum(F.when(F.col("regime_days") == 1, 1).otherwise(0)).over(running(["_series"])))
    return numbered.groupBy("_run", "regime").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("_run")


def regime_distribution(trades: DataFrame, keys, regimes: DataFrame, as_of=None, trade_id="trade_id") -> DataFrame:
    """per key and regime the regime's days, and the trades held in it with the calendar days they spent there.

    Trades meet the regimes' intervals by day buckets, an equality join; a pair that shares several buckets counts in the
    first one. A trade without an exit, or with one after `as_of`, is held to `as_of` (else to the last day known).
    """
    runs = regime_intervals(regimes, as_of)
    last = F.lit(as_of).cast("date") if as_of is not None else F.col("exit_date")
    held = trades.select(*keys, F.col(trade_id).alias("_trade"), F.col("entry_date").alias("_a"), F.least("exit_date", last).alias("_b")).filter(F.col("_a") <= F.col("_b"))
    bucket = lambda c: F.floor(F.unix_date(c) / REGIME_BUCKET)
    buckets = lambda a, b: F.explode(F.sequence(bucket(a), bucket(b)))
    pairs = held.withColumn("_bucket", buckets("_a", "_b")).join(runs.withColumn("_bucket", buckets("first_day", "last_day")), "_bucket").filter(
        (F.col("_a") <= F.col("last_day")) & (F.col("_b") >= F.col("first_day")) & (F.col("_bucket") == F.greatest(bucket("_a"), bucket("first_day"))))
    spent = F.datediff(F.least("_b", "last_day"), F.greatest("_a", "first_day")) + 1
    per = pairs.groupBy(*keys, "_trade", "regime").agg(F.sum(spent).alias("_days")).groupBy(*keys, "regime").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("_days").alias("trade_days"))
    return per.join(runs.groupBy("regime").agg(F.sum("days").alias("days")), "regime").select(*keys, "regime", "days", "trades", "trade_days")


def strategy_statistics(trades: DataFrame, keys, capital: float = 100000.0, as_of=None, regimes: DataFrame | None = None) -> DataFrame:
    """open/closed counts, realized and total P&L, return, equity, utilisation, win statistics.

    A trade with NULL P&L is open; its `unrealized_pnl`, if the column exists, adds to the total. With `as_of` trades entered
    later don't count and those closed later are open. With `regimes` (d, regime) each regime's days and trades follow
    (`days_low`, `trades_low`, ...).
    """
    if as_of is not None:
        day = F.lit(as_of).cast("date")
        trades = trades.filter(F.col("entry_date") <= day).withColumn("realized_pnl", F.when(F.col("exit_date") <= day, F.col("realized_pnl")))
    p, cost = F.col("realized_pnl"), F.col("total_cost")
    unreal = F.coalesce(F.sum("unrealized_pnl"), F.lit(0.0)) if "unrealized_pnl" in trades.columns else F.lit(0.0)
    still_open = p.isNull()
    base = trades.groupBy(*keys).agg(
        F.count_if(still_open).alias("num_open"), F.count(p).alias("num_closed"),
        F.coalesce(F.sum(p), F.lit(0.0)).alias("realized_pnl"), unreal.alias("unrealized_pnl"),
        F.count_if(p > 0).alias("num_wins"), F.count_if(p <= 0).alias("num_losses_incl_flat"),
        win_rate_agg().alias("win_rate_pct"), average_win_agg().alias("average_win"), average_loss_agg().alias("average_loss"),
        F.avg(F.when(p.isNotNull(), F.datediff("exit_date", "entry_date"))).alias("avg_hold_days"),
        F.coalesce(F.sum(F.when(still_open, F.abs(cost))), F.lit(0.0)).alias("_used"),
    )
    total = F.col("realized_pnl") + F.col("unrealized_pnl")
    out = base.withColumns(
        {"total_pnl": total, "return_frac": total / capital, "equity": F.lit(capital) + total,
         "utilization": F.col("_used") / capital}
    ).drop("_used")
    if regimes is None:
        return out
    wide = regime_distribution(trades, keys, regimes, as_of).groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col("regime") == g, F.col(c))), F.lit(0)).alias(f"{c}_{g.lower()}") for g in REGIMES for c in ("days", "trades")])
    return out.join(wide, keys, "left").na.fill(0, [f"{c}_{g.lower()}" for g in REGIMES for c in ("days", "trades")])


def run_comparison(curve: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """curves rebased to 100 at their first day."""
    start = F.first(value).over(daily(keys, date).rowsBetween(W.unboundedPreceding, 0))
    return curve.withColumn("normalized", F.when(start != 0, F.col(value) / start * 100.0))


def rating_flags(metrics: DataFrame) -> DataFrame:
    """Banded verdicts over the combined metrics."""
    def band(x, good, fair):
        c = F.col(x)
        return F.when(c > good, F.lit("good")).when(c > fair, F.lit("fair")).otherwise(F.lit("poor"))

    dd = F.col("max_drawdown_frac")
    return metrics.withColumns(
        {"sharpe_band": band("sharpe_ratio", 1.0, 0.5), "win_rate_band": band("win_rate_pct", 65.0, 50.0),
         "drawdown_band": F.when(dd < -0.15, F.lit("poor")).when(dd < -0.10, F.lit("fair")).otherwise(F.lit("good")),
         "profit_factor_band": band("profit_factor", 1.5, 1.0)}
    )


def full_backtest_metrics(curve: DataFrame, trades: DataFrame, keys, day="exit_date", order=("trade_id",)) -> DataFrame:
    """performance, risk and summary columns per run."""
    from .risk import all_risk_metrics

    risk = all_risk_metrics(curve, keys).withColumnRenamed("average_loss", "average_loss_return")
    return all_metrics(curve, trades, keys, day, order).join(risk, keys, "left")
