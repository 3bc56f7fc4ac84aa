"""Chart-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.normal import norm_pdf, norm_ppf
from ..operators.joins import attach_by_key
from ..operators.quantiles import exact_quantiles
from ..operators.series import drawdown_series, rolling_sharpe, running_total, simple_returns
from ..operators.structures import breakeven_points, payoff_grid


def histogram(df: DataFrame, keys, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins per key with mean, median, deviation, 5 % quantile and the fitted normal density.

    Rows meet their key's range through a salted join, so a hot key is counted by many tasks.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    stats = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.count("_v").alias("_n"))
    stats = stats.join(exact_quantiles(rows, keys, "_v", {"median": 0.5, "p5": 0.05}), keys)
    width = (F.col("_hi") - F.col("_lo")) / float(bins)
    at = attach_by_key(rows, stats.select(*keys, "_lo", "_hi"), keys, F.col("_v"))
    bin_ = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = at.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    out = counts.join(stats, keys).withColumn("_w", width)
    centre = F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w")
    return out.withColumns({
        "bin_start": F.col("_lo") + F.col("bin") * F.col("_w"), "bin_centre": centre, "density": F.when(F.col("_w") > 0, F.col("count") / (F.col("_n") * F.col("_w"))),
        "normal_density": F.when(F.col("std") > 0, norm_pdf((centre - F.col("mean")) / F.col("std")) / F.col("std"))}).drop("_lo", "_hi", "_n", "_w")


def qq_points(returns: DataFrame, keys, r="r") -> DataFrame:
    """Each key's .01-.99 quantiles of daily returns against normal ones."""
    levels = [i / 100.0 for i in range(1, 100)]
    q = returns.groupBy(*keys).agg(F.percentile(r, F.array(*map(F.lit, levels))).alias("_q"))
    pts = q.select(*keys, F.posexplode("_q").alias("_i", "sample_quantile"))
    return pts.withColumn("level", (F.col("_i") + 1) / 100.0).withColumn("normal_quantile", norm_ppf("level")).drop("_i")


def entry_exit_markers(prices: DataFrame, log: DataFrame, side: dict[str, int] | None = None) -> DataFrame:
    """Trade rows with the underlying's price of the day and a buy/sell sign."""
    px = prices.select(F.col("symbol").alias("underlying"), "d", F.col("spot").alias("price"))
    sign = F.when(F.col("structure_type").startswith("short") | F.col("structure_type").startswith("iron"), -1).otherwise(1)
    return log.join(px, ["underlying", "d"], "left").select(
        "strategy_id", "underlying", "d", "action", "price", F.when(F.col("action") == "open", sign).otherwise(-sign).alias("sign"))


def win_loss_counts(trades: DataFrame, keys, pnl="realized_pnl") -> DataFrame:
    """R05."""
    p = F.col(pnl)
    return trades.groupBy(*keys).agg(F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.count_if(p == 0).alias("flat"))


def pnl_by_trade(trades: DataFrame, keys, day: str, order, value: str, out="cumulative_pnl") -> DataFrame:
    """Trades in order with the running total."""
    return running_total(trades, keys, day, list(order), value, out)


def trade_stats(trades: DataFrame, keys, pnl="realized_pnl") -> DataFrame:
    """R05."""
    p = F.col(pnl)
    return trades.groupBy(*keys).agg(
        F.count(pnl).alias("trades"), F.sum(pnl).alias("total"), F.avg(pnl).alias("mean"), F.max(pnl).alias("best"), F.min(pnl).alias("worst"),
        F.avg(F.when(p > 0, p)).alias("mean_win"), F.avg(F.when(p < 0, p)).alias("mean_loss"))


def drawdown_table(curve: DataFrame, keys, value="equity", date="d") -> DataFrame:
    """Percent drawdown per day."""
    return drawdown_series(curve, keys, value, date).select(*keys, date, (F.col("dd") * 100.0).alias("drawdown_pct"), "peak")


def rolling_sharpe_table(curve: DataFrame, keys, window=63, value="equity", date="d") -> DataFrame:
    """Days whose window is full."""
    r = rolling_sharpe(simple_returns(curve, keys, value, date), keys, window=window, date=date)
    return r.filter(F.col("rolling_sharpe").isNotNull()).select(*keys, date, "rolling_sharpe")


def greeks_table(greeks: DataFrame, keys, date="d", names=("delta", "gamma", "theta", "vega", "rho")) -> DataFrame:
    """Greeks per day in long form."""
    pairs = ", ".join(f"'{g}', `{g}`" for g in names)
    return greeks.select(*keys, date, F.expr(f"stack({len(names)}, {pairs}) as (greek, value)"))


def payoff_table(legs: DataFrame, keys=("position_id",), points=101, spot="spot") -> DataFrame:
    """Payoff grid with the break-evens and the current spot of each position."""
    be = breakeven_points(legs, keys).groupBy(*keys).agg(F.sort_array(F.collect_list("breakeven")).alias("breakevens"))
    now = legs.groupBy(*keys).agg(F.first(spot).alias("current_spot"))
    return payoff_grid(legs, keys, points=points, spot=spot).join(now, list(keys)).join(be, list(keys), "left")


def summary_table(metrics: DataFrame, keys, columns) -> DataFrame:
    """metric/value rows."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return metrics.select(*keys, F.expr(f"stack({len(columns)}, {pairs}) as (metric, value)"))


def trade_log_page(log: DataFrame, keys, order, size=50, page=1) -> DataFrame:
    """One page of a trade log per key. Ranks below the page end are cut before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return log.withColumn("row", F.row_number().over(w)).filter(F.col("row") <= size * page).filter(F.col("row") > size * (page - 1))
