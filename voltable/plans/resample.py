"""Resampled return paths as tables.

A path set is a long table (keys, sim_id, period, value). Draws are integer hashes of (seed, key,
simulation, period), so the same path appears whatever the partitioning, and after a lost executor.
Simulations are spread over partitions in blocks; nothing is held on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.common import EPSILON, TRADING_DAYS, finite
from ..functions.draws import draw32, key_code, stream_code
from ..operators.metrics import PERCENTILES

MIN_OBS = 30
SEED = 42
SIM_BLOCK = 64  # simulations that share one copy of a key's returns


def resampled(returns: DataFrame, keys, n_sims: int, n_periods: int, block: int = 1, seed=SEED, date="d", r="r") -> DataFrame:
    """`steps`: the drawn log returns of every (key, sim_id), n_periods of them, in one row.

    A key's returns are one array, bounded by the calendar. It is sent once to every block of simulations, and a row draws,
    compounds and measures inside itself; periods are never shuffled. A return of -100 % or less has no logarithm and
    leaves a path as it is.
    """
    known = returns.filter(F.col(r).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(r).cast("double").alias("r")))).alias("_pool"))
    known = known.filter(F.size("_pool") >= MIN_OBS).select(*keys, F.transform("_pool", lambda x: F.coalesce(F.log1p(x["r"]), F.lit(0.0))).alias("_pool"), key_code(*keys).alias("_key"))
    blocks = known.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n_sims - 1) // SIM_BLOCK)))).repartition(*keys, "_block")
    first = F.col("_block") * SIM_BLOCK + 1
    sims = blocks.withColumn("sim_id", F.explode(F.sequence(first, F.least(first + SIM_BLOCK - 1, F.lit(n_sims)))))
    sims = sims.withColumn("_stream", stream_code(seed, F.col("_key"), F.col("sim_id"))).withColumn("_n", F.size("_pool"))
    size = F.when(F.lit(block) > F.col("_n"), F.greatest(F.floor(F.col("_n") / 2), F.lit(1))).otherwise(F.lit(block)).cast("int")
    sims = sims.withColumn("_b", size)
    periods = F.sequence(F.lit(1), F.lit(n_periods))

    def drawn(period):
        if block == 1:
            return F.pmod(draw32(F.col("_stream"), period), F.col("_n"))
        start = F.pmod(draw32(F.col("_stream"), F.floor((period - 1) / F.col("_b"))), F.col("_n") - F.col("_b") + 1)
        return start + (period - 1) % F.col("_b")

    return sims.select(*keys, "_block", "sim_id", F.transform(periods, lambda p: F.get("_pool", drawn(p).cast("int"))).alias("steps"))


def values_of(sims: DataFrame, keys, initial=1.0) -> DataFrame:
    """`steps` as rows (keys, sim_id, period, value), period 0 included. Rows stay where their simulation is."""
    rows = sims.select(*keys, "_block", "sim_id", F.posexplode(F.concat(F.array(F.lit(0.0)), "steps")).alias("period", "_g"))
    w = W.partitionBy(*keys, "_block", "sim_id").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    return rows.select(*keys, "sim_id", "period", (F.exp(F.sum("_g").over(w)) * initial).alias("value"))


def bootstrap_paths(returns: DataFrame, keys, n_sims=1000, n_periods=252, seed=SEED, initial=1.0, date="d", r="r") -> DataFrame:
    """Daily returns drawn with replacement and compounded."""
    return values_of(resampled(returns, keys, n_sims, n_periods, 1, seed, date, r), keys, initial)


def block_bootstrap_paths(returns: DataFrame, keys, n_sims=1000, n_periods=252, block=20, seed=SEED, initial=1.0, date="d", r="r") -> DataFrame:
    """Contiguous blocks drawn with replacement, the last one cut to fit; a block longer than the history halves it."""
    return values_of(resampled(returns, keys, n_sims, n_periods, block, seed, date, r), keys, initial)


def step_metrics(sims: DataFrame, keys, initial=1.0) -> DataFrame:
    """M04 inside the row, from `steps`: the metrics of `path_metrics` without exploding a path."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("log"), F.lit(1.0).alias("peak"), zero.alias("worst"), zero.alias("sum"), F.lit(0).alias("n"))

    def step(acc, g):
        value, before = F.exp(acc["log"] + g), F.exp(acc["log"])
        move = finite(value / before - 1.0)
        peak = F.greatest(acc["peak"], value)
        return F.struct((acc["log"] + g).alias("log"), peak.alias("peak"), F.least(acc["worst"], (value - peak) / peak).alias("worst"),
                        (acc["sum"] + F.coalesce(move, zero)).alias("sum"), (acc["n"] + F.when(move.isNull(), 0).otherwise(1)).alias("n"))

    known = sims.withColumn("_s", F.aggregate("steps", start, step)).withColumn("_mean", F.col("_s.sum") / F.when(F.col("_s.n") > 0, F.col("_s.n")))
    squares = F.aggregate("steps", zero, lambda a, g: a + F.coalesce(F.pow(finite(F.exp(g) - 1.0) - F.col("_mean"), F.lit(2.0)), zero))
    known = known.withColumn("_std", F.sqrt(squares / F.when(F.col("_s.n") > 0, F.col("_s.n"))))
    last, year = F.exp("_s.log"), F.sqrt(F.lit(TRADING_DAYS))
    return known.select(
        *keys, "sim_id", (last - 1.0).alias("total_return"), F.col("_s.worst").alias("max_drawdown"), (F.col("_std") * year).alias("volatility"),
        F.when(F.col("_std") < EPSILON, zero).otherwise(F.col("_mean") / F.col("_std") * year).alias("sharpe"), (last * initial).alias("final_value"))


def path_metrics(paths: DataFrame, keys) -> DataFrame:
    """Total return, max drawdown, volatility, Sharpe and final value per path (population deviation).

    For any table of paths; paths drawn here are measured without a shuffle by `step_metrics` of `resampled`."""
    w = W.partitionBy(*keys, "sim_id").orderBy("period")
    frame = paths.withColumns({"_r": finite(F.col("value") / F.lag("value").over(w) - 1.0), "_pk": F.max("value").over(w.rowsBetween(W.unboundedPreceding, 0))})
    std = F.stddev_pop("_r")
    first, last = F.min_by("value", "period"), F.max_by("value", "period")
    return frame.groupBy(*keys, "sim_id").agg(
        (last / first - 1.0).alias("total_return"), F.min((F.col("value") - F.col("_pk")) / F.col("_pk")).alias("max_drawdown"),
        (std * F.sqrt(F.lit(TRADING_DAYS))).alias("volatility"), F.when(std < EPSILON, F.lit(0.0)).otherwise(F.avg("_r") / std * F.sqrt(F.lit(TRADING_DAYS))).alias("sharpe"),
        last.alias("final_value"))


def custom_path_metric(paths: DataFrame, keys, fn, name="metric") -> DataFrame:
    """`fn(values: pandas.Series ordered by period) -> float` per path; one path per call, bounded by its periods."""
    ordered = paths.groupBy(*keys, "sim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "value"))), lambda x: x["value"]).alias("_v"))

    def batch(vs):
        import pandas as pd

        return pd.Series([float(fn(pd.Series(v))) for v in vs])

    import pandas as pd

    batch.__annotations__ = {"vs": pd.Series, "return": pd.Series}
    return ordered.select(*keys, "sim_id", F.pandas_udf(batch, "double")("_v").alias(name))


def metric_confidence_interval(metrics: DataFrame, keys, columns=("total_return", "max_drawdown", "volatility", "sharpe", "final_value"), confidence=0.95) -> DataFrame:
    """Mean, percentile bounds and standard error per metric. A key's simulations are bounded by `n_sims`."""
    parts = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = metrics.select(*keys, F.expr(f"stack({len(columns)}, {parts}) as (metric, x)")).withColumn("x", finite(F.col("x")))
    tail = (1.0 - confidence) / 2.0
    return long.groupBy(*keys, "metric").agg(
        F.avg("x").alias("point_estimate"), F.percentile("x", F.lit(tail)).alias("lower_bound"), F.percentile("x", F.lit(1.0 - tail)).alias("upper_bound"),
        (F.stddev_pop("x") / F.sqrt(F.count("x"))).alias("standard_error"))


def horizon_returns(paths: DataFrame, keys, horizon: int) -> DataFrame:
    ends = paths.filter(F.col("period").isin(0, horizon))
    return ends.groupBy(*keys, "sim_id").agg((F.max_by("value", "period") / F.min_by("value", "period") - 1.0).alias("hr"), F.min_by("value", "period").alias("_v0"), F.count(F.lit(1)).alias("_n")).filter("_n = 2")


def simulated_var(paths: DataFrame, keys, horizon=1, confidences=(0.90, 0.95, 0.99)) -> DataFrame:
    """VaR and CVaR at a horizon, as fractions and in money, one row per level."""
    h = horizon_returns(paths, keys, horizon).withColumn("confidence", F.explode(F.array(*map(F.lit, confidences))))
    lows = F.percentile("hr", F.array(*[F.lit(1.0 - c) for c in confidences])).over(W.partitionBy(*keys, "confidence"))
    at = F.array_position(F.array(*map(F.lit, confidences)), F.col("confidence")).cast("int")
    v = h.withColumn("var", F.element_at(lows, at))
    out = v.groupBy(*keys, "confidence").agg(F.max("var").alias("var"), F.avg(F.when(F.col("hr") <= F.col("var"), F.col("hr"))).alias("cvar"),
                                            F.max("_v0").alias("_v0"), F.count("hr").alias("num_simulations"))
    return out.withColumns({"var_dollar": F.abs("var") * F.col("_v0"), "cvar_dollar": F.abs("cvar") * F.col("_v0")}).drop("_v0")


def terminal_distribution(paths: DataFrame, keys, n_periods: int) -> DataFrame:
    """M07."""
    h = horizon_returns(paths, keys, n_periods)
    whole = W.partitionBy(*keys)
    z = h.withColumns({"_m": F.avg("hr").over(whole), "_s": F.stddev_pop("hr").over(whole)})
    x, m, s = F.col("hr"), F.col("_m"), F.col("_s")
    up, down, n = F.when(x > 0, x), F.when(x < 0, x), F.count("hr")
    return z.groupBy(*keys).agg(
        F.avg("hr").alias("mean"), F.median("hr").alias("median"), F.stddev_pop("hr").alias("std"), F.skewness("hr").alias("skewness"), F.kurtosis("hr").alias("kurtosis"),
        *[F.percentile("hr", F.lit(p / 100.0)).alias(f"p{p}") for p in PERCENTILES],
        (F.count(up) / n).alias("prob_profit"), (F.count(down) / n).alias("prob_loss"), (F.lit(1.0) - F.count(up) / n - F.count(down) / n).alias("prob_breakeven"),
        F.coalesce(F.avg(up), F.lit(0.0)).alias("mean_profit"), F.coalesce(F.avg(down), F.lit(0.0)).alias("mean_loss"),
        *[(F.count_if(cond) / n).alias(name) for name, cond in (
            ("left_2sigma", x < m - s * 2.0), ("right_2sigma", x > m + s * 2.0), ("left_3sigma", x < m - s * 3.0), ("right_3sigma", x > m + s * 3.0))],
        F.min("hr").alias("worst"), F.max("hr").alias("best"), n.alias("num_simulations"))


def probability_of_target(paths: DataFrame, keys, n_periods: int, target: float) -> DataFrame:
    """M08."""
    hit = F.when(F.col("hr") >= target, F.col("hr"))
    return horizon_returns(paths, keys, n_periods).groupBy(*keys).agg(
        (F.count(hit) / F.count("hr")).alias("probability"), F.count(hit).alias("num_achieving"), F.coalesce(F.avg(hit), F.lit(float(target))).alias("expected_given_achieved"))


def drawdown_distribution(metrics: DataFrame, keys) -> DataFrame:
    """M09 from the metrics of each path (`step_metrics` or `path_metrics`)."""
    x = "max_drawdown"
    n = F.count(x)
    return metrics.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_pop(x).alias("std"), F.min(x).alias("worst"), F.max(x).alias("best"),
        *[F.percentile(x, F.lit(p / 100.0)).alias(f"p{p}") for p in PERCENTILES],
        *[(F.count_if(F.col(x) < -c / 100.0) / n).alias(f"prob_exceeds_{c}") for c in (10, 20, 30)])


def path_fan(paths: DataFrame, keys, levels=(5, 50, 95)) -> DataFrame:
    """Percentile bands per period."""
    return paths.groupBy(*keys, "period").agg(*[F.percentile("value", F.lit(p / 100.0)).alias(f"p{p}") for p in levels])


def summary_report(paths: DataFrame, keys, n_periods: int) -> DataFrame:
    """Terminal, drawdown and VaR figures side by side."""
    t = terminal_distribution(paths, keys, n_periods).select(*keys, F.col("mean").alias("mean_return"), F.col("std").alias("std_return"), "prob_profit", "prob_loss")
    d = drawdown_distribution(path_metrics(paths, keys), keys).select(*keys, F.col("mean").alias("mean_drawdown"), F.col("worst").alias("worst_drawdown"))
    v = simulated_var(paths, keys, n_periods, (0.95,)).select(*keys, F.col("var").alias("var_95"), F.col("cvar").alias("cvar_95"))
    return t.join(d, keys).join(v, keys)


def sample_paths(paths: DataFrame, keys, n: int, n_sims: int, seed=SEED) -> DataFrame:
    """A reproducible sample of n simulations per key without replacement: the n smallest hashes."""
    sims = paths.filter(F.col("period") == 0).select(*keys, "sim_id")
    h = stream_code(seed, key_code(*keys), F.col("sim_id"))
    chosen = sims.withColumn("_h", h).withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy("_h", "sim_id"))).filter(F.col("_rn") <= min(n, n_sims))
    return paths.join(chosen.select(*keys, "sim_id"), [*keys, "sim_id"], "left_semi")
