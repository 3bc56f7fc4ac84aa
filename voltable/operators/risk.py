"""Risk measures per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.common import CONTRACT_MULTIPLIER, EPSILON, TRADING_DAYS, is_call
from ..functions.normal import norm_ppf
from .joins import align
from .series import daily, drawdown_series, simple_returns

# Rounded normal quantiles for the usual confidence levels.
Z_SCORES = {0.90: 1.282, 0.95: 1.645, 0.99: 2.326, 0.995: 2.576}
GREEKS = ("delta", "gamma", "theta", "vega", "rho")
MIN_OBS = 30
SIGMAS = 2.0


def _enough(r: str, minimum: int, value: Column) -> Column:
    return F.when(F.count(r) >= minimum, value)


def var_agg(r="r", confidence=0.95, method="historical", minimum=MIN_OBS) -> Column:
    """Historical (linear-interpolated quantile) or parametric value at risk."""
    if method == "historical":
        return _enough(r, minimum, F.percentile(r, F.lit(1.0 - confidence)))
    z = F.lit(Z_SCORES[confidence]) if confidence in Z_SCORES else norm_ppf(confidence)
    return _enough(r, minimum, F.avg(r) - z * F.stddev_samp(r))


def value_at_risk(returns: DataFrame, keys, r="r", confidence=0.95, method="historical") -> DataFrame:
    return returns.groupBy(*keys).agg(var_agg(r, confidence, method).alias("var"))


def conditional_var(returns: DataFrame, keys, r="r", confidence=0.95) -> DataFrame:
    """Mean of the returns at or below the historical VaR."""
    held = F.percentile(r, F.lit(1.0 - confidence)).over(W.partitionBy(*keys))
    tail = returns.withColumn("_var", held)
    mean = F.avg(F.when(F.col(r) <= F.col("_var"), F.col(r)))
    return tail.groupBy(*keys).agg(
        _enough(r, MIN_OBS, F.max("_var")).alias("var"), _enough(r, MIN_OBS, F.coalesce(mean, F.max("_var"))).alias("cvar")
    )


def var_breaches(returns: DataFrame, keys, threshold: float, r="r") -> DataFrame:
    """Number and share of returns below a threshold."""
    hit = F.count_if(F.col(r) < threshold)
    return returns.groupBy(*keys).agg(
        hit.alias("breach_count"), F.when(F.count(r) > 0, hit / F.count(r)).alias("breach_rate"), F.count(r).alias("observations")
    )


def var_breach_dates(returns: DataFrame, keys, threshold: float, r="r", date="d") -> DataFrame:
    return returns.filter(F.col(r) < threshold).select(*keys, date, r)


def beta_agg(position: str, portfolio: str) -> Column:
    """Sample covariance over population variance, as the reference values mix them."""
    v = F.var_pop(portfolio)
    return F.when(v < EPSILON, F.lit(0.0)).otherwise(F.covar_samp(portfolio, position) / v)


def marginal_var(portfolio: DataFrame, positions: DataFrame, keys, date="d", confidence=0.95) -> DataFrame:
    """Beta of a position to the portfolio times the portfolio's VaR over the common days.

    `portfolio` has (date, r_port), `positions` has (keys, date, r).
    """
    both = align(positions, portfolio, [date], ["r", "r_port"])
    value = beta_agg("r", "r_port") * F.percentile("r_port", F.lit(1.0 - confidence))
    return both.groupBy(*keys).agg(
        _enough("r", MIN_OBS, beta_agg("r", "r_port")).alias("beta"), _enough("r", MIN_OBS, value).alias("marginal_var")
    )


def greeks_long(history: DataFrame, keys, date="d") -> DataFrame:
    pairs = ", ".join(f"'{g}', `{g}`" for g in GREEKS)
    return history.select(*keys, date, F.expr(f"stack({len(GREEKS)}, {pairs}) as (greek, value)"))


def greeks_over_time(history: DataFrame, keys, date="d") -> DataFrame:
    """One row per key and Greek."""
    x = "value"
    return greeks_long(history, keys, date).filter(F.col(x).isNotNull()).groupBy(*keys, "greek").agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        (F.max(x) - F.min(x)).alias("range"), F.median(x).alias("median"), F.max_by(x, date).alias("current"),
        F.count(x).alias("count"),
    )


def greeks_correlation(history: DataFrame, keys) -> DataFrame:
    """The ten pairwise correlations over rows where all five are known."""
    pairs = [(a, b) for i, a in enumerate(GREEKS) for b in GREEKS[i + 1:]]
    return history.dropna(subset=list(GREEKS)).groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])


def greeks_pnl_attribution(history: DataFrame, keys, date="d", spot="spot", vol="vol", pnl="pnl") -> DataFrame:
    """yesterday's Greeks on today's moves, summed, and what they leave unexplained."""
    w = daily(keys, date)
    ds, dv = F.col(spot) - F.lag(spot).over(w), F.col(vol) - F.lag(vol).over(w)
    terms = history.select(
        *keys, F.col(pnl).alias("_pnl"), (F.lag("delta").over(w) * ds).alias("_d"),
        (F.lag("gamma").over(w) * ds * ds * 0.5).alias("_g"), F.col("theta").alias("_t"),
        (F.lag("vega").over(w) * dv).alias("_v"),
    )
    total = {n: F.coalesce(F.sum(c), F.lit(0.0)) for n, c in
             {"delta_pnl": "_d", "gamma_pnl": "_g", "theta_pnl": "_t", "vega_pnl": "_v", "total_pnl": "_pnl"}.items()}
    out = terms.groupBy(*keys).agg(*[c.alias(n) for n, c in total.items()])
    explained = F.col("delta_pnl") + F.col("gamma_pnl") + F.col("theta_pnl") + F.col("vega_pnl")
    return out.withColumn("unexplained", F.col("total_pnl") - explained)


def tail_risk(returns: DataFrame, keys, r="r") -> DataFrame:
    """Moments, two-sigma tails and the Jarque-Bera test (closed form for two degrees of freedom)."""
    whole = W.partitionBy(*keys)
    m, s = F.avg(r).over(whole), F.stddev_samp(r).over(whole)
    cut = returns.filter(F.col(r).isNotNull()).withColumns({"_lo": m - s * SIGMAS, "_hi": m + s * SIGMAS})
    spread = F.stddev_samp(r) > EPSILON
    left, right, n = F.count_if(F.col(r) < F.col("_lo")), F.count_if(F.col(r) > F.col("_hi")), F.count(r)
    base = cut.groupBy(*keys).agg(
        n.alias("n"), F.skewness(r).alias("skewness"), F.kurtosis(r).alias("kurtosis"),
        F.when(spread, left).otherwise(F.lit(0)).alias("_l"), F.when(spread, right).otherwise(F.lit(0)).alias("_r"),
        spread.alias("_spread"),
    ).filter(F.col("n") >= 4)
    ratio = F.when(F.col("_r") > 0, F.col("_l") / F.col("_r")).when(F.col("_l") > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    jb = F.col("n") / 6.0 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4.0)
    return base.withColumns(
        {"left_tail_ratio": F.col("_l") / F.col("n"), "right_tail_ratio": F.col("_r") / F.col("n"),
         "tail_ratio": F.when(F.col("_spread"), ratio).otherwise(F.lit(1.0)), "jarque_bera": jb}
    ).withColumn("jb_pvalue", F.exp(F.col("jarque_bera") * -0.5)).withColumn("is_normal", F.col("jb_pvalue") > 0.05).drop("_l", "_r", "_spread")


def downside_risk(returns: DataFrame, keys, target=0.0, r="r") -> DataFrame:
    """G08."""
    short = F.least(F.col(r) - target, F.lit(0.0))
    losing = F.when(F.col(r) < target, F.col(r))
    return returns.groupBy(*keys).agg(
        F.sqrt(F.avg(short * short)).alias("downside_deviation"), F.avg(short * short).alias("downside_variance"),
        F.when(F.count(r) > 0, F.count(losing) / F.count(r)).alias("loss_probability"),
        F.coalesce(F.avg(losing), F.lit(0.0)).alias("average_loss"), F.min(r).alias("worst_loss"), F.count(losing).alias("loss_count"),
    )


def margin_utilization(equity: DataFrame, margin: DataFrame, keys, date="d") -> DataFrame:
    """Margin over equity on common days; days above 80 % and 100 %."""
    both = align(equity, margin, [*keys, date], ["equity", "margin"])
    u = both.withColumn("u", F.when(F.col("equity") > EPSILON, F.col("margin") / F.col("equity")).otherwise(F.lit(0.0)))
    return u.groupBy(*keys).agg(
        F.avg("u").alias("avg_utilization"), F.max("u").alias("max_utilization"), F.min("u").alias("min_utilization"),
        F.stddev_samp("u").alias("std_utilization"), F.count_if(F.col("u") > 0.8).alias("high_utilization_days"),
        F.count_if(F.col("u") > 1.0).alias("margin_call_days"), F.count("u").alias("days"),
    )


def mae_mfe(trades: DataFrame, marks: DataFrame | None = None, position="position_id") -> DataFrame:
    """Excursions per trade; with daily marks the true extremes, else the sign-based bounds."""
    p = F.col("realized_pnl")
    if marks is not None:
        ext = marks.groupBy(position).agg(F.min("pnl").alias("mae"), F.max("pnl").alias("mfe"))
        base = trades.join(ext, position, "left")
    else:
        base = trades.withColumns({"mae": F.least(p, F.lit(0.0)), "mfe": F.greatest(p, F.lit(0.0))})
    cost = F.abs(F.col("total_cost"))
    return base.withColumns(
        {"mae_pct": F.when(cost > EPSILON, F.col("mae") / cost),
         "efficiency": F.when(F.col("mfe") > EPSILON, p / F.col("mfe"))}
    )


def mae_statistics(excursions: DataFrame, keys) -> DataFrame:
    """G11."""
    return excursions.groupBy(*keys).agg(
        F.avg("mae").alias("avg_mae"), F.min("mae").alias("worst_mae"), F.avg("mfe").alias("avg_mfe"),
        F.max("mfe").alias("best_mfe"), F.avg("mae_pct").alias("avg_mae_pct"), F.avg("efficiency").alias("avg_efficiency"),
        F.count(F.lit(1)).alias("num_trades"),
    )


def all_risk_metrics(curve: DataFrame, keys, value="equity", date="d", confidence=0.95) -> DataFrame:
    """VaR, CVaR, tails and downside of each curve's daily returns."""
    r = simple_returns(curve, keys, value, date).select(*keys, date, "r")
    level = str(int(round(confidence * 100)))
    cv = conditional_var(r, keys, confidence=confidence).withColumnsRenamed({"var": f"var_{level}", "cvar": f"cvar_{level}"})
    param = r.groupBy(*keys).agg(
        var_agg("r", confidence, "parametric").alias(f"var_{level}_parametric"), var_agg("r", 0.99).alias("var_99"))
    return cv.join(param, keys).join(tail_risk(r, keys), keys, "left").join(downside_risk(r, keys), keys, "left")


# ---- benchmark, limits, sanity -----------------------------------------------------------------

def compare_to_benchmark(returns: DataFrame, benchmark: DataFrame, keys, date="d") -> DataFrame:
    """`returns` has (keys, date, r), `benchmark` has (date, rb); statistics over common days."""
    both = align(returns, benchmark, [date], ["r", "rb"]).withColumn("x", F.col("r") - F.col("rb"))
    live = F.stddev_pop("rb") > 0
    beta = F.when(live, F.covar_samp("r", "rb") / F.var_pop("rb")).otherwise(F.lit(0.0))
    te = F.stddev_pop("x") * F.sqrt(F.lit(TRADING_DAYS))
    alpha = (F.avg("r") - F.when(live, beta * F.avg("rb")).otherwise(F.lit(0.0))) * TRADING_DAYS
    out = both.groupBy(*keys).agg(
        (F.product(F.col("r") + 1.0) - 1.0).alias("strategy_return"), (F.product(F.col("rb") + 1.0) - 1.0).alias("benchmark_return"),
        alpha.alias("alpha"), beta.alias("beta"),
        F.when((F.stddev_pop("r") > 0) & live, F.corr("r", "rb")).otherwise(F.lit(0.0)).alias("correlation"),
        te.alias("tracking_error"),
        F.when(te > 0, F.avg("x") * TRADING_DAYS / te).otherwise(F.lit(0.0)).alias("information_ratio"),
    )
    return out.withColumn("outperformed", F.col("strategy_return") > F.col("benchmark_return"))


def flag_rows(df: DataFrame, keys, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Rules as rows: (keys, code, severity) for every rule that holds."""
    hits = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity")))
            for code, sev, cond in rules]
    return df.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("_f")).select(*keys, "_f.code", "_f.severity")


def validate_against_benchmark(comparison: DataFrame, keys) -> DataFrame:
    """G14."""
    return flag_rows(comparison, keys, [
        ("SIGNIFICANT_UNDERPERFORMANCE", "warning", F.col("strategy_return") < F.col("benchmark_return") * 0.5),
        ("HIGH_BETA", "info", F.abs("beta") > 1.5),
        ("HIGH_TRACKING_ERROR", "info", F.col("tracking_error") > 0.3),
        ("POOR_RISK_ADJUSTED_RETURN", "warning", F.col("information_ratio") < -1.0),
    ])


def risk_limit_report(curve: DataFrame, keys, value="equity", date="d", max_drawdown=0.20, max_daily_loss=0.05,
                      positions: DataFrame | None = None, max_position=0.10, max_delta=100.0) -> DataFrame:
    """Limits broken by a curve; with `positions` (keys, position_value, delta) also size and delta."""
    frame = drawdown_series(simple_returns(curve, keys, value, date), keys, value, date)
    facts = frame.groupBy(*keys).agg(
        F.min("dd").alias("_dd"), F.min("r").alias("_worst"), F.count(F.lit(1)).alias("_n"), F.max_by(value, date).alias("_eq"))
    rules = [
        ("INSUFFICIENT_DATA", "warning", F.col("_n") < 2),
        ("MAX_DRAWDOWN_EXCEEDED", "warning", F.col("_dd") < -max_drawdown),
        ("LARGE_DAILY_LOSS", "warning", F.col("_worst") < -max_daily_loss),
    ]
    if positions is not None:
        size = positions.groupBy(*keys).agg(F.max(F.abs("position_value")).alias("_big"), F.abs(F.sum("delta")).alias("_delta"))
        facts = facts.join(size, keys, "left")
        rules += [
            ("POSITION_TOO_LARGE", "warning", F.col("_big") > F.col("_eq") * max_position),
            ("DELTA_LIMIT_EXCEEDED", "warning", F.col("_delta") > max_delta),
        ]
    return flag_rows(facts, keys, rules)


def backtest_sanity(curve: DataFrame, trades: DataFrame, keys, value="equity", date="d", trade_day="exit_date") -> DataFrame:
    """Results too good or too thin to trust."""
    from .metrics import annualized_return_agg, monthly_returns, sharpe_agg, win_rate_agg

    facts = simple_returns(curve, keys, value, date).groupBy(*keys).agg(
        annualized_return_agg(value, date).alias("_ann"), sharpe_agg("r").alias("_sharpe"))
    t = trades.groupBy(*keys).agg(F.count("realized_pnl").alias("_n"), (win_rate_agg() / 100.0).alias("_win"))
    # distinct trading days per key are bounded by the calendar
    days = trades.select(*keys, trade_day).distinct()
    gap = days.withColumn("_gap", F.datediff(trade_day, F.lag(trade_day).over(daily(keys, trade_day))))
    gaps = gap.groupBy(*keys).agg(F.max("_gap").alias("_gap"))
    months = monthly_returns(curve, keys, value, date).groupBy(*keys).agg(
        F.count("month_return").alias("_months"), F.stddev_pop("month_return").alias("_mstd"))
    all_ = facts.join(t, keys, "left").join(gaps, keys, "left").join(months, keys, "left")
    return flag_rows(all_, keys, [
        ("RETURNS_UNREALISTIC", "warning", F.col("_ann") > 5.0), ("RETURNS_EXTREME_LOSS", "warning", F.col("_ann") < -0.99),
        ("INSUFFICIENT_TRADES", "warning", F.coalesce("_n", F.lit(0)) < 10),
        ("WIN_RATE_SUSPICIOUS", "warning", (F.col("_win") > 0.95) & (F.col("_n") > 20)),
        ("SHARPE_UNREALISTIC", "warning", F.col("_sharpe") > 5.0),
        ("RETURNS_TOO_CONSISTENT", "warning", (F.col("_months") >= 12) & (F.col("_mstd") < 0.01)),
        ("LARGE_TRADING_GAP", "info", F.col("_gap") > 60),
    ])


# ---- Greeks, margin and exposure of open positions ---------------------------------------------

def portfolio_greeks(legs: DataFrame, keys) -> DataFrame:
    """Sum of side x quantity x Greek (no contract multiplier)."""
    w = F.col("side") * F.col("quantity")
    return legs.groupBy(*keys).agg(*[F.sum(w * F.col(g)).alias(g) for g in GREEKS])


def leg_margin(otm_credit: bool = True) -> Column:
    """Margin of one leg: the naked-option rule for shorts, the premium for longs."""
    m, s, k, px = CONTRACT_MULTIPLIER, F.col("spot_at_entry"), F.col("strike"), F.col("entry_price")
    otm = F.when(is_call("option_type"), F.greatest(k - s, F.lit(0.0))).otherwise(F.greatest(s - k, F.lit(0.0)))
    naked = s * m * 0.2 + px * m - (otm * m if otm_credit else F.lit(0.0))
    need = F.greatest(naked, k * m * 0.1 + px * m, px * m)
    return F.when(F.col("side") > 0, px * m).otherwise(need) * F.col("quantity")


def structure_margin(legs: DataFrame, keys, otm_credit: bool = True, max_loss: DataFrame | None = None,
                     position="position_id") -> DataFrame:
    """Per position. A credit whose loss is bounded (below five times the credit) needs just that loss."""
    credit = F.sum(-F.col("side") * F.col("entry_price") * F.col("quantity")) * CONTRACT_MULTIPLIER
    per = legs.groupBy(*keys, position).agg(F.sum(leg_margin(otm_credit)).alias("_m"), credit.alias("net_premium"))
    if max_loss is not None:
        per = per.join(max_loss.select(position, F.col("max_loss").alias("_ml")), position, "left")
    else:
        per = per.withColumn("_ml", F.lit(None).cast("double"))
    c = F.col("net_premium")
    rule = F.when(c > 0, F.greatest(F.col("_m") - c, c)).otherwise(F.col("_m"))
    bounded = (c > 0) & (F.abs("_ml") < F.abs(c) * 5.0)
    return per.withColumn("margin", F.when(bounded, F.abs("_ml")).otherwise(F.greatest(rule, F.lit(0.0)))).drop("_m", "_ml")


def margin_requirement(per_position: DataFrame, keys) -> DataFrame:
    """Total over the positions of each key."""
    return per_position.groupBy(*keys).agg(F.sum("margin").alias("margin"), F.count(F.lit(1)).alias("positions"))


def total_exposure(per_position: DataFrame, keys) -> DataFrame:
    """Margin plus the absolute net debit of debit positions."""
    debit = F.when(F.col("net_premium") < 0, F.abs("net_premium")).otherwise(F.lit(0.0))
    return per_position.groupBy(*keys).agg(F.sum(F.col("margin") + debit).alias("exposure"))


def position_limit_check(per_position: DataFrame, greeks: DataFrame, keys, capital: float = 100000.0, max_positions=10,
                         max_single=0.20, max_utilization=0.80, max_delta=100.0, max_vega=500.0) -> DataFrame:
    """One verdict column per limit."""
    facts = per_position.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("positions"), F.max("margin").alias("largest"), F.sum("margin").alias("margin"))
    both = facts.join(greeks, keys, "left")
    return both.select(
        *keys, (F.col("positions") <= max_positions).alias("count_ok"), (F.col("largest") <= capital * max_single).alias("size_ok"),
        (F.col("margin") <= capital * max_utilization).alias("utilization_ok"), (F.abs("delta") <= max_delta).alias("delta_ok"),
        (F.abs("vega") <= max_vega).alias("vega_ok"),
    )


