"""Stress scenarios over position tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.common import CONTRACT_MULTIPLIER, EPSILON
from ..functions.pricing import price_chain

# Fixed values: (name, spot shock, volatility shock, rate shock, days).
STRESS = [
    ("Severe Market Crash", -0.25, 0.40, -0.01, 0.0),
    ("Moderate Market Crash", -0.15, 0.25, -0.005, 0.0),
    ("Flash Crash", -0.10, 0.50, 0.0, 0.0),
    ("Volatility Spike", -0.05, 0.30, 0.0, 0.0),
    ("Volatility Crush", 0.02, -0.15, 0.0, 0.0),
    ("Rate Hike", -0.02, 0.05, 0.01, 0.0),
    ("Emergency Rate Cut", 0.03, -0.05, -0.01, 0.0),
    ("Melt Up", 0.15, -0.10, 0.005, 0.0),
]
HISTORICAL = [
    ("Black Monday 1987", -0.22, 0.60, -0.005, 0.0),
    ("Lehman Crisis 2008", -0.30, 0.50, -0.02, 0.0),
    ("Flash Crash 2010", -0.09, 0.40, 0.0, 0.0),
    ("COVID Crash 2020", -0.35, 0.55, -0.015, 0.0),
    ("Volmageddon 2018", -0.04, 0.80, 0.0, 0.0),
]
SPOT_LADDER = (-0.20, -0.10, -0.05, 0.05, 0.10, 0.20)
VOL_LADDER = (-0.10, -0.05, 0.05, 0.10, 0.20, 0.50)
RATE_LADDER = (-0.02, -0.01, -0.005, 0.005, 0.01, 0.02)
DAY_LADDER = (1.0, 5.0, 10.0, 20.0, 30.0)
MATRIX_SPOT = (-0.20, -0.15, -0.10, -0.05, 0.0, 0.05, 0.10, 0.15, 0.20)
MATRIX_VOL = (-0.20, -0.10, -0.05, 0.0, 0.05, 0.10, 0.20)
COMPONENTS = ("delta_pnl", "gamma_pnl", "vega_pnl", "theta_pnl", "rho_pnl")
LAYOUT = "scenario string, scenario_type string, spot_shock double, vol_shock double, rate_shock double, time_shock double"


def predefined() -> list[tuple]:
    """Stress and historical rows."""
    return [(n, "stress", *x) for n, *x in STRESS] + [(n, "historical", *x) for n, *x in HISTORICAL]


def scenario_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or predefined(), LAYOUT)


def custom_scenario(name: str, spot=0.0, vol=0.0, rate=0.0, days=0.0) -> tuple:
    """A spot cannot lose more than all of its value."""
    if spot < -1.0:
        raise ValueError("spot shock must not be below -1")
    return (name, "custom", float(spot), float(vol), float(rate), float(days))


def compose_scenarios(base: DataFrame, name: str, spot=0.0, vol=0.0, rate=0.0, days=0.0) -> DataFrame:
    """Further shocks on top of existing scenarios; the spot shock stays at or above -1."""
    return base.select(
        F.concat_ws(" + ", "scenario", F.lit(name)).alias("scenario"), F.lit("custom").alias("scenario_type"), F.greatest(F.col("spot_shock") + spot, F.lit(-1.0)).alias("spot_shock"),
        (F.col("vol_shock") + vol).alias("vol_shock"), (F.col("rate_shock") + rate).alias("rate_shock"), (F.col("time_shock") + days).alias("time_shock"))


def _literal(rows: list[tuple]) -> Column:
    names = ("scenario", "scenario_type", "spot_shock", "vol_shock", "rate_shock", "time_shock")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def cross_scenarios(positions: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """Every position under every scenario; the scenario list is configuration and rides as a literal."""
    return positions.select("*", F.inline(_literal(rows or predefined())))


def with_scenario_pnl(df: DataFrame) -> DataFrame:
    """Second-order P&L of rows that carry Greeks, value, optional spot and the shocks."""
    base = F.when(F.col("spot") > 0, F.col("spot")).otherwise(F.col("position_value")) if "spot" in df.columns else F.col("position_value")
    d = df.withColumn("_move", base * F.col("spot_shock"))
    d = d.withColumns({
        "delta_pnl": F.col("delta") * F.col("_move"), "gamma_pnl": F.col("gamma") * F.col("_move") * F.col("_move") * 0.5, "vega_pnl": F.col("vega") * F.col("vol_shock") * 100.0,
        "theta_pnl": F.col("theta") * F.col("time_shock"), "rho_pnl": F.col("rho") * F.col("rate_shock") * 100.0}).drop("_move")
    total = sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0]))
    d = d.withColumn("pnl", total)
    largest = F.array_max(F.array(*[F.struct(F.abs(c).alias("size"), F.lit(-i).alias("first"), F.lit(c).alias("name")) for i, c in enumerate(COMPONENTS)]))["name"]
    return d.withColumns({
        "new_value": F.col("position_value") + F.col("pnl"), "max_component": largest,
        "pnl_pct": F.when(F.col("position_value") > EPSILON, F.col("pnl") / F.col("position_value")).otherwise(F.lit(0.0))})


def apply_scenarios(positions: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """The suite of predefined (or given) scenarios."""
    return with_scenario_pnl(cross_scenarios(positions, rows))


def apply_scenario_table(positions: DataFrame, scenarios: DataFrame, keys) -> DataFrame:
    """N01 for scenarios that are data, matched to positions by key columns."""
    return with_scenario_pnl(positions.join(scenarios, list(keys)))


def worst_scenarios(results: DataFrame, keys, n=5) -> DataFrame:
    """S01."""
    w = W.partitionBy(*keys).orderBy("pnl", "scenario")
    return results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sensitivity(positions: DataFrame, factor: str, ladder=None) -> DataFrame:
    """P&L along a ladder of one factor: spot, vol, rate or time."""
    at = {"spot": (0, SPOT_LADDER), "vol": (1, VOL_LADDER), "rate": (2, RATE_LADDER), "time": (3, DAY_LADDER)}
    i, default = at[factor]
    rows = [(f"{factor} {x:+g}", factor, *[float(x) if j == i else 0.0 for j in range(4)]) for x in (ladder or default)]
    return apply_scenarios(positions, rows).withColumn("shock", F.col(f"{factor}_shock"))


def what_if(positions: DataFrame, keys, spots=MATRIX_SPOT, vols=MATRIX_VOL) -> DataFrame:
    """N04 in long form."""
    rows = [(f"{s:+g}/{v:+g}", "matrix", float(s), float(v), 0.0, 0.0) for s in spots for v in vols]
    return apply_scenarios(positions, rows).select(*keys, "spot_shock", "vol_shock", "pnl")


def what_if_matrix(positions: DataFrame, keys, spots=MATRIX_SPOT, vols=MATRIX_VOL) -> DataFrame:
    """One row per spot shock, one column per volatility shock."""
    long = what_if(positions, keys, spots, vols)
    cells = [F.sum(F.when(F.col("vol_shock") == float(v), F.col("pnl"))).alias(f"vol_{'m' if v < 0 else 'p'}{round(abs(v) * 100)}") for v in vols]
    return long.groupBy(*keys, "spot_shock").agg(*cells)


def stress_report(results: DataFrame, keys) -> DataFrame:
    """N06."""
    return results.groupBy(*keys).agg(
        F.min("pnl").alias("worst_pnl"), F.max("pnl").alias("best_pnl"), F.avg("pnl").alias("avg_pnl"), F.count_if(F.col("pnl") < 0).alias("scenarios_with_loss"),
        F.min_by("scenario", F.struct("pnl", "scenario")).alias("max_loss_scenario"))


def full_reprice(legs: DataFrame, keys, rows: list[tuple] | None = None, rate=0.04, t="t", sigma="vol") -> DataFrame:
    """Closed-form value of all legs under each scenario against their current value."""
    x = cross_scenarios(legs, rows)
    now = price_chain(x, t=t, rate=rate, sigma=sigma, out="_now")
    then = price_chain(
        now, F.col("spot") * (F.col("spot_shock") + 1.0), "strike", F.greatest(F.col(t) - F.col("time_shock") / 365.0, F.lit(0.0)), F.col("rate_shock") + rate,
        F.greatest(F.col(sigma) + F.col("vol_shock"), F.lit(0.01)), out="_then")
    q = F.col("side") * F.col("quantity") * CONTRACT_MULTIPLIER
    return then.groupBy(*keys, "scenario").agg(F.sum(F.col("_now") * q).alias("value"), F.sum(F.col("_then") * q).alias("shocked_value"),
                                              F.sum((F.col("_then") - F.col("_now")) * q).alias("pnl"))
