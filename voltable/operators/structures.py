"""Multi-leg positions as tables of legs.

A structure type is a handful of leg templates; building positions is one `explode` of a literal array,
and everything about a position is an aggregate over its legs. A position's legs are few by construction,
so carrying them as an array for payoff work is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.common import CONTRACT_MULTIPLIER, col_of, is_call
from ..functions.instrument import leg_pnl, market_value, round_strike
from .risk import portfolio_greeks

# Fixed values: (option type, side, widths from the centre strike, wings from the centre strike) per leg.
LEG_TEMPLATES = {
    "long_call": [("call", 1, 0, 0)],
    "short_call": [("call", -1, 0, 0)],
    "long_put": [("put", 1, 0, 0)],
    "short_put": [("put", -1, 0, 0)],
    "long_straddle": [("call", 1, 0, 0), ("put", 1, 0, 0)],
    "short_straddle": [("call", -1, 0, 0), ("put", -1, 0, 0)],
    "long_strangle": [("call", 1, 1, 0), ("put", 1, -1, 0)],
    "short_strangle": [("call", -1, 1, 0), ("put", -1, -1, 0)],
    "bull_call_spread": [("call", 1, 0, 0), ("call", -1, 1, 0)],
    "bear_put_spread": [("put", 1, 0, 0), ("put", -1, -1, 0)],
    "bull_put_spread": [("put", 1, -1, 0), ("put", -1, 0, 0)],
    "bear_call_spread": [("call", 1, 1, 0), ("call", -1, 0, 0)],
    "iron_condor": [("put", 1, -1, -1), ("put", -1, -1, 0), ("call", -1, 1, 0), ("call", 1, 1, 1)],
    "iron_butterfly": [("put", 1, -1, 0), ("put", -1, 0, 0), ("call", -1, 0, 0), ("call", 1, 1, 0)],
}
# Default width as a share of the centre strike.
DEFAULT_WIDTH = {"bull_call_spread": 0.02, "bear_put_spread": 0.02, "bull_put_spread": 0.02, "bear_call_spread": 0.02}
OTHER_WIDTH = 0.05
SPOT_LOW, SPOT_HIGH = 0.01, 3.0


def leg_templates(spark) -> DataFrame:
    """The templates as a dimension table."""
    rows = [(s, i, t, d, float(w), float(g)) for s, legs in LEG_TEMPLATES.items() for i, (t, d, w, g) in enumerate(legs, 1)]
    return spark.createDataFrame(rows, "structure_type string, leg_no int, option_type string, side int, widths double, wings double")


def default_width(structure_type="structure_type", atm="atm") -> Column:
    share = F.lit(OTHER_WIDTH)
    for name, s in DEFAULT_WIDTH.items():
        share = F.when(F.col(structure_type) == name, F.lit(s)).otherwise(share)
    return col_of(atm) * share


def build_structures(entries: DataFrame) -> DataFrame:
    """Entries (position_id, structure_type, atm, width, wing, ...) to legs.

    NULL `width` takes the default share of the centre strike, NULL `wing` half the width.
    Unknown structure types give no legs.
    """
    legs = None
    for name, template in LEG_TEMPLATES.items():
        arr = F.array(*[
            F.struct(F.lit(i).alias("leg_no"), F.lit(t).alias("option_type"), F.lit(d).alias("side"),
                     F.lit(float(w)).alias("w"), F.lit(float(g)).alias("g"))
            for i, (t, d, w, g) in enumerate(template, 1)])
        hit = F.col("structure_type") == name
        legs = F.when(hit, arr) if legs is None else legs.when(hit, arr)
    sized = entries.withColumn("_w", F.coalesce(F.col("width"), default_width())).withColumn(
        "_g", F.coalesce(F.col("wing"), F.col("_w") * 0.5))
    out = sized.withColumn("_leg", F.explode(legs))
    strike = F.col("atm") + F.col("_leg.w") * F.col("_w") + F.col("_leg.g") * F.col("_g")
    return out.withColumns({
        "leg_no": F.col("_leg.leg_no"), "option_type": F.col("_leg.option_type"), "side": F.col("_leg.side"), "strike": strike,
    }).drop("_leg", "_w", "_g")


def whole_structures(legs: DataFrame, price="entry_price", position="position_id") -> DataFrame:
    """Legs of the positions all of whose legs have a price: a position without one of its legs is another position."""
    missing = F.max(F.col(price).isNull()).over(W.partitionBy(position))
    return legs.withColumn("_missing", missing).filter(~F.col("_missing")).drop("_missing")


def dropped_structures(legs: DataFrame, price="entry_price", position="position_id") -> DataFrame:
    """The positions that `whole_structures` leaves out, and why."""
    per = legs.groupBy(position, "structure_type").agg(F.count(F.lit(1)).alias("num_legs"), F.count_if(F.col(price).isNull()).alias("missing_legs"))
    return per.filter("missing_legs > 0").withColumn("reason", F.lit("leg_not_listed"))


def strikes_by_stddev(df: DataFrame, spot="spot", iv="iv", dte="dte", k=1.0, wing_share=0.02) -> DataFrame:
    """Short strikes k deviations from spot, wings a share of spot further out, rounded to 5."""
    move = col_of(spot) * col_of(iv) * F.sqrt(col_of(dte) / 365.0) * k
    wing = col_of(spot) * wing_share
    shorts = df.withColumns({"put_sell": round_strike(col_of(spot) - move), "call_sell": round_strike(col_of(spot) + move)})
    return shorts.withColumns({"put_buy": round_strike(F.col("put_sell") - wing), "call_buy": round_strike(F.col("call_sell") + wing)})


def select_nearest_contract(chain: DataFrame, target_dte=45, dte_range=(30, 60), spot="spot", keys=("symbol", "quote_date")) -> DataFrame:
    """Per symbol-day the expiration nearest the target and its strike nearest the spot."""
    dte = F.datediff("expiration", "quote_date")
    rank = F.struct(F.abs(dte - target_dte), F.col("expiration"), F.abs(F.col("strike") - col_of(spot)), F.col("strike"))
    best = chain.filter(dte.between(*dte_range)).groupBy(*keys).agg(F.min_by(F.struct("expiration", "strike"), rank).alias("_b"))
    return best.select(*keys, "_b.expiration", "_b.strike")


def select_strike_by_delta(chain: DataFrame, target: float, keys=("symbol", "quote_date", "expiration", "option_type")) -> DataFrame:
    """The strike whose absolute delta is nearest the target."""
    gap = F.struct(F.abs(F.abs(F.col("delta")) - target), F.col("strike"))
    return chain.filter(F.col("delta").isNotNull()).groupBy(*keys).agg(F.min_by("strike", gap).alias("strike"))


def net_premium_agg(price="entry_price") -> Column:
    return F.sum(-F.col("side") * F.col(price) * F.col("quantity")) * CONTRACT_MULTIPLIER


def net_premium(legs: DataFrame, keys=("position_id",)) -> DataFrame:
    """Credit positive."""
    return legs.groupBy(*keys).agg(net_premium_agg().alias("net_premium"))


def structure_metrics(legs: DataFrame, keys=("position_id", "structure_type")) -> DataFrame:
    """Maximum profit and loss, break-evens and widths in closed form per structure type."""
    c = F.col

    def strike(option_type, side):
        return F.max(F.when((c("option_type") == option_type) & (c("side") == side), c("strike")))

    p = legs.groupBy(*keys).agg(
        net_premium_agg().alias("net_premium"), F.max("quantity").alias("_q"), strike("call", 1).alias("_lc"),
        strike("call", -1).alias("_sc"), strike("put", 1).alias("_lp"), strike("put", -1).alias("_sp"),
    ).withColumn("_mult", c("_q") * CONTRACT_MULTIPLIER).withColumn("_ps", F.abs("net_premium") / c("_mult"))
    s, inf = c("structure_type"), F.lit(float("inf"))
    long_vol, short_vol = s.isin("long_straddle", "long_strangle"), s.isin("short_straddle", "short_strangle")
    debit, credit = s.isin("bull_call_spread", "bear_put_spread"), s.isin("bull_put_spread", "bear_call_spread")
    iron = s.isin("iron_condor", "iron_butterfly")
    put_wing, call_wing = c("_sp") - c("_lp"), c("_lc") - c("_sc")
    width = F.when(debit | credit, F.abs(F.coalesce(c("_lc") - c("_sc"), c("_lp") - c("_sp")))).when(iron, F.greatest(put_wing, call_wing))
    p = p.withColumn("width", width).withColumn("_wd", c("width") * c("_mult"))
    n = c("net_premium")
    return p.select(
        *keys, "net_premium", "width",
        F.when(long_vol, inf).when(short_vol | credit | iron, n).when(debit, c("_wd") + n).alias("max_profit"),
        F.when(short_vol, -inf).when(long_vol | debit, -n).when(credit | iron, c("_wd") - n).alias("max_loss"),
        F.when(long_vol, c("_lp") - c("_ps")).when(short_vol | iron, c("_sp") - c("_ps")).when(s == "bear_put_spread", c("_lp") - c("_ps"))
        .when(s == "bull_put_spread", c("_sp") - c("_ps")).alias("lower_breakeven"),
        F.when(long_vol, c("_lc") + c("_ps")).when(short_vol | iron, c("_sc") + c("_ps")).when(s == "bull_call_spread", c("_lc") + c("_ps"))
        .when(s == "bear_call_spread", c("_sc") + c("_ps")).alias("upper_breakeven"),
    )


def net_greeks(legs: DataFrame, keys=("position_id",), expired: Column | None = None) -> DataFrame:
    """Signed sums of per-leg Greeks; rows where `expired` holds contribute nothing."""
    live = legs if expired is None else legs.withColumns(
        {g: F.when(expired, F.lit(0.0)).otherwise(F.col(g)) for g in ("delta", "gamma", "theta", "vega", "rho")})
    out = portfolio_greeks(live, list(keys))
    return out.withColumn("is_delta_neutral", F.abs("delta") <= 0.10)


def structure_pnl(legs: DataFrame, keys=("position_id",), mark="mark") -> DataFrame:
    """P&L, P&L over the absolute premium, and current value."""
    s = legs.groupBy(*keys).agg(
        F.sum(leg_pnl(mark, "entry_price", "side", "quantity")).alias("pnl"),
        F.sum(market_value(mark, "side", "quantity")).alias("current_value"), net_premium_agg().alias("net_premium"))
    return s.withColumn("pnl_pct", F.when(F.abs("net_premium") > 0, F.col("pnl") / F.abs("net_premium")))


def with_leg_array(legs: DataFrame, keys=("position_id",)) -> DataFrame:
    leg = F.struct(F.col("strike").cast("double").alias("k"), F.when(is_call("option_type"), 1.0).otherwise(-1.0).alias("w"),
                   (F.col("side") * F.col("quantity")).cast("double").alias("q"), F.col("entry_price").cast("double").alias("p"))
    return legs.groupBy(*keys).agg(F.collect_list(leg).alias("_legs"))


def _payoff(spot: Column, legs="_legs", net: bool = True) -> Column:
    """Payoff (or P&L when `net`) of an array of legs at one expiry spot."""
    def add(acc, leg):
        gain = F.greatest(leg["w"] * (spot - leg["k"]), F.lit(0.0))
        return acc + leg["q"] * (gain - leg["p"] if net else gain) * CONTRACT_MULTIPLIER

    return F.aggregate(legs, F.lit(0.0), add)


def payoff_grid(legs: DataFrame, keys=("position_id",), low=0.5, high=1.5, points=101, spot="spot") -> DataFrame:
    """Payoff and P&L at expiry on an even grid of spots between low and high times the spot."""
    arr = with_leg_array(legs, [*keys, spot])
    step = F.col(spot) * ((high - low) / (points - 1))
    at = arr.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "grid_spot", F.col(spot) * low + F.col("point") * step)
    return at.select(*keys, "point", "grid_spot", _payoff(F.col("grid_spot"), net=False).alias("payoff"),
                     _payoff(F.col("grid_spot")).alias("pnl"))


def _knots(legs: DataFrame, keys) -> DataFrame:
    """P&L at every strike and at both ends of the search range: it is linear in between."""
    arr = with_leg_array(legs, keys)
    ks = F.transform("_legs", lambda leg: leg["k"])
    ends = F.array(F.array_min(ks) * SPOT_LOW, F.array_max(ks) * SPOT_HIGH)
    arr = arr.withColumn("_knots", F.array_sort(F.array_distinct(F.concat(ks, ends))))
    pts = F.transform("_knots", lambda s: F.struct(s.alias("s"), _payoff(s).alias("v")))
    return arr.select(*keys, pts.alias("_pts"))


def payoff_extremes(legs: DataFrame, keys=("position_id",)) -> DataFrame:
    """Greatest and least P&L over [0.01 lowest strike, 3 highest strike], exact."""
    vals = F.transform("_pts", lambda p: p["v"])
    return _knots(legs, list(keys)).select(*keys, F.array_max(vals).alias("max_profit"), F.array_min(vals).alias("max_loss"))


def breakeven_points(legs: DataFrame, keys=("position_id",)) -> DataFrame:
    """Spots where the P&L at expiry crosses zero, exact per linear segment."""
    seg = _knots(legs, list(keys)).select(
        *keys, F.explode(F.arrays_zip(F.slice("_pts", F.lit(1), F.size("_pts") - 1).alias("a"),
                                      F.slice("_pts", F.lit(2), F.size("_pts") - 1).alias("b"))).alias("_s"))
    seg = seg.select(*keys, F.col("_s.a.s").alias("s0"), F.col("_s.a.v").alias("v0"), F.col("_s.b.s").alias("s1"), F.col("_s.b.v").alias("v1"))
    cross = seg.filter((F.col("v0") * F.col("v1") < 0) | ((F.col("v0") == 0) & (F.col("v1") != 0)))
    return cross.select(*keys, (F.col("s0") - F.col("v0") * (F.col("s1") - F.col("s0")) / (F.col("v1") - F.col("v0"))).alias("breakeven"))


def expiration_span(legs: DataFrame, keys=("position_id",), date="entry_date") -> DataFrame:
    """J19."""
    a, b = F.min("expiration"), F.max("expiration")
    return legs.groupBy(*keys).agg(
        a.alias("earliest"), b.alias("latest"), (a == b).alias("same_expiration"),
        F.greatest(F.datediff(a, F.max(date)), F.lit(0)).alias("structure_dte"))


def build_from_strikes(entries: DataFrame, legs: list[tuple[str, int, str, str]]) -> DataFrame:
    """Positions from chosen strike and price columns: (option type, side, strike column, price column) per leg."""
    arr = F.array(*[
        F.struct(F.lit(i).alias("leg_no"), F.lit(t).alias("option_type"), F.lit(d).alias("side"),
                 F.col(k).cast("double").alias("strike"), F.col(p).cast("double").alias("entry_price"))
        for i, (t, d, k, p) in enumerate(legs, 1)])
    return entries.withColumn("_l", F.explode(arr)).select("*", "_l.*").drop("_l")


def short_straddle_at(entries: DataFrame) -> DataFrame:
    return build_from_strikes(entries, [("call", -1, "strike_atm", "call_price"), ("put", -1, "strike_atm", "put_price")])


def iron_condor_at(entries: DataFrame) -> DataFrame:
    return build_from_strikes(entries, [
        ("put", 1, "put_buy", "put_buy_price"), ("put", -1, "put_sell", "put_sell_price"),
        ("call", -1, "call_sell", "call_sell_price"), ("call", 1, "call_buy", "call_buy_price")])


def invalid_structures(legs: DataFrame, keys=("position_id", "structure_type")) -> DataFrame:
    """Positions whose strikes break their type's order (long put < short put <= short call < long call)."""
    c = F.col
    pick = lambda t, s: F.max(F.when((c("option_type") == t) & (c("side") == s), c("strike")))
    p = legs.groupBy(*keys).agg(pick("call", 1).alias("lc"), pick("call", -1).alias("sc"), pick("put", 1).alias("lp"), pick("put", -1).alias("sp"))
    iron = c("structure_type").isin("iron_condor", "iron_butterfly")
    ok = (c("lp") < c("sp")) & (c("sp") <= c("sc")) & (c("sc") < c("lc"))
    return p.filter(iron & ~F.coalesce(ok, F.lit(False))).select(*keys)
