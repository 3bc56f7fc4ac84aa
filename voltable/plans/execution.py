"""Fills, costs and orders as Columns and one aggregation per position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import CONTRACT_MULTIPLIER, col_of

COMMISSION = 0.65
SPREAD_PCT = 0.02
IMPACT_LAMBDA = 0.5
MAX_IMPACT = 0.10
DEFAULT_VOLUME = 1000
MAX_FILL_RATIO = 0.10
MIN_FILL = 0.01


def fill_price(buying: Column, bid="bid", ask="ask", mid="quote_mid", current=None, entry=None, use_bid_ask=True,
               spread_pct=SPREAD_PCT) -> Column:
    """Ask or bid of a two-sided quote; else the mid, the current or the entry price, each moved
    by half the default spread against the trader."""
    def shifted(p):
        half = p * (spread_pct / 2.0)
        return F.when(buying, p + half).otherwise(F.greatest(p - half, F.lit(0.0))) if use_bid_ask else p

    b, a, m = col_of(bid), col_of(ask), col_of(mid)
    out = F.when((b > 0) & (a > 0), F.when(buying, a).otherwise(b)) if use_bid_ask else F.when(F.lit(False), a)
    out = out.when(m > 0, shifted(m))
    for x in (current, entry):
        if x is not None:
            out = out.when(col_of(x) > 0, shifted(col_of(x)))
    return out


def with_fills(legs: DataFrame, action: str, commission=COMMISSION, slippage_pct=0.0, **price_cols) -> DataFrame:
    """Per leg: fill, signed premium, slippage and commission. `action` is 'entry' or 'exit'."""
    buying = (F.col("side") > 0) if action == "entry" else (F.col("side") < 0)
    q = F.col("quantity") * CONTRACT_MULTIPLIER
    priced = legs.withColumn("buying", buying).withColumn("base_fill", fill_price(F.col("buying"), **price_cols))
    slip = F.col("base_fill") * slippage_pct
    sign = F.when(F.col("buying"), F.lit(1.0)).otherwise(F.lit(-1.0))
    # greatest() would turn an unknown price into zero
    priced = priced.withColumn("fill", F.when(F.col("base_fill").isNotNull(), F.greatest(F.col("base_fill") + sign * slip, F.lit(0.0))))
    return priced.withColumns({
        "leg_premium": -sign * F.col("fill") * q, "leg_slippage": F.abs(slip) * q, "leg_commission": F.col("quantity") * commission})


def execute(legs: DataFrame, keys: list[str], action: str, commission=COMMISSION, slippage_pct=0.0, slippage_mode="double", **price_cols) -> DataFrame:
    """One row per position: premium, commission, slippage, total cost (entry) or proceeds (exit).

    Slippage is inside the fill and, under `slippage_mode='double'`, charged once more on top.
    Positions with an unpriced leg have NULL totals.
    """
    per = with_fills(legs, action, commission, slippage_pct, **price_cols).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_legs"), F.count("fill").alias("_priced"), F.sum("quantity").alias("num_contracts"),
        F.sum("leg_premium").alias("total_premium"), F.sum("leg_slippage").alias("slippage"), F.sum("leg_commission").alias("commission"))
    whole = F.col("num_legs") == F.col("_priced")
    per = per.withColumn("total_premium", F.when(whole, F.col("total_premium")))
    extra = F.col("slippage") if slippage_mode == "double" else F.lit(0.0)
    total = {"total_cost": -F.col("total_premium") + F.col("commission") + extra} if action == "entry" else {
        "total_proceeds": F.col("total_premium") - F.col("commission") - extra}
    return per.withColumns(total).drop("_priced")


def volume_impact(size, volume, lam=IMPACT_LAMBDA, cap=MAX_IMPACT) -> Column:
    """Square-root impact, capped; the cap where nothing trades."""
    v = col_of(volume)
    return F.when(v <= 0, F.lit(cap)).otherwise(F.least(F.sqrt(col_of(size) / v) * lam, F.lit(cap)))


def execute_orders(orders: DataFrame, commission=COMMISSION, slippage_pct=0.01, use_impact=True, partial_fills=False,
                   max_fill_ratio=MAX_FILL_RATIO) -> DataFrame:
    """Market, limit and stop orders against quotes.

    Columns in: order_type (buy/sell), order_style, quantity, limit_price, stop_price, bid, ask, volume.
    Orders without a two-sided quote stay unfilled with `fill_reason='no_quote'`.
    """
    c = F.col
    buy = c("order_type") == "buy"
    mid = (c("bid") + c("ask")) / 2.0
    quoted = F.coalesce((c("bid") > 0) & (c("ask") > 0), F.lit(False))
    at_limit = F.when(buy, c("ask") <= c("limit_price")).otherwise(c("bid") >= c("limit_price"))
    at_stop = F.when(buy, mid >= c("stop_price")).otherwise(mid <= c("stop_price"))
    eligible = F.coalesce(F.when(c("order_style") == "market", F.lit(True)).when(c("order_style") == "limit", at_limit).when(c("order_style") == "stop", at_stop), F.lit(False))
    volume = F.coalesce(c("volume"), F.lit(DEFAULT_VOLUME))
    fillable = F.least(c("quantity"), F.greatest(F.floor(volume * max_fill_ratio), F.lit(1))) if partial_fills else c("quantity")
    o = orders.withColumn("fill_reason", F.when(~quoted, F.lit("no_quote")).when(~eligible, F.lit("not_marketable")).otherwise(F.lit("filled")))
    o = o.withColumn("filled_quantity", F.when(c("fill_reason") == "filled", fillable).otherwise(F.lit(0)).cast("bigint"))
    o = o.withColumns({
        "unfilled_quantity": c("quantity") - c("filled_quantity"),
        "volume_impact": F.when(c("filled_quantity") > 0, volume_impact("filled_quantity", volume)).otherwise(F.lit(0.0)) if use_impact else F.lit(0.0),
        "_base": F.when(c("order_style") == "limit", F.when(buy, F.least("ask", "limit_price")).otherwise(F.greatest("bid", "limit_price"))).otherwise(F.when(buy, c("ask")).otherwise(c("bid")))})
    sign = F.when(buy, F.lit(1.0)).otherwise(F.lit(-1.0))
    done, q = c("filled_quantity") > 0, c("filled_quantity") * CONTRACT_MULTIPLIER
    raw = c("_base") + sign * (c("_base") * slippage_pct + mid * c("volume_impact"))
    o = o.withColumns({
        "fill_price": F.when(done, F.greatest(raw, F.lit(MIN_FILL))).otherwise(F.lit(0.0)),
        "commission": c("filled_quantity") * commission,
        "slippage": F.when(done, c("_base") * slippage_pct * q).otherwise(F.lit(0.0)),
        "impact_cost": F.when(done, mid * c("volume_impact") * q).otherwise(F.lit(0.0))})
    premium, fees = c("fill_price") * q, c("commission") + c("slippage") + c("impact_cost")
    o = o.withColumns({
        "total_cost": F.when(done & buy, premium + fees).otherwise(F.lit(0.0)), "total_proceeds": F.when(done & ~buy, premium - fees).otherwise(F.lit(0.0)),
        "fill_rate": F.when(c("quantity") > 0, c("filled_quantity") / c("quantity")).otherwise(F.lit(0.0))})
    spread = F.when(done & (premium > 0), (c("slippage") + c("impact_cost")) / premium).otherwise(F.lit(0.0))
    return o.withColumn("execution_quality", F.lit(1.0) - spread).drop("_base")


def execute_structures(legs: DataFrame, keys: list[str], action="entry", **options) -> DataFrame:
    """Market orders for all legs of a position and their totals."""
    buying = (F.col("side") > 0) if action == "entry" else (F.col("side") < 0)
    orders = legs.withColumns({
        "order_type": F.when(buying, F.lit("buy")).otherwise(F.lit("sell")), "order_style": F.lit("market"),
        "limit_price": F.lit(None).cast("double"), "stop_price": F.lit(None).cast("double")})
    x = execute_orders(orders, **options)
    signed = F.when(F.col("order_type") == "sell", F.col("total_proceeds")).otherwise(
        F.col("commission") + F.col("slippage") + F.col("impact_cost") - F.col("total_cost"))
    per = x.groupBy(*keys).agg(
        F.sum("total_cost").alias("total_cost"), F.sum(signed).alias("total_premium"), F.sum("commission").alias("commission"),
        F.sum("slippage").alias("slippage"), F.sum("impact_cost").alias("impact_cost"), F.sum("filled_quantity").alias("filled_contracts"),
        F.sum("unfilled_quantity").alias("unfilled_contracts"))
    cost = F.col("slippage") + F.col("impact_cost")
    return per.withColumn("execution_quality", F.lit(1.0) - cost / F.greatest(F.abs("total_premium"), F.lit(1.0)))


def execution_summary(executions: DataFrame, keys: list[str]) -> DataFrame:
    """over executions with (kind, commission, slippage, num_contracts)."""
    return executions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_executions"), F.count_if(F.col("kind") == "entry").alias("num_entries"), F.count_if(F.col("kind") == "exit").alias("num_exits"),
        F.sum("commission").alias("total_commissions"), F.sum("slippage").alias("total_slippage"),
        F.avg("commission").alias("avg_commission"), F.sum("num_contracts").alias("total_contracts"))


def order_statistics(filled: DataFrame, keys: list[str]) -> DataFrame:
    """F22 for K11 output: fill rate, impact and quality."""
    some = F.col("filled_quantity") > 0
    return filled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_executions"), F.count_if(F.col("unfilled_quantity") > 0).alias("num_partial_fills"), F.avg("fill_rate").alias("avg_fill_rate"),
        F.coalesce(F.avg(F.when(some, F.col("volume_impact"))), F.lit(0.0)).alias("avg_volume_impact"),
        F.coalesce(F.max(F.when(some, F.col("volume_impact"))), F.lit(0.0)).alias("max_volume_impact"),
        F.coalesce(F.avg(F.when(some, F.col("execution_quality"))), F.lit(0.0)).alias("avg_execution_quality"),
        F.sum("impact_cost").alias("total_impact_cost"), F.sum("commission").alias("total_commission"))
