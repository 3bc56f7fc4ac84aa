"""Closed-form European prices and Greeks.

All edge cases of the scalar rules (spot, strike, time or volatility at zero) collapse into one
degenerate branch: the discounted intrinsic value. `price_chain` and `enrich_greeks` materialise
d1/d2 and N(d1)/N(d2) in their own projections so that Catalyst keeps one evaluation of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import EPSILON, col_of, fenced, phi
from .normal import cdf_from, cdf_terms, norm_cdf

DAYS_PER_YEAR = 365.0
TINY = 1e-300
INV_SQRT_2PI = 0.3989422804014327


def d1_d2(spot, strike, t, rate, sigma) -> tuple[Column, Column]:
    """d1 and d2; both +inf/-inf/0 by the sign of log-moneyness when t or sigma vanish."""
    s, k, t, r, v = map(col_of, (spot, strike, t, rate, sigma))
    lm = F.log(F.greatest(s, F.lit(TINY)) / F.greatest(k, F.lit(TINY)))
    width = v * F.sqrt(t)
    flat = (t < EPSILON) | (v < EPSILON)
    empty = (s < EPSILON) | (k < EPSILON)
    edge = (
        F.when(empty | (lm == 0), F.lit(0.0))
        .when(lm > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    d1 = F.when(flat, edge).otherwise((lm + (r + v * v * 0.5) * t) / width)
    return d1, F.when(flat, edge).otherwise(d1 - width)


def discounted_intrinsic(spot, strike, t, rate, option_type) -> Column:
    s, k, t, r = map(col_of, (spot, strike, t, rate))
    return F.greatest(phi(option_type) * (s - k * F.exp(-r * t)), F.lit(0.0))


def _degenerate(s, k, t, v) -> Column:
    return (s < EPSILON) | (k < EPSILON) | (t < EPSILON) | (v < EPSILON)


def bs_price(spot, strike, t, rate, sigma, option_type) -> Column:
    """European price of one row as a single expression (prefer `price_chain` on tables)."""
    s, k, t, r, v = map(col_of, (spot, strike, t, rate, sigma))
    w = phi(option_type)
    d1, d2 = d1_d2(s, k, t, r, v)
    value = w * (s * norm_cdf(w * d1) - k * F.exp(-r * t) * norm_cdf(w * d2))
    return F.when(_degenerate(s, k, t, v), discounted_intrinsic(s, k, t, r, option_type)).otherwise(
        F.greatest(value, F.lit(0.0))
    )


def _prepared(df: DataFrame, spot, strike, t, rate, sigma, option_type) -> DataFrame:
    s, k, tt, r, v = map(col_of, (spot, strike, t, rate, sigma))
    base = df.withColumns(
        {"_s": s, "_k": k, "_t": tt, "_r": r, "_v": v, "_w": phi(option_type)}
    ).withColumns(
        {
            "_flat": _degenerate(F.col("_s"), F.col("_k"), F.col("_t"), F.col("_v")),
            "_disc": F.exp(-F.col("_r") * F.col("_t")),
            # the floor on volatility serves vega and rho, which are defined at zero volatility
            "_vf": F.greatest(F.col("_v"), F.lit(EPSILON)),
        }
    )
    d1, d2 = d1_d2("_s", "_k", "_t", "_r", "_vf")
    base = base.withColumn("_d1", d1).withColumn(
        "_d2", F.when(F.col("_t") < EPSILON, F.col("_d1")).otherwise(F.col("_d1") - F.col("_vf") * F.sqrt("_t"))
    )
    base = base.withColumns({"_x1": F.col("_w") * F.col("_d1"), "_x2": F.col("_w") * F.col("_d2")})
    (a1, e1), (a2, e2) = cdf_terms("_x1"), cdf_terms("_x2")
    base = base.withColumns({"_a1": a1, "_e1": e1, "_a2": a2, "_e2": e2})
    # the density is even, so |d1| = |x1| gives it for free
    return base.withColumns({"_n1": cdf_from("_x1", "_a1", "_e1"), "_n2": cdf_from("_x2", "_a2", "_e2"), "_pdf": F.col("_e1") * INV_SQRT_2PI})


_SCRATCH = ("_s", "_k", "_t", "_r", "_v", "_w", "_flat", "_disc", "_vf", "_d1", "_d2", "_x1", "_x2", "_a1", "_e1", "_a2", "_e2", "_n1", "_n2", "_pdf")


def _price_column(zero_vol: str) -> Column:
    degenerate = F.greatest(F.col("_w") * (F.col("_s") - F.col("_k") * F.col("_disc")), F.lit(0.0))
    if zero_vol == "undiscounted":
        edge = (F.col("_s") >= EPSILON) & (F.col("_k") >= EPSILON)
        degenerate = F.when(edge, F.greatest(F.col("_w") * (F.col("_s") - F.col("_k")), F.lit(0.0))).otherwise(degenerate)
    value = F.col("_w") * (F.col("_s") * F.col("_n1") - F.col("_k") * F.col("_disc") * F.col("_n2"))
    return F.when(F.col("_flat"), degenerate).otherwise(F.greatest(value, F.lit(0.0)))


def _greek_columns() -> dict[str, Column]:
    s, k, t, r, v, w = (F.col(c) for c in ("_s", "_k", "_t", "_r", "_v", "_w"))
    zero = F.lit(0.0)
    no_time = (t < EPSILON) | (s < EPSILON) | (k < EPSILON)
    call_edge = (
        F.when(s < EPSILON, zero).when(k < EPSILON, F.lit(1.0)).when(s > k, F.lit(1.0))
        .when(s == k, F.lit(0.5)).otherwise(zero)
    )
    carry = w * r * k * F.col("_disc")
    return {
        "delta": F.when(F.col("_flat"), call_edge - F.when(w < 0, F.lit(1.0)).otherwise(zero)).otherwise(w * F.col("_n1")),
        "gamma": F.when(F.col("_flat"), zero).otherwise(F.col("_pdf") / (s * v * F.sqrt(t))),
        "theta": F.when(no_time, zero)
        .when(v < EPSILON, F.when(w * (s - k) > 0, -carry).otherwise(zero))
        .otherwise(-s * F.col("_pdf") * v / (F.sqrt(t) * 2.0) - carry * F.col("_n2")) / DAYS_PER_YEAR,
        "vega": F.when(no_time, zero).otherwise(s * F.col("_pdf") * F.sqrt(t)) / 100.0,
        "rho": F.when((t < EPSILON) | (k < EPSILON), zero).otherwise(w * k * t * F.col("_disc") * F.col("_n2")) / 100.0,
    }


def price_chain(
    df: DataFrame, spot="spot", strike="strike", t="t", rate=0.04, sigma="vol",
    option_type="option_type", out: str = "price", zero_vol: str = "discounted",
) -> DataFrame:
    """Theoretical price per row. `zero_vol='undiscounted'` is the whole-chain convention
    in which a row without time or volatility is worth S - K."""
    base = _prepared(df, spot, strike, t, rate, sigma, option_type)
    return fenced(base, {out: _price_column(zero_vol)}).drop(*_SCRATCH)


def enrich_greeks(
    df: DataFrame, spot="spot", strike="strike", t="t", rate=0.04, sigma="vol",
    option_type="option_type", price: str | None = None, prefix: str = "",
) -> DataFrame:
    """Delta, gamma, theta (per calendar day), vega and rho (per 1 %), optionally the price."""
    base = _prepared(df, spot, strike, t, rate, sigma, option_type)
    cols = {prefix + n: c for n, c in _greek_columns().items()}
    if price:
        cols[price] = _price_column("discounted")
    return fenced(base, cols).drop(*_SCRATCH)
