"""Vectorised pandas kernels where no closed form exists.

Each kernel works on one Arrow batch, row by row independent, so Spark may cut and move batches freely.
Rows with a cheap answer (expired, European-equivalent) are settled in Columns and never reach Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.common import EPSILON, col_of, phi
from ..functions.normal import np_norm_cdf
from ..functions.pricing import discounted_intrinsic, price_chain

IV_LOW, IV_HIGH = 0.001, 5.0
IV_START = 0.30
IV_TOL = 1e-8
IV_STEPS = 100
TREE_STEPS = 200
TREE_BLOCK = 2048  # rows priced together: bounds the (rows x nodes) work array
SPOT_BUMP, VOL_BUMP, RATE_BUMP, DAY_BUMP = 0.01, 0.01, 0.01, 1.0 / 365.0


def _bs(s, k, t, r, v, w, q=0.0):
    """European price and vega of arrays; w is +1 for calls, -1 for puts."""
    sd = v * np.sqrt(t)
    d1 = (np.log(s / k) + (r - q + 0.5 * v * v) * t) / sd
    d2 = d1 - sd
    price = w * (s * np.exp(-q * t) * np_norm_cdf(w * d1) - k * np.exp(-r * t) * np_norm_cdf(w * d2))
    vega = s * np.exp(-q * t) * np.exp(-0.5 * d1 * d1) / np.sqrt(2 * np.pi) * np.sqrt(t)
    return price, vega


def np_implied_vol(price, s, k, t, r, w) -> np.ndarray:
    """Safeguarded Newton: a step that leaves the bracket is replaced by a bisection; NaN above the bracket."""
    lo, hi = np.full_like(price, IV_LOW), np.full_like(price, IV_HIGH)
    top = _bs(s, k, t, r, hi, w)[0]
    v = np.full_like(price, IV_START)
    for _ in range(IV_STEPS):
        p, vega = _bs(s, k, t, r, v, w)
        diff = p - price
        lo, hi = np.where(diff < 0, v, lo), np.where(diff > 0, v, hi)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = v - diff / vega
        mid = 0.5 * (lo + hi)
        nxt = np.where((step > lo) & (step < hi) & np.isfinite(step), step, mid)
        done = (np.abs(diff) < IV_TOL * 1e-3) | (hi - lo < 1e-14)
        if done.all():
            break
        v = np.where(done, v, nxt)
    return np.where(price > top, np.nan, v)


def implied_vol(df: DataFrame, price="mid", spot="spot", strike="strike", t="t", rate=0.04, option_type="option_type",
                out="iv", reason="iv_reason") -> DataFrame:
    """Volatility implied by a price, with the reason where there is none.

    Below the intrinsic value, expired, negative or above the largest admissible price give NULL; a
    (nearly) zero price gives the lower bound.
    """

    @F.pandas_udf("double")
    def solve(p: pd.Series, s: pd.Series, k: pd.Series, tt: pd.Series, r: pd.Series, w: pd.Series) -> pd.Series:
        out = np.full(len(p), np.nan)
        ok = (p.notna() & s.notna() & k.notna() & tt.notna() & r.notna()).to_numpy()
        if ok.any():
            args = [x.to_numpy(dtype=float)[ok] for x in (p, s, k, tt, r, w)]
            out[ok] = np_implied_vol(*args)
        return pd.Series(out)

    p, tt = col_of(price), col_of(t)
    base = df.withColumn("_why", F.when(p.isNull() | (p < 0), F.lit("invalid_price")).when(tt < EPSILON, F.lit("expired"))
                         .when(p < discounted_intrinsic(spot, strike, t, rate, option_type) - EPSILON, F.lit("below_intrinsic"))
                         .when(p < EPSILON, F.lit("zero_price")).otherwise(F.lit("ok")))
    # NULL inputs pass through the kernel untouched
    gate = F.when(F.col("_why") == "ok", p)
    base = base.withColumn("_iv", F.nanvl(solve(gate, col_of(spot), col_of(strike), tt, col_of(rate), phi(option_type)), F.lit(None)))
    return base.withColumns({
        out: F.when(F.col("_why") == "zero_price", F.lit(IV_LOW)).otherwise(F.col("_iv")),
        reason: F.when((F.col("_why") == "ok") & F.col("_iv").isNull(), F.lit("above_max")).otherwise(F.col("_why")),
    }).drop("_why", "_iv")


def np_american_quadratic(s, k, t, r, v, w, q) -> np.ndarray:
    """Quadratic approximation for calls (w = 1) and puts (w = -1): one bisection for all critical prices."""
    euro = _bs(s, k, t, r, v, w, q)[0]
    m, n = 2 * r / v**2, 2 * (r - q) / v**2
    with np.errstate(divide="ignore", invalid="ignore"):
        root = np.sqrt((n - 1) ** 2 + 4 * m / (1 - np.exp(-r * t)))
    power = (1 - n + w * root) / 2

    def premium(x):
        d1 = (np.log(x / k) + (r - q + 0.5 * v * v) * t) / (v * np.sqrt(t))
        return w * x / power * (1 - np.exp(-q * t) * np_norm_cdf(w * d1))

    def gap(x):
        return w * (x - k) - _bs(x, k, t, r, v, w, q)[0] - premium(x)

    lo, hi = np.where(w > 0, k, 1e-10), np.where(w > 0, k * 10.0, k)
    glo, ghi = gap(lo), gap(hi)
    bracketed = (glo * ghi <= 0) & np.isfinite(glo) & np.isfinite(ghi)
    for _ in range(120):
        mid = 0.5 * (lo + hi)
        same = np.sign(gap(mid)) == np.sign(glo)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
    x = 0.5 * (lo + hi)
    held = euro + premium(x) * (s / x) ** power
    exercised = w * (s - x) >= 0
    return np.where(bracketed, np.where(exercised, w * (s - k), held), euro)


def american_price_baw(df: DataFrame, spot="spot", strike="strike", t="t", rate=0.04, sigma="vol", q=0.0,
                       option_type="option_type", out="american") -> DataFrame:
    """Quadratic approximation with dividend yield. Calls without yield and expired rows stay in Columns;
    puts at a non-positive rate are European."""

    @F.pandas_udf("double")
    def solve(s: pd.Series, k: pd.Series, tt: pd.Series, r: pd.Series, v: pd.Series, w: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(s), np.nan)
        ok = s.notna().to_numpy()
        if ok.any():
            a = [x.to_numpy(dtype=float)[ok] for x in (s, k, tt, r, v, w, y)]
            put_flat = (a[5] < 0) & (a[3] <= 0)
            with np.errstate(all="ignore"):
                est = np_american_quadratic(*a)
                est = np.where(put_flat, _bs(*a[:6], a[6])[0], est)
            out[ok] = est
        return pd.Series(out)

    w, y, tt = phi(option_type), col_of(q), col_of(t)
    base = price_chain(df, spot, strike, t, rate, sigma, option_type, out="_euro")
    cheap = F.when(tt < EPSILON, F.greatest(w * (col_of(spot) - col_of(strike)), F.lit(0.0))).when((w > 0) & (y < EPSILON), F.col("_euro"))
    base = base.withColumn("_cheap", cheap)
    gate = F.when(F.col("_cheap").isNull(), col_of(spot))
    hard = F.nanvl(solve(gate, col_of(strike), tt, col_of(rate), col_of(sigma), w, y), F.lit(None))
    return base.withColumn(out, F.coalesce("_cheap", hard)).drop("_euro", "_cheap")


def np_tree(s, k, t, r, v, w, steps: int, american: bool = True) -> np.ndarray:
    """Recombining binomial tree for many rows at once: (rows x nodes) backward induction in blocks."""
    out = np.empty(len(s))
    nodes = np.arange(steps + 1)
    for a in range(0, len(s), TREE_BLOCK):
        b = slice(a, a + TREE_BLOCK)
        s0, k0, t0, r0, v0, w0 = (x[b][:, None] for x in (s, k, t, r, v, w))
        dt = t0 / steps
        up = v0 * np.sqrt(dt)
        with np.errstate(all="ignore"):
            p = (np.exp(r0 * dt) - np.exp(-up)) / (np.exp(up) - np.exp(-up))
            disc = np.exp(-r0 * dt)
            spots = s0 * np.exp(up * (steps - 2 * nodes)[None, :])
            val = np.maximum(w0 * (spots - k0), 0.0)
            for level in range(steps - 1, -1, -1):
                val = disc * (p * val[:, :-1] + (1 - p) * val[:, 1:])
                if american:
                    spots = spots[:, :-1] * np.exp(-up)
                    val = np.maximum(val, w0 * (spots - k0))
            fwd = np.maximum(w0 * (s0 * np.exp(r0 * t0) - k0), 0.0) * np.exp(-r0 * t0)
        res = np.where((p > 0) & (p < 1), val, np.nan)
        res = np.where(v0 <= EPSILON, fwd, res)
        out[b] = np.where(t0 <= EPSILON, np.maximum(w0 * (s0 - k0), 0.0), res)[:, 0]
    return out


def _dividend_adjusted(df: DataFrame, spot, t, rate, dividends) -> DataFrame:
    """Spot less the present value of discrete dividends: `dividends` is an array<struct<time, amount>> column."""
    s = col_of(spot)
    if dividends is None:
        return df.withColumn("_adj", s)
    pv = F.aggregate(
        F.filter(col_of(dividends), lambda d: (d["time"] > 0) & (d["time"] <= col_of(t))), F.lit(0.0),
        lambda acc, d: acc + d["amount"] * F.exp(-col_of(rate) * d["time"]))
    return df.withColumn("_adj", F.greatest(s - F.coalesce(pv, F.lit(0.0)), F.lit(EPSILON)))


def _tree_udf(steps: int, american: bool):
    @F.pandas_udf("double")
    def tree(s: pd.Series, k: pd.Series, tt: pd.Series, r: pd.Series, v: pd.Series, w: pd.Series) -> pd.Series:
        out = np.full(len(s), np.nan)
        ok = (s.notna() & k.notna() & tt.notna() & v.notna()).to_numpy()
        if ok.any():
            out[ok] = np_tree(*[x.to_numpy(dtype=float)[ok] for x in (s, k, tt, r, v, w)], steps, american)
        return pd.Series(out)

    return tree


def american_price_tree(df: DataFrame, spot="spot", strike="strike", t="t", rate=0.04, sigma="vol", option_type="option_type",
                        steps=TREE_STEPS, dividends=None, american=True, always_tree=False, out="tree") -> DataFrame:
    """Binomial price. A call without dividends is worth its European price and stays in Columns."""
    w = phi(option_type)
    base = price_chain(_dividend_adjusted(df, spot, t, rate, dividends), spot, strike, t, rate, sigma, option_type, out="_euro")
    cheap = F.when((w > 0) & F.lit(dividends is None and not always_tree and american), F.col("_euro"))
    base = base.withColumn("_cheap", cheap)
    gate = F.when(F.col("_cheap").isNull(), F.col("_adj"))
    hard = _tree_udf(steps, american)(gate, col_of(strike), col_of(t), col_of(rate), col_of(sigma), w)
    return base.withColumn(out, F.coalesce("_cheap", F.nanvl(hard, F.lit(None)))).drop("_euro", "_cheap", "_adj")


def american_greeks(df: DataFrame, spot="spot", strike="strike", t="t", rate=0.04, sigma="vol", option_type="option_type",
                    steps=TREE_STEPS, dividends=None) -> DataFrame:
    """Bump-and-reprice Greeks per 1 % spot, one day, one volatility point and one rate point.

    vega and rho are the price change of that one-point bump (no further division by 100).
    """

    @F.pandas_udf("price double, delta double, gamma double, theta double, vega double, rho double")
    def bump(s: pd.Series, pv: pd.Series, k: pd.Series, tt: pd.Series, r: pd.Series, v: pd.Series, w: pd.Series) -> pd.DataFrame:
        s, pv, k, tt, r, v, w = (x.to_numpy(dtype=float) for x in (s, pv, k, tt, r, v, w))

        def price(ds=0.0, dtt=0.0, dv=0.0, dr=0.0):
            return np_tree(np.maximum(s + ds - pv, EPSILON), k, np.maximum(tt - dtt, 0.0), r + dr, v + dv, w, steps)

        h = np.maximum(s * SPOT_BUMP, EPSILON)
        mid, up, down = price(), price(ds=h), price(ds=-h)
        theta = np.where(tt > DAY_BUMP, price(dtt=DAY_BUMP) - mid, -mid)
        return pd.DataFrame({
            "price": mid, "delta": (up - down) / (2 * h), "gamma": (up - 2 * mid + down) / h**2, "theta": theta,
            "vega": price(dv=VOL_BUMP) - mid, "rho": price(dr=RATE_BUMP) - mid})

    base = _dividend_adjusted(df, spot, t, rate, dividends)
    g = bump(col_of(spot), col_of(spot) - F.col("_adj"), col_of(strike), col_of(t), col_of(rate), col_of(sigma), phi(option_type))
    return base.withColumn("_g", g).withColumns({f"am_{n}": F.col(f"_g.{n}") for n in
                                                 ("price", "delta", "gamma", "theta", "vega", "rho")}).drop("_g", "_adj")


def early_exercise_premium(df: DataFrame, steps=TREE_STEPS, out="early_exercise", **cols) -> DataFrame:
    """American less European tree price, not below zero."""
    a = american_price_tree(df, steps=steps, always_tree=True, out="_a", **cols)
    b = american_price_tree(a, steps=steps, american=False, always_tree=True, out="_e", **cols)
    return b.withColumn(out, F.greatest(F.col("_a") - F.col("_e"), F.lit(0.0))).drop("_a", "_e")


def exercise_boundary(df: DataFrame, strike="strike", horizon="t", rate=0.04, sigma="vol", points=10, steps=TREE_STEPS,
                      iterations=30) -> DataFrame:
    """Critical spot of an American put at evenly spaced times to expiry (infinite for a call).

    Bisection keeps moving towards the largest spot at which exercise is optimal.
    """

    @F.pandas_udf("double")
    def search(k: pd.Series, tt: pd.Series, r: pd.Series, v: pd.Series) -> pd.Series:
        k, tt, r, v = (x.to_numpy(dtype=float) for x in (k, tt, r, v))
        lo, hi, w = np.full(len(k), 0.01), k * 2.0, np.full(len(k), -1.0)
        for _ in range(iterations):
            mid = 0.5 * (lo + hi)
            held = np_tree(mid, k, tt, r, v, w, steps) - np.maximum(k - mid, 0.0) > 1e-6
            lo, hi = np.where(held, lo, mid), np.where(held, mid, hi)
        return pd.Series(0.5 * (lo + hi))

    grid = df.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "boundary_t", F.lit(0.01) + (col_of(horizon) - 0.01) * F.col("point") / float(points - 1))
    return grid.withColumn("boundary", search(col_of(strike), F.col("boundary_t"), col_of(rate), col_of(sigma)))


