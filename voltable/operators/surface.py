"""Volatility smiles per (symbol, day, dte) and interpolation between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import col_of

SLICE = ["symbol", "quote_date", "dte"]
MIN_POINTS = 5
# Admissible ranges of the five smile parameters.
BOUNDS = {"a": (0.001, 1.0), "b": (0.001, 1.0), "rho": (-0.999, 0.999), "m": (-2.0, 2.0), "sigma": (0.01, 2.0)}
VAR_CLIP = (1e-4, 4.0)
BLOCK_CELLS = 2048  # slices x points fitted together
PARAM_TYPE = "a double, b double, rho double, m double, sigma double, rmse double"


def svi_variance(k, a="a", b="b", rho="rho", m="m", sigma="sigma") -> Column:
    """a + b (rho (k - m) + sqrt((k - m)^2 + sigma^2))."""
    x = col_of(k) - col_of(m)
    return col_of(a) + col_of(b) * (col_of(rho) * x + F.sqrt(x * x + col_of(sigma) * col_of(sigma)))


def _trial(k, w, m, s):
    """Best a, b, rho for grids of (m, s) of many slices at once: k and w are (slices, points), m and s
    (slices, grid). Normal equations of the three linear parameters, then the admissible box."""
    x = k[:, None, :] - m[:, :, None]
    root = np.sqrt(x * x + (s * s)[:, :, None])
    y = w[:, None, :]
    n = float(k.shape[1])
    gram = np.empty(m.shape + (3, 3))
    gram[..., 0, 0] = n
    gram[..., 0, 1] = gram[..., 1, 0] = x.sum(-1)
    gram[..., 0, 2] = gram[..., 2, 0] = root.sum(-1)
    gram[..., 1, 1] = (x * x).sum(-1)
    gram[..., 1, 2] = gram[..., 2, 1] = (x * root).sum(-1)
    gram[..., 2, 2] = gram[..., 1, 1] + n * s * s
    gram += 1e-10 * np.eye(3)
    rhs = np.stack([np.broadcast_to(y.sum(-1), m.shape), (x * y).sum(-1), (root * y).sum(-1)], -1)
    lin = np.linalg.solve(gram, rhs[..., None])[..., 0]
    b = np.clip(lin[..., 2], *BOUNDS["b"])
    rho = np.clip(lin[..., 1] / b, *BOUNDS["rho"])
    shape = b[..., None] * (rho[..., None] * x + root)
    a = np.clip((y - shape).mean(-1), *BOUNDS["a"])
    err = ((a[..., None] + shape - y) ** 2).sum(-1)
    i = err.argmin(1)
    pick = np.arange(len(i))
    return np.stack([z[pick, i] for z in (err, a, b, rho, m, s)], 1)


def _fit_block(k: np.ndarray, iv: np.ndarray) -> np.ndarray:
    """Slices with equally many points: a grid over the two non-linear parameters, refined around each slice's best."""
    w = iv * iv
    steps = np.linspace(-1, 1, 11)
    dm, ds = (g.ravel() for g in np.meshgrid(steps, steps))
    centre_m, centre_s = np.zeros(len(k)), np.full(len(k), np.log(0.3))
    span_m, span_s, best = 0.6, 2.2, None
    for _ in range(5):
        m = np.clip(centre_m[:, None] + span_m * dm, *BOUNDS["m"])
        s = np.clip(np.exp(centre_s[:, None] + span_s * ds), *BOUNDS["sigma"])
        cand = _trial(k, w, m, s)
        best = cand if best is None else np.where((cand[:, 0] < best[:, 0])[:, None], cand, best)
        centre_m, centre_s = best[:, 4], np.log(best[:, 5])
        span_m, span_s = span_m / 3, span_s / 3
    a, b, rho, m, s = (best[:, i][:, None] for i in range(1, 6))
    x = k - m
    model = a + b * (rho * x + np.sqrt(x * x + s * s))
    rmse = np.sqrt(((np.sqrt(np.maximum(model, 0.0)) - iv) ** 2).mean(1))
    return np.column_stack([best[:, 1:], rmse])


def _fit_slices(ks: pd.Series, ivs: pd.Series) -> pd.DataFrame:
    """One Arrow batch: slices of equal length are fitted together, in blocks that bound the work arrays."""
    out = np.empty((len(ks), 6))
    sizes = ks.map(len).to_numpy()
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        block = max(1, BLOCK_CELLS // int(n))
        for i in range(0, len(rows), block):
            part = rows[i:i + block]
            out[part] = _fit_block(np.stack(ks.iloc[part].to_list()), np.stack(ivs.iloc[part].to_list()))
    return pd.DataFrame(out, columns=["a", "b", "rho", "m", "sigma", "rmse"])


def fit_vol_surface(chain: DataFrame, spot="spot", iv="vol", min_points=MIN_POINTS) -> DataFrame:
    """Smile parameters, fit error and point count per slice.

    A slice is bounded by the strikes listed for one expiry, so its points travel as one small array; a
    task fits the slices of its partition. Slices with too few points or negative minimum variance drop out.
    """
    ok = chain.filter((F.col(iv) > 0) & (F.col(iv) < 2.0) & (F.col("strike") > 0) & (F.col(spot) > 0))
    # an explicit partition count keeps AQE from merging slices that are small in bytes but costly to fit
    tasks = int(chain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = ok.repartition(tasks, *SLICE).groupBy(*SLICE).agg(
        F.avg(spot).alias("_spot"), F.array_sort(F.collect_list(F.struct("strike", F.col(iv).alias("iv")))).alias("_pts"))
    slices = slices.withColumn("num_points", F.size("_pts")).filter(F.col("num_points") >= min_points)
    logm = F.transform("_pts", lambda p: F.log(p["strike"] / F.col("_spot")))
    fit = slices.withColumn("_f", F.pandas_udf(_fit_slices, PARAM_TYPE)(logm, F.transform("_pts", lambda p: p["iv"]))).select(*SLICE, "_f.*", "num_points")
    floor = F.col("a") + F.col("b") * F.col("sigma") * F.sqrt(F.lit(1.0) - F.col("rho") * F.col("rho"))
    return fit.filter((F.col("b") >= 0) & (F.abs("rho") < 1) & (floor >= 0))


def surface_bracket(points: DataFrame, params: DataFrame, keys=("symbol", "quote_date")) -> DataFrame:
    """The fitted slices at or just below and just above each requested dte (NULL outside)."""
    keys = list(keys)
    fitted = F.struct(F.col("dte").cast("double").alias("dte"), "a", "b", "rho", "m", "sigma")
    # the fitted expiries of one symbol-day: a few dozen structs
    ladder = params.groupBy(*keys).agg(F.array_sort(F.collect_list(fitted)).alias("_sl"))
    # both sides are larger than Spark's estimate of them (exploded grids, arrays): neither must be broadcast through the driver
    joined = points.join(ladder.hint("merge"), keys)
    lo = F.array_max(F.filter("_sl", lambda x: x["dte"] <= F.col("dte")))
    hi = F.array_min(F.filter("_sl", lambda x: x["dte"] > F.col("dte")))
    return joined.withColumns({"_lo": lo, "_hi": hi}).drop("_sl")


def surface_iv(points: DataFrame, params: DataFrame, spot="spot", out="surface_iv", keys=("symbol", "quote_date")) -> DataFrame:
    """Volatility at any strike and dte, linear in variance between slices and flat outside."""
    b = surface_bracket(points, params, keys).withColumn("_k", F.log(F.col("strike") / col_of(spot)))

    def var(side):
        return svi_variance("_k", *[F.col(f"{side}.{p}") for p in ("a", "b", "rho", "m", "sigma")])

    w = (F.col("dte") - F.col("_lo.dte")) / (F.col("_hi.dte") - F.col("_lo.dte"))
    mixed = F.coalesce(var("_lo") * (F.lit(1.0) - w) + var("_hi") * w, var("_lo"), var("_hi"))
    clipped = F.least(F.greatest(mixed, F.lit(VAR_CLIP[0])), F.lit(VAR_CLIP[1]))
    return b.withColumn(out, F.sqrt(clipped)).drop("_lo", "_hi", "_k")


def smile_grid(requests: DataFrame, params: DataFrame, low=0.8, high=1.2, points=50, spot="spot", keys=("symbol", "quote_date")) -> DataFrame:
    """Strike, moneyness, log-moneyness and IV on an even strike grid per request (keys, dte, spot)."""
    step = (high - low) / (points - 1)
    g = requests.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "moneyness", F.lit(low) + F.col("point") * step)
    g = g.withColumn("strike", col_of(spot) * F.col("moneyness")).withColumn("log_moneyness", F.log("moneyness"))
    return surface_iv(g, params, spot, "iv", keys)


def calibration_report(params: DataFrame) -> DataFrame:
    return params.select(*SLICE, "a", "b", "rho", "m", "sigma", "rmse", "num_points")
