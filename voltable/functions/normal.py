"""Standard normal density, distribution and quantile as Columns (no erf in Spark SQL)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from .common import col_of

# Rational approximation of the normal CDF (Hart 1968, as given by West 2005).
CDF_NUM = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_DEN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
CDF_SPLIT = 7.07106781186547
SQRT_2PI = 2.506628274631

# Inverse normal CDF (Acklam).
PPF_A = (
    -3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
    1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00,
)
PPF_B = (
    -5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
    6.680131188771972e+01, -1.328068155288572e+01,
)
PPF_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
    -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00,
)
PPF_D = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
    3.754408661907416e+00,
)
PPF_LOW = 0.02425


def _horner(x, coeffs):
    acc = coeffs[0]
    for k in coeffs[1:]:
        acc = acc * x + k
    return acc


def norm_pdf(x) -> Column:
    x = col_of(x)
    return F.exp(x * x * -0.5) / F.sqrt(F.lit(2.0 * np.pi))


def norm_cdf(x) -> Column:
    """P(Z <= x). On a hot path use `cdf_terms` and `cdf_from`, which evaluate |x| and its density once."""
    x = col_of(x)
    return cdf_from(x, F.abs(x), F.exp(x * x * -0.5))


def cdf_terms(x) -> tuple[Column, Column]:
    """|x| and exp(-x^2 / 2), to be materialised as columns before `cdf_from`."""
    x = col_of(x)
    return F.abs(x), F.exp(x * x * -0.5)


def cdf_from(x, a, e) -> Column:
    """The distribution from prepared terms. The text stays small: methods beyond 8000 bytes of code
    are not compiled by the JVM, and this formula occurs twice per priced row."""
    x, a, e = col_of(x), col_of(a), col_of(e)
    centre = e * _horner(a, tuple(map(F.lit, CDF_NUM))) / _horner(a, tuple(map(F.lit, CDF_DEN)))
    # beyond the split the whole tail is below 1e-12: three terms of the asymptotic series
    s = F.pow(a, F.lit(-2.0))
    tail = e * F.pow(a, F.lit(-1.0)) * (F.lit(1.0) - s + s * s * 3.0) * F.lit(1.0 / SQRT_2PI)
    low = F.when(a < CDF_SPLIT, centre).when(a < 37.0, tail).otherwise(F.lit(0.0))
    return F.when(x > 0, F.lit(1.0) - low).otherwise(low)


def norm_ppf(p) -> Column:
    """Quantile of the standard normal for 0 < p < 1, else NULL."""
    p = col_of(p)
    one = F.lit(1.0)

    def outer(q):
        u = F.sqrt(F.lit(-2.0) * F.log(q))
        return _horner(u, tuple(map(F.lit, PPF_C))) / (_horner(u, tuple(map(F.lit, PPF_D))) * u + one)

    z = p - F.lit(0.5)
    s = z * z
    inner = _horner(s, tuple(map(F.lit, PPF_A))) * z / (_horner(s, tuple(map(F.lit, PPF_B))) * s + one)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < PPF_LOW, outer(p))
        .when(p > 1.0 - PPF_LOW, -outer(one - p))
        .otherwise(inner)
    )


def np_norm_cdf(x: np.ndarray) -> np.ndarray:
    """The same approximation on an Arrow batch, for the pandas kernels."""
    x = np.asarray(x, dtype=float)
    a = np.minimum(np.abs(x), 40.0)
    e = np.exp(-0.5 * a * a)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + k / tail
    low = np.where(
        a < CDF_SPLIT, e * _horner(a, CDF_NUM) / _horner(a, CDF_DEN), e / tail / SQRT_2PI
    )
    low = np.where(a > 37.0, 0.0, low)
    return np.where(x > 0, 1.0 - low, low)
