"""Identities and brute-force checks of prices, Greeks, kernels and smiles."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltable.functions import instrument as ins, normal
from voltable.functions.pricing import enrich_greeks, price_chain
from voltable.operators import kernels as ker, structures as st, surface as sf


def N(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def bs(s, k, t, r, v, call):
    d1 = (math.log(s / k) + (r + v * v / 2) * t) / (v * math.sqrt(t))
    d2 = d1 - v * math.sqrt(t)
    c = s * N(d1) - k * math.exp(-r * t) * N(d2)
    return c if call else c - s + k * math.exp(-r * t)


def brute_tree(s, k, t, r, v, call, n, american=True, pv=0.0):
    s, dt_ = s - pv, t / n
    u = math.exp(v * math.sqrt(dt_))
    p, disc = (math.exp(r * dt_) - 1 / u) / (u - 1 / u), math.exp(-r * dt_)
    pay = (lambda x: max(x - k, 0.0)) if call else (lambda x: max(k - x, 0.0))
    vals = [pay(s * u ** (n - 2 * j)) for j in range(n + 1)]
    for i in range(n - 1, -1, -1):
        vals = [disc * (p * vals[j] + (1 - p) * vals[j + 1]) for j in range(i + 1)]
        if american:
            vals = [max(x, pay(s * u ** (i - 2 * j))) for j, x in enumerate(vals)]
    return vals[0]


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(float(s), float(k), t, v, o) for s in (80, 100, 125) for k in (70, 100, 130) for t in (0.05, 0.5, 2.0) for v in (0.1, 0.35, 0.9) for o in ("call", "put")]
    return spark.createDataFrame(rows, "spot double, strike double, t double, vol double, option_type string")


def test_normal_functions():
    x = np.linspace(-10, 10, 4001)
    exact = np.array([N(v) for v in x])
    assert np.abs(normal.np_norm_cdf(x) - exact).max() < 1e-14


def test_column_cdf_and_quantile(spark):
    rows = spark.createDataFrame([(float(x),) for x in np.linspace(-9, 9, 181)], "x double").select("x", normal.norm_cdf("x").alias("p")).withColumn("z", normal.norm_ppf("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(N(r.x), abs=1e-14)
        if abs(r.x) < 6:
            assert r.z == pytest.approx(r.x, abs=1e-6)


def test_prices_match_closed_form(grid):
    for r in price_chain(grid, rate=0.03).collect():
        assert r.price == pytest.approx(bs(r.spot, r.strike, r.t, 0.03, r.vol, r.option_type == "call"), abs=1e-10)


def test_greeks_match_finite_differences(grid):
    h = 1e-4
    for r in enrich_greeks(grid, rate=0.03).collect():
        call, a = r.option_type == "call", (r.spot, r.strike, r.t, 0.03, r.vol)
        f = lambda s=a[0], t=a[2], q=a[3], v=a[4]: bs(s, a[1], t, q, v, call)
        assert r.delta == pytest.approx((f(s=a[0] + h) - f(s=a[0] - h)) / (2 * h), abs=1e-6)
        assert r.gamma == pytest.approx((f(s=a[0] + 0.01) - 2 * f() + f(s=a[0] - 0.01)) / 1e-4, abs=1e-5)
        assert r.vega == pytest.approx((f(v=a[4] + h) - f(v=a[4] - h)) / (2 * h) / 100, abs=1e-6)
        assert r.rho == pytest.approx((f(q=a[3] + h) - f(q=a[3] - h)) / (2 * h) / 100, abs=1e-6)
        assert r.theta == pytest.approx(-(f(t=a[2] + 1e-5) - f(t=a[2] - 1e-5)) / 2e-5 / 365, abs=1e-5)


def test_edge_rules(spark):
    rows = [(0.0, 100.0, 1.0, 0.2, "put"), (100.0, 0.0, 1.0, 0.2, "call"), (110.0, 100.0, 0.0, 0.2, "call"), (100.0, 100.0, 0.0, 0.2, "put"), (100.0, 95.0, 1.0, 0.0, "call")]
    df = spark.createDataFrame(rows, "spot double, strike double, t double, vol double, option_type string")
    g = enrich_greeks(df, rate=0.05, price="price").collect()
    assert [round(r.price, 6) for r in g] == [round(100 * math.exp(-0.05), 6), 100.0, 10.0, 0.0, round(100 - 95 * math.exp(-0.05), 6)]
    assert [r.delta for r in g] == [-1.0, 1.0, 1.0, -0.5, 1.0]
    assert [r.gamma for r in g] == [0.0] * 5 and g[2].theta == 0.0


def test_implied_vol_round_trip(grid):
    priced = price_chain(grid, rate=0.04)
    for r in ker.implied_vol(priced, "price").collect():
        intrinsic = max((1 if r.option_type == "call" else -1) * (r.spot - r.strike * math.exp(-0.04 * r.t)), 0)
        if r.price - intrinsic > 1e-3:
            assert r.iv == pytest.approx(r.vol, abs=1e-6) and r.iv_reason == "ok"


def test_tree_matches_brute_force_with_and_without_dividends(grid):
    divs = F.array(F.struct(F.lit(0.04).alias("time"), F.lit(1.5).alias("amount")), F.struct(F.lit(9.0).alias("time"), F.lit(50.0).alias("amount")))
    small = grid.filter("vol > 0.2").withColumn("divs", divs)
    pv = 1.5 * math.exp(-0.04 * 0.04)
    for r in ker.american_price_tree(small, steps=25, dividends="divs").collect():
        assert r.tree == pytest.approx(brute_tree(r.spot, r.strike, r.t, 0.04, r.vol, r.option_type == "call", 25, pv=pv), abs=1e-9)
    for r in ker.american_price_tree(small, steps=25).filter("option_type = 'put'").collect():
        assert r.tree == pytest.approx(brute_tree(r.spot, r.strike, r.t, 0.04, r.vol, False, 25), abs=1e-9)


def test_american_greeks_and_premium(grid):
    small = grid.filter("strike = 100 and vol = 0.35")
    for r in ker.american_greeks(small, steps=40).collect():
        call = r.option_type == "call"
        f = lambda s=r.spot, t=r.t, q=0.04, v=r.vol: brute_tree(s, r.strike, t, q, v, call, 40)
        h = r.spot * 0.01
        assert r.am_delta == pytest.approx((f(s=r.spot + h) - f(s=r.spot - h)) / (2 * h), abs=1e-9)
        assert r.am_vega == pytest.approx(f(v=r.vol + 0.01) - f(), abs=1e-9)
        assert r.am_rho == pytest.approx(f(q=0.05) - f(), abs=1e-9)
        assert r.am_theta == pytest.approx(f(t=r.t - 1 / 365) - f(), abs=1e-9)
    for r in ker.early_exercise_premium(small, steps=40).collect():
        call = r.option_type == "call"
        gap = brute_tree(r.spot, 100.0, r.t, 0.04, r.vol, call, 40) - brute_tree(r.spot, 100.0, r.t, 0.04, r.vol, call, 40, american=False)
        assert r.early_exercise == pytest.approx(max(gap, 0.0), abs=1e-9)


def test_quadratic_approximation_is_near_the_tree(grid):
    puts = grid.filter("option_type = 'put' and t < 1 and vol > 0.2")
    for r in ker.american_price_tree(ker.american_price_baw(puts), steps=200).collect():
        assert r.american == pytest.approx(r.tree, abs=0.15)
        assert r.american >= max(r.strike - r.spot, 0) - 1e-9


def test_exercise_boundary_separates_holding_from_exercise(spark):
    df = spark.createDataFrame([(100.0, 0.5, 0.3)], "strike double, t double, vol double")
    rows = ker.exercise_boundary(df, points=4, steps=50).orderBy("boundary_t").collect()
    assert all(0 < r.boundary <= 100 for r in rows)
    assert [r.boundary for r in rows] == sorted((r.boundary for r in rows), reverse=True)
    last = rows[-1]
    assert brute_tree(last.boundary - 1, 100, last.boundary_t, 0.04, 0.3, False, 50) == pytest.approx(100 - last.boundary + 1, abs=1e-5)
    assert brute_tree(last.boundary + 1, 100, last.boundary_t, 0.04, 0.3, False, 50) > 100 - last.boundary - 1 + 1e-4


def test_smile_fit_recovers_a_smile_and_drops_thin_slices(spark):
    day, rows = dt.date(2024, 1, 2), []
    for dte in (7, 30, 60):
        for k in np.arange(382.5, 520, 9.0) if dte != 60 else (440.0, 450.0):
            x = math.log(k / 450)
            rows.append(("S", day, dte, float(k), math.sqrt(0.03 + 0.1 * (-0.4 * (x - 0.01) + math.sqrt((x - 0.01) ** 2 + 0.04))), 450.0))
    df = spark.createDataFrame(rows, "symbol string, quote_date date, dte int, strike double, vol double, spot double")
    fit = sf.fit_vol_surface(df)
    assert {r.dte for r in fit.collect()} == {7, 30}
    assert all(r.rmse < 1e-3 for r in fit.collect())
    pts = df.filter("dte = 30").drop("vol")
    back = sf.surface_iv(pts, fit).join(df.filter("dte = 30").select("strike", "vol"), "strike").collect()
    assert max(abs(r.surface_iv - r.vol) for r in back) < 3e-3


def test_structures_by_hand(spark):
    e = spark.createDataFrame([("p", "S", dt.date(2024, 1, 2), 100.0, "iron_condor", dt.date(2024, 3, 15), 10.0, 5.0, 100.0, 1)],
                              "position_id string, symbol string, entry_date date, spot double, structure_type string, expiration date, width double, wing double, atm double, quantity int")
    legs = st.build_structures(e)
    assert [(r.option_type, r.side, r.strike) for r in legs.orderBy("leg_no").collect()] == [("put", 1, 85.0), ("put", -1, 90.0), ("call", -1, 110.0), ("call", 1, 115.0)]
    priced = legs.withColumn("entry_price", F.when(F.col("side") < 0, 3.0).otherwise(1.0))
    row = st.structure_metrics(priced).collect()[0]
    assert (row.net_premium, row.max_profit, row.max_loss, row.lower_breakeven, row.upper_breakeven) == (400.0, 400.0, 100.0, 86.0, 114.0)
    assert sorted(r.breakeven for r in st.breakeven_points(priced).collect()) == pytest.approx([86.0, 114.0])
    ext = st.payoff_extremes(priced).collect()[0]
    assert (ext.max_profit, ext.max_loss) == pytest.approx((400.0, -100.0))
    assert st.invalid_structures(priced).count() == 0


def test_round_strike_is_half_even(spark):
    row = spark.range(1).select(ins.round_strike(F.lit(447.5)).alias("a"), ins.round_strike(F.lit(452.5)).alias("b")).collect()[0]
    assert (row.a, row.b) == (450.0, 450.0)


def test_exit_thresholds_are_exact(spark):
    """A day exactly at a limit holds it, and a peak of nothing stops nothing."""
    from types import SimpleNamespace

    import catalog.all  # noqa: F401
    from catalog.base import QUERIES

    d0, exp = dt.date(2024, 1, 4), dt.date(2024, 3, 15)
    legs = [("lost", d0, exp, 30.0, 1, 2.01), ("even", d0, exp, 35.0, 1, 0.1), ("even", d0, exp, 40.0, -1, 0.2)]
    marks = [(30.0, 1, 0.51), (35.0, 1, 0.2), (40.0, 1, 0.3), (35.0, 2, 0.0), (40.0, 2, 0.3)]
    v = SimpleNamespace(
        legs=spark.createDataFrame(legs, "position_id string, entry_date date, expiration date, strike double, side int, entry_price double").selectExpr("*", "'S' AS symbol", "'put' AS option_type", "1 AS quantity"),
        chain_px=spark.createDataFrame([(k, d0 + dt.timedelta(days=n), exp, px) for k, n, px in marks], "strike double, quote_date date, expiration date, mid double").selectExpr("*", "'S' AS symbol", "'put' AS option_type"))
    assert [r.dollars for r in QUERIES["b10_b12_exit_conditions"](v).collect() if r.position_id == "lost"] == [True]
    even = {r.d.day: (r.peak_pnl, r.stop) for r in QUERIES["b11_trailing_stop"](v).collect() if r.position_id == "even"}
    assert even == {5: (0.0, False), 6: (0.0, False)}
