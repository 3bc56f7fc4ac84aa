"""Hand-computed metrics, ties, empty and single-row groups, and brute force on skewed keys."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltable.operators import metrics as m, risk as k, series as s
from voltable.operators.quantiles import exact_quantiles

D0 = dt.date(2024, 1, 1)


def curve(spark, values, sid="a"):
    return spark.createDataFrame([(sid, D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "sid string, d date, equity double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_total_and_annualized_return(spark):
    c = curve(spark, [100, 110, 121])
    assert one(m.total_return(c, ["sid"])).total_return_pct == pytest.approx(21.0)
    assert one(m.annualized_return(c, ["sid"])).annualized_return == pytest.approx(1.21 ** (252 / 2) - 1)
    assert one(m.annualized_return(curve(spark, [100, -5]), ["sid"])).annualized_return == -1.0


def test_single_row_and_flat_curves(spark):
    assert one(m.sharpe_ratio(curve(spark, [100]), ["sid"])).sharpe_ratio is None
    assert one(m.sharpe_ratio(curve(spark, [100, 100, 100]), ["sid"])).sharpe_ratio == 0.0
    assert one(m.sortino_ratio(curve(spark, [100, 101, 103]), ["sid"])).sortino_ratio == math.inf


def test_max_drawdown_dates_and_recovery(spark):
    row = one(m.max_drawdown(curve(spark, [100, 120, 90, 100, 120, 80, 70]), ["sid"]))
    assert row.max_drawdown_frac == pytest.approx(-50 / 120)
    assert (row.peak_date, row.trough_date, row.recovery_date) == (D0 + dt.timedelta(days=1), D0 + dt.timedelta(days=6), None)
    row = one(m.max_drawdown(curve(spark, [100, 120, 60, 130]), ["sid"]))
    assert (row.duration_days, row.recovery_days) == (1, 1)


def test_trade_metrics_by_hand(spark):
    pnl = [100, -50, 200, -30, 150, 80, -100, 250, -40, 120]
    t = spark.createDataFrame([("a", float(x)) for x in pnl], "sid string, realized_pnl double")
    row = one(m.trade_metric(t, ["sid"], *m.TRADE_AGGS))
    assert row.win_rate_pct == pytest.approx(60.0)
    assert row.profit_factor == pytest.approx(900 / 220)
    assert row.average_win == pytest.approx(150.0) and row.average_loss == pytest.approx(-55.0)
    assert row.expectancy == pytest.approx(0.6 * 150 - 0.4 * 55)
    wins = t.filter("realized_pnl > 0")
    assert one(m.trade_metric(wins, ["sid"], "profit_factor")).profit_factor == math.inf


def _brute_streak(rows, flag):
    best = run = 0
    for r in sorted(rows):
        run = run + 1 if flag(r[2]) else 0
        best = max(best, run)
    return best


def test_streaks_and_running_totals_match_brute_force_on_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", D0 + dt.timedelta(days=rng.randrange(5)), i, float(rng.choice([-1, 1, 1, 1, 0]))) for i in range(900)]
    df = spark.createDataFrame(rows, "sid string, day date, n int, realized_pnl double").repartition(7)
    wins = {r.sid: r.w for r in s.longest_streaks(df, ["sid"], "day", ["n"], F.col("realized_pnl") > 0, "w").collect()}
    total = {(r.sid, r.n): r.cum for r in s.running_total(df, ["sid"], "day", ["n"], "realized_pnl", "cum").collect()}
    number = {(r.sid, r.n): r.no for r in s.sequence_number(df, ["sid"], "day", ["n"], "no").collect()}
    for sid in {r[0] for r in rows}:
        mine = [(d, n, p) for x, d, n, p in rows if x == sid]
        assert wins[sid] == _brute_streak(mine, lambda p: p > 0)
        acc = 0.0
        for i, (d, n, p) in enumerate(sorted(mine), 1):
            acc += p
            assert total[(sid, n)] == pytest.approx(acc) and number[(sid, n)] == i


def test_streak_of_an_unbroken_key_and_of_a_key_without_wins(spark):
    rows = [("w", D0 + dt.timedelta(days=i % 4), i, 1.0) for i in range(40)] + [("l", D0, i, -1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "sid string, day date, n int, realized_pnl double")
    got = {r.sid: r.w for r in s.longest_streaks(df, ["sid"], "day", ["n"], F.col("realized_pnl") > 0, "w").collect()}
    assert got == {"w": 40, "l": 0}


def test_exact_quantiles_match_numpy_under_ties_and_outliers(spark):
    rng = np.random.default_rng(5)
    data = {"heavy": np.round(rng.standard_cauchy(4000), 1), "same": np.full(500, 2.5), "two": np.array([1.0, 9.0]), "one": np.array([4.0])}
    rows = [(key, float(x)) for key, xs in data.items() for x in xs] + [("heavy", None)]
    df = spark.createDataFrame(rows, "sid string, x double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.937, "e": 1.0}
    for row in exact_quantiles(df, ["sid"], "x", probs).collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(float(np.percentile(data[row.sid], p * 100)), abs=1e-9)


def test_month_gaps_are_filled(spark):
    c = spark.createDataFrame([("a", dt.date(2024, 1, 31), 100.0), ("a", dt.date(2024, 3, 29), 110.0)], "sid string, d date, equity double")
    rows = {r.month: r.month_return for r in m.monthly_returns(c, ["sid"]).collect()}
    assert rows[1] is None and rows[2] == pytest.approx(0.0) and rows[3] == pytest.approx(0.10)


def test_var_needs_thirty_observations(spark):
    few = spark.createDataFrame([("a", float(i)) for i in range(10)], "sid string, r double")
    assert one(k.value_at_risk(few, ["sid"]))["var"] is None
    xs = np.random.default_rng(1).normal(0, 0.01, 300)
    many = spark.createDataFrame([("a", float(x)) for x in xs], "sid string, r double")
    row = one(k.conditional_var(many, ["sid"]))
    q = np.percentile(xs, 5)
    assert row["var"] == pytest.approx(q) and row.cvar == pytest.approx(xs[xs <= q].mean())


def test_results_do_not_depend_on_partitioning(spark, views):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a = m.all_metrics(views.equity, views.trades, ["sid"], order=order).orderBy("sid").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    b = m.all_metrics(views.equity.repartition(11), views.trades.repartition(5), ["sid"], order=order).orderBy("sid").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for x, y in zip(a, b):
        for name in x.asDict():
            assert x[name] == y[name] or x[name] == pytest.approx(y[name], rel=1e-9), name
