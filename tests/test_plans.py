"""Acceptance fold against brute force, path reproducibility, plan shape and the driver contract."""

import datetime as dt
import itertools
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voltable.operators import metrics as m
from voltable.plans import backtest as bt, resample as rs, scenarios as sc, strategies as sg
from voltable.plans.lineage import materialize

D0 = dt.date(2024, 1, 1)


def _brute(cands, slots, per_symbol, size=None, single=0.2, used=0.8, capital=1000.0):
    taken, open_ = [], []
    for e, sym, pid, x, need in sorted(cands):
        open_ = [o for o in open_ if o[0] > e or o[3] == e]
        ok = len(open_) < slots and (per_symbol is None or sum(o[1] == sym for o in open_) < per_symbol)
        if size:
            ok = ok and need <= capital * single and sum(o[2] for o in open_) + need <= capital * used
        if ok:
            open_.append((x, sym, need, e))
            taken.append(pid)
    return set(taken)


@pytest.mark.parametrize("per_symbol,size", [(None, None), (1, None), (2, None), (None, "need")])
def test_acceptance_matches_brute_force(spark, per_symbol, size):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        a = rng.randrange(60)
        rows.append((f"k{0 if i % 3 else i % 5}", f"S{rng.randrange(4)}", f"p{i:05d}", D0 + dt.timedelta(days=a), D0 + dt.timedelta(days=a + rng.randrange(20)), float(rng.randrange(50, 260))))
    df = spark.createDataFrame(rows, "k string, symbol string, position_id string, entry_date date, exit_date date, need double").withColumns(
        {"max_positions": F.lit(3), "capital": F.lit(1000.0)})
    got = {}
    for r in bt.accept_entries(df, ["k"], per_symbol, size).collect():
        got.setdefault(r.k, set()).add(r.position_id)
    for k in {r[0] for r in rows}:
        assert got[k] == _brute([(e, s, p, x, n) for kk, s, p, e, x, n in rows if kk == k], 3, per_symbol, size)


def test_a_position_of_today_holds_its_slot_today(spark):
    rows = [("k", f"S{i}", f"p{i}", D0, D0, 1, 1000.0) for i in range(7)] + [("k", "S1", "q", D0 + dt.timedelta(days=1), None, 1, 1000.0)]
    df = spark.createDataFrame(rows, "k string, symbol string, position_id string, entry_date date, exit_date date, max_positions int, capital double")
    for per_symbol in (None, 1, 2):
        assert {r.position_id for r in bt.accept_entries(df, ["k"], per_symbol).collect()} == {"p0", "q"}


def test_widths_and_wings_as_given(spark):
    rows = [("S", D0, 50.0, "iron_condor", D0 + dt.timedelta(days=30), w, g) for w, g in ((2.5, 5.0), (20.0, None), (None, None))]
    df = spark.createDataFrame(rows, "symbol string, d date, spot double, structure_type string, expiration date, width double, wing double")
    assert {(r.width, r.wing) for r in bt.with_instances(df).collect()} == {(2.5, 5.0), (20.0, 10.0), (2.5, 1.25)}


def test_no_position_lacks_a_leg(views):
    from catalog.pricing_queries import every_legs, priced_legs
    from voltable.operators.structures import LEG_TEMPLATES, dropped_structures

    n = {r.position_id: (r.structure_type, r["n"]) for r in every_legs(views).groupBy("position_id", "structure_type").agg(F.count("*").alias("n")).collect()}
    assert n and all(k == len(LEG_TEMPLATES[s]) for s, k in n.values())
    gone = {r.position_id for r in dropped_structures(priced_legs(views)).collect()}
    assert gone and not gone & set(n) and len(gone) + len(n) == views.bars.count() * len(LEG_TEMPLATES)
    assert {r["n"] for r in views.legs.groupBy("position_id").agg(F.count("*").alias("n")).collect()} == {4}


def _returns(spark, n=60):
    rng = random.Random(2)
    return spark.createDataFrame([(k, D0 + dt.timedelta(days=i), rng.gauss(0, 0.01)) for k in ("a", "b") for i in range(n)], "sid string, d date, r double")


@pytest.mark.parametrize("make", [rs.bootstrap_paths, rs.block_bootstrap_paths])
def test_paths_are_the_same_under_any_partitioning(spark, make):
    r = _returns(spark)
    a = make(r, ["sid"], n_sims=20, n_periods=9).orderBy("sid", "sim_id", "period").collect()
    b = make(r.repartition(9), ["sid"], n_sims=20, n_periods=9).repartition(3).orderBy("sid", "sim_id", "period").collect()
    assert len(a) == 2 * 20 * 10
    assert all(x.value == pytest.approx(y.value, rel=1e-12) for x, y in zip(a, b))


def test_draws_look_random(spark):
    drawn = rs.bootstrap_paths(_returns(spark), ["sid"], n_sims=2000, n_periods=1).filter("period = 1").groupBy("sid").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    pool = {r.sid: r for r in _returns(spark).groupBy("sid").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s")).collect()}
    for r in drawn.collect():
        f = pool[r.sid]
        assert r.s == pytest.approx(f.s, rel=0.08) and abs(r.m - 1 - f.m) < 4 * f.s / 2000**0.5


def test_metrics_inside_the_row_equal_those_of_exploded_paths_without_a_shuffle_of_periods(spark):
    returns = _returns(spark).withColumn("r", F.when((F.col("sid") == "b") & (F.col("d") == D0), F.lit(-1.0)).otherwise(F.col("r")))
    sims = rs.resampled(returns, ["sid"], 70, 12)
    got = {(r.sid, r.sim_id): r for r in rs.step_metrics(sims, ["sid"]).collect()}
    want = rs.path_metrics(rs.bootstrap_paths(returns, ["sid"], 70, 12), ["sid"]).collect()
    assert len(got) == len(want) == 140
    for w in want:
        for c in ("total_return", "max_drawdown", "volatility", "sharpe", "final_value"):
            assert got[w.sid, w.sim_id][c] == pytest.approx(w[c], rel=1e-9, abs=1e-12), (w, c)
    plan = rs.step_metrics(sims, ["sid"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "_block" in plan  # by key, then by key and block of simulations


def test_too_short_history_gives_no_paths(spark):
    assert rs.bootstrap_paths(_returns(spark, 20), ["sid"], 5, 5).count() == 0


def test_blocks_are_contiguous(spark):
    n = 40
    r = spark.createDataFrame([("a", D0 + dt.timedelta(days=i), i / 1000.0) for i in range(n)], "sid string, d date, r double")
    pdf = rs.block_bootstrap_paths(r, ["sid"], n_sims=5, n_periods=12, block=4).toPandas().sort_values(["sim_id", "period"])
    for _, g in pdf.groupby("sim_id"):
        idx = ((g.value / g.value.shift() - 1).dropna() * 1000).round().astype(int).tolist()
        for i in range(0, 12, 4):
            assert [x - idx[i] for x in idx[i:i + 4]] == [0, 1, 2, 3]


def test_custom_path_metric_sees_ordered_values(spark):
    p = rs.bootstrap_paths(_returns(spark), ["sid"], 5, 5)
    rows = rs.custom_path_metric(p, ["sid"], lambda v: v.iloc[-1] / v.iloc[0] - 1).collect()
    want = {(r.sid, r.sim_id): r.total_return for r in rs.path_metrics(p, ["sid"]).collect()}
    assert all(r.metric == pytest.approx(want[(r.sid, r.sim_id)]) for r in rows)


def test_scenario_by_hand(spark):
    pos = spark.createDataFrame([("p", 100.0, 5.0, -50.0, 200.0, 25.0, 10000.0, 450.0)], "id string, delta double, gamma double, theta double, vega double, rho double, position_value double, spot double")
    row = sc.apply_scenarios(pos, [sc.custom_scenario("x", -0.1, 0.2, 0.01, 2.0)]).collect()[0]
    assert row.pnl == pytest.approx(100 * -45 + 0.5 * 5 * 45**2 + 200 * 20 - 100 + 25)
    assert row.max_component == "gamma_pnl"
    with pytest.raises(ValueError):
        sc.custom_scenario("bad", -1.5)


def test_builder_and_validation(spark):
    row = sg.StrategyBuilder("mine").underlying("S1").when("iv_rank", ">", 60).structure("short_straddle", 40).exit_at(0.5, 2.0, 7).position_size("fixed", 2).build()
    ok = sg.strategies_table(spark, [row])
    assert sg.validate_strategies(ok).count() == 0
    bad = sg.strategies_table(spark, [row | {"name": "", "capital": 10.0, "structure_type": "no_such", "target_dte": -1}])
    assert {r.code for r in sg.validate_strategies(bad).collect()} == {"NAME_MISSING", "CAPITAL_TOO_LOW", "STRUCTURE_UNKNOWN", "DTE_NEGATIVE"}
    with pytest.raises(ValueError):
        sg.condition("no_field", ">", 1)


def test_backtest_end_to_end(spark, views):
    from catalog.chain_queries import snapshots

    chain = materialize(views.quotes, "chain")
    snaps = materialize(snapshots(views), "snaps")
    strategies = sg.for_symbols([sg.short_straddle_rule("s", 10.0, max_positions=2)], views.bars)
    run = bt.run_backtest(strategies, chain, snaps, limit_margin=False)
    pos = run["positions"].toPandas()
    assert len(pos) > 0
    for _, g in pos.groupby("strategy_id"):
        days = pd.date_range(pos.entry_date.min(), "2024-01-31").date
        for d in days:
            assert ((g.entry_date <= d) & (g.exit_date.isna() | (g.exit_date > d))).sum() <= 2
    log = run["trade_log"].toPandas()
    assert (log.action == "open").sum() == len(pos) and (log.action == "close").sum() == pos.exit_date.notna().sum()
    last = run["equity_curve"].groupBy("strategy_id").agg(F.max_by("equity", "d").alias("e"), F.max_by("cash", "d").alias("c"), F.max_by("positions_value", "d").alias("v")).toPandas()
    assert ((last.e - last.c - last.v).abs() < 1e-6).all()
    flows = -pos.total_cost.sum() + pos.total_proceeds.fillna(0).sum()
    assert last.c.sum() == pytest.approx(1e5 * len(last) + flows)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_plans_have_no_cartesian_products_or_global_windows(spark, views):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    for df in (m.all_metrics(views.equity, views.trades, ["sid"], order=order), rs.bootstrap_paths(_returns(spark), ["sid"], 10, 5), m.value_distribution(views.trades, ["sid"], "realized_pnl")):
        text = _plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("files", [1, 2, 7])
def test_streams_do_not_depend_on_where_batches_are_cut(spark, tmp_path, files):
    from voltable.streaming import live

    rng = random.Random(5)
    rows = [("AB"[i % 2], D0 + dt.timedelta(days=i // 6), i, rng.choice([1.0, 1.0, 1.0, 2.0, None])) for i in range(140)]
    want, last, run = [], {}, {}
    for c, ts, i, p in rows:
        run[c] = 0 if p is None else run.get(c, 0) + 1 if p == last.get(c) else 1
        last[c] = p
        if run[c] >= 3:
            want.append((c, i, run[c]))
    edges = [len(rows) * k // files for k in range(files + 1)]
    for a, b in zip(edges, edges[1:]):
        spark.createDataFrame(rows[a:b], "contract string, d date, seq bigint, price double").withColumn("quote_ts", F.col("d").cast("timestamp")).drop("d").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live.use_rocksdb(spark)
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = lambda: live.stream_chain(spark, f"{tmp_path}/in", schema)
    q = live.stream_stale_quotes(stream()).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.contract, r.quote_ts.date(), r.run_length) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((c, rows[i][1], n) for c, i, n in want)
    days = stream().selectExpr("contract as symbol", "quote_ts", "0.5D as delta", "0.2D as vol", "price as strike")
    live.keep_latest(live.stream_snapshots(days), f"{tmp_path}/days", f"{tmp_path}/cp2").awaitTermination()
    assert live.latest(spark, f"{tmp_path}/days", ["symbol", "d"]).count() == len({(c, ts) for c, ts, _, _ in rows})


def test_marks_read_the_chain_as_it_is(views):
    """Only the wanted contracts are multiplied, never the chain."""
    from catalog.chain_queries import snapshots
    from voltable.operators.chain import interpolated_marks

    chain = materialize(views.quotes, "chain")
    missing = views.quotes.filter("volume % 5 = 0").select("symbol", "quote_date", "option_type", "expiration", "strike")
    lines = interpolated_marks(missing, chain)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    multiplied = [i for i, line in enumerate(lines) if "Generate explode(sequence(" in line]
    assert multiplied and all("Aggregate" in lines[i + 1] for i in multiplied)  # the distinct wanted contracts


def test_scan_filters_reach_parquet(spark, tmp_path, capsys):
    from voltable.sources.chains import scan_option_chain

    rows = [("S", D0, D0 + dt.timedelta(days=30), 50.0, "call", 1.0)]
    spark.createDataFrame(rows, "symbol string, quote_date date, expiration date, strike double, option_type string, bid double").write.parquet(f"{tmp_path}/c")
    df = scan_option_chain(spark.read.parquet(f"{tmp_path}/c"), "S", "2024-01-01", 10, 40, ordered=False).select("symbol", "bid")
    df.explain("formatted")
    text = capsys.readouterr().out
    assert "ReadSchema: struct<symbol:string,quote_date:date,expiration:date,bid:double>" in text
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    assert all(x in pushed for x in ("EqualTo(symbol,S)", "EqualTo(quote_date", "GreaterThanOrEqual(expiration"))


def test_driver_contract(spark):
    assert entry.entry(spark).count() == 10
    names, oracles = set(entry.queries()), set(entry.oracle_sql())
    assert oracles <= names and len(oracles) > 200


def test_exit_rules_by_hand(spark):
    """Each stop on the day it first holds; the user's own rule as a column and on exploded rows."""
    days = [(D0 + dt.timedelta(days=k + 1), p) for k, p in enumerate((10.0, 50.0, 40.0, 20.0, -30.0, -90.0))]
    paths = spark.createDataFrame([("i", d, p, 0.0, 40, "MEDIUM") for d, p in days], "instance_id string, d date, pnl double, value double, dte int, regime string")
    facts = spark.createDataFrame([("i", 100.0, 2, 0.3, None, 500.0, 100.0)], "instance_id string, net_premium double, num_legs int, delta_per_contract double, max_loss_per_contract double, margin_per_contract double, premium_per_contract double")
    none = dict(profit_target=None, loss_limit=None, exit_dte=None)
    rows = [sg.strategy("trail", "short_straddle", trailing_stop=0.5, **none), sg.strategy("tight", "short_straddle", trailing_stop=0.2, **none), sg.strategy("dollars", "short_straddle", stop_dollars=50.0, sizing_value=2.0, **none),
            sg.strategy("delta", "short_straddle", stop_dollars=1e6, sizing_method="delta_target", sizing_value=1.0, **none), sg.strategy("both", "short_straddle", stop_dollars=10.0, trailing_stop=0.9, **none)]
    signals = sg.strategies_table(spark, rows).withColumns({"instance_id": F.lit("i"), "entry_date": F.lit(D0), "dte": F.lit(46)})
    got = {r.strategy_id: (r.exit_reason, r.exit_date and (r.exit_date - D0).days, r.quantity) for r in bt.first_exit(signals, paths, facts).collect()}
    assert got == {"trail": ("trailing_stop", 4, 1), "tight": ("trailing_stop", 3, 1), "dollars": ("dollar_stop", 5, 2), "delta": (None, None, 3), "both": ("dollar_stop", 5, 1)}
    for rule in (lambda x: (x["pnl"] < 45) & (x["peak"] > 45) & (F.col("quantity") > 1), (F.col("day.pnl") < 45) & (F.col("day.peak") > 45) & (F.col("quantity") > 1)):
        got = {r.strategy_id: (r.exit_reason, r.exit_date and (r.exit_date - D0).days) for r in bt.first_exit(signals, paths, facts, rule).collect()}
        assert got == {"trail": ("trailing_stop", 4), "tight": ("trailing_stop", 3), "dollars": ("custom", 3), "delta": ("custom", 3), "both": ("dollar_stop", 5)}


def _plain_acceptance(rows, most):
    held, taken = [], []
    for pid, symbol, entry, leaves in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        held = [h for h in held if h[0] > entry or h[1] == entry]
        if len(held) < most:
            held.append((leaves or dt.date(9999, 12, 31), entry))
            taken.append(pid)
    return taken


def test_an_account_is_accepted_in_segments(spark):
    """A hot account is cut at days on which nothing can be open; the result is that of one pass."""
    rng = random.Random(7)
    rows = []
    for block in range(60):
        first = D0 + dt.timedelta(days=20 * block)
        for k in range(rng.randint(1, 25)):
            entry = first + dt.timedelta(days=rng.randint(0, 9))
            rows.append((f"p{block}_{k}", rng.choice("xyz"), entry, entry + dt.timedelta(days=rng.randint(0, 10))))
    rows.append(("open", "x", D0 + dt.timedelta(days=20 * 58), None))
    cold = [(f"c{k}", "x", D0, D0 + dt.timedelta(days=k)) for k in range(5)]
    df = spark.createDataFrame([("hot", *r, 3) for r in rows] + [("cold", *r, 3) for r in cold], "strategy_id string, position_id string, symbol string, entry_date date, exit_date date, max_positions int")
    got = {(r.strategy_id, r.position_id) for r in bt.accept_entries(df, ["strategy_id"]).collect()}
    assert got == {("hot", p) for p in _plain_acceptance(rows, 3)} | {("cold", p) for p in _plain_acceptance(cold, 3)}
    leaves = df.withColumn("_leaves", F.coalesce("exit_date", F.lit("9999-12-31").cast("date")))
    parts = {r.strategy_id: r.n for r in bt.acceptance_segments(leaves, ["strategy_id"]).groupBy("strategy_id").agg(F.countDistinct("_segment").alias("n")).collect()}
    assert parts["cold"] == 1 and parts["hot"] >= 55
    plan = bt.accept_entries(df, ["strategy_id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(strategy_id" in plan and "_segment" in plan.split("MapInArrow")[1].split("REPARTITION")[0]


def test_only_hot_keys_are_copied(spark):
    from voltable.operators.joins import attach_measured

    rows = spark.createDataFrame([("hot", i) for i in range(60)] + [("cold", i) for i in range(5)] + [(None, 1)], "k string, i int")
    side = spark.createDataFrame([("hot", 1.0), ("cold", 2.0), ("unused", 3.0)], "k string, x double")
    joined = attach_measured(rows, side, ["k"], F.col("i"), salts=8, hot_rows=50)
    assert sorted((r.k, r.i, r.x) for r in joined.collect()) == sorted([("hot", i, 1.0) for i in range(60)] + [("cold", i, 2.0) for i in range(5)])
    from voltable.operators import joins

    made = joins.with_salts(side, rows.groupBy("k").count().filter("count > 50").select("k", F.lit(8).alias("_salts")), ["k"])
    assert {r.k: r["count"] for r in made.groupBy("k").count().collect()} == {"hot": 8, "cold": 1, "unused": 1}


def test_streaks_of_both_kinds(spark):
    from voltable.operators.series import streaks

    rng = random.Random(1)
    rows = [(k, D0 + dt.timedelta(days=rng.randint(0, 12)), i, rng.choice([-1.0, 0.0, 1.0, 1.0])) for k in "abc" for i in range(80)] + [("one", D0, 1, -1.0)]
    df = spark.createDataFrame(rows, "k string, d date, i int, p double")
    got = {r.k: (r.up, r.down) for r in streaks(df, ["k"], "d", ["i"], {"up": F.col("p") > 0, "down": F.col("p") < 0}).collect()}
    for k in {r[0] for r in rows}:
        signs = [p for _, _, _, p in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])]
        best = lambda ok: max((len(list(g)) for hit, g in itertools.groupby(signs, ok) if hit), default=0)
        assert got[k] == (best(lambda p: p > 0), best(lambda p: p < 0))


def test_exchanges_of_combined_plans(spark, tmp_path, views):
    """One exchange of the chain for snapshots; few for all metrics."""
    from voltable.operators import chain as ch, metrics as m

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    views.quotes.write.parquet(f"{tmp_path}/q")
    views.vix.write.parquet(f"{tmp_path}/v")
    views.equity.write.parquet(f"{tmp_path}/e")
    views.trades.write.parquet(f"{tmp_path}/t")
    read = lambda x: spark.read.parquet(f"{tmp_path}/{x}")
    assert exchanges(ch.build_snapshots(read("q"), read("v"))) <= 4
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    assert exchanges(m.all_metrics(read("e"), read("t"), ["sid"], order=order)) <= 5
    assert exchanges(m.full_backtest_metrics(read("e"), read("t"), ["sid"], order=order)) <= 10


def test_stream_state_goes_after_expiration(spark, tmp_path):
    """The same rows as without expirations, and no state once the stream has passed the last one."""
    from voltable.streaming import live

    live.use_rocksdb(spark)
    schema = "contract string, quote_ts timestamp, price double, expiration date"
    t = lambda d, h=10: dt.datetime(2024, 1, d, h)
    files = [[("A", t(2), 1.0, dt.date(2024, 1, 10)), ("A", t(3), 1.0, dt.date(2024, 1, 10)), ("B", t(3), 5.0, dt.date(2024, 1, 20))],
             [("A", t(4), 1.0, dt.date(2024, 1, 10)), ("B", t(12), 5.0, dt.date(2024, 1, 20))], [("B", t(13), 5.0, dt.date(2024, 1, 20)), ("B", t(14), 5.0, dt.date(2024, 1, 20))],
             [("C", t(31), 2.0, dt.date(2024, 1, 25))]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live.stream_stale_quotes(live.stream_chain(spark, f"{tmp_path}/in", schema))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        held = {r.key[0] for r in spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/cp").collect()}
        assert held == [{"A", "B"}, {"B"}, {"B"}, set()][k] or k in (0, 1), (k, held)
    got = {(r.contract, r.quote_ts, r.run_length) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("A", t(4), 3), ("B", t(13), 3), ("B", t(14), 4)}
    assert held == set()


def test_smiles_are_not_broadcast(spark, views):
    """Sizes of exploded grids and arrays are underestimated, so a broadcast of them would not be bounded by the threshold."""
    import catalog.all  # noqa: F401
    from catalog.base import QUERIES

    for name in ("h12_fit_vol_surface", "h13_surface_iv", "h14_smile_grid"):
        df = QUERIES[name](views)
        df.collect()
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_legs_travel_with_arrays_and_keep_their_last_mark(spark):
    """Days without a mark keep the last one of a day after entry; candidates carry no paths through acceptance."""
    day = lambda n: D0 + dt.timedelta(days=n)
    legs = spark.createDataFrame([("i", "S", "call", day(60), 50.0, 1, 1, D0, 2.0), ("j", "S", "call", day(60), 50.0, 1, 1, day(1), 2.0)],
                                 "instance_id string, symbol string, option_type string, expiration date, strike double, side int, quantity int, entry_date date, entry_price double")
    quotes = spark.createDataFrame([("S", day(n), "call", day(60), 50.0, p, p) for n, p in ((0, 2.0), (1, 3.0), (3, 1.0))], "symbol string, quote_date date, option_type string, expiration date, strike double, bid double, ask double")
    snaps = spark.createDataFrame([("S", day(n), s, 0.2, "LOW") for n, s in ((0, 50.0), (1, 50.0), (2, None), (3, 50.0))], "symbol string, d date, spot double, iv double, regime string")
    paths = bt.daily_paths(legs.withColumn("leg_no", F.lit(1)), quotes, snaps)
    assert {(r.instance_id, (r.d - D0).days): r.pnl for r in paths.collect()} == {("i", 1): 100.0, ("i", 2): 100.0, ("i", 3): -100.0, ("j", 3): -100.0}
    # the exploded days of an instance are grouped where they lie: only arrays were shuffled by instance
    assert not re.search(r"hashpartitioning\(instance_id#\d+, (symbol|leg_no|quote_date)#", paths._jdf.queryExecution().executedPlan().toString())


def test_contract_days_are_marked_where_they_lie(spark):
    """Strikes within a cent share a quote, not what is interpolated for them; no contract-day is shuffled on its way to an instance."""
    day = lambda n: D0 + dt.timedelta(days=n)
    legs = spark.createDataFrame([(i, "S", "call", day(60), k, 1, 1, D0, 2.0) for i, k in (("i", 50.0), ("j", 50.004), ("k", 52.5), ("m", 52.502))],
                                 "instance_id string, symbol string, option_type string, expiration date, strike double, side int, quantity int, entry_date date, entry_price double")
    listed = [("S", day(1), "call", day(60), k, p, p) for k, p in ((50.0, 3.0), (55.0, 1.0))] + [("S", day(2), "call", day(60), 50.0, 4.0, 4.0)]
    quotes = spark.createDataFrame(listed, "symbol string, quote_date date, option_type string, expiration date, strike double, bid double, ask double")
    snaps = spark.createDataFrame([("S", day(n), s, 0.2, r) for n, s, r in ((0, 50.0, "LOW"), (1, 50.0, "HIGH"), (2, None, "LOW"), (60, 56.0, None), (61, 50.0, "LOW"))], "symbol string, d date, spot double, iv double, regime string")
    paths = bt.daily_paths(legs, quotes, snaps)
    got = {(r.instance_id, (r.d - D0).days): (round(r.value, 6), r.dte, r.regime) for r in paths.collect()}
    last = {"i": 600.0, "j": 599.6, "k": 350.0, "m": 349.8}
    first = {"i": 300.0, "j": 300.0, "k": 200.0, "m": 199.92}
    second = {"i": 400.0, "j": 400.0, "k": 200.0, "m": 199.92}  # no quote near, no spot: the last mark stays
    assert got == {(i, n): (v[i], 60 - n, r) for n, v, r in ((1, first, "HIGH"), (2, second, "LOW"), (60, last, None)) for i in "ijkm"}
    plan = paths._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    assert "Exchange" not in plan[plan.index("Window [last"):plan.index("Join", plan.index("Window [last"))]


def test_signals_are_made_in_a_fixed_number_of_tasks(spark):
    """Days and strategies are few in bytes, so AQE would pair them all in one task."""
    days = spark.createDataFrame([(f"S{i}", D0, 50.0, 0.2, 50.0, 20.0, "LOW", 1, 10, [D0 + dt.timedelta(days=40)]) for i in range(8)],
                                 "symbol string, d date, spot double, iv double, iv_rank double, vix double, regime string, regime_days int, chain_size int, expiries array<date>")
    rows = sg.strategies_table(spark, [sg.strategy("s", "long_straddle", [sg.condition("vix", ">", 12)], symbol=f"S{i}") for i in range(8)])
    out = bt.entry_signals(days, rows)
    assert out.count() == 8
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_quantiles_and_rolling_windows_read_rows_once(spark, views):
    """Hot keys of quantiles are told from counts that exist anyway; curves are dealt over a fixed number of tasks, a frame's deviation is folded once."""
    from voltable.operators.quantiles import exact_quantiles
    from voltable.plans import tables as tb

    plan = exact_quantiles(views.trades, ["sid"], "realized_pnl", {"median": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[sid#\d+, _v#\d+", plan)) <= 4
    out = tb.rolling_sharpe_table(views.equity, ["sid"])
    assert len(re.findall("stddev_samp\\(", out._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_days_found_by_a_custom_exit_meet_signals_without_paths(spark):
    """No path is shuffled by strategy: the rule's days are joined to the signals before these meet their instances."""
    rows = [(f"s{i}", "a", D0, "long_call", 0.5, "premium") for i in range(3)]
    signals = spark.createDataFrame(rows, "strategy_id string, instance_id string, entry_date date, structure_type string, loss_limit double, exit_base string").selectExpr(
        "*", "CAST(NULL AS int) AS exit_dte", "CAST(NULL AS double) AS profit_target", "CAST(NULL AS double) AS stop_dollars", "CAST(NULL AS double) AS trailing_stop", "CAST(NULL AS int) AS max_holding_days",
        "false AS regime_exit", "'fixed' AS sizing_method", "1.0D AS sizing_value", "10 AS max_contracts", "100000.0D AS capital")
    paths = spark.createDataFrame([("a", D0 + dt.timedelta(days=n), -10.0 * n, 90.0, 30 - n, "LOW") for n in range(1, 5)], "instance_id string, d date, pnl double, value double, dte int, regime string")
    facts = spark.createDataFrame([("a", -100.0, 1, 0.5, 100.0, 100.0, 100.0)], "instance_id string, net_premium double, num_legs int, delta_per_contract double, max_loss_per_contract double, margin_per_contract double, premium_per_contract double")
    out = bt.first_exit(signals, paths, facts, F.col("day.pnl") <= -30)
    assert [(r.strategy_id, r.exit_reason, (r.exit_date - D0).days) for r in out.sort("strategy_id").collect()] == [(f"s{i}", "custom", 3) for i in range(3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    top = plan[:plan.index("Exchange hashpartitioning")]
    assert not re.search(r"Join \[strategy_id#", top)  # the last join is by instance


def test_instances_become_legs_where_their_quotes_lie(spark):
    """Legs of one instance are not shuffled: the quotes of its day and expiration come to it as one array."""
    day = lambda n: D0 + dt.timedelta(days=n)
    named = [(f"{k}{w}", "S", D0, "long_strangle", day(40), 50.0, w, 5.0, 50.0) for k in "ab" for w in (5.0, 10.0)] + [("c", "T", D0, "long_strangle", day(40), 50.0, 5.0, 5.0, 50.0)]
    signals = spark.createDataFrame(named * 2, "instance_id string, symbol string, entry_date date, structure_type string, expiration date, atm double, width double, wing double, spot double")
    listed = [("S", D0, t, day(40), k, 1.0, 3.0) for t, k in (("put", 45.0), ("call", 55.001), ("put", 40.0), ("call", 65.0))] + [("S", day(1), "call", day(40), 60.0, 1.0, 3.0)]
    quotes = spark.createDataFrame(listed, "symbol string, quote_date date, option_type string, expiration date, strike double, bid double, ask double")
    legs = bt.instance_legs(signals, quotes)
    assert sorted((r.instance_id, r.leg_no, r.option_type, r.strike, r.bid, r.entry_price) for r in legs.collect()) == [
        (i, n, t, k, 1.0, 2.0) for i in ("a5.0", "b5.0") for n, t, k in sorted((r.leg_no, r.option_type, r.strike) for r in legs.filter(F.col("instance_id") == i).collect())]
    assert {r.strike for r in legs.collect()} == {45.0, 55.0}
    plan = legs._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    assert plan.count("Exchange") == 2


def test_missing_days_are_told_without_grouping_days(spark):
    """Days without a quote are read off the arrays of days and quotes; no contract-day is grouped to find them."""
    from voltable.operators.chain import SERIES, mark_series

    day = lambda n: D0 + dt.timedelta(days=n)
    own = spark.createDataFrame([("S", "call", day(60), 5000, 50.0, [(day(n), 50.0, 0.2) for n in range(3)])],
                                "symbol string, option_type string, expiration date, _strike bigint, strike double, _days array<struct<quote_date: date, _spot: double, _iv: double>>")
    quotes = spark.createDataFrame([("S", day(1), "call", day(60), k, 3.0, 5.0) for k in (50.0, 55.0)] + [("S", day(2), "call", day(60), k, p, p) for k, p in ((45.0, 6.0), (55.0, 2.0))],
                                   "symbol string, quote_date date, option_type string, expiration date, strike double, bid double, ask double")
    marks = mark_series(own.repartition(4, *SERIES), quotes)
    assert {(r.quote_date - D0).days: (r.mark_source, r.mark if r.mark_source != "model" else None) for r in marks.collect()} == {0: ("model", None), 1: ("exact", 4.0), 2: ("interpolated", 4.0)}
    plan = marks._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate inline\(concat", plan)) == 1


def test_exits_read_their_day_as_one_array(spark):
    """Closing quotes come by day and expiration as one array, no contract is shuffled alone; an unlisted leg falls back to its entry price. Curves' days are dealt over tasks."""
    day = lambda n: D0 + dt.timedelta(days=n)
    legs = spark.createDataFrame([(i, "S", "call", day(40), k, 1, 1, D0, 2.0, 1.9, 2.1, 2.0) for i, k in (("a", 50.0), ("b", 55.0))],
                                 "instance_id string, symbol string, option_type string, expiration date, strike double, side int, quantity int, entry_date date, entry_price double, bid double, ask double, quote_mid double")
    quotes = spark.createDataFrame([("S", day(n), t, day(40), 50.001, 1.0 + n, 5.0) for n in (0, 3) for t in ("call", "put")], "symbol string, quote_date date, option_type string, expiration date, strike double, bid double, ask double")
    taken = spark.createDataFrame([("a", day(3)), ("a", day(3)), ("b", day(3)), ("b", None)], "instance_id string, exit_date date")
    fills = bt.exit_fills(taken, legs, quotes, 0.65, 0.01, "double")
    assert {r.instance_id: round(r.total_proceeds, 6) for r in fills.collect()} == {"a": 391.35, "b": 193.39}
    assert not re.search(r"hashpartitioning\([^)]*option_type#", fills._jdf.queryExecution().executedPlan().toString())
    positions = spark.createDataFrame([], "strategy_id string, entry_date date, exit_date date, total_cost double, net_premium double, total_proceeds double, realized_pnl double, quantity int, "
                                          f"greeks array<struct<d: date, {', '.join(f'{g}: double' for g in bt.GREEKS)}>>")
    marks = spark.createDataFrame([], "strategy_id string, d date, value double, pnl double")
    curve = bt.equity_curve(positions, marks, spark.createDataFrame([("s", "S", 100.0)], "strategy_id string, symbol string, capital double"), spark.createDataFrame([("S", day(n)) for n in range(2)], "symbol string, d date"))
    assert [(r.d, r.equity) for r in curve.sort("d").collect()] == [(day(0), 100.0), (day(1), 100.0)]
    assert "RepartitionByExpression [strategy_id" in curve._jdf.queryExecution().optimizedPlan().toString()
