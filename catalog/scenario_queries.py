"""M, N, R, S and T queries: resampling, stress, chart tables and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from voltable.operators import metrics as m, series as s
from voltable.plans import resample as rs, scenarios as sc, tables as tb
from voltable.plans.lineage import new_path
from voltable.streaming import live

from .base import query, r
from .metrics_queries import ORDER, PCT
from .pricing_queries import GREEKS, leg_greeks
from .sqlviews import bs, mix32, pdf, phi, ppf, view

KEY = ["sid"]
SIMS, PERIODS, BLOCK = 40, 12, 5


def _returns(v):
    return s.simple_returns(v.equity, KEY).select("sid", "d", "r")


# ---- M: resampling ----------------------------------------------------------------------------------
view("pool", "SELECT sid, d, r, row_number() OVER (PARTITION BY sid ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY sid) AS n FROM returns WHERE r IS NOT NULL")
view("key_codes", "SELECT sid, ('0x' || substr(md5(sid), 1, 8))::BIGINT AS kc, any_value(n) AS n FROM pool GROUP BY sid HAVING any_value(n) >= 30")
view("streams", f"""SELECT sid, n, sim_id, {mix32('h + sim_id * 2654435')} AS st FROM (SELECT sid, n, {mix32('xor(kc, 42)')} AS h FROM key_codes), (SELECT unnest(range(1, {SIMS + 1})) AS sim_id)""")
view("ticks", f"SELECT unnest(range(1, {PERIODS + 1})) AS period")


def _paths(steps: str) -> str:
    return f"""SELECT sid, sim_id, period, exp(sum(g) OVER (PARTITION BY sid, sim_id ORDER BY period)) AS value FROM ({steps} UNION ALL SELECT sid, sim_id, 0, 0e0 FROM streams)"""


view("boot", _paths(f"SELECT t.sid, sim_id, period, ln(1 + p.r) AS g FROM (SELECT sid, sim_id, period, {mix32('st + period * 40503')} % n AS i FROM streams, ticks) t JOIN pool p ON p.sid = t.sid AND p.i = t.i"))
view("blocks", _paths(f"SELECT t.sid, sim_id, period, ln(1 + p.r) AS g FROM (SELECT sid, sim_id, period, {mix32(f'st + ((period - 1) // {BLOCK}) * 40503')} % (n - {BLOCK} + 1) + (period - 1) % {BLOCK} AS i FROM streams, ticks) t JOIN pool p ON p.sid = t.sid AND p.i = t.i"))


def boot(v):
    return rs.bootstrap_paths(_returns(v), KEY, SIMS, PERIODS)


def measured(v):
    return rs.step_metrics(rs.resampled(_returns(v), KEY, SIMS, PERIODS), KEY)


_P = f"SELECT sid, sim_id::INT AS sim_id, period::INT AS period, {r('value', 8)} AS value FROM "
query("m02_bootstrap_paths", _P + "boot", 8)(boot)
query("m03_block_bootstrap_paths", _P + "blocks", 8)(lambda v: rs.block_bootstrap_paths(_returns(v), KEY, SIMS, PERIODS, BLOCK))
view("path_m", """SELECT sid, sim_id, arg_max(value, period) / arg_min(value, period) - 1 AS total_return, min(value / pk - 1) AS max_drawdown, stddev_pop(x) * sqrt(252e0) AS volatility,
      CASE WHEN stddev_pop(x) < 1e-10 THEN 0 ELSE avg(x) / stddev_pop(x) * sqrt(252e0) END AS sharpe, arg_max(value, period) AS final_value
    FROM (SELECT *, value / lag(value) OVER w - 1 AS x, max(value) OVER w AS pk FROM boot WINDOW w AS (PARTITION BY sid, sim_id ORDER BY period)) GROUP BY ALL""")
_PM = ("total_return", "max_drawdown", "volatility", "sharpe", "final_value")
query("m04_path_metrics", "SELECT sid, sim_id::INT AS sim_id, " + ", ".join(f"{r(x)} AS {x}" for x in _PM) + " FROM path_m")(measured)
query("m05_metric_confidence_interval", " UNION ALL ".join(
    f"SELECT sid, '{x}' AS metric, {r(f'avg({x})')} AS point_estimate, {r(f'quantile_cont({x}, 0.025)')} AS lower_bound, {r(f'quantile_cont({x}, 0.975)')} AS upper_bound, {r(f'stddev_pop({x}) / sqrt(count({x}))')} AS standard_error FROM path_m GROUP BY sid" for x in _PM))(
    lambda v: rs.metric_confidence_interval(measured(v), KEY))
view("hr", "SELECT sid, sim_id, max(value) FILTER (period = 5) / max(value) FILTER (period = 0) - 1 AS h5, max(value) FILTER (period = 12) / max(value) FILTER (period = 0) - 1 AS hr FROM boot GROUP BY ALL")
query("m06_simulated_var", " UNION ALL ".join(
    f"SELECT sid, {c} AS confidence, {r('v', 8)} AS var, {r('avg(h5) FILTER (h5 <= v)', 8)} AS cvar, count(*) AS num_simulations, {r('abs(v)', 8)} AS var_dollar, {r('abs(avg(h5) FILTER (h5 <= v))', 8)} AS cvar_dollar FROM (SELECT *, quantile_cont(h5, {q}) OVER (PARTITION BY sid) AS v FROM hr) GROUP BY sid, v"
    for c, q in (("9e-1", "0.1"), ("95e-2", "0.05"), ("99e-2", "0.01"))), 8)(lambda v: rs.simulated_var(boot(v), KEY, 5))
_TD = ", ".join(f"{r(f'quantile_cont(hr, {p} / 100e0)')} AS p{p}" for p in PCT)
query("m07_terminal_distribution", f"""SELECT sid, {r('avg(hr)')} AS mean, {r('median(hr)')} AS median, {r('stddev_pop(hr)')} AS std, {r('avg((hr - mu) ** 3) / pow(avg((hr - mu) ** 2), 15e-1)')} AS skewness, {r('avg((hr - mu) ** 4) / avg((hr - mu) ** 2) ** 2 - 3')} AS kurtosis, {_TD},
      {r('count_if(hr > 0) / count(*)')} AS prob_profit, {r('count_if(hr < 0) / count(*)')} AS prob_loss, {r('1 - count_if(hr > 0) / count(*) - count_if(hr < 0) / count(*)')} AS prob_breakeven, {r('coalesce(avg(hr) FILTER (hr > 0), 0)')} AS mean_profit,
      {r('coalesce(avg(hr) FILTER (hr < 0), 0)')} AS mean_loss, {r('count_if(hr < mu - 2 * sd) / count(*)')} AS left_2sigma, {r('count_if(hr > mu + 2 * sd) / count(*)')} AS right_2sigma, {r('count_if(hr < mu - 3 * sd) / count(*)')} AS left_3sigma,
      {r('count_if(hr > mu + 3 * sd) / count(*)')} AS right_3sigma, {r('min(hr)')} AS worst, {r('max(hr)')} AS best, count(*) AS num_simulations FROM (SELECT *, avg(hr) OVER (PARTITION BY sid) AS mu, stddev_pop(hr) OVER (PARTITION BY sid) AS sd FROM hr) GROUP BY sid""")(
    lambda v: rs.terminal_distribution(boot(v), KEY, PERIODS))
query("m08_probability_of_target", f"SELECT sid, {r('count_if(hr >= 0.001) / count(*)')} AS probability, count_if(hr >= 0.001) AS num_achieving, {r('coalesce(avg(hr) FILTER (hr >= 0.001), 0.001)')} AS expected_given_achieved FROM hr GROUP BY sid")(
    lambda v: rs.probability_of_target(boot(v), KEY, PERIODS, 0.001))
_DD = ", ".join(f"{r(f'quantile_cont(max_drawdown, {p} / 100e0)')} AS p{p}" for p in PCT)
query("m09_drawdown_distribution", f"""SELECT sid, {r('avg(max_drawdown)')} AS mean, {r('median(max_drawdown)')} AS median, {r('stddev_pop(max_drawdown)')} AS std, {r('min(max_drawdown)')} AS worst, {r('max(max_drawdown)')} AS best, {_DD},
      {', '.join(f"{r(f'count_if(max_drawdown < -{c / 100}) / count(*)')} AS prob_exceeds_{c}" for c in (10, 20, 30))} FROM path_m GROUP BY sid""")(lambda v: rs.drawdown_distribution(measured(v), KEY))
query("m10_path_fan", f"SELECT sid, period::INT AS period, {', '.join(f'{r(f'quantile_cont(value, {p} / 100e0)', 8)} AS p{p}' for p in (5, 50, 95))} FROM boot GROUP BY ALL", 8)(lambda v: rs.path_fan(boot(v), KEY))
query("m10_summary_report", f"""SELECT h.sid, {r('avg(hr)')} AS mean_return, {r('stddev_pop(hr)')} AS std_return, {r('count_if(hr > 0) / count(*)')} AS prob_profit, {r('count_if(hr < 0) / count(*)')} AS prob_loss, {r('avg(max_drawdown)')} AS mean_drawdown, {r('min(max_drawdown)')} AS worst_drawdown,
      {r('any_value(v)')} AS var_95, {r('avg(hr) FILTER (hr <= v)')} AS cvar_95 FROM (SELECT *, quantile_cont(hr, 0.05) OVER (PARTITION BY sid) AS v FROM hr) h JOIN path_m USING (sid, sim_id) GROUP BY h.sid""")(lambda v: rs.summary_report(boot(v), KEY, PERIODS))
query("s03_sample_paths", f"{_P} boot WHERE (sid, sim_id) IN (SELECT sid, sim_id FROM streams QUALIFY row_number() OVER (PARTITION BY sid ORDER BY st, sim_id) <= 7)", 8)(lambda v: rs.sample_paths(boot(v), KEY, 7, SIMS))
query("x03_custom_path_metric", f"SELECT sid, sim_id::INT AS sim_id, {r('max(value) - min(value)', 8)} AS metric FROM boot GROUP BY ALL", 8)(lambda v: rs.custom_path_metric(boot(v), KEY, lambda p: p.max() - p.min()))

# ---- N: stress --------------------------------------------------------------------------------------
view("book", "SELECT symbol, entry_date, spot, " + ", ".join(f"sum(side * quantity * {g}) AS {g}" for g in GREEKS) + ", sum(side * quantity * entry_price) * 100 AS position_value FROM leg_greeks GROUP BY ALL")
BOOK = ["symbol", "entry_date"]


def book(v):
    w = F.col("side") * F.col("quantity")
    return leg_greeks(v).groupBy(*BOOK, "spot").agg(*[F.sum(w * F.col(g)).alias(g) for g in GREEKS], (F.sum(w * F.col("entry_price")) * 100.0).alias("position_value"))


def _rows(rows):
    return "(VALUES " + ", ".join("('{}', '{}', {}e0, {}e0, {}e0, {}e0)".format(a.replace("'", "''"), b, *x) for a, b, *x in rows) + ") s(scenario, scenario_type, ss, vs, rs, ts)"


_ALL = sc.predefined()


def _stress(rows, source="book"):
    return f"""SELECT *, position_value + pnl AS new_value, CASE WHEN position_value > 1e-10 THEN pnl / position_value ELSE 0 END AS pnl_pct,
        CASE greatest(abs(dp), abs(gp), abs(vp), abs(tp), abs(rp)) WHEN abs(dp) THEN 'delta_pnl' WHEN abs(gp) THEN 'gamma_pnl' WHEN abs(vp) THEN 'vega_pnl' WHEN abs(tp) THEN 'theta_pnl' ELSE 'rho_pnl' END AS max_component FROM (
      SELECT *, dp + gp + vp + tp + rp AS pnl FROM (SELECT *, delta * spot * ss AS dp, gamma * (spot * ss) * (spot * ss) / 2 AS gp, vega * vs * 100 AS vp, theta * ts AS tp, rho * rs * 100 AS rp FROM {source}, {_rows(rows)}))"""


view("stressed", _stress(_ALL))
query("n01_apply_scenarios", f"SELECT symbol, entry_date, scenario, {r('dp')} AS delta_pnl, {r('gp')} AS gamma_pnl, {r('vp')} AS vega_pnl, {r('tp')} AS theta_pnl, {r('rp')} AS rho_pnl, {r('pnl')} AS pnl, {r('new_value')} AS new_value, {r('pnl_pct')} AS pnl_pct, max_component FROM stressed")(
    lambda v: sc.apply_scenarios(book(v)).select(*BOOK, "scenario", *sc.COMPONENTS, "pnl", "new_value", "pnl_pct", "max_component"))
query("n02_stress_suite", f"SELECT symbol, entry_date, scenario, scenario_type, {r('pnl')} AS pnl, row_number() OVER (PARTITION BY symbol, entry_date ORDER BY pnl, scenario)::INT AS rank FROM stressed")(
    lambda v: sc.worst_scenarios(sc.apply_scenarios(book(v)), BOOK, 99).select(*BOOK, "scenario", "scenario_type", "pnl", "rank"))
query("s01_worst_scenarios", f"SELECT symbol, entry_date, scenario, {r('pnl')} AS pnl, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol, entry_date ORDER BY pnl, scenario) AS rn FROM stressed) WHERE rn <= 5")(
    lambda v: sc.worst_scenarios(sc.apply_scenarios(book(v)), BOOK, 5).select(*BOOK, "scenario", "pnl", "rank"))
for _f, _i, _l in (("spot", 0, sc.SPOT_LADDER), ("vol", 1, sc.VOL_LADDER), ("rate", 2, sc.RATE_LADDER), ("time", 3, sc.DAY_LADDER)):
    _rowset = [(f"{x}", _f, *[x if j == _i else 0.0 for j in range(4)]) for x in _l]
    query(f"n03_{_f}_sensitivity", f"SELECT symbol, entry_date, {('ss', 'vs', 'rs', 'ts')[_i]} AS shock, {r('pnl')} AS pnl FROM ({_stress(_rowset)})")(lambda v, f=_f: sc.sensitivity(book(v), f).select(*BOOK, "shock", "pnl"))
_MX = [("x", "m", a, b, 0.0, 0.0) for a in sc.MATRIX_SPOT for b in sc.MATRIX_VOL]
query("n04_what_if_matrix", f"SELECT symbol, entry_date, ss AS spot_shock, " + ", ".join(f"{r(f'sum(pnl) FILTER (vs = {b}e0)')} AS vol_{'m' if b < 0 else 'p'}{round(abs(b) * 100)}" for b in sc.MATRIX_VOL) + f" FROM ({_stress(_MX)}) GROUP BY ALL")(
    lambda v: sc.what_if_matrix(book(v), BOOK))
query("n05_compose_scenarios", f"SELECT symbol, entry_date, scenario || ' + shock' AS scenario, {r('pnl')} AS pnl FROM ({_stress([(a, b, max(x - 0.1, -1.0), y + 0.05, z, w + 2.0) for a, b, x, y, z, w in _ALL])})")(
    lambda v: sc.apply_scenario_table(book(v), _composed(v), ["symbol"]).select(*BOOK, "scenario", "pnl"))


def _composed(v):
    """Scenario rows per symbol, with further shocks on top."""
    base = v.bars.select("symbol").distinct().select("symbol", F.inline(sc._literal(_ALL)))
    more = sc.compose_scenarios(base.withColumn("scenario", F.concat_ws("#", "symbol", "scenario")), "shock", spot=-0.1, vol=0.05, days=2.0)
    return more.withColumn("symbol", F.substring_index("scenario", "#", 1)).withColumn("scenario", F.substring_index("scenario", "#", -1))


query("n06_stress_report", f"SELECT symbol, entry_date, {r('min(pnl)')} AS worst_pnl, {r('max(pnl)')} AS best_pnl, {r('avg(pnl)')} AS avg_pnl, count_if(pnl < 0) AS scenarios_with_loss, arg_min(scenario, (pnl, scenario)) AS max_loss_scenario FROM stressed GROUP BY ALL")(
    lambda v: sc.stress_report(sc.apply_scenarios(book(v)), BOOK))
_LT = "((expiration - entry_date) / 365e0)"
query("n07_full_reprice", f"""SELECT position_id, scenario, {r('sum(a * side * quantity * 100)')} AS value, {r('sum(b * side * quantity * 100)')} AS shocked_value, {r('sum((b - a) * side * quantity * 100)')} AS pnl FROM (
      SELECT *, {bs(t='t', v='vol')} AS a, {bs(s='s1', t='t', rate='r1', v='v1')} AS b FROM (SELECT *, iv_at_entry AS vol, {_LT} AS t, spot * (1 + ss) AS s1, 4e-2 + rs AS r1, greatest(iv_at_entry + vs, 1e-2) AS v1 FROM legs, {_rows(_ALL)})) GROUP BY ALL""")(
    lambda v: sc.full_reprice(v.legs.withColumns({"t": F.datediff("expiration", "entry_date") / 365.0, "vol": F.col("iv_at_entry")}), ["position_id"]))
query("u01_scenario_union", "SELECT DISTINCT symbol, scenario, scenario_type FROM bars, " + _rows(_ALL))(
    lambda v: v.bars.select("symbol").distinct().select("symbol", F.inline(sc._literal(sc.predefined()[:8]))).unionByName(v.bars.select("symbol").distinct().select("symbol", F.inline(sc._literal(sc.predefined()[8:])))).select(
        "symbol", "scenario", "scenario_type"))

# ---- R, S: chart tables -----------------------------------------------------------------------------
query("r01_histogram", f"""SELECT sid, bin, count, {r('mean')} AS mean, {r('std')} AS std, {r('median')} AS median, {r('p5')} AS p5, {r('lo + bin * w')} AS bin_start, {r('lo + (bin + 5e-1) * w')} AS bin_centre, {r('count / (n * w)')} AS density,
      {r(pdf('((lo + (bin + 5e-1) * w - mean) / std)') + ' / std')} AS normal_density FROM (
      SELECT t.sid, least(floor((realized_pnl - lo) / w), 29)::INT AS bin, count(*) AS count, any_value(s.mean) AS mean, any_value(s.std) AS std, any_value(s.median) AS median, any_value(s.p5) AS p5, any_value(lo) AS lo, any_value(w) AS w, any_value(n) AS n
      FROM trades t JOIN (SELECT sid, avg(realized_pnl) AS mean, stddev_samp(realized_pnl) AS std, median(realized_pnl) AS median, quantile_cont(realized_pnl, 0.05) AS p5, min(realized_pnl) AS lo, (max(realized_pnl) - min(realized_pnl)) / 30e0 AS w, count(*) AS n FROM trades GROUP BY 1) s USING (sid)
      GROUP BY t.sid, 2)""")(lambda v: tb.histogram(v.trades, KEY, "realized_pnl"))
query("r03_qq_points", " UNION ALL ".join(f"SELECT sid, {i}e0 / 100 AS level, {r(f'quantile_cont(r, {i} / 100e0)', 8)} AS sample_quantile, {r(ppf(f'{i / 100!r}e0'), 8)} AS normal_quantile FROM returns GROUP BY sid" for i in range(1, 100)), 8)(
    lambda v: tb.qq_points(_returns(v), KEY))
query("r05_win_loss_counts", "SELECT sid, count_if(realized_pnl > 0) AS wins, count_if(realized_pnl < 0) AS losses, count_if(realized_pnl = 0) AS flat FROM trades GROUP BY sid")(lambda v: tb.win_loss_counts(v.trades, KEY))
query("r05_pnl_by_trade", f"SELECT sid, trade_id, {r('realized_pnl', 4)} AS realized_pnl, {r('sum(pnl_dec) OVER (PARTITION BY sid ORDER BY exit_date, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)', 4)} AS cumulative_pnl FROM trades", 4)(
    lambda v: tb.pnl_by_trade(v.trades, KEY, "exit_date", ORDER, "pnl_dec").select("sid", "trade_id", "realized_pnl", F.col("cumulative_pnl").cast("double").alias("cumulative_pnl")))
query("r05_trade_stats", f"SELECT sid, count(*) AS trades, {r('sum(realized_pnl)', 4)} AS total, {r('avg(realized_pnl)')} AS mean, {r('max(realized_pnl)')} AS best, {r('min(realized_pnl)')} AS worst, {r('avg(realized_pnl) FILTER (realized_pnl > 0)')} AS mean_win, {r('avg(realized_pnl) FILTER (realized_pnl < 0)')} AS mean_loss FROM trades GROUP BY sid")(
    lambda v: tb.trade_stats(v.trades, KEY).withColumn("total", F.round("total", 4)))
query("r06_drawdown_table", f"SELECT sid, d, {r('dd * 100')} AS drawdown_pct, {r('peak', 4)} AS peak FROM drawdowns")(lambda v: tb.drawdown_table(v.equity, KEY).withColumn("peak", F.round("peak", 4)))
query("r06_rolling_sharpe_table", f"""SELECT sid, d, {r('(mu - 2e-2 / 252e0) / sd * sqrt(252e0)')} AS rolling_sharpe FROM (SELECT sid, d, count(r) OVER w AS n, avg(r) OVER w AS mu, stddev_samp(r) OVER w AS sd FROM returns
      WINDOW w AS (PARTITION BY sid ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) WHERE n = 63 AND sd > 0""")(lambda v: tb.rolling_sharpe_table(v.equity, KEY))
query("r06_greeks_table", " UNION ALL ".join(f"SELECT symbol, entry_date, '{g}' AS greek, {r(g)} AS value FROM book" for g in GREEKS))(lambda v: tb.greeks_table(book(v), ["symbol"], "entry_date"))
query("r07_payoff_table", f"""SELECT g.position_id, g.point, {r('g.pnl')} AS pnl, {r('g.spot')} AS current_spot, coalesce(b.n, 0)::INT AS num_breakevens FROM (
      SELECT position_id, i::INT AS point, spot, sum((greatest({phi()} * (spot * 5e-1 + i * (spot * 1e-1) - strike), 0) - entry_price) * side * quantity * 100) AS pnl FROM every_legs, range(11) t(i) GROUP BY position_id, i, spot) g
    LEFT JOIN (SELECT position_id, count(*) AS n FROM (SELECT *, lead(v) OVER (PARTITION BY position_id ORDER BY s) AS v2 FROM knots) WHERE v * v2 < 0 OR (v = 0 AND v2 <> 0) GROUP BY 1) b USING (position_id)""")(
    lambda v: tb.payoff_table(__import__("catalog.pricing_queries", fromlist=["x"]).every_legs(v), points=11).select("position_id", "point", "pnl", "current_spot", F.greatest(F.coalesce(F.size("breakevens"), F.lit(0)), F.lit(0)).alias("num_breakevens")))
_ST = ("sharpe_ratio", "max_drawdown_frac", "total_return_pct")
query("r08_summary_table", " UNION ALL ".join(f"SELECT sid, '{x}' AS metric, {r(x)} AS value FROM curve_metrics" for x in _ST))(lambda v: tb.summary_table(m.curve_metrics(v.equity, KEY), KEY, _ST))
query("s05_trade_log_page", f"SELECT sid, trade_id, rn::INT AS row FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY exit_date, trade_id) AS rn FROM trades) WHERE rn <= 50")(
    lambda v: tb.trade_log_page(v.trades, KEY, ["exit_date", "trade_id"]).select("sid", "trade_id", "row"))

# ---- T: streams over the event files ----------------------------------------------------------------


def _stream(v, columns):
    spark = v.spark
    schema = v.table("events").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    return src.selectExpr(*columns)


def _drain(v, df, name):
    """Run a stream to the end of its input into a table of the shared folder and read that back."""
    live.use_rocksdb(v.spark)
    base = new_path(v.spark, name)
    q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.read.schema(df.schema).parquet(f"{base}/out")


def _drain_latest(v, df, name, keys):
    """Run a stream to the end of its input, keeping the last state of every key."""
    base = new_path(v.spark, name)
    live.keep_latest(df, f"{base}/out", f"{base}/cp").awaitTermination()
    return live.latest(v.spark, f"{base}/out", keys)


_SYM = "concat('S', cast(floor(user_id / 10) as string)) as symbol"
query("t01_stream_chain", f"SELECT 'S' || (user_id // 10) AS symbol, event_id, {r('value')} AS price FROM events")(lambda v: _drain(v, _stream(v, [_SYM, "event_id", "value as price"]), "t01"))
query("t02_stream_snapshots", f"""SELECT 'S' || (user_id // 10) AS symbol, ts::DATE AS d, {r('avg(value) FILTER (value BETWEEN 40 AND 60)')} AS spot, {r('avg(1e-1 + value / 1000) FILTER (value BETWEEN 40 AND 60)')} AS iv, count(*) AS chain_size FROM events GROUP BY ALL""")(
    lambda v: _drain_latest(v, live.stream_snapshots(_stream(v, [_SYM, "cast(ts as timestamp) as quote_ts", "value / 100 as delta", "0.1D + value / 1000 as vol", "value as strike"])), "t02", ["symbol", "d"]))
query("t03_stream_stale_quotes", """SELECT contract, count(*) AS stale FROM (SELECT *, row_number() OVER (PARTITION BY contract, g ORDER BY ts, event_id) AS n FROM (
      SELECT *, sum(ch) OVER (PARTITION BY contract ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN p = lag(p) OVER (PARTITION BY contract ORDER BY ts, event_id) THEN 0 ELSE 1 END AS ch FROM (
        SELECT 'C' || user_id AS contract, ts, event_id, floor(value / 40) AS p FROM events)))) WHERE n >= 3 GROUP BY 1""")(
    lambda v: _drain(v, live.stream_stale_quotes(_stream(v, ["concat('C', user_id) as contract", "cast(ts as timestamp) as quote_ts", "event_id as seq", "cast(floor(value / 40) as double) as price", "date'2024-01-20' as expiration"])), "t03").groupBy("contract").agg(F.count(F.lit(1)).alias("stale")))
query("t04_stream_exit_monitor", """SELECT 'C' || user_id AS position_id, arg_min(CASE WHEN value - 50 >= 120 THEN 'profit_target' WHEN value - 50 <= -49.5 THEN 'stop_loss' END, ts) AS exit_reason FROM events WHERE value - 50 >= 120 OR value - 50 <= -49.5 GROUP BY user_id""")(
    lambda v: _drain(v, live.stream_exit_monitor(
        _stream(v, ["concat('C', user_id) as position_id", "cast(ts as timestamp) as quote_ts", "event_id as seq", "value - 50 as pnl", "30 as dte", "date'2024-02-16' as expiration"]),
        v.table("events").select(F.concat(F.lit("C"), "user_id").alias("position_id")).distinct().selectExpr("position_id", "100D as net_premium", "1.2D as profit_target", "0.495D as loss_limit", "7 as exit_dte", "1e9D as trail")), "t04").select("position_id", "exit_reason"))


def _batches(v):
    base = new_path(v.spark, "t05")

    def keep(batch, number):
        batch.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{base}/out")

    live.on_step(_stream(v, [_SYM]), keep, f"{base}/cp").awaitTermination()
    return v.spark.read.parquet(f"{base}/out").groupBy("symbol").agg(F.sum("n").alias("n"))


query("t05_on_step", "SELECT 'S' || (user_id // 10) AS symbol, count(*) AS n FROM events GROUP BY 1")(_batches)
