"""F, G, W and C05 queries over the daily curves and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltable.operators import metrics as m, risk as k, series as s

from .base import query, r
from .sqlviews import view

KEY = ["sid"]
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
DAYS = "252e0"

view("curve_agg", f"""
    SELECT e.sid, arg_min(e.equity, e.d) AS a, arg_max(e.equity, e.d) AS z, count(*) AS n, avg(e.r) AS mu, stddev_samp(e.r) AS sd,
           count(e.r) AS nr, sqrt(avg(least(e.r, 0e0) ** 2)) AS down, count_if(e.r < 0) AS neg, min(x.dd) AS mdd,
           avg(x.dd) AS avg_dd, sqrt(avg(x.dd * x.dd)) AS ulcer
    FROM returns e JOIN drawdowns x ON x.sid = e.sid AND x.d = e.d GROUP BY e.sid""")
view("curve_metrics", f"""
    SELECT sid, (z - a) / a * 100e0 AS total_return_pct, pow(z / a, {DAYS} / (n - 1)) - 1e0 AS annualized_return, sd * sqrt({DAYS}) AS volatility,
           CASE WHEN sd < 1e-10 THEN 0e0 ELSE (mu - 2e-2 / {DAYS}) / sd * sqrt({DAYS}) END AS sharpe_ratio,
           CASE WHEN neg < 1 THEN NULL WHEN down < 1e-10 THEN 0e0 ELSE (mu - 2e-2 / {DAYS}) / down * sqrt({DAYS}) END AS sortino_ratio,
           mdd AS max_drawdown_frac, avg_dd AS average_drawdown, ulcer AS ulcer_index, z AS final_equity, n AS days,
           CASE WHEN abs(mdd) < 1e-10 THEN NULL ELSE (pow(z / a, {DAYS} / (n - 1)) - 1e0) / abs(mdd) END AS calmar_ratio
    FROM curve_agg""")
view("trade_agg", """
    SELECT sid, count(realized_pnl) AS n, count_if(realized_pnl > 0) AS w, avg(realized_pnl) FILTER (realized_pnl > 0) AS aw,
           avg(realized_pnl) FILTER (realized_pnl < 0) AS al, coalesce(sum(realized_pnl) FILTER (realized_pnl > 0), 0) AS gp,
           abs(coalesce(sum(realized_pnl) FILTER (realized_pnl < 0), 0)) AS gl, avg(realized_pnl) AS avt FROM trades GROUP BY sid""")
view("trade_metrics", """
    SELECT sid, w * 100e0 / n AS win_rate_pct, CASE WHEN gl < 1e-10 THEN NULL ELSE gp / gl END AS profit_factor, aw AS average_win,
           al AS average_loss, avt AS average_trade, (w / n::DOUBLE) * coalesce(aw, 0) - (1 - w / n::DOUBLE) * abs(coalesce(al, 0)) AS expectancy,
           CASE WHEN aw IS NULL OR al IS NULL THEN 0e0 ELSE abs(aw / al) END AS payoff_ratio, n AS closed_trades FROM trade_agg""")


def _islands(flag: str) -> str:
    """Longest run by the difference of two row numbers."""
    order = "exit_date, l_orderkey, l_linenumber, l_partkey, l_suppkey"
    return f"""
      SELECT k.sid, coalesce(max(n), 0)::BIGINT AS best FROM (SELECT DISTINCT sid FROM trades) k LEFT JOIN (
        SELECT sid, g, count(*) AS n FROM (
          SELECT sid, f, row_number() OVER (PARTITION BY sid ORDER BY {order}) - row_number() OVER (PARTITION BY sid, f ORDER BY {order}) AS g
          FROM (SELECT *, {flag} AS f FROM trades)) WHERE f GROUP BY sid, g) i ON i.sid = k.sid GROUP BY k.sid"""


view("win_streaks", _islands("realized_pnl > 0"))
view("loss_streaks", _islands("realized_pnl < 0"))

query("w01_simple_returns", f"SELECT sid, d, {r('r', 8)} AS r FROM returns", 8)(
    lambda v: s.simple_returns(v.equity, KEY).select("sid", "d", "r"))
query("w01_log_returns", f"SELECT symbol, d, {r('CASE WHEN c > 0 AND p > 0 THEN ln(c / p) END', 8)} AS lr FROM "
      "(SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY d) AS p FROM bars_long)", 8)(
    lambda v: s.log_returns(v.bars_long, ["symbol"]).select("symbol", "d", "lr"))
query("w02_drawdown_series", f"SELECT sid, d, {r('dd')} AS dd, {r('dd_value', 4)} AS dd_value FROM drawdowns")(
    lambda v: s.drawdown_series(v.equity, KEY).select("sid", "d", "dd", F.round("dd_value", 4).alias("dd_value")))
query("w03_rolling_sharpe", f"""
    SELECT sid, d, {r('CASE WHEN n = 63 AND sd > 0 THEN (mu - 2e-2 / 252e0) / sd * sqrt(252e0) END')} AS rolling_sharpe FROM (
      SELECT sid, d, count(r) OVER w AS n, avg(r) OVER w AS mu, stddev_samp(r) OVER w AS sd FROM returns
      WINDOW w AS (PARTITION BY sid ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))""")(
    lambda v: s.rolling_sharpe(s.simple_returns(v.equity, KEY), KEY).select("sid", "d", "rolling_sharpe"))
query("w04_historical_volatility", f"""
    SELECT symbol, d, {r('CASE WHEN n = 20 THEN sd * sqrt(252e0) END')} AS hv FROM (
      SELECT symbol, d, count(lr) OVER w AS n, stddev_samp(lr) OVER w AS sd FROM (
        SELECT *, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY d)) AS lr FROM bars_long)
      WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")(
    lambda v: s.historical_volatility(v.bars_long, ["symbol"]).select("symbol", "d", "hv"))
_W252 = "WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
query("w05_iv_minmax_rank", f"""
    SELECT symbol, d, {r('CASE WHEN n >= 30 THEN CASE WHEN hi = lo THEN 50e0 ELSE (iv - lo) / (hi - lo) * 100e0 END END')} AS iv_rank FROM (
      SELECT symbol, d, iv, count(iv) OVER w AS n, min(iv) OVER w AS lo, max(iv) OVER w AS hi FROM bars_long {_W252})""")(
    lambda v: s.iv_minmax_rank(v.bars_long, ["symbol"]).select("symbol", "d", "iv_rank"))
query("w06_iv_pct_below", f"""
    SELECT symbol, d, {r('CASE WHEN len(xs) >= 30 THEN len(list_filter(xs, lambda x: x < iv)) * 100e0 / len(xs) END')} AS iv_pct_below FROM (
      SELECT symbol, d, iv, list(iv) OVER w AS xs FROM bars_long {_W252})""")(
    lambda v: s.iv_pct_below(v.bars_long, ["symbol"]).select("symbol", "d", "iv_pct_below"))
query("w07_iv_pct_le", f"""
    SELECT symbol, d, {r('len(list_filter(xs, lambda x: x <= iv)) * 100e0 / len(xs)')} AS iv_pct_le FROM (
      SELECT symbol, d, iv, list(iv) OVER w AS xs FROM bars_long {_W252})""")(
    lambda v: s.iv_pct_le(v.bars_long, ["symbol"]).select("symbol", "d", "iv_pct_le"))
query("w10_cumulative_pnl", f"""
    SELECT sid, trade_id, exit_date, {r('sum(pnl_dec) OVER (PARTITION BY sid ORDER BY exit_date, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)', 4)}
      AS cumulative_pnl FROM trades""", 4)(
    lambda v: s.running_total(v.trades, KEY, "exit_date", ORDER, "pnl_dec", "cum").select(
        "sid", "trade_id", "exit_date", F.col("cum").cast("double").alias("cumulative_pnl")))

for _name, _qid, _fn in (
    ("total_return_pct", "f01_total_return", m.total_return), ("annualized_return", "f02_annualized_return", m.annualized_return),
    ("sharpe_ratio", "f03_sharpe_ratio", m.sharpe_ratio), ("sortino_ratio", "f04_sortino_ratio", m.sortino_ratio),
    ("average_drawdown", "f07_average_drawdown", m.average_drawdown), ("ulcer_index", "f08_ulcer_index", m.ulcer_index),
):
    query(_qid, f"SELECT sid, {r(_name)} AS {_name} FROM curve_metrics")(lambda v, fn=_fn: fn(v.equity, KEY))
query("f05_calmar_ratio", f"SELECT sid, {r('annualized_return')} AS annualized_return, {r('max_drawdown_frac')} AS max_drawdown, "
      f"{r('calmar_ratio')} AS calmar_ratio FROM curve_metrics")(lambda v: m.calmar_ratio(v.equity, KEY))
query("f06_max_drawdown", f"""
    WITH t AS (SELECT sid, arg_min({{'dd': dd, 'd': d, 'v': dd_value, 'e': equity, 'p': peak}}, (dd, d)) AS t FROM drawdowns GROUP BY sid),
    p AS (SELECT t.sid, t.t, min(x.d) AS peak_date FROM t JOIN drawdowns x ON x.sid = t.sid AND x.equity = t.t.p AND x.d <= t.t.d GROUP BY ALL),
    q AS (SELECT t.sid, min(x.d) AS recovery_date FROM t JOIN drawdowns x ON x.sid = t.sid AND x.d >= t.t.d AND x.equity >= t.t.p GROUP BY ALL)
    SELECT p.sid, {r('t.dd')} AS max_drawdown_frac, {r('t.v', 4)} AS max_drawdown_value, peak_date, {r('t.p', 4)} AS peak_value,
           t.d AS trough_date, {r('t.e', 4)} AS trough_value, recovery_date, (t.d - peak_date)::INT AS duration_days,
           (recovery_date - t.d)::INT AS recovery_days FROM p LEFT JOIN q USING (sid)""")(
    lambda v: m.max_drawdown(v.equity, KEY).withColumns({c: F.round(c, 4) for c in ("max_drawdown_value", "peak_value", "trough_value")}))

for _qid, _name in (
    ("f09_win_rate", "win_rate_pct"), ("f10_profit_factor", "profit_factor"), ("f11_average_win", "average_win"),
    ("f12_average_loss", "average_loss"), ("f13_average_trade", "average_trade"), ("f14_expectancy", "expectancy"),
    ("f15_payoff_ratio", "payoff_ratio"),
):
    query(_qid, f"SELECT sid, {r(_name)} AS {_name} FROM trade_metrics")(lambda v, n=_name: m.trade_metric(v.trades, KEY, n))
query("f16_max_consecutive_wins", "SELECT sid, best AS max_consecutive_wins FROM win_streaks")(
    lambda v: m.consecutive_wins(v.trades, KEY, order=ORDER))
query("f17_max_consecutive_losses", "SELECT sid, best AS max_consecutive_losses FROM loss_streaks")(
    lambda v: m.consecutive_losses(v.trades, KEY, order=ORDER))


def skew(x: str) -> str:
    """Population skewness from central moments."""
    return f"avg(({x} - mu) ** 3) / pow(avg(({x} - mu) ** 2), 15e-1)"


def kurt(x: str) -> str:
    return f"avg(({x} - mu) ** 4) / (avg(({x} - mu) ** 2) ** 2) - 3"


PCT = (1, 5, 10, 25, 50, 75, 90, 95, 99)
PCT_SQL = ", ".join(r(f"quantile_cont(r, {p} / 100e0)") + f" AS p{p}" for p in PCT)
view("centred", "SELECT *, avg(r) OVER (PARTITION BY sid) AS mu, stddev_samp(r) OVER (PARTITION BY sid) AS sd FROM returns WHERE r IS NOT NULL")
query("f18_returns_distribution", f"""
    SELECT sid, {r('avg(r)')} AS mean, {r('median(r)')} AS median, {r('stddev_samp(r)')} AS std, {r('var_samp(r)')} AS variance,
      {r(skew('r'))} AS skewness, {r(kurt('r'))} AS kurtosis, {r('min(r)')} AS min, {r('max(r)')} AS max, {r('max(r) - min(r)')} AS range,
      count(r) AS count, {PCT_SQL} FROM centred GROUP BY sid""")(lambda v: m.returns_distribution(v.equity, KEY))
query("f18_trade_distribution", f"""
    SELECT sid, {r('avg(r)')} AS mean, {r('stddev_samp(r)', 4)} AS std, {r(skew('r'))} AS skewness, {r(kurt('r'))} AS kurtosis, {r('min(r)')} AS min,
      {r('max(r)')} AS max, count(r) AS count, {PCT_SQL}
    FROM (SELECT sid, realized_pnl AS r, avg(realized_pnl) OVER (PARTITION BY sid) AS mu FROM trades) GROUP BY sid""")(
    lambda v: m.value_distribution(v.trades, KEY, "realized_pnl").withColumn("std", F.round("std", 4)))

view("months", """
    SELECT g.sid, g.month, last_value(h.value IGNORE NULLS) OVER (PARTITION BY g.sid ORDER BY g.month) AS value FROM (
      SELECT sid, unnest(generate_series(min(date_trunc('month', d)), max(date_trunc('month', d)), INTERVAL 1 MONTH))::DATE AS month FROM equity GROUP BY sid) g
    LEFT JOIN (SELECT sid, date_trunc('month', d)::DATE AS month, arg_max(equity, d) AS value FROM equity GROUP BY ALL) h USING (sid, month)""")
view("month_returns", "SELECT sid, month, value / lag(value) OVER (PARTITION BY sid ORDER BY month) - 1e0 AS mr FROM months")
query("f19_monthly_returns", f"SELECT sid, year(month)::INT AS year, month(month)::INT AS month, {r('mr')} AS month_return FROM month_returns")(
    lambda v: m.monthly_returns(v.equity, KEY))
query("r02_monthly_heatmap", "SELECT sid, year(month)::INT AS year, " + ", ".join(
    f"{r(f'max(mr * 100e0) FILTER (month(month) = {i + 1})')} AS \"{n}\"" for i, n in enumerate(m.MONTH_NAMES)) + " FROM month_returns GROUP BY ALL")(
    lambda v: m.monthly_table(v.equity, KEY, percent=True))
_CURVE = ("total_return_pct", "annualized_return", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown_frac", "average_drawdown",
          "ulcer_index", "final_equity", "calmar_ratio")
_TRADE = ("win_rate_pct", "profit_factor", "average_win", "average_loss", "average_trade", "expectancy", "payoff_ratio")
view("all_metrics", f"""
    SELECT c.*, {", ".join("t." + x for x in _TRADE)}, t.closed_trades, w.best AS max_consecutive_wins, l.best AS max_consecutive_losses
    FROM curve_metrics c LEFT JOIN trade_metrics t USING (sid) LEFT JOIN win_streaks w USING (sid) LEFT JOIN loss_streaks l USING (sid)""")
_ALL_SQL = ", ".join(f"{r(x)} AS {x}" for x in _CURVE + _TRADE)
query("f20_all_metrics", f"SELECT sid, {_ALL_SQL}, days, closed_trades, max_consecutive_wins, max_consecutive_losses FROM all_metrics")(
    lambda v: m.all_metrics(v.equity, v.trades, KEY, order=ORDER))
query("f21_strategy_statistics", f"""
    SELECT sid, count_if(p IS NULL) AS num_open, count(p) AS num_closed, {r('coalesce(sum(p), 0)', 4)} AS realized_pnl, 0e0 AS unrealized_pnl,
      count_if(p > 0) AS num_wins, count_if(p <= 0) AS num_losses_incl_flat, {r('count_if(p > 0) * 100e0 / count(p)')} AS win_rate_pct,
      {r('avg(p) FILTER (p > 0)')} AS average_win, {r('avg(p) FILTER (p < 0)')} AS average_loss,
      {r('avg(exit_date - entry_date) FILTER (p IS NOT NULL)')} AS avg_hold_days, {r('coalesce(sum(p), 0)', 4)} AS total_pnl,
      {r('coalesce(sum(p), 0) / 1e5')} AS return_frac, {r('1e5 + coalesce(sum(p), 0)', 4)} AS equity,
      {r('coalesce(sum(abs(total_cost)) FILTER (p IS NULL), 0) / 1e5')} AS utilization
    FROM (SELECT *, CASE WHEN l_linenumber <> 7 THEN realized_pnl END AS p FROM trades) GROUP BY sid""")(
    lambda v: m.strategy_statistics(v.trades.withColumn("realized_pnl", F.when(F.col("l_linenumber") != 7, F.col("realized_pnl"))), KEY)
    .withColumns({c: F.round(c, 4) for c in ("realized_pnl", "total_pnl", "equity")}))
# regimes by the size of the benchmark's daily move; a trade's calendar days in a regime's intervals
view("move_regimes", "SELECT d, CASE WHEN abs(rb) < 2e-5 THEN 'LOW' WHEN abs(rb) > 1e-4 THEN 'HIGH' ELSE 'MEDIUM' END AS regime FROM benchmark_returns WHERE rb IS NOT NULL AND d <= DATE '1997-06-30'")
view("regime_runs", """SELECT regime, min(d) AS a, max(d) AS b, count(*) AS days FROM (SELECT *, sum(t) OVER (ORDER BY d) AS g FROM (SELECT *, CASE WHEN regime = lag(regime) OVER (ORDER BY d) THEN 0 ELSE 1 END AS t FROM move_regimes)) GROUP BY g, regime""")
view("trades_asof", "SELECT * REPLACE (CASE WHEN exit_date <= DATE '1997-06-30' THEN realized_pnl END AS realized_pnl), least(exit_date, DATE '1997-06-30') AS z FROM trades WHERE entry_date <= DATE '1997-06-30'")
view("regime_trades", """SELECT sid, regime, count(DISTINCT trade_id) AS trades, sum((least(z, b) - greatest(entry_date, a))::BIGINT + 1)::BIGINT AS trade_days
    FROM trades_asof JOIN regime_runs ON entry_date <= b AND z >= a GROUP BY ALL""")
query("f21_regime_distribution", "SELECT sid, regime, days, trades, trade_days FROM regime_trades JOIN (SELECT regime, sum(days)::BIGINT AS days FROM regime_runs GROUP BY 1) USING (regime)")(
    lambda v: m.regime_distribution(v.trades, KEY, _regimes(v), _AS_OF))
query("f21_statistics_as_of", "SELECT sid, num_open, num_closed, num_wins, " + ", ".join(f"coalesce({c}_{g}, 0) AS {c}_{g}" for g in ("low", "medium", "high") for c in ("days", "trades")) + f""", {r('pnl', 8)} AS realized_pnl, {r('used', 8)} AS utilization
    FROM (SELECT sid, count_if(realized_pnl IS NULL) AS num_open, count(realized_pnl) AS num_closed, count_if(realized_pnl > 0) AS num_wins, coalesce(sum(realized_pnl), 0) AS pnl, coalesce(sum(abs(total_cost)) FILTER (realized_pnl IS NULL), 0) / 1e5 AS used FROM trades_asof GROUP BY 1)
    LEFT JOIN (SELECT sid, """ + ", ".join(f"max({c}) FILTER (regime = '{g.upper()}') AS {c}_{g}" for g in ("low", "medium", "high") for c in ("days", "trades")) + """
      FROM regime_trades JOIN (SELECT regime, sum(days)::BIGINT AS days FROM regime_runs GROUP BY 1) USING (regime) GROUP BY 1) USING (sid)""", 8)(
    lambda v: m.strategy_statistics(v.trades, KEY, as_of=_AS_OF, regimes=_regimes(v)).select(
        "sid", "num_open", "num_closed", "num_wins", *[f"{c}_{g}" for g in ("low", "medium", "high") for c in ("days", "trades")], "realized_pnl", "utilization"))
_AS_OF = "1997-06-30"


def _regimes(v):
    move = F.abs("r")
    returns = s.simple_returns(v.benchmark_equity.withColumn("_all", F.lit(0)), ["_all"])
    return returns.filter("r IS NOT NULL").select("d", F.when(move < 2e-5, F.lit("LOW")).when(move > 1e-4, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("regime"))


query("f24_run_comparison", f"SELECT sid, d, {r('equity / first_value(equity) OVER (PARTITION BY sid ORDER BY d) * 100e0', 8)} AS normalized FROM equity", 8)(
    lambda v: m.run_comparison(v.equity, KEY).select("sid", "d", "normalized"))
query("f25_monthly_compounded", f"SELECT sid, date_trunc('month', d)::DATE AS month, {r('product(1e0 + r) - 1e0')} AS month_return FROM returns WHERE r IS NOT NULL GROUP BY ALL")(
    lambda v: m.monthly_compounded(v.equity, KEY))
query("f25_monthly_sum", f"SELECT sid, date_trunc('month', d)::DATE AS month, {r('sum(r)')} AS month_return FROM returns WHERE r IS NOT NULL GROUP BY ALL")(
    lambda v: m.monthly_compounded(v.equity, KEY, how="sum"))
query("r10_rating_flags", f"""
    SELECT sid, {_ALL_SQL}, days, closed_trades, max_consecutive_wins, max_consecutive_losses,
      CASE WHEN sharpe_ratio > 1 THEN 'good' WHEN sharpe_ratio > 0.5 THEN 'fair' ELSE 'poor' END AS sharpe_band,
      CASE WHEN win_rate_pct > 65 THEN 'good' WHEN win_rate_pct > 50 THEN 'fair' ELSE 'poor' END AS win_rate_band,
      CASE WHEN max_drawdown_frac < -0.15 THEN 'poor' WHEN max_drawdown_frac < -0.10 THEN 'fair' ELSE 'good' END AS drawdown_band,
      CASE WHEN profit_factor > 1.5 THEN 'good' WHEN profit_factor > 1 THEN 'fair' ELSE 'poor' END AS profit_factor_band FROM all_metrics""")(
    lambda v: m.rating_flags(m.all_metrics(v.equity, v.trades, KEY, order=ORDER)))

# ---- risk ---------------------------------------------------------------------------------------

def _returns(v):
    return s.simple_returns(v.equity, KEY).select("sid", "d", "r")


view("var95", "SELECT sid, quantile_cont(r, 0.05) AS v, count(r) AS n FROM returns GROUP BY sid")
view("cvar95", "SELECT r.sid, any_value(v) AS v, avg(r.r) AS cv FROM returns r JOIN var95 USING (sid) WHERE r.r <= v GROUP BY r.sid")
query("g01_var_historical", f"SELECT sid, {r('v', 8)} AS var FROM var95", 8)(lambda v: k.value_at_risk(_returns(v), KEY))
query("g01_var_parametric", f"SELECT sid, {r('avg(r) - 1.645e0 * stddev_samp(r)', 8)} AS var FROM returns GROUP BY sid", 8)(
    lambda v: k.value_at_risk(_returns(v), KEY, method="parametric"))
from .sqlviews import ppf  # noqa: E402

query("g01_var_parametric_any_level", f"SELECT sid, {r('avg(r) - ' + ppf('975e-3') + ' * stddev_samp(r)', 8)} AS var FROM returns GROUP BY sid", 8)(
    lambda v: k.value_at_risk(_returns(v), KEY, confidence=0.975, method="parametric"))
query("g02_conditional_var", f"SELECT sid, {r('v', 8)} AS var, {r('cv', 8)} AS cvar FROM cvar95", 8)(lambda v: k.conditional_var(_returns(v), KEY))
query("g03_var_breaches", f"SELECT sid, count_if(r < -0.001) AS breach_count, {r('count_if(r < -0.001) / count(r)')} AS breach_rate, count(r) AS observations FROM returns GROUP BY sid")(
    lambda v: k.var_breaches(_returns(v), KEY, -0.001))
query("g03_var_breach_dates", f"SELECT sid, d, {r('r', 8)} AS r FROM returns WHERE r < -0.001", 8)(lambda v: k.var_breach_dates(_returns(v), KEY, -0.001))


def _bench(v, name):
    one = v.benchmark_equity.withColumn("_k", F.lit("benchmark"))
    return s.simple_returns(one, ["_k"], out=name).select("d", name)


view("aligned", "SELECT r.sid, r.d, r.r, b.rb, r.r - b.rb AS x FROM returns r JOIN benchmark_returns b USING (d) WHERE r.r IS NOT NULL AND b.rb IS NOT NULL")
query("g04_marginal_var", f"""
    SELECT sid, {r('CASE WHEN count(*) >= 30 THEN covar_samp(rb, r) / var_pop(rb) END')} AS beta,
      {r('CASE WHEN count(*) >= 30 THEN covar_samp(rb, r) / var_pop(rb) * quantile_cont(rb, 0.05) END', 8)} AS marginal_var FROM aligned GROUP BY sid""", 8)(
    lambda v: k.marginal_var(_bench(v, "r_port"), _returns(v), KEY).withColumn("beta", F.round("beta", 6)))
query("c05_align", f"SELECT sid, d, {r('r', 8)} AS r, {r('rb', 8)} AS rb FROM aligned", 8)(
    lambda v: __import__("voltable.operators.joins", fromlist=["align"]).align(_returns(v), _bench(v, "rb"), ["d"], ["r", "rb"]))
view("jb", f"""
    SELECT sid, n, skewness, kurtosis, left_tail_ratio, right_tail_ratio, tail_ratio, n / 6e0 * (skewness ** 2 + kurtosis ** 2 / 4e0) AS jarque_bera FROM (
      SELECT sid, count(*) AS n, {skew('r')} AS skewness, {kurt('r')} AS kurtosis, count_if(r < mu - 2 * sd) / count(*) AS left_tail_ratio,
        count_if(r > mu + 2 * sd) / count(*) AS right_tail_ratio,
        CASE WHEN count_if(r > mu + 2 * sd) > 0 THEN count_if(r < mu - 2 * sd) / count_if(r > mu + 2 * sd) WHEN count_if(r < mu - 2 * sd) > 0 THEN NULL ELSE 1e0 END AS tail_ratio
      FROM centred GROUP BY sid)""")
_TAIL = ", ".join(f"{r(x, 4 if x == 'jarque_bera' else 6)} AS {x}" for x in ("skewness", "kurtosis", "left_tail_ratio", "right_tail_ratio", "tail_ratio", "jarque_bera"))
query("g07_tail_risk", f"SELECT sid, n, {_TAIL}, {r('exp(-5e-1 * jarque_bera)')} AS jb_pvalue, exp(-5e-1 * jarque_bera) > 0.05 AS is_normal FROM jb")(
    lambda v: k.tail_risk(_returns(v), KEY).withColumn("jarque_bera", F.round("jarque_bera", 4)))
view("downside", """
    SELECT sid, sqrt(avg(least(r, 0) ** 2)) AS downside_deviation, avg(least(r, 0) ** 2) AS downside_variance, count_if(r < 0) / count(r) AS loss_probability,
      coalesce(avg(r) FILTER (r < 0), 0) AS average_loss, min(r) AS worst_loss, count_if(r < 0) AS loss_count FROM returns GROUP BY sid""")
_DOWN = ", ".join(f"{r(x, 8)} AS {x}" for x in ("downside_deviation", "downside_variance", "loss_probability", "average_loss", "worst_loss"))
query("g08_downside_risk", f"SELECT sid, {_DOWN}, loss_count FROM downside", 8)(lambda v: k.downside_risk(_returns(v), KEY))


def _margin(v):
    """A margin table: daily cost of the day's trades."""
    return v.trades.groupBy("sid", F.col("exit_date").alias("d")).agg((F.sum("total_cost") * 4.0).alias("margin"))


query("g09_margin_utilization", f"""
    SELECT sid, {r('avg(u)')} AS avg_utilization, {r('max(u)')} AS max_utilization, {r('min(u)')} AS min_utilization, {r('stddev_samp(u)')} AS std_utilization,
      count_if(u > 0.8) AS high_utilization_days, count_if(u > 1) AS margin_call_days, count(u) AS days
    FROM (SELECT e.sid, CASE WHEN equity > 1e-10 THEN margin / equity ELSE 0 END AS u FROM equity e
          JOIN (SELECT sid, exit_date AS d, sum(total_cost) * 4 AS margin FROM trades GROUP BY ALL) t USING (sid, d)) GROUP BY sid""")(
    lambda v: k.margin_utilization(v.equity, _margin(v), KEY))
view("mae", """
    SELECT sid, trade_id, realized_pnl, least(realized_pnl, 0) AS mae, greatest(realized_pnl, 0) AS mfe,
      CASE WHEN abs(total_cost) > 1e-10 THEN least(realized_pnl, 0) / abs(total_cost) END AS mae_pct,
      CASE WHEN realized_pnl > 1e-10 THEN realized_pnl / realized_pnl END AS efficiency FROM trades""")
query("g10_mae_mfe", f"SELECT sid, trade_id, {', '.join(f'{r(x)} AS {x}' for x in ('mae', 'mfe', 'mae_pct', 'efficiency'))} FROM mae")(
    lambda v: k.mae_mfe(v.trades).select("sid", "trade_id", "mae", "mfe", "mae_pct", "efficiency"))
query("g11_mae_statistics", f"""
    SELECT sid, {r('avg(mae)')} AS avg_mae, {r('min(mae)')} AS worst_mae, {r('avg(mfe)')} AS avg_mfe, {r('max(mfe)')} AS best_mfe, {r('avg(mae_pct)')} AS avg_mae_pct,
      {r('avg(efficiency)')} AS avg_efficiency, count(*) AS num_trades FROM mae GROUP BY sid""")(lambda v: k.mae_statistics(k.mae_mfe(v.trades), KEY))
view("risk_all", """
    SELECT c.sid, c.v AS var_95, c.cv AS cvar_95, p.vp AS var_95_parametric, p.v99 AS var_99, j.* EXCLUDE (sid), exp(-5e-1 * jarque_bera) AS jb_pvalue,
      exp(-5e-1 * jarque_bera) > 0.05 AS is_normal, w.* EXCLUDE (sid)
    FROM cvar95 c JOIN (SELECT sid, avg(r) - 1.645e0 * stddev_samp(r) AS vp, quantile_cont(r, 0.01) AS v99 FROM returns GROUP BY sid) p USING (sid)
    LEFT JOIN jb j USING (sid) LEFT JOIN downside w USING (sid)""")
_RISK_COLS = ("var_95", "cvar_95", "var_95_parametric", "var_99", "skewness", "kurtosis", "left_tail_ratio", "right_tail_ratio", "tail_ratio", "jb_pvalue",
              "downside_deviation", "downside_variance", "loss_probability", "average_loss", "worst_loss")
_RISK = ", ".join(f"{r(x)} AS {x}" for x in _RISK_COLS)
query("g12_all_risk_metrics", f"SELECT sid, {_RISK}, {r('jarque_bera', 4)} AS jarque_bera, n, is_normal, loss_count FROM risk_all")(
    lambda v: k.all_risk_metrics(v.equity, KEY).withColumn("jarque_bera", F.round("jarque_bera", 4)))
query("f23_full_backtest_metrics", f"""
    SELECT a.sid, {', '.join(f'{r("a." + x)} AS {x}' for x in _CURVE + _TRADE)}, days, closed_trades, max_consecutive_wins, max_consecutive_losses,
      {', '.join(f'{r("b." + x)} AS {"average_loss_return" if x == "average_loss" else x}' for x in _RISK_COLS)}, {r('jarque_bera', 4)} AS jarque_bera, b.n, is_normal, loss_count FROM all_metrics a LEFT JOIN risk_all b USING (sid)""")(
    lambda v: m.full_backtest_metrics(v.equity, v.trades, KEY, order=ORDER).withColumn("jarque_bera", F.round("jarque_bera", 4)))
view("bench_cmp", """
    SELECT sid, product(1e0 + r) - 1e0 AS strategy_return, product(1e0 + rb) - 1e0 AS benchmark_return,
      (avg(r) - covar_samp(r, rb) / var_pop(rb) * avg(rb)) * 252e0 AS alpha, covar_samp(r, rb) / var_pop(rb) AS beta, corr(r, rb) AS correlation,
      stddev_pop(x) * sqrt(252e0) AS tracking_error, avg(x) * 252e0 / (stddev_pop(x) * sqrt(252e0)) AS information_ratio FROM aligned GROUP BY sid""")
query("g13_compare_to_benchmark", "SELECT sid, " + ", ".join(f"{r(x)} AS {x}" for x in (
    "strategy_return", "benchmark_return", "alpha", "beta", "correlation", "tracking_error", "information_ratio")) + ", strategy_return > benchmark_return AS outperformed FROM bench_cmp")(
    lambda v: k.compare_to_benchmark(_returns(v), _bench(v, "rb"), KEY))


def _flags(source: str, rules: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT sid, '{c}' AS code, '{s_}' AS severity FROM {source} WHERE {cond}" for c, s_, cond in rules)


query("g14_validate_against_benchmark", _flags("bench_cmp", [
    ("SIGNIFICANT_UNDERPERFORMANCE", "warning", "strategy_return < benchmark_return * 0.5"), ("HIGH_BETA", "info", "abs(beta) > 1.5"),
    ("HIGH_TRACKING_ERROR", "info", "tracking_error > 0.3"), ("POOR_RISK_ADJUSTED_RETURN", "warning", "information_ratio < -1")]))(
    lambda v: k.validate_against_benchmark(k.compare_to_benchmark(_returns(v), _bench(v, "rb"), KEY), KEY))
view("limit_facts", "SELECT x.sid, min(dd) AS dd, min(r) AS worst, count(*) AS n FROM drawdowns x JOIN returns r ON r.sid = x.sid AND r.d = x.d GROUP BY x.sid")
query("g15_risk_limit_report", _flags("limit_facts", [
    ("INSUFFICIENT_DATA", "warning", "n < 2"), ("MAX_DRAWDOWN_EXCEEDED", "warning", "dd < -0.02"), ("LARGE_DAILY_LOSS", "warning", "worst < -0.004")]))(
    lambda v: k.risk_limit_report(v.equity, KEY, max_drawdown=0.02, max_daily_loss=0.004))
view("sanity_facts", """
    SELECT c.sid, c.annualized_return AS ann, c.sharpe_ratio AS sharpe, t.closed_trades AS n, t.win_rate_pct / 100e0 AS win, g.gap, m.k, m.sd
    FROM curve_metrics c LEFT JOIN trade_metrics t USING (sid)
    LEFT JOIN (SELECT sid, max(gap) AS gap FROM (SELECT sid, exit_date - lag(exit_date) OVER (PARTITION BY sid ORDER BY exit_date) AS gap FROM (SELECT DISTINCT sid, exit_date FROM trades)) GROUP BY sid) g USING (sid)
    LEFT JOIN (SELECT sid, count(mr) AS k, stddev_pop(mr) AS sd FROM month_returns GROUP BY sid) m USING (sid)""")
query("g16_backtest_sanity", _flags("sanity_facts", [
    ("RETURNS_UNREALISTIC", "warning", "ann > 5"), ("RETURNS_EXTREME_LOSS", "warning", "ann < -0.99"), ("INSUFFICIENT_TRADES", "warning", "coalesce(n, 0) < 10"),
    ("WIN_RATE_SUSPICIOUS", "warning", "win > 0.95 AND n > 20"), ("SHARPE_UNREALISTIC", "warning", "sharpe > 5"),
    ("RETURNS_TOO_CONSISTENT", "warning", "k >= 12 AND sd < 0.01"), ("LARGE_TRADING_GAP", "info", "gap > 60")]))(
    lambda v: k.backtest_sanity(v.equity, v.trades, KEY))
