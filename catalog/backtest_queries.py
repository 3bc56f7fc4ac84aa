"""K, X and backtest-fed R queries: many strategies on every symbol, end to end."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from voltable.operators import metrics as m, risk as k
from voltable.plans import backtest as bt, execution as ex, strategies as sg, tables as tb
from voltable.plans.lineage import materialize, new_path, still_written

from .base import query, r
from .chain_queries import _MID, snapshots
from .pricing_queries import GREEKS, every_legs, greeks_of
from .sqlviews import view

# definition, its condition in SQL, width, wing
DEFS = [
    (sg.short_straddle_rule("straddle", 60.0, max_positions=2, sizing_value=2.0), "iv_rank >= 60", 5, 5),
    (sg.iron_condor_rule("condor", 30.0, width=10.0, wing=5.0, min_dte=45, max_positions=3, sizing_method="capital_percent", sizing_value=0.05), "iv_rank >= 30", 10, 5),
    *[(row, sql, 5 if "straddle" in row["structure_type"] else 10, 5) for row, sql in zip(
        sg.volatility_regime_rules("regime", 14.0, 22.0, 1, width=10.0, wing=5.0),
        ("vix > 22 AND regime_days >= 1", "vix BETWEEN 14 AND 22 AND regime_days >= 1", "vix < 14 AND regime_days >= 1"))],
    (sg.strategy("either", "long_strangle", [sg.condition("iv_rank", "<", 20), sg.condition("weekday", "==", 0)], combine="or", width=10.0, wing=5.0, exit_base="premium",
                 max_holding_days=6, exit_dte=None, loss_limit=0.5), "(iv_rank < 20 OR isodow(d) = 1)", 10, 5),
    (sg.strategy("not_high", "bull_put_spread", [sg.condition("vix", ">", 20, negate=True)], width=5.0, wing=5.0, max_positions=1), "NOT coalesce(vix > 20, false)", 5, 5),
    # a width off the strike grid finds no quotes and opens nothing; a missing wing is half the width
    (sg.strategy("narrow", "bull_put_spread", [sg.condition("vix", ">", 20, negate=True)], max_positions=1), "NOT coalesce(vix > 20, false)", 2.5, 5),
    (sg.strategy("half_wing", "iron_condor", [sg.condition("iv_rank", ">=", 30)], min_dte=45, max_positions=2), "iv_rank >= 30", 10, None),
    # stops inside the run: a share of the peak given back, dollars lost by the whole position; sizes by the entry delta
    (sg.strategy("trail", "short_strangle", [sg.condition("iv_rank", ">=", 30)], min_dte=45, trailing_stop=0.3, max_positions=2), "iv_rank >= 30", 10, 5),
    (sg.strategy("dollars", "long_straddle", [sg.condition("vix", ">", 12)], stop_dollars=150.0, loss_limit=None, exit_base="premium", sizing_value=2.0, max_positions=3), "vix > 12", 5, 5),
    (sg.strategy("by_delta", "bull_call_spread", [sg.condition("vix", ">", 14)], exit_base="premium", trailing_stop=0.5, stop_dollars=400.0, sizing_method="delta_target", sizing_value=1.5, max_positions=2), "vix > 14", 10, 5),
    (sg.strategy("default_width", "long_strangle", [sg.condition("iv_rank", ">=", 30)], min_dte=45), "iv_rank >= 30", None, None),
]
for _row, _, _w, _g in DEFS:
    _row["width"], _row["wing"] = (None if x is None else float(x) for x in (_w, _g))
TARGETS = (0.05, 0.2)


def strategies(v):
    return sg.parameter_sweep(sg.for_symbols([row for row, *_ in DEFS], v.bars), {"profit_target": list(TARGETS)})


_RUNS: dict = {}


def _inputs(v):
    """Chain and snapshots as written tables, once per session and folder while the tables exist."""
    key = (v.spark.sparkContext.applicationId, v.folder, "inputs")
    if key not in _RUNS or not all(map(still_written, _RUNS[key])):
        chain = materialize(v.quotes, "chain")
        v.__dict__["quotes"] = chain
        _RUNS[key] = (chain, materialize(snapshots(v), "snapshots"))
    return _RUNS[key]


def _written_once(v, name, make):
    """Written tables of one session and folder, made again if they are gone."""
    key = (v.spark.sparkContext.applicationId, v.folder, name)
    if key not in _RUNS or not all(map(still_written, _RUNS[key])):
        _RUNS[key] = make()
    return _RUNS[key]


def _signals(v):
    return _written_once(v, "signals", lambda: (bt.prepare_signals(strategies(v), *_inputs(v)),))[0]


def _instances(v):
    """Legs and instances of the signals."""
    return _written_once(v, "instances", lambda: bt.prepare_instances(_signals(v), *_inputs(v)))


def run(v):
    """The backtest's result tables, once per session and folder while its tables exist: the queries below are its outputs."""
    key = (v.spark.sparkContext.applicationId, v.folder, "run")
    if key not in _RUNS or not all(map(still_written, _RUNS[key].values())):
        chain, snaps = _inputs(v)
        _RUNS[key] = bt.run_backtest(strategies(v), chain, snaps, slippage_pct=0.01, prepared=(_signals(v), *_instances(v)))
    return _RUNS[key]


def _val(x):
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}e0" if isinstance(x, float) else str(x)


_COLS = ("structure_type", "min_dte", "target_dte", "max_dte", "width", "wing", "exit_dte", "loss_limit", "exit_base", "max_holding_days", "regime_exit", "trailing_stop", "stop_dollars", "max_positions", "sizing_method",
         "sizing_value", "max_contracts", "capital")
view("defs", "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join([_val(row["strategy_id"]), *[_val(row[c]) for c in _COLS]]) + ")" for row, *_ in DEFS) + f") t(def, {', '.join(_COLS)})")
view("strats", "SELECT def || '_' || symbol || '|profit_target=' || t AS strategy_id, d.*, s.symbol, t::DOUBLE AS profit_target FROM defs d, (SELECT DISTINCT symbol FROM bars) s, "
     "(VALUES " + ", ".join(f"('{t}')" for t in TARGETS) + ") x(t)")
view("sig0", " UNION ALL ".join(f"SELECT '{row['strategy_id']}' AS def, symbol, d, spot, iv_rank, vix FROM snapshots WHERE {sql}" for row, sql, *_ in DEFS))
view("sig_exp", """SELECT s.def, s.symbol, s.d, s.spot, arg_min(e.expiration, (abs(e.dte - x.target_dte), e.expiration)) AS expiration FROM sig0 s JOIN defs x USING (def)
    JOIN (SELECT DISTINCT symbol, quote_date AS d, expiration, dte FROM quotes) e ON e.symbol = s.symbol AND e.d = s.d AND e.dte BETWEEN x.min_dte AND x.max_dte GROUP BY ALL""")
view("sig_width", """SELECT t.* EXCLUDE (width, wing), s.d AS entry_date, s.spot, s.expiration, round_even(s.spot / 5e0, 0) * 5e0 AS atm,
      coalesce(t.width, round_even(s.spot / 5e0, 0) * 5e0 * CASE WHEN t.structure_type LIKE '%spread' THEN 2e-2 ELSE 5e-2 END) AS width, t.wing AS wing0
    FROM strats t JOIN sig_exp s ON s.def = t.def AND s.symbol = t.symbol""")
view("signals", """SELECT strategy_id, def, symbol, entry_date, spot, expiration, structure_type, atm, width, wing,
      symbol || '_' || strftime(entry_date, '%Y%m%d') || '_' || structure_type || '_' || strftime(expiration, '%Y%m%d') || '_' || printf('%.2f_%.4f_%.4f', atm, width, wing) AS instance_id,
      exit_dte, profit_target, loss_limit, exit_base, max_holding_days, regime_exit, trailing_stop, stop_dollars, max_positions, sizing_method, sizing_value, max_contracts, capital
    FROM (SELECT *, coalesce(wing0, width * 5e-1) AS wing FROM sig_width)""")
view("inst_legs0", f"""SELECT i.*, t.leg_no, t.option_type, t.side, i.atm + t.w * i.width + t.g * i.wing AS strike, q.px AS entry_price, q.bid, q.ask
    FROM (SELECT DISTINCT instance_id, symbol, entry_date, spot, expiration, structure_type, atm, width, wing FROM signals) i JOIN templates t USING (structure_type)
    LEFT JOIN (SELECT symbol AS s, quote_date, expiration AS e, option_type AS o, strike AS k, {_MID} AS px, bid, ask FROM quotes) q
      ON q.s = i.symbol AND q.quote_date = i.entry_date AND q.e = i.expiration AND q.o = t.option_type AND q.k = i.atm + t.w * i.width + t.g * i.wing""")
view("inst_legs", "SELECT * FROM inst_legs0 WHERE instance_id NOT IN (SELECT instance_id FROM inst_legs0 WHERE coalesce(entry_price, 0) <= 0)")
view("paths", f"""SELECT l.instance_id, s.d, sum((q.px - l.entry_price) * l.side * 100) AS pnl, sum(q.px * l.side * 100) AS value, (l.expiration - s.d)::INT AS dte, s.regime
    FROM inst_legs l JOIN snapshots s ON s.symbol = l.symbol AND s.d > l.entry_date AND s.d <= l.expiration
    JOIN (SELECT symbol, quote_date, expiration, option_type, strike, {_MID} AS px FROM quotes) q ON q.symbol = l.symbol AND q.quote_date = s.d AND q.expiration = l.expiration AND q.option_type = l.option_type AND q.strike = l.strike
    GROUP BY l.instance_id, s.d, l.expiration, s.regime""")
view("facts", """SELECT instance_id, c AS net_premium, n AS num_legs, CASE WHEN wd IS NOT NULL AND c > 0 THEN wd * 100 - c WHEN c <= 0 THEN -c END AS max_loss,
      greatest(CASE WHEN c > 0 THEN greatest(mg - c, c) ELSE mg END, 0) AS margin FROM (
      SELECT instance_id, sum(-side * entry_price) * 100 AS c, count(*) AS n,
        sum(CASE WHEN side > 0 THEN entry_price * 100 ELSE greatest(spot * 20 + entry_price * 100 - (CASE WHEN option_type = 'call' THEN greatest(strike - spot, 0) ELSE greatest(spot - strike, 0) END) * 100, strike * 10 + entry_price * 100, entry_price * 100) END) AS mg,
        max(CASE WHEN structure_type = 'iron_condor' THEN wing WHEN structure_type LIKE '%spread' THEN width END) AS wd FROM inst_legs GROUP BY instance_id)""")
# net Greeks of one contract per instance and day, at the day's spot and volatility
view("inst_terms", """SELECT l.instance_id, s.d, l.side, l.option_type, l.strike, s.spot, CASE WHEN s.iv > 0 THEN s.iv ELSE 2e-1 END AS vol, (l.expiration - s.d)::INT / 365e0 AS t
    FROM inst_legs l JOIN snapshots s ON s.symbol = l.symbol AND s.d >= l.entry_date AND s.d < l.expiration""")
view("inst_greeks", "SELECT instance_id, d, " + ", ".join(f"sum(side * {g}) AS {g}" for g in GREEKS) + f" FROM ({greeks_of('inst_terms')}) GROUP BY ALL")
view("sized", """SELECT s.*, f.net_premium, f.num_legs, f.margin, CASE WHEN exit_base = 'premium' THEN nullif(abs(f.net_premium), 0) WHEN f.net_premium > 0 THEN f.net_premium END AS base,
      greatest(least(CASE WHEN sizing_method = 'fixed' THEN floor(sizing_value) WHEN sizing_method = 'capital_percent' THEN CASE WHEN f.margin > 0 THEN floor(capital * sizing_value / f.margin) ELSE 1 END
        WHEN sizing_method = 'delta_target' THEN CASE WHEN g.delta <> 0 THEN floor(sizing_value / abs(g.delta)) ELSE 1 END END, max_contracts), 1)::INT AS quantity
    FROM signals s JOIN facts f USING (instance_id) LEFT JOIN inst_greeks g ON g.instance_id = s.instance_id AND g.d = s.entry_date""")
view("peaks", "SELECT *, max(pnl) OVER (PARTITION BY instance_id ORDER BY d) AS peak FROM paths")


def _exits_sql(custom: str = "false") -> str:
    return f"""SELECT strategy_id, instance_id, arg_min({{'d': d, 'pnl': pnl, 'why': why}}, d) AS x FROM (
      SELECT s.strategy_id, s.instance_id, p.d, p.pnl, CASE WHEN p.dte <= coalesce(s.exit_dte, 0) THEN 'expiration' WHEN p.pnl / s.base >= s.profit_target THEN 'profit_target' WHEN p.pnl / s.base <= -s.loss_limit THEN 'stop_loss'
          WHEN p.pnl * s.quantity <= -s.stop_dollars THEN 'dollar_stop' WHEN p.peak > 0 AND (p.peak - p.pnl) / p.peak >= s.trailing_stop THEN 'trailing_stop'
          WHEN p.d - s.entry_date >= s.max_holding_days THEN 'holding_period'
          WHEN s.regime_exit AND ((s.structure_type LIKE 'long%' AND p.regime = 'HIGH') OR (s.structure_type LIKE 'short%' AND p.regime = 'LOW')) THEN 'regime_change'
          WHEN {custom} THEN 'custom' END AS why
      FROM sized s JOIN peaks p USING (instance_id)) WHERE why IS NOT NULL GROUP BY ALL"""


view("exits", _exits_sql())
view("candidates", """SELECT s.*, s.strategy_id || '|' || s.instance_id AS position_id, x.x.d AS exit_date, x.x.pnl AS exit_pnl, x.x.why AS exit_reason
    FROM sized s LEFT JOIN exits x USING (strategy_id, instance_id)""")
view("numbered", "SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY entry_date, symbol, position_id) AS rn FROM candidates")
_FOLD = """WITH RECURSIVE fold AS (
      SELECT strategy_id, 0::BIGINT AS rn, []::DATE[] AS open, NULL::VARCHAR AS position_id, false AS ok FROM (SELECT DISTINCT strategy_id FROM numbered)
      UNION ALL
      SELECT strategy_id, rn, CASE WHEN ok THEN list_append(still, fin) ELSE still END, position_id, ok FROM (
        SELECT n.strategy_id, n.rn, n.position_id, coalesce(n.exit_date, DATE '9999-12-31') AS fin, list_filter(f.open, lambda x: x > n.entry_date) AS still, len(list_filter(f.open, lambda x: x > n.entry_date)) < n.max_positions AS ok
        FROM fold f JOIN numbered n ON n.strategy_id = f.strategy_id AND n.rn = f.rn + 1))
    SELECT c.* FROM candidates c JOIN fold f ON f.position_id = c.position_id AND f.ok"""
view("accepted", f"SELECT * FROM ({_FOLD})")


def _fills(source: str, day: str, entry: bool) -> str:
    buy = "side > 0" if entry else "side < 0"
    base = f"(CASE WHEN bid > 0 AND ask > 0 THEN CASE WHEN {buy} THEN ask ELSE bid END WHEN px > 0 THEN CASE WHEN {buy} THEN px * 101e-2 ELSE px * 99e-2 END ELSE CASE WHEN {buy} THEN entry_price * 101e-2 ELSE entry_price * 99e-2 END END)"
    return f"""SELECT instance_id, {day} AS d, sum(CASE WHEN {buy} THEN -1 ELSE 1 END * greatest({base} + (CASE WHEN {buy} THEN 1 ELSE -1 END) * {base} * 1e-2, 0)) * 100 AS premium,
      sum({base}) AS slip, count(*) * 65e-2 AS comm FROM {source} GROUP BY ALL"""


view("entry_exec", _fills("(SELECT *, entry_price AS px FROM inst_legs)", "entry_date", True))
view("exit_legs", f"""SELECT l.instance_id, l.side, l.entry_price, c.exit_date, q.bid, q.ask, q.px FROM inst_legs l JOIN (SELECT DISTINCT instance_id, exit_date FROM accepted WHERE exit_date IS NOT NULL) c USING (instance_id)
    LEFT JOIN (SELECT symbol, quote_date, expiration, option_type, strike, {_MID} AS px, bid, ask FROM quotes) q ON q.symbol = l.symbol AND q.quote_date = c.exit_date AND q.expiration = l.expiration AND q.option_type = l.option_type AND q.strike = l.strike""")
view("exit_exec", _fills("exit_legs", "exit_date", False))
view("positions", """SELECT a.strategy_id, a.position_id, a.instance_id, a.symbol, a.structure_type, a.expiration, a.entry_date, a.exit_date, a.exit_reason, a.quantity, a.num_legs, a.capital, a.net_premium * a.quantity AS net_premium,
      a.margin * a.quantity AS margin, (-e.premium + e.comm + e.slip) * a.quantity AS total_cost, (x.premium - x.comm - x.slip) * a.quantity AS total_proceeds, e.comm * a.quantity AS entry_commission, x.comm * a.quantity AS exit_commission,
      e.slip * a.quantity AS entry_slippage, x.slip * a.quantity AS exit_slippage, a.exit_pnl * a.quantity AS realized_pnl, ((x.premium - x.comm - x.slip) - (-e.premium + e.comm + e.slip)) * a.quantity AS realized_pnl_fill,
      (a.exit_date - a.entry_date)::INT AS hold_days
    FROM accepted a JOIN entry_exec e USING (instance_id) LEFT JOIN exit_exec x ON x.instance_id = a.instance_id AND x.d = a.exit_date""")
view("pos_marks", """SELECT p.strategy_id, p.position_id, p.symbol, t.d, t.value * p.quantity AS value, t.pnl * p.quantity AS pnl, t.dte FROM positions p JOIN paths t USING (instance_id) WHERE p.exit_date IS NULL OR t.d < p.exit_date""")
view("log0", """SELECT strategy_id, position_id AS structure_id, structure_type, symbol AS underlying, 'open' AS action, entry_date AS d, num_legs, net_premium, total_cost, NULL::DOUBLE AS total_proceeds, entry_commission AS commission, entry_slippage AS slippage, NULL::DOUBLE AS realized_pnl, NULL AS exit_reason FROM positions
    UNION ALL SELECT strategy_id, position_id, structure_type, symbol, 'close', exit_date, num_legs, net_premium, NULL, total_proceeds, exit_commission, exit_slippage, realized_pnl, exit_reason FROM positions WHERE exit_date IS NOT NULL""")
view("log", "SELECT *, 'T' || lpad(row_number() OVER (PARTITION BY strategy_id ORDER BY d, action, structure_id)::VARCHAR, 6, '0') AS trade_id FROM log0")
_SUMS = ("f", "z", "v", "u", "o", *GREEKS)


def _flow(source: str, d: str = "d", **named: str) -> str:
    return f"SELECT strategy_id, {d} AS d, {', '.join(f'{named[x]} AS {x}' if x in named else f'0e0 AS {x}' for x in _SUMS)} FROM {source}"


view("flows", f"SELECT strategy_id, d, {', '.join(f'sum({x}) AS {x}' for x in _SUMS)} FROM (" + " UNION ALL ".join([
    _flow("positions", "entry_date", f="-total_cost", v="-net_premium", o="1"), _flow("positions WHERE exit_date IS NOT NULL", "exit_date", f="total_proceeds", z="realized_pnl"),
    _flow("pos_marks", v="value", u="pnl", o="1"),
    _flow("positions JOIN inst_greeks g USING (instance_id) WHERE g.d >= entry_date AND (exit_date IS NULL OR g.d < exit_date)", "g.d", **{g: f"g.{g} * quantity" for g in GREEKS})]) + ") GROUP BY ALL")
view("curve", f"""SELECT g.strategy_id, g.d, g.capital + sum(coalesce(f, 0)) OVER w AS cash, coalesce(v, 0) AS positions_value, g.capital + sum(coalesce(f, 0)) OVER w + coalesce(v, 0) AS equity, coalesce(o, 0)::BIGINT AS num_positions,
      sum(coalesce(z, 0)) OVER w AS realized_pnl, coalesce(u, 0) AS unrealized_pnl, {', '.join(f'coalesce({g}, 0) AS {g}' for g in GREEKS)}
    FROM (SELECT t.strategy_id, t.capital, s.d FROM strats t JOIN snapshots s USING (symbol)) g LEFT JOIN flows USING (strategy_id, d) WINDOW w AS (PARTITION BY g.strategy_id ORDER BY g.d)""")

_SIG = "strategy_id, instance_id, symbol, entry_date, expiration, structure_type"
SIG = [x.strip() for x in _SIG.split(",")]
query("k01_entry_signals", f"SELECT {_SIG} FROM signals")(lambda v: _signals(v).select(*SIG))
for _qid, _pre in (("k02_short_straddle_rule", "straddle"), ("k03_iron_condor_rule", "condor"), ("k04_volatility_regime_rule", "regime")):
    query(_qid, f"SELECT {_SIG} FROM signals WHERE def LIKE '{_pre}%'")(lambda v, p=_pre: _signals(v).filter(F.col("strategy_id").startswith(p)).select(*SIG))


def _exits(v, custom=None):
    return bt.scan_exits(_signals(v), _instances(v)[1], custom)


_EXIT = ("strategy_id", "instance_id", "exit_date", "exit_reason", "exit_pnl")
query("k05_first_exit", f"SELECT strategy_id, instance_id, exit_date, exit_reason, {r('exit_pnl')} AS exit_pnl FROM candidates")(lambda v: _exits(v).select(*_EXIT))
query("k05_stops", f"SELECT strategy_id, exit_reason, count(*) AS n, {r('sum(exit_pnl * quantity)', 4)} AS pnl FROM candidates WHERE exit_reason IN ('trailing_stop', 'dollar_stop') GROUP BY ALL", 4)(
    lambda v: _exits(v).filter(F.col("exit_reason").isin("trailing_stop", "dollar_stop")).groupBy("strategy_id", "exit_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("exit_pnl") * F.col("quantity")).alias("pnl")))
query("k07_entry_delta", f"SELECT s.strategy_id, s.instance_id, {r('g.delta')} AS delta_per_contract, quantity FROM sized s JOIN inst_greeks g ON g.instance_id = s.instance_id AND g.d = s.entry_date WHERE sizing_method = 'delta_target'")(
    lambda v: _exits(v).filter("sizing_method = 'delta_target'").select("strategy_id", "instance_id", "delta_per_contract", "quantity"))


def _lost_and_old(day):
    """Down for the third day or later, on a Friday."""
    return (F.datediff(day["d"], F.col("entry_date")) >= 3) & (day["pnl"] * F.col("quantity") < -20) & (F.weekday(day["d"]) == 4)


@F.pandas_udf(BooleanType())
def _lost_and_old_rows(d: pd.Series, entry: pd.Series, pnl: pd.Series, quantity: pd.Series) -> pd.Series:
    d, entry = pd.to_datetime(d), pd.to_datetime(entry)
    return ((d - entry).dt.days >= 3) & (pnl * quantity < -20) & (d.dt.weekday == 4)


_CUSTOM = _exits_sql("p.d - s.entry_date >= 3 AND p.pnl * s.quantity < -20 AND isodow(p.d) = 5")
query("x01_custom_exit", f"""SELECT form, strategy_id, instance_id, x.x.d AS exit_date, x.x.why AS exit_reason, {r('x.x.pnl')} AS exit_pnl
    FROM (SELECT unnest(['column', 'pandas']) AS form, strategy_id, instance_id FROM sized) LEFT JOIN ({_CUSTOM}) x USING (strategy_id, instance_id)""")(
    lambda v: _exits(v, _lost_and_old).select(F.lit("column").alias("form"), *_EXIT).unionByName(
        _exits(v, _lost_and_old_rows("day.d", "entry_date", "day.pnl", "quantity")).select(F.lit("pandas").alias("form"), *_EXIT)))
query("k06_accept_entries", "SELECT strategy_id, position_id, entry_date, exit_date FROM accepted")(lambda v: run(v)["positions"].select("strategy_id", "position_id", "entry_date", "exit_date"))
# trades as candidates of one account per strategy; every seventh leaves on the day it came
view("cand3", """SELECT sid AS strategy_id, 'G' || l_partkey % 5 AS symbol, trade_id AS position_id, entry_date, CASE WHEN l_partkey % 7 = 0 THEN entry_date ELSE exit_date END AS exit_date, round(total_cost) AS need,
      row_number() OVER (PARTITION BY sid ORDER BY entry_date, 'G' || l_partkey % 5, trade_id) AS rn FROM trades""")


def _fold3(rule: str) -> str:
    """Acceptance of `cand3` with three slots and a further rule over the positions still held."""
    return f"""WITH RECURSIVE fold AS (
      SELECT strategy_id, 0::BIGINT AS rn, []::STRUCT(s VARCHAR, e DATE, x DATE, m DOUBLE)[] AS open, NULL::VARCHAR AS position_id, false AS ok FROM (SELECT DISTINCT strategy_id FROM cand3)
      UNION ALL
      SELECT strategy_id, rn, CASE WHEN ok THEN list_append(still, mine) ELSE still END, position_id, ok FROM (
        SELECT *, len(still) < 3 AND {rule} AS ok FROM (
          SELECT n.strategy_id, n.rn, n.position_id, n.symbol, n.need, {{'s': n.symbol, 'e': n.entry_date, 'x': n.exit_date, 'm': n.need}} AS mine, list_filter(f.open, lambda o: o.x > n.entry_date OR o.e = n.entry_date) AS still
          FROM fold f JOIN cand3 n ON n.strategy_id = f.strategy_id AND n.rn = f.rn + 1)))
    SELECT strategy_id, position_id FROM fold WHERE ok"""


def _cand3(v):
    return v.trades.select(
        F.col("sid").alias("strategy_id"), F.concat(F.lit("G"), (F.col("l_partkey") % 5).cast("string")).alias("symbol"), F.col("trade_id").alias("position_id"), "entry_date",
        F.when(F.col("l_partkey") % 7 == 0, F.col("entry_date")).otherwise(F.col("exit_date")).alias("exit_date"), F.round("total_cost").alias("need"), F.lit(3).alias("max_positions"), F.lit(1.5e5).alias("capital"))


for _qid, _rule, _opts in (
        ("k06_accept_slots", "true", {}), ("k06_accept_with_symbol_cap", "len(list_filter(still, lambda o: o.s = symbol)) < 1", {"per_symbol": 1}),
        ("k06_accept_two_per_symbol", "len(list_filter(still, lambda o: o.s = symbol)) < 2", {"per_symbol": 2}),
        ("k06_accept_margin", "need <= 15e4 * 2e-1 AND coalesce(list_sum(list_transform(still, lambda o: o.m)), 0) + need <= 15e4 * 5e-1", {"size": "need", "max_utilization": 0.5})):
    query(_qid, _fold3(_rule))(lambda v, o=_opts: bt.accept_entries(_cand3(v), ["strategy_id"], **o).select("strategy_id", "position_id"))
_SIZES = ("fixed", "risk_percent", "capital_percent", "delta_target", "premium_target", "other")
query("k07_position_size", """SELECT sid, trade_id, m AS method, greatest(least(CASE m WHEN 'fixed' THEN 3 WHEN 'risk_percent' THEN floor(1e6 * 1e-1 / total_cost) WHEN 'capital_percent' THEN floor(1e6 * 1e-1 / (total_cost * 2))
      WHEN 'delta_target' THEN floor(1e-1 / 3e-2) WHEN 'premium_target' THEN floor(1e-1 / total_cost) ELSE 1 END, 20), 1)::INT AS size
    FROM trades, (VALUES ('fixed'), ('risk_percent'), ('capital_percent'), ('delta_target'), ('premium_target'), ('other')) t(m)""")(
    lambda v: v.trades.withColumn("method", F.explode(F.array(*map(F.lit, _SIZES)))).withColumns({
        "sizing_method": F.col("method"), "sizing_value": F.when(F.col("method") == "fixed", F.lit(3.0)).otherwise(F.lit(0.1)), "capital": F.lit(1e6), "max_loss_per_contract": F.col("total_cost"),
        "margin_per_contract": F.col("total_cost") * 2.0, "delta_per_contract": F.lit(0.03), "premium_per_contract": F.col("total_cost"), "max_contracts": F.lit(20)}).select(
        "sid", "trade_id", "method", sg.position_size().alias("size")))
view("leg_quotes", f"SELECT l.*, q.bid, q.ask, q.volume, {_MID.replace('bid', 'q.bid').replace('ask', 'q.ask')} AS px FROM every_legs l LEFT JOIN quotes q ON q.symbol = l.symbol AND q.quote_date = l.entry_date AND q.expiration = l.expiration AND q.option_type = l.option_type AND q.strike = l.strike AND q.volume % 4 <> 0")


def leg_quotes(v):
    from voltable.operators.chain import lookup_quotes

    return lookup_quotes(every_legs(v), v.quotes.filter("volume % 4 <> 0"), "entry_date")


_FB = "(CASE WHEN bid > 0 AND ask > 0 THEN CASE WHEN side > 0 THEN ask ELSE bid END WHEN px > 0 THEN px * (CASE WHEN side > 0 THEN 101e-2 ELSE 99e-2 END) WHEN entry_price > 0 THEN entry_price * (CASE WHEN side > 0 THEN 101e-2 ELSE 99e-2 END) END)"
query("k08_fill_price", f"SELECT position_id, leg_no, {r(_FB)} AS fill FROM leg_quotes")(
    lambda v: leg_quotes(v).select("position_id", "leg_no", ex.fill_price(F.col("side") > 0, entry="entry_price").alias("fill")))
view("k09", f"""SELECT position_id, structure_type, count(*) AS num_legs, sum(quantity)::BIGINT AS num_contracts, CASE WHEN count(fb) = count(*) THEN sum((CASE WHEN side > 0 THEN -1 ELSE 1 END) * greatest(fb + (CASE WHEN side > 0 THEN 1 ELSE -1 END) * fb * 2e-2, 0) * quantity * 100) END AS total_premium,
      sum(fb * 2e-2 * quantity * 100) AS slippage, sum(quantity * 65e-2) AS commission FROM (SELECT *, {_FB} AS fb FROM leg_quotes) GROUP BY ALL""")
query("k09_execute_entry", f"SELECT position_id, structure_type, num_legs, num_contracts, {r('total_premium', 6)} AS total_premium, {r('slippage', 6)} AS slippage, {r('commission', 6)} AS commission, {r('-total_premium + commission + slippage', 6)} AS total_cost FROM k09", 6)(
    lambda v: ex.execute(leg_quotes(v), ["position_id", "structure_type"], "entry", slippage_pct=0.02, entry="entry_price"))
query("k09_execute_exit_single_slippage", f"""SELECT position_id, {r('CASE WHEN count(fb) = count(*) THEN sum((CASE WHEN side < 0 THEN -1 ELSE 1 END) * greatest(fb + (CASE WHEN side < 0 THEN 1 ELSE -1 END) * fb * 2e-2, 0) * quantity * 100) - sum(quantity * 65e-2) END', 6)} AS total_proceeds
    FROM (SELECT *, CASE WHEN bid > 0 AND ask > 0 THEN CASE WHEN side < 0 THEN ask ELSE bid END WHEN px > 0 THEN px * (CASE WHEN side < 0 THEN 101e-2 ELSE 99e-2 END) WHEN entry_price > 0 THEN entry_price * (CASE WHEN side < 0 THEN 101e-2 ELSE 99e-2 END) END AS fb FROM leg_quotes) GROUP BY ALL""", 6)(
    lambda v: ex.execute(leg_quotes(v), ["position_id"], "exit", slippage_pct=0.02, slippage_mode="single", entry="entry_price").select("position_id", "total_proceeds"))
query("k10_volume_impact", f"SELECT symbol, quote_date, expiration, strike, option_type, {r('CASE WHEN volume - 300 <= 0 THEN 1e-1 ELSE least(5e-1 * sqrt(10 / (volume - 300)::DOUBLE), 1e-1) END')} AS impact FROM quotes")(
    lambda v: v.quotes.select("symbol", "quote_date", "expiration", "strike", "option_type", ex.volume_impact(F.lit(10.0), F.col("volume") - 300).alias("impact")))
view("orders_in", """SELECT symbol, quote_date, expiration, strike, option_type, bid, ask, volume, CASE WHEN volume % 2 = 0 THEN 'buy' ELSE 'sell' END AS order_type,
      CASE volume % 3 WHEN 0 THEN 'market' WHEN 1 THEN 'limit' ELSE 'stop' END AS order_style, 40 AS quantity, mid * 101e-2 AS limit_price, mid * 99e-2 AS stop_price FROM quotes""")
view("orders_done", """SELECT *, CASE WHEN filled > 0 THEN greatest(base + sg * (base * 1e-2 + mid * impact), 1e-2) ELSE 0 END AS fill, CASE WHEN filled > 0 THEN base * 1e-2 * filled * 100 ELSE 0 END AS slip, CASE WHEN filled > 0 THEN mid * impact * filled * 100 ELSE 0 END AS icost FROM (
      SELECT *, CASE WHEN filled > 0 THEN CASE WHEN volume <= 0 THEN 1e-1 ELSE least(5e-1 * sqrt(filled / volume::DOUBLE), 1e-1) END ELSE 0e0 END AS impact FROM (
        SELECT *, CASE WHEN why = 'filled' THEN least(quantity, greatest(floor(volume * 1e-1), 1)) ELSE 0 END::BIGINT AS filled FROM (
          SELECT *, (bid + ask) / 2 AS mid, CASE WHEN order_type = 'buy' THEN 1e0 ELSE -1e0 END AS sg,
            CASE WHEN order_style = 'limit' THEN CASE WHEN order_type = 'buy' THEN least(ask, limit_price) ELSE greatest(bid, limit_price) END WHEN order_type = 'buy' THEN ask ELSE bid END AS base,
            CASE WHEN NOT (bid > 0 AND ask > 0) THEN 'no_quote' WHEN order_style = 'market' OR (order_style = 'limit' AND ((order_type = 'buy' AND ask <= limit_price) OR (order_type = 'sell' AND bid >= limit_price)))
              OR (order_style = 'stop' AND ((order_type = 'buy' AND (bid + ask) / 2 >= stop_price) OR (order_type = 'sell' AND (bid + ask) / 2 <= stop_price))) THEN 'filled' ELSE 'not_marketable' END AS why FROM orders_in)))""")


def orders(v):
    vol = F.col("volume")
    return ex.execute_orders(v.quotes.select(
        "symbol", "quote_date", "expiration", "strike", "option_type", "bid", "ask", "volume", F.when(vol % 2 == 0, F.lit("buy")).otherwise(F.lit("sell")).alias("order_type"),
        F.when(vol % 3 == 0, F.lit("market")).when(vol % 3 == 1, F.lit("limit")).otherwise(F.lit("stop")).alias("order_style"), F.lit(40).alias("quantity"), (F.col("mid") * 1.01).alias("limit_price"),
        (F.col("mid") * 0.99).alias("stop_price")), partial_fills=True)


query("k11_execute_orders", f"""SELECT symbol, quote_date, expiration, strike, option_type, why AS fill_reason, filled AS filled_quantity, {r('fill')} AS fill_price, {r('impact')} AS volume_impact,
      {r("CASE WHEN filled > 0 AND order_type = 'buy' THEN fill * filled * 100 + filled * 65e-2 + slip + icost ELSE 0 END", 4)} AS total_cost,
      {r("CASE WHEN filled > 0 AND order_type = 'sell' THEN fill * filled * 100 - filled * 65e-2 - slip - icost ELSE 0 END", 4)} AS total_proceeds,
      {r('CASE WHEN filled > 0 THEN 1 - (slip + icost) / (fill * filled * 100) ELSE 1 END')} AS execution_quality, {r('filled / quantity')} AS fill_rate FROM orders_done""")(
    lambda v: orders(v).select("symbol", "quote_date", "expiration", "strike", "option_type", "fill_reason", "filled_quantity", "fill_price", "volume_impact",
                               F.round("total_cost", 4).alias("total_cost"), F.round("total_proceeds", 4).alias("total_proceeds"), "execution_quality", "fill_rate"))
query("f22_order_statistics", f"""SELECT symbol, count(*) AS num_executions, count_if(quantity - filled > 0) AS num_partial_fills, {r('avg(filled / quantity)')} AS avg_fill_rate, {r('coalesce(avg(impact) FILTER (filled > 0), 0)')} AS avg_volume_impact,
      {r('coalesce(max(impact) FILTER (filled > 0), 0)')} AS max_volume_impact, {r('coalesce(avg(1 - (slip + icost) / (fill * filled * 100)) FILTER (filled > 0), 0)')} AS avg_execution_quality, {r('sum(icost)')} AS total_impact_cost, {r('sum(filled * 65e-2)')} AS total_commission FROM orders_done GROUP BY symbol""")(
    lambda v: ex.order_statistics(orders(v), ["symbol"]))
view("k12", f"""SELECT position_id, sum(CASE WHEN side > 0 THEN pr + fees ELSE 0 END) AS total_cost, sum(CASE WHEN side > 0 THEN -pr ELSE pr - fees END) AS total_premium, sum(comm) AS commission, sum(slip) AS slippage, sum(icost) AS impact_cost,
      sum(done)::BIGINT AS filled, sum(q - done)::BIGINT AS unfilled FROM (
      SELECT *, comm + slip + icost AS fees FROM (SELECT position_id, side, q, done, done * 65e-2 AS comm, coalesce(b * 1e-2 * done * 100, 0) AS slip, coalesce(mid * im * done * 100, 0) AS icost,
          CASE WHEN done > 0 THEN greatest(b + (CASE WHEN side > 0 THEN 1 ELSE -1 END) * (b * 1e-2 + mid * im), 1e-2) * done * 100 ELSE 0 END AS pr
        FROM (SELECT *, quantity AS q, CASE WHEN side > 0 THEN ask ELSE bid END AS b, (bid + ask) / 2 AS mid, least(5e-1 * sqrt(quantity / volume::DOUBLE), 1e-1) AS im, CASE WHEN bid > 0 AND ask > 0 THEN quantity ELSE 0 END AS done FROM leg_quotes))) GROUP BY position_id""")
query("k12_execute_structures", f"SELECT position_id, {', '.join(f'{r(x, 4)} AS {x}' for x in ('total_cost', 'total_premium', 'commission', 'slippage', 'impact_cost'))}, filled AS filled_contracts, unfilled AS unfilled_contracts, {r('1 - (slippage + impact_cost) / greatest(abs(total_premium), 1)', 4)} AS execution_quality FROM k12", 4)(
    lambda v: ex.execute_structures(leg_quotes(v), ["position_id"]))
_POS = ("net_premium", "margin", "total_cost", "total_proceeds", "entry_commission", "exit_commission", "entry_slippage", "exit_slippage", "realized_pnl", "realized_pnl_fill")
query("k17_positions", "SELECT strategy_id, position_id, instance_id, symbol, structure_type, expiration, entry_date, exit_date, exit_reason, quantity, num_legs, capital, hold_days, " + ", ".join(f"{r(x, 7)} AS {x}" for x in _POS) + " FROM positions", 7)(
    lambda v: run(v)["positions"])
query("k13_mark_to_market", f"SELECT strategy_id, position_id, symbol, d, {r('value', 7)} AS value, {r('pnl', 7)} AS pnl, dte FROM pos_marks", 7)(lambda v: run(v)["marks"])
_LOG = ("net_premium", "total_cost", "total_proceeds", "commission", "slippage", "realized_pnl")
query("k14_trade_log", "SELECT strategy_id, structure_id, structure_type, underlying, action, d, num_legs, exit_reason, trade_id, " + ", ".join(f"{r(x, 7)} AS {x}" for x in _LOG) + " FROM log", 7)(lambda v: run(v)["trade_log"])
_CUR = ("cash", "positions_value", "equity", "realized_pnl", "unrealized_pnl", *GREEKS)
query("k15_equity_curve", "SELECT strategy_id, d, num_positions, " + ", ".join(f"{r(x, 7)} AS {x}" for x in _CUR) + " FROM curve", 7)(lambda v: run(v)["equity_curve"])
query("k15_greeks_history", "SELECT strategy_id, d, " + ", ".join(f"{r(g, 7)} AS {g}" for g in GREEKS) + " FROM curve", 7)(lambda v: run(v)["greeks_history"])
query("g05_run_greeks", " UNION ALL ".join(
    f"SELECT strategy_id, '{g}' AS greek, {r(f'avg({g})')} AS mean, {r(f'min({g})')} AS min, {r(f'max({g})')} AS max, {r(f'arg_max({g}, d)')} AS current, count({g}) AS count FROM curve GROUP BY 1" for g in GREEKS))(
    lambda v: k.greeks_over_time(run(v)["greeks_history"], ["strategy_id"]).select("strategy_id", "greek", "mean", "min", "max", "current", "count"))
query("g06_run_attribution", f"""SELECT strategy_id, {r('coalesce(sum(pd * ds), 0)', 4)} AS delta_pnl, {r('coalesce(sum(pg * ds * ds / 2), 0)', 4)} AS gamma_pnl, {r('coalesce(sum(theta), 0)', 4)} AS theta_pnl, {r('coalesce(sum(pv * dv), 0)', 4)} AS vega_pnl
    FROM (SELECT *, lag(delta) OVER w AS pd, lag(gamma) OVER w AS pg, lag(vega) OVER w AS pv, spot - lag(spot) OVER w AS ds, vol - lag(vol) OVER w AS dv
      FROM (SELECT c.*, s.spot, s.iv AS vol FROM curve c JOIN strats t USING (strategy_id) JOIN snapshots s ON s.symbol = t.symbol AND s.d = c.d) WINDOW w AS (PARTITION BY strategy_id ORDER BY d)) GROUP BY 1""", 4)(lambda v: _attributed(v))


def _attributed(v):
    days = _inputs(v)[1].select("symbol", "d", "spot", F.col("iv").alias("vol"))
    history = run(v)["greeks_history"].join(strategies(v).select("strategy_id", "symbol"), "strategy_id").join(days, ["symbol", "d"]).withColumn("pnl", F.lit(0.0))
    return k.greeks_pnl_attribution(history, ["strategy_id"]).select("strategy_id", "delta_pnl", "gamma_pnl", "theta_pnl", "vega_pnl")


query("r06_run_greeks", " UNION ALL ".join(f"SELECT strategy_id, d, '{g}' AS greek, {r(g, 7)} AS value FROM curve" for g in GREEKS), 7)(lambda v: tb.greeks_table(run(v)["greeks_history"], ["strategy_id"]))
query("k16_close_records", f"""SELECT strategy_id, position_id, structure_type, symbol, entry_date, exit_date, exit_reason, {r('net_premium', 4)} AS net_premium, {r('realized_pnl', 4)} AS realized_pnl,
      {r('CASE WHEN net_premium <> 0 THEN realized_pnl / abs(net_premium) ELSE 0 END', 4)} AS return_pct, hold_days FROM positions WHERE exit_date IS NOT NULL""", 4)(lambda v: bt.close_records(run(v)["positions"]))
query("k17_run_totals", f"""SELECT c.strategy_id, {r('final_equity', 7)} AS final_equity, {r('rp', 7)} AS realized_pnl, coalesce(o, 0) AS trades_opened, coalesce(cl, 0) AS trades_closed FROM (SELECT strategy_id, arg_max(equity, d) AS final_equity, arg_max(realized_pnl, d) AS rp FROM curve GROUP BY 1) c
    LEFT JOIN (SELECT strategy_id, count(*) AS o, count(exit_date) AS cl FROM positions GROUP BY 1) p USING (strategy_id)""", 7)(lambda v: bt.run_totals(run(v)))
query("k22_position_summary", f"""SELECT symbol, structure_type, count(*) AS positions, count_if(exit_date IS NULL) AS open_positions, {r('sum(net_premium)', 4)} AS net_premium, {r('sum(margin) FILTER (exit_date IS NULL)', 4)} AS open_margin,
      {r('sum(realized_pnl)', 4)} AS realized_pnl, sum(quantity)::BIGINT AS contracts FROM positions GROUP BY ALL""", 4)(lambda v: bt.position_summary(run(v)["positions"], ["symbol", "structure_type"]))
query("k23_pnl_summary", f"""SELECT strategy_id, d, {r('realized_pnl', 9)} AS realized_pnl, {r('unrealized_pnl', 9)} AS unrealized_pnl, {r('realized_pnl + unrealized_pnl', 9)} AS total_pnl, {r('(realized_pnl + unrealized_pnl) / 1e5', 9)} AS return_frac,
      {r('equity', 9)} AS equity, {r('CASE WHEN equity > 0 THEN abs(positions_value) / equity END', 9)} AS utilization FROM curve""", 9)(lambda v: bt.pnl_summary(run(v)["equity_curve"]))
query("k24_lifecycle", """SELECT strategy_id, position_id, CASE WHEN exit_date <= DATE '2024-01-18' THEN 'closed' WHEN entry_date = DATE '2024-01-18' THEN 'open' WHEN entry_date < DATE '2024-01-18' THEN 'active' ELSE 'pending' END AS state, false AS is_duplicate FROM positions""")(
    lambda v: bt.lifecycle(run(v)["positions"], "2024-01-18"))
query("f22_execution_summary", f"""SELECT strategy_id, count(*) AS num_executions, count_if(action = 'open') AS num_entries, count_if(action = 'close') AS num_exits, {r('sum(commission)', 7)} AS total_commissions, {r('sum(slippage)', 7)} AS total_slippage,
      {r('avg(commission)', 7)} AS avg_commission, sum(num_legs)::BIGINT AS total_contracts FROM log GROUP BY 1""", 7)(
    lambda v: ex.execution_summary(run(v)["trade_log"].withColumns({"kind": F.when(F.col("action") == "open", F.lit("entry")).otherwise(F.lit("exit")), "num_contracts": F.col("num_legs")}), ["strategy_id"]))
query("r04_entry_exit_markers", f"""SELECT strategy_id, underlying, l.d, action, {r('b.spot')} AS price, (CASE WHEN action = 'open' THEN 1 ELSE -1 END * CASE WHEN structure_type LIKE 'short%' OR structure_type LIKE 'iron%' THEN -1 ELSE 1 END)::INT AS sign
    FROM log l LEFT JOIN bars b ON b.symbol = l.underlying AND b.d = l.d""")(lambda v: tb.entry_exit_markers(v.bars, run(v)["trade_log"]))
query("r09_portfolio_timeline", f"SELECT c.strategy_id, c.d, {r('c.equity', 7)} AS equity, coalesce(n, 0)::INT AS held, {r('coalesce(p, 0)', 7)} AS held_pnl FROM curve c LEFT JOIN (SELECT strategy_id, d, count(*) AS n, sum(pnl) AS p FROM pos_marks GROUP BY ALL) USING (strategy_id, d)", 7)(
    lambda v: bt.portfolio_timeline(run(v)["equity_curve"], run(v)["marks"]).select(
        "strategy_id", "d", "equity", F.coalesce(F.size("open_positions"), F.lit(0)).alias("held"),
        F.coalesce(F.aggregate("open_positions", F.lit(0.0), lambda a, x: a + x["pnl"]), F.lit(0.0)).alias("held_pnl")).withColumn("held", F.greatest("held", F.lit(0))))
def _written(v):
    from voltable.sources.sinks import read_results, write_results

    base = new_path(v.spark, "results")
    write_results({x: run(v)[x] for x in ("equity_curve", "trade_log", "greeks_history")}, base)
    got = [read_results(v.spark, base, x) for x in ("equity_curve", "trade_log", "greeks_history")]
    curve, log, greeks = (x.groupBy("strategy_id").agg(F.count(F.lit(1)).alias(f"{n}_rows"), *more) for x, n, more in zip(got, ("curve", "log", "greeks"), (
        [F.sum("equity").alias("equity")], [], [F.sum("delta").alias("delta"), F.sum("vega").alias("vega")])))
    return curve.join(log, "strategy_id", "left").join(greeks, "strategy_id").na.fill(0, ["log_rows"])


query("a17_write_results", f"""SELECT c.strategy_id, c.n AS curve_rows, c.n AS greeks_rows, coalesce(l.n, 0) AS log_rows, {r('equity', 4)} AS equity, {r('delta', 4)} AS delta, {r('vega', 4)} AS vega
    FROM (SELECT strategy_id, count(*) AS n, sum(equity) AS equity, sum(delta) AS delta, sum(vega) AS vega FROM curve GROUP BY 1) c LEFT JOIN (SELECT strategy_id, count(*) AS n FROM log GROUP BY 1) l USING (strategy_id)""", 4)(_written)
query("x01_custom_rule", f"SELECT {_SIG} FROM signals WHERE spot > 45")(
    lambda v: bt.with_instances(bt.entry_signals(bt.with_expiries(_inputs(v)[1], _inputs(v)[0]), strategies(v), custom=F.col("spot") > 45)).select(*SIG))
_TPL = ("high_iv_straddle", "iron_condor", "wheel", "earnings_straddle", "trend_following")
_TROWS = [sg.template(t) for t in _TPL]
query("k18_templates", "SELECT t.name || '_' || s.symbol AS strategy_id, s.symbol, t.* EXCLUDE (name) FROM (SELECT DISTINCT symbol FROM bars) s, (VALUES " + ", ".join(
    "(" + ", ".join(_val(row[c]) for c in ("strategy_id", "structure_type", "min_dte", "max_dte", "target_dte", "profit_target", "max_positions", "sizing_method", "sizing_value")) + f", {len(row['conditions'])})" for row in _TROWS) +
    ") t(name, structure_type, min_dte, max_dte, target_dte, profit_target, max_positions, sizing_method, sizing_value, num_conditions)")(
    lambda v: sg.for_symbols(_TROWS, v.bars).select("strategy_id", "symbol", "structure_type", "min_dte", "max_dte", "target_dte", "profit_target", "max_positions", "sizing_method", "sizing_value",
                                                    F.size("conditions").alias("num_conditions")))
query("k19_strategies_from_config", "SELECT 'cfg_' || symbol AS strategy_id, symbol, 'iron_condor' AS structure_type, 'cfg_' || symbol AS name, 40 AS target_dte, 30 AS min_dte, 5e-1 AS profit_target, 'or' AS combine, 2 AS num_conditions, 1e5 AS capital FROM (SELECT DISTINCT symbol FROM bars)")(
    lambda v: sg.strategies_from_config(v.bars.select("symbol").distinct().select(F.concat(
        F.lit('{"strategy_id": "cfg_'), "symbol", F.lit('", "symbol": "'), "symbol", F.lit('", "structure_type": "iron_condor", "target_dte": 40, "combine": "or", "conditions": ' + json.dumps([sg.condition("iv_rank", ">", 50), sg.condition("vix", "<", 15)]) + "}"))
        .alias("config"))).select("strategy_id", "symbol", "structure_type", "name", "target_dte", "min_dte", "profit_target", "combine", F.size("conditions").alias("num_conditions"), "capital"))
_BAD = {"NAME_TOO_SHORT": ("warning", "n % 2 = 0"), "CAPITAL_TOO_LOW": ("error", "n % 3 = 0"), "DTE_VERY_LONG": ("warning", "n % 5 = 0"), "QUANTITY_INVALID": ("error", "n % 7 = 0"), "WIDTH_MISSING": ("warning", "true"), "POSITIONS_TOO_MANY": ("warning", "n % 4 = 1"), "MAX_POSITIONS_HIGH": ("warning", "n % 4 = 1")}
query("k20_validate_strategies", " UNION ALL ".join(f"SELECT 'v_' || symbol AS strategy_id, '{c}' AS code, '{s}' AS severity FROM (SELECT DISTINCT symbol, substr(symbol, 2)::INT AS n FROM bars) WHERE {cond}" for c, (s, cond) in _BAD.items()))(
    lambda v: _invalid(v))


def _invalid(v):
    n = F.substring("symbol", 2, 9).cast("int")
    base = sg.for_symbols([sg.strategy("v", "iron_condor")], v.bars)
    return sg.validate_strategies(base.withColumns({
        "name": F.when(n % 2 == 0, F.lit("ab")).otherwise(F.lit("a fine name")), "capital": F.when(n % 3 == 0, F.lit(500.0)).otherwise(F.lit(1e5)), "target_dte": F.when(n % 5 == 0, F.lit(800)).otherwise(F.lit(45)),
        "sizing_value": F.when(n % 7 == 0, F.lit(0.0)).otherwise(F.lit(1.0)), "max_positions": F.when(n % 4 == 1, F.lit(200)).otherwise(F.lit(5))}))


query("k21_parameter_sweep", "SELECT 's_' || symbol || '|exit_dte=' || e || '|loss_limit=' || l AS strategy_id, symbol, e AS exit_dte, l::DOUBLE AS loss_limit FROM (SELECT DISTINCT symbol FROM bars), (VALUES (5), (7), (14), (21)) a(e), (VALUES ('0.5'), ('1.0'), ('2.0')) b(l)")(
    lambda v: sg.parameter_sweep(sg.for_symbols([sg.strategy("s", "short_straddle")], v.bars), {"exit_dte": [5, 7, 14, 21], "loss_limit": [0.5, 1.0, 2.0]}).select("strategy_id", "symbol", "exit_dte", "loss_limit"))
query("x05_strategy_builder", "SELECT 'fluent_' || symbol AS strategy_id, symbol, 'iron_condor' AS structure_type, 40 AS target_dte, 25 AS min_dte, 60 AS max_dte, 'risk_percent' AS sizing_method, 2e-2 AS sizing_value, 4 AS max_positions FROM (SELECT DISTINCT symbol FROM bars)")(
    lambda v: sg.for_symbols([sg.StrategyBuilder("fluent").when("iv_rank", ">", 50).structure("iron_condor", 40, 10.0, 5.0).dte_between(25, 60).exit_at(0.5, 2.0, 7).position_size("risk_percent", 0.02).max_positions(4).build()], v.bars).select(
        "strategy_id", "symbol", "structure_type", "target_dte", "min_dte", "max_dte", "sizing_method", "sizing_value", "max_positions"))
query("f20_backtest_metrics", f"""SELECT strategy_id, {r('(z - a) / a * 100')} AS total_return_pct, {r('CASE WHEN sd < 1e-10 THEN 0 ELSE (mu - 2e-2 / 252) / sd * sqrt(252) END')} AS sharpe_ratio, {r('mdd')} AS max_drawdown_frac FROM (
      SELECT strategy_id, arg_min(equity, d) AS a, arg_max(equity, d) AS z, avg(rr) AS mu, stddev_samp(rr) AS sd, min(equity / pk - 1) AS mdd FROM (
        SELECT *, equity / lag(equity) OVER w - 1 AS rr, max(equity) OVER w AS pk FROM curve WINDOW w AS (PARTITION BY strategy_id ORDER BY d)) GROUP BY 1)""")(
    lambda v: m.curve_metrics(run(v)["equity_curve"], ["strategy_id"]).select("strategy_id", "total_return_pct", "sharpe_ratio", "max_drawdown_frac"))
query("g15_position_limits", """SELECT strategy_id, code, 'warning' AS severity FROM (
      SELECT p.strategy_id, unnest(CASE WHEN big > eq * 0.01 THEN ['POSITION_TOO_LARGE'] ELSE [] END) AS code FROM (SELECT strategy_id, max(abs(net_premium)) AS big FROM positions WHERE exit_date IS NULL GROUP BY 1) p JOIN (SELECT strategy_id, arg_max(equity, d) AS eq FROM curve GROUP BY 1) USING (strategy_id))""")(
    lambda v: k.risk_limit_report(run(v)["equity_curve"], ["strategy_id"], max_drawdown=9.0, max_daily_loss=9.0, max_position=0.01, max_delta=1e9,
                                  positions=run(v)["positions"].filter("exit_date is null").select("strategy_id", F.col("net_premium").alias("position_value"), F.lit(0.0).alias("delta"))))
