"""A, B, C, D and E queries over the derived chain, quotes and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltable.functions import conditions as c, instrument as ins

from voltable.operators import chain as ch, quality as q, series as s
from voltable.plans.lineage import new_path
from voltable.sources import calendar as cal, chain_csv as tree, chains as src, sinks

from .base import query, r
from .sqlviews import bs, view

# ---- A: scans and sources -----------------------------------------------------------------------
_CONTRACT = "symbol, quote_date, expiration, strike, option_type"
CONTRACT = ["symbol", "quote_date", "expiration", "strike", "option_type"]

query("a01_scan_option_chain", f"""
    SELECT {_CONTRACT}, {r('bid')} AS bid, {r('ask')} AS ask FROM quotes WHERE symbol = 'S1' AND quote_date = DATE '2024-01-15'
    AND expiration BETWEEN DATE '2024-01-15' AND DATE '2024-03-15' AND option_type = 'put'""")(
    lambda v: src.scan_option_chain(v.quotes, "S1", "2024-01-15", 0, 60, option_type="put").select(*CONTRACT, "bid", "ask"))
query("a01_scan_option_chains_by_request", f"""
    SELECT {_CONTRACT}, {r('mid')} AS mid FROM quotes WHERE (symbol, quote_date) IN (SELECT symbol, d FROM bars WHERE volume >= 20) AND dte BETWEEN 30 AND 80""")(
    lambda v: src.scan_option_chains(v.quotes, v.bars.filter("volume >= 20").select("symbol", F.col("d").alias("quote_date")), 30, 80).select(*CONTRACT, "mid"))
query("a02_scan_historical_options", f"""
    SELECT {_CONTRACT}, {r('mid')} AS mid FROM quotes WHERE symbol = 'S0' AND quote_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
    AND strike IN (40, 50) AND expiration = DATE '2024-03-15'""")(
    lambda v: src.scan_historical_options(v.quotes, "S0", "2024-01-05", "2024-01-20", [40, 50], ["2024-03-15"]).select(*CONTRACT, "mid"))
view("vol_hist", """
    SELECT symbol, d, iv_current, stddev_samp(lr) OVER w AS hv_current, max(iv_current) OVER y AS iv_year_high, min(iv_current) OVER y AS iv_year_low FROM (
      SELECT symbol, d, iv AS iv_current, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY d)) AS lr FROM bars_long)
    WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), y AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")


def vol_history(v):
    base = s.log_returns(v.bars_long, ["symbol"])
    year = s.trailing(["symbol"], 252)
    return base.select("symbol", "d", F.col("iv").alias("iv_current"), F.stddev_samp("lr").over(s.trailing(["symbol"], 20)).alias("hv_current"),
                       F.max("iv").over(year).alias("iv_year_high"), F.min("iv").over(year).alias("iv_year_low"))


_VH = ", ".join(f"{r(x)} AS {x}" for x in ("iv_current", "hv_current", "iv_year_high", "iv_year_low"))
query("a03_scan_volatility_history", f"SELECT symbol, d, {_VH} FROM vol_hist WHERE symbol = 'L2' AND d BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")(
    lambda v: src.scan_volatility_history(vol_history(v), "L2", "1996-01-01", "1998-12-31"))
query("a04_scan_vix_history", f"SELECT 'VIX' AS symbol, d, {r('vix')} AS vix FROM vix WHERE d BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'")(
    lambda v: src.scan_vix_history(v.vix.withColumn("symbol", F.lit("VIX")), "2024-01-03", "2024-01-25"))
_FREE = "SELECT symbol, count(*) AS n, max(strike) AS top FROM {t} WHERE option_type = 'call' GROUP BY symbol"
query("a05_query_sql", _FREE.format(t="quotes"))(
    lambda v: src.query_sql(v.spark, _FREE.format(t="vt_quotes"), {"vt_quotes": v.quotes}))
query("a06_available_symbols", "SELECT DISTINCT symbol FROM quotes WHERE quote_date = DATE '2024-01-10'")(lambda v: src.available_symbols(v.quotes, "2024-01-10"))
query("a07_date_range", "SELECT symbol, min(quote_date) AS first_date, max(quote_date) AS last_date FROM quotes GROUP BY symbol")(
    lambda v: src.date_range(v.quotes, ["symbol"]))
query("a10_coalesce_sources", f"""
    WITH a AS (SELECT {_CONTRACT}, mid FROM quotes WHERE day(quote_date) % 3 = 0), b AS (SELECT {_CONTRACT}, mid + 1 AS mid FROM quotes WHERE day(quote_date) % 2 = 0)
    SELECT {_CONTRACT}, {r('mid')} AS mid, 'primary' AS source FROM a UNION ALL
    SELECT {_CONTRACT}, {r('mid')} AS mid, 'backup' AS source FROM b WHERE (symbol, quote_date) NOT IN (SELECT symbol, quote_date FROM a)""")(
    lambda v: src.coalesce_sources([
        ("primary", 1, v.quotes.filter("day(quote_date) % 3 = 0").select(*CONTRACT, "mid")),
        ("backup", 2, v.quotes.filter("day(quote_date) % 2 = 0").select(*CONTRACT, (F.col("mid") + 1.0).alias("mid")))]))
query("a10_source_counts", """
    SELECT CASE WHEN day(d) % 3 = 0 THEN 'primary' WHEN day(d) % 2 = 0 THEN 'backup' ELSE 'none' END AS source, count(*) AS requests FROM bars GROUP BY 1""")(
    lambda v: src.source_counts(v.bars.select("symbol", F.col("d").alias("quote_date")), src.coalesce_sources([
        ("primary", 1, v.quotes.filter("day(quote_date) % 3 = 0").select(*CONTRACT)),
        ("backup", 2, v.quotes.filter("day(quote_date) % 2 = 0").select(*CONTRACT))])))
query("a11_resolve_underlying_price", f"""
    SELECT b.symbol, b.d AS quote_date, {r("CASE WHEN day(b.d) % 4 = 0 THEN b.c WHEN x.spot IS NOT NULL THEN x.spot ELSE 50 END")} AS price
    FROM bars b LEFT JOIN (SELECT symbol, quote_date, max(CASE WHEN day(quote_date) % 5 <> 0 THEN spot END) AS spot FROM quotes GROUP BY ALL) x
      ON x.symbol = b.symbol AND x.quote_date = b.d""")(
    lambda v: src.resolve_underlying_price(
        v.bars.select("symbol", F.col("d").alias("quote_date")),
        v.bars.filter("day(d) % 4 = 0").select("symbol", F.col("d").alias("quote_date"), F.col("c").alias("close")),
        v.quotes.withColumn("spot", F.when(F.dayofmonth("quote_date") % 5 != 0, F.col("spot")))))
query("a12_volatility_snapshot", f"SELECT symbol, d, {_VH} FROM vol_hist")(lambda v: src.volatility_snapshot(vol_history(v)))
query("a13_load_bars", f"SELECT symbol, d, {r('c')} AS c, volume::DOUBLE AS volume FROM bars WHERE d BETWEEN DATE '2024-01-08' AND DATE '2024-01-22'")(
    lambda v: src.load_bars(v.bars, None, "2024-01-08", "2024-01-22", ["c", "volume", "adjusted"]))
query("a14_standardize_chain", f"""
    SELECT symbol, quote_date, expiration, strike, option_type, {r("CASE WHEN day(quote_date) % 2 = 0 THEN bid END")} AS bid, {r('ask')} AS ask, {r('vol')} AS vol FROM quotes""")(
    lambda v: src.standardize_chain(v.quotes.select(
        F.col("symbol").alias("Act_Symbol"), F.col("quote_date").cast("string").alias("Date"), F.col("expiration").cast("string").alias("Expiration"),
        F.col("strike").cast("string").alias("Strike"), F.initcap("option_type").alias("Call_Put"),
        F.when(F.dayofmonth("quote_date") % 2 == 0, F.col("bid").cast("string")).otherwise(F.lit("n/a")).alias("Bid"),
        F.col("ask").alias("Ask"), F.coalesce("vol", F.lit(float("nan"))).alias("Implied_Volatility"))))
view("cal", """
    SELECT symbol, d FROM (SELECT symbol, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM bars_long GROUP BY symbol)
    WHERE isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN ('01-01', '07-04', '12-25')""")


def _calendar(v):
    return cal.calendar_spans(src.date_range(v.bars_long, ["symbol"], "d"), ["symbol"])


query("a15_trading_calendar", "SELECT symbol, d, lead(d) OVER (PARTITION BY symbol ORDER BY d) AS next_day FROM cal")(
    lambda v: cal.with_next_trading_day(_calendar(v), ["symbol"]))
query("a16_trading_dates", "SELECT DISTINCT symbol, d FROM bars")(lambda v: cal.trading_dates(v.bars, ["symbol"]))

# ---- B: filters and predicates -------------------------------------------------------------------
query("b01_load_option_chain", f"""
    SELECT {_CONTRACT}, {r('mid')} AS mid, dte FROM quotes WHERE dte BETWEEN 20 AND 60 AND volume >= 200 AND open_interest >= 500 AND vol BETWEEN 0.2 AND 0.5
      AND strike / spot BETWEEN 0.9 AND 1.1""")(
    lambda v: ch.load_option_chain(v.quotes, (20, 60), 200, 500, (0.2, 0.5), (0.9, 1.1)).select(*CONTRACT, "mid", "dte"))
query("b02_filter_bad_quotes", f"SELECT {_CONTRACT}, {r('bid')} AS bid FROM quotes WHERE bid >= 0.05 AND bid <= ask AND (vol IS NULL OR vol BETWEEN 0.01 AND 5) "
      "AND (ask - bid) / ((bid + ask) / 2) <= 0.06 AND volume >= 150")(
    lambda v: ch.filter_bad_quotes(v.quotes, min_bid=0.05, max_spread_pct=0.06, min_volume=150).select(*CONTRACT, "bid"))
query("b03_with_chain_columns", f"""
    SELECT {_CONTRACT}, {r('(bid + ask) / 2')} AS mid, {r('ask - bid')} AS spread, {r('CASE WHEN bid + ask > 0 THEN (ask - bid) / ((bid + ask) / 2) ELSE 0 END')} AS spread_pct,
      dte, {r('strike / spot')} AS moneyness, {r('ln(strike / spot)')} AS log_moneyness FROM quotes""")(
    lambda v: ch.with_chain_columns(v.quotes).select(*CONTRACT, "mid", "spread", "spread_pct", "dte", "moneyness", "log_moneyness"))
view("rank_days", f"""
    SELECT symbol, d, iv, CASE WHEN n >= 30 THEN CASE WHEN hi = lo THEN 50e0 ELSE (iv - lo) / (hi - lo) * 100e0 END END AS iv_rank FROM (
      SELECT symbol, d, iv, count(iv) OVER w AS n, min(iv) OVER w AS lo, max(iv) OVER w AS hi FROM bars_long
      WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))""")
query("b04_iv_rank_conditions", """
    SELECT symbol, d, coalesce(iv_rank > 70, false) AS above, coalesce(iv_rank < 20, false) AS below, coalesce(iv_rank BETWEEN 30 AND 60, false) AS inside FROM rank_days""")(
    lambda v: s.iv_minmax_rank(v.bars_long, ["symbol"]).select("symbol", "d", c.iv_rank_above(70).alias("above"), c.iv_rank_below(20).alias("below"),
                                                               c.iv_rank_between(30, 60).alias("inside")))
view("vix_bars", "SELECT b.symbol, b.d, b.spot, CASE WHEN day(b.d) % 7 <> 0 THEN x.vix END AS vix FROM bars b JOIN vix x USING (d)")


def vix_bars(v):
    return v.bars.join(v.vix, "d").select("symbol", "d", "spot", F.when(F.dayofmonth("d") % 7 != 0, F.col("vix")).alias("vix"))


query("b05_vix_conditions", "SELECT symbol, d, coalesce(vix > 22, false) AS above, coalesce(vix < 14, false) AS below, coalesce(vix BETWEEN 14 AND 22, false) AS inside FROM vix_bars")(
    lambda v: vix_bars(v).select("symbol", "d", c.vix_above(22).alias("above"), c.vix_below(14).alias("below"), c.vix_between(14, 22).alias("inside")))
query("b06_vix_thresholds", "SELECT symbol, d, coalesce(vix > 20, false) AS high, coalesce(vix < 15, false) AS low, coalesce(vix BETWEEN 15 AND 30, false) AS mid FROM vix_bars")(
    lambda v: vix_bars(v).select("symbol", "d", c.is_vix_above_threshold().alias("high"), c.is_vix_below_threshold().alias("low"), c.is_vix_in_range().alias("mid")))
query("b07_dte_conditions", "SELECT symbol, quote_date, count_if(dte > 45) AS above, count_if(dte < 21) AS below, count_if(dte BETWEEN 30 AND 60) AS inside FROM quotes GROUP BY ALL")(
    lambda v: v.quotes.groupBy("symbol", "quote_date").agg(F.count_if(c.dte_above(45)).alias("above"), F.count_if(c.dte_below(21)).alias("below"),
                                                           F.count_if(c.dte_between(30, 60)).alias("inside")))
query("b08_day_of_week", "SELECT symbol, d FROM bars_long WHERE isodow(d) IN (1, 5)")(lambda v: v.bars_long.filter(c.day_of_week("Monday", "friday")).select("symbol", "d"))
query("b13_boolean_algebra", """
    SELECT symbol, d, coalesce(vix > 22, false) AND spot > 50 AS both, coalesce(vix > 22, false) OR spot > 50 AS either, NOT coalesce(vix > 22, false) AS neither,
      true AS yes, false AS no FROM vix_bars""")(
    lambda v: vix_bars(v).select("symbol", "d", c.all_of(c.vix_above(22), F.col("spot") > 50).alias("both"), c.any_of(c.vix_above(22), F.col("spot") > 50).alias("either"),
                                 c.negate(F.col("vix") > 22).alias("neither"), c.always_true().alias("yes"), c.always_false().alias("no")))
query("b14_named_conditions", """
    SELECT symbol, d, coalesce(vix >= 20, false) AS t, coalesce(vix BETWEEN 15 AND 20, false) AS g, coalesce(vix >= 20, false) AND spot < 55 AS a,
      coalesce(vix >= 20, false) OR spot < 55 AS o, NOT coalesce(vix >= 20, false) AS n FROM vix_bars""")(
    lambda v: vix_bars(v).select(
        "symbol", "d", c.threshold_condition("vix", ">=", 20.0).alias("t"), c.range_condition("vix", 15.0, 20.0).alias("g"),
        c.combine_conditions([c.threshold_condition("vix", ">=", 20.0), c.threshold_condition("spot", "<", 55.0)]).alias("a"),
        c.combine_conditions([c.threshold_condition("vix", ">=", 20.0), c.threshold_condition("spot", "<", 55.0)], "or").alias("o"),
        c.negate_condition(c.threshold_condition("vix", ">=", 20.0)).alias("n")))
query("b15_profit_conditions", f"""
    SELECT sid, trade_id, {r('CASE WHEN total_cost > 0 THEN realized_pnl / total_cost END', 8)} AS profit_pct, coalesce(realized_pnl / total_cost >= 0.03, false) AS target,
      coalesce(realized_pnl / total_cost <= -0.025, false) AS stop FROM trades""", 8)(
    lambda v: v.trades.select("sid", "trade_id", c.profit_pct("realized_pnl", "total_cost").alias("profit_pct"),
                              c.has_reached_profit_target("realized_pnl", "total_cost", 0.03).alias("target"),
                              c.has_reached_stop_loss("realized_pnl", "total_cost", -0.025).alias("stop")))
query("b16_expiry_conditions", """
    SELECT symbol, d, x.expiration, greatest((x.expiration - d), 0)::INT AS dte, x.expiration = d AS expires, greatest((x.expiration - d), 0) BETWEEN 1 AND 20 AS near
    FROM bars, (VALUES (DATE '2024-01-19'), (DATE '2024-02-16')) x(expiration)""")(
    lambda v: v.bars.withColumn("expiration", F.explode(F.array(*[F.lit(x).cast("date") for x in ("2024-01-19", "2024-02-16")]))).select(
        "symbol", "d", "expiration", ins.days_to_expiry("d", "expiration").alias("dte"), ins.is_expiration_day("d", "expiration").alias("expires"),
        ins.is_within_dte_range("d", "expiration", 1, 20).alias("near")))
query("b17_limit_checks", """
    SELECT sid, exit_date, count(*) < 2 AS positions_ok, sum(total_cost) + 10000 <= 100000 AS capital_ok, abs(sum(contracts * (CASE WHEN pnl_dec > 0 THEN 1 ELSE -1 END))) <= 20 AS delta_ok
    FROM trades GROUP BY ALL""")(
    lambda v: v.trades.groupBy("sid", "exit_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_cost").alias("used"),
        F.sum(F.col("contracts") * F.when(F.col("pnl_dec") > 0, 1).otherwise(-1)).alias("delta")).select(
        "sid", "exit_date", c.check_position_limit("n", 2).alias("positions_ok"), c.check_capital_limit("used", F.lit(10000.0), F.lit(100000.0)).alias("capital_ok"),
        c.check_delta_limit("delta", 20).alias("delta_ok")))
_EVENTS = [("earnings", "2024-01-25"), ("fomc", "2024-01-31"), ("cpi", "2024-01-11"), ("earnings", "2024-04-25"), ("fomc", "2024-03-20"), ("cpi", "2024-02-13")]
view("calendar_events", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', DATE '{d}')" for t, d in _EVENTS) + ") t(event_type, event_date)")


def events(v):
    return v.spark.createDataFrame(_EVENTS, "event_type string, event_date string").withColumn("event_date", F.to_date("event_date"))


query("b18_major_event_dates", f"SELECT symbol, d, {r('c')} AS c FROM bars b WHERE EXISTS (SELECT 1 FROM calendar_events e WHERE event_type IN ('cpi', 'earnings') AND abs(e.event_date - b.d) <= 2)")(
    lambda v: c.is_major_event_date(v.bars.select("symbol", "d", "c"), events(v), "d", 2, ["cpi", "earnings"]))
query("b18_away_from_events", f"SELECT symbol, d, {r('c')} AS c FROM bars b WHERE NOT EXISTS (SELECT 1 FROM calendar_events e WHERE abs(e.event_date - b.d) <= 1)")(
    lambda v: c.is_major_event_date(v.bars.select("symbol", "d", "c"), events(v), "d", 1, keep="away"))
query("b19_upcoming_events", """
    SELECT b.symbol, e.event_type, e.event_date FROM (SELECT symbol, max(d) AS d FROM bars GROUP BY symbol) b, calendar_events e
    WHERE e.event_date BETWEEN DATE '2024-01-20' AND DATE '2024-03-31' AND e.event_type IN ('fomc', 'earnings') AND e.event_date >= b.d - 6""")(
    lambda v: c.upcoming_events(
        v.bars.groupBy("symbol").agg(F.max("d").alias("d")).select("symbol", "d", F.explode(F.array(*[
            F.struct(F.lit(t).alias("event_type"), F.lit(x).cast("date").alias("event_date")) for t, x in _EVENTS])).alias("e")).select("symbol", "d", "e.*"),
        "2024-01-20", "2024-03-31", ["fomc", "earnings"]).filter("event_date >= date_sub(d, 6)").select("symbol", "event_type", "event_date"))
query("b20_moneyness", f"""
    SELECT {_CONTRACT}, {r('spot / strike')} AS moneyness, CASE WHEN abs(spot / strike - 1) <= 0.02 THEN 'ATM' WHEN (option_type = 'call') = (spot > strike) AND spot <> strike THEN 'ITM' ELSE 'OTM' END AS bucket,
      CASE WHEN option_type = 'call' THEN spot > strike ELSE spot < strike END AS itm, abs(spot / strike - 1) <= 0.02 AS atm, CASE WHEN option_type = 'call' THEN spot < strike ELSE spot > strike END AS otm FROM quotes""")(
    lambda v: v.quotes.select(*CONTRACT, ins.moneyness("spot", "strike").alias("moneyness"), ins.moneyness_class("spot", "strike", "option_type").alias("bucket"),
                              ins.is_itm("spot", "strike", "option_type").alias("itm"), ins.is_atm("spot", "strike").alias("atm"), ins.is_otm("spot", "strike", "option_type").alias("otm")))
view("regimes", "SELECT symbol, d, vix, CASE WHEN vix IS NULL THEN NULL WHEN vix < 15 THEN 'LOW' WHEN vix > 25 THEN 'HIGH' ELSE 'MEDIUM' END AS regime FROM vix_bars")
query("b21_regime", "SELECT symbol, d, regime, CASE regime WHEN 'HIGH' THEN 'short_straddle' WHEN 'MEDIUM' THEN 'iron_condor' WHEN 'LOW' THEN 'long_straddle' END AS structure FROM regimes")(
    lambda v: vix_bars(v).select("symbol", "d", c.regime("vix").alias("regime")).withColumn("structure", c.recommended_structure()))
query("w08_regime_duration", """
    SELECT symbol, d, regime, row_number() OVER (PARTITION BY symbol, g ORDER BY d)::INT AS regime_days FROM (
      SELECT *, sum(t) OVER (PARTITION BY symbol ORDER BY d) AS g FROM (
        SELECT *, CASE WHEN regime IS NOT DISTINCT FROM lag(regime) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS t FROM regimes WINDOW w AS (PARTITION BY symbol ORDER BY d)))""")(
    lambda v: s.regime_duration(vix_bars(v).select("symbol", "d", c.regime("vix").alias("regime")), ["symbol"]))

# ---- C: joins -------------------------------------------------------------------------------------
query("c01_lookup_quotes", f"""
    SELECT l.position_id, l.leg_no, {r('q.bid')} AS bid, {r('q.ask')} AS ask, {r('CASE WHEN q.bid > 0 AND q.ask > 0 THEN (q.bid + q.ask) / 2 WHEN q.ask > 0 THEN q.ask ELSE q.bid END')} AS quote_mid
    FROM legs l LEFT JOIN quotes q ON q.symbol = l.symbol AND q.quote_date = l.entry_date AND q.option_type = l.option_type AND q.expiration = l.expiration AND abs(q.strike - l.strike) < 0.005 AND day(q.quote_date) % 3 <> 0""")(
    lambda v: ch.lookup_quotes(v.legs, v.quotes.filter("day(quote_date) % 3 <> 0"), "entry_date").select("position_id", "leg_no", "bid", "ask", "quote_mid"))
_MID = "CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 WHEN ask > 0 THEN ask ELSE bid END"
# wanted contracts: listed ones, one between strikes and off-expiry, one outside the ladder
view("wanted", """
    SELECT DISTINCT symbol, d AS quote_date, t.option_type, x.expiration, x.strike FROM bars, (VALUES ('call'), ('put')) t(option_type),
      (VALUES (DATE '2024-02-16', 45e0), (DATE '2024-02-20', 47.5e0), (DATE '2024-03-15', 90e0), (DATE '2024-03-18', 50e0)) x(expiration, strike)""")
view("day_iv", "SELECT symbol, d, spot, 25e-2 AS iv FROM bars")
view("marked", f"""
    SELECT w.*, coalesce(e.px, i.px, CASE WHEN w.spot > 0 THEN greatest({bs(s='w.spot', k='w.strike', t='((w.expiration - w.quote_date) / 365e0)', rate='5e-2', v='w.iv', w="(CASE WHEN w.option_type = 'call' THEN 1e0 ELSE -1e0 END)")}, 1e-2) END) AS mark,
      CASE WHEN e.px IS NOT NULL THEN 'exact' WHEN i.px IS NOT NULL THEN 'interpolated' ELSE 'model' END AS mark_source
    FROM (SELECT w.*, b.spot, b.iv FROM wanted w JOIN day_iv b ON b.symbol = w.symbol AND b.d = w.quote_date) w
    LEFT JOIN (SELECT symbol, quote_date, option_type, expiration, strike, {_MID} AS px FROM quotes) e USING (symbol, quote_date, option_type, expiration, strike)
    LEFT JOIN (
      SELECT symbol, quote_date, option_type, expiration, strike,
        greatest((lo.px + (strike - lo.k) / (hi.k - lo.k) * (hi.px - lo.px)) * sqrt((expiration - quote_date) / (((lo.e - quote_date) + (hi.e - quote_date)) / 2e0)), 1e-2) AS px
      FROM (SELECT w.symbol, w.quote_date, w.option_type, w.expiration, w.strike,
              arg_min({{'k': q.strike, 'px': q.px, 'e': q.expiration}}, (w.strike - q.strike, abs(q.expiration - w.expiration), q.expiration)) FILTER (q.strike < w.strike) AS lo,
              arg_min({{'k': q.strike, 'px': q.px, 'e': q.expiration}}, (q.strike - w.strike, abs(q.expiration - w.expiration), q.expiration)) FILTER (q.strike > w.strike) AS hi
            FROM wanted w JOIN (SELECT *, {_MID} AS px FROM quotes) q
              ON q.symbol = w.symbol AND q.quote_date = w.quote_date AND q.option_type = w.option_type AND abs(q.expiration - w.expiration) <= 7 GROUP BY ALL)
      WHERE lo.px > 0 AND hi.px > 0) i USING (symbol, quote_date, option_type, expiration, strike)""")


def wanted(v):
    combos = F.array(*[F.struct(F.lit(x).cast("date").alias("expiration"), F.lit(k).alias("strike")) for x, k in
                       (("2024-02-16", 45.0), ("2024-02-20", 47.5), ("2024-03-15", 90.0), ("2024-03-18", 50.0))])
    days = v.bars.select("symbol", F.col("d").alias("quote_date"), F.explode(F.array(F.lit("call"), F.lit("put"))).alias("option_type"))
    return days.withColumn("_c", F.explode(combos)).select("symbol", "quote_date", "option_type", "_c.*")


query("c02_mark_contracts", f"SELECT symbol, quote_date, option_type, expiration, strike, {r('mark')} AS mark, mark_source FROM marked")(
    lambda v: ch.mark_contracts(wanted(v), v.quotes, v.bars.select("symbol", "d", "spot", F.lit(0.25).alias("iv"))))
query("c03_put_call_pairs", f"""
    SELECT symbol, quote_date, expiration, strike, {r("max(mid) FILTER (option_type = 'call')")} AS call_price, {r("max(mid) FILTER (option_type = 'put')")} AS put_price
    FROM quotes WHERE bid > 0 OR option_type = 'call' GROUP BY ALL HAVING count(DISTINCT option_type) = 2""")(
    lambda v: ch.put_call_pairs(v.quotes.filter("bid > 0 or option_type = 'call'")))
query("c04_asof_spot", f"""
    SELECT k.symbol, k.d, {r('b.c')} AS spot, b.d AS bar_date FROM cal k ASOF LEFT JOIN bars_long b ON b.symbol = k.symbol AND b.d <= k.d WHERE b.d >= k.d - 5
    UNION ALL SELECT k.symbol, k.d, NULL, NULL FROM cal k ASOF LEFT JOIN bars_long b ON b.symbol = k.symbol AND b.d <= k.d WHERE b.d IS NULL OR b.d < k.d - 5""")(
    lambda v: ch.asof_spot(_calendar(v), v.bars_long, 5))
query("c08_attach_snapshot", f"SELECT {_CONTRACT}, {r('x.c')} AS c FROM quotes q LEFT JOIN (SELECT symbol AS s, d, c FROM bars WHERE day(d) % 2 = 0) x ON x.s = q.symbol AND x.d = q.quote_date")(
    lambda v: ch.attach_snapshot(v.quotes.select(*CONTRACT), v.bars.filter("day(d) % 2 = 0"), columns=("c",)))

# ---- D: spot and volatility -----------------------------------------------------------------------
query("d01_spot_median_strike", f"SELECT symbol, quote_date, {r('median(strike)')} AS spot_median FROM (SELECT DISTINCT symbol, quote_date, strike FROM quotes WHERE volume % 3 <> 0) GROUP BY ALL")(
    lambda v: ch.spot_median_strike(v.quotes.filter("volume % 3 <> 0")))
view("pc_spot", """
    SELECT symbol, quote_date, arg_min(strike, (abs(cp - pp), strike)) AS spot FROM (
      SELECT symbol, quote_date, expiration, strike, max(mid) FILTER (option_type = 'call') AS cp, max(mid) FILTER (option_type = 'put') AS pp FROM quotes GROUP BY ALL)
    WHERE cp IS NOT NULL AND pp IS NOT NULL GROUP BY ALL""")
query("d02_spot_put_call", f"SELECT symbol, quote_date, {r('spot')} AS spot_put_call FROM pc_spot")(lambda v: ch.spot_put_call(v.quotes))
view("band_iv", """
    SELECT symbol, quote_date, coalesce(CASE WHEN count_if(near) > 0 THEN avg(CASE WHEN vol > 0 THEN vol END) FILTER (near) ELSE avg(CASE WHEN vol > 0 THEN vol END) FILTER (rn <= 5) END, 2e-1) AS iv
    FROM (SELECT *, abs(strike / spot - 1) < 0.02 AS near, row_number() OVER (PARTITION BY symbol, quote_date ORDER BY abs(strike - spot), strike, expiration, option_type) AS rn FROM quotes) GROUP BY ALL""")
query("d03_atm_iv_band", f"SELECT symbol, quote_date, {r('iv', 10)} AS iv FROM band_iv", 10)(lambda v: ch.atm_iv_band(v.quotes))
query("d04_daily_atm_iv", f"""
    WITH s AS (SELECT * FROM quotes WHERE dte BETWEEN 40 AND 50), p AS (
      SELECT symbol, quote_date, arg_min(strike, (abs(cp - pp), strike)) AS spot FROM (
        SELECT symbol, quote_date, expiration, strike, max(mid) FILTER (option_type = 'call') AS cp, max(mid) FILTER (option_type = 'put') AS pp FROM s GROUP BY ALL) GROUP BY ALL),
    k AS (SELECT s.symbol, s.quote_date, strike, avg(vol) AS iv, any_value(p.spot) AS spot FROM s JOIN p ON p.symbol = s.symbol AND p.quote_date = s.quote_date GROUP BY ALL)
    SELECT symbol, quote_date, {r('iv', 10)} AS iv FROM (SELECT symbol, quote_date, arg_min_null(iv, (abs(strike - spot), strike)) AS iv FROM k GROUP BY ALL) WHERE iv > 0""", 10)(
    lambda v: ch.daily_atm_iv(v.quotes, 45))
query("d04_daily_mean_iv", f"SELECT symbol, quote_date, {r('avg(vol)', 10)} AS iv FROM quotes WHERE dte BETWEEN 25 AND 35 GROUP BY ALL", 10)(
    lambda v: ch.daily_atm_iv(v.quotes, 30, use_atm=False))
query("d05_chain_iv", f"""
    WITH k AS (SELECT symbol, quote_date, strike, avg(vol) AS iv FROM quotes WHERE dte BETWEEN 20 AND 40 AND vol > 0 GROUP BY ALL)
    SELECT symbol, quote_date, {r('arg_min(iv, (abs(strike - m), strike))', 10)} AS iv FROM (SELECT *, median(strike) OVER (PARTITION BY symbol, quote_date) AS m FROM k) GROUP BY ALL""", 10)(
    lambda v: ch.chain_iv(v.quotes))
query("d05_chain_iv_at_strike", f"SELECT symbol, quote_date, {r('avg(vol)', 10)} AS iv FROM quotes WHERE dte BETWEEN 20 AND 40 AND vol > 0 AND strike = 50 GROUP BY ALL", 10)(
    lambda v: ch.chain_iv(v.quotes, 50.0))
query("s02_nearest_strikes", f"""
    SELECT {_CONTRACT}, rn::INT AS nearness FROM (SELECT *, row_number() OVER (PARTITION BY symbol, quote_date ORDER BY abs(strike - spot), strike, expiration, option_type) AS rn FROM quotes) WHERE rn <= 5""")(
    lambda v: ch.nearest_rows(v.quotes).select(*CONTRACT, "nearness"))
view("snap_days", """
    SELECT p.symbol, p.quote_date AS d, p.spot, coalesce(i.iv, 2e-1) AS iv, c.n AS chain_size FROM pc_spot p JOIN (SELECT symbol, quote_date, count(*) AS n FROM quotes GROUP BY ALL) c USING (symbol, quote_date)
    JOIN (SELECT symbol, quote_date, CASE WHEN count_if(near) > 0 THEN avg(CASE WHEN vol > 0 THEN vol END) FILTER (near) ELSE avg(CASE WHEN vol > 0 THEN vol END) FILTER (rn <= 5) END AS iv
      FROM (SELECT q.symbol, q.quote_date, vol, abs(strike / p.spot - 1) < 0.02 AS near, row_number() OVER (PARTITION BY q.symbol, q.quote_date ORDER BY abs(strike - p.spot), strike, expiration, option_type) AS rn
            FROM quotes q JOIN pc_spot p ON p.symbol = q.symbol AND p.quote_date = q.quote_date) GROUP BY ALL) i USING (symbol, quote_date)""")
view("vix_regimes", """
    SELECT d, vix, regime, row_number() OVER (PARTITION BY g ORDER BY d)::INT AS regime_days FROM (
      SELECT *, sum(t) OVER (ORDER BY d) AS g FROM (SELECT *, CASE WHEN regime = lag(regime) OVER (ORDER BY d) THEN 0 ELSE 1 END AS t FROM (
        SELECT d, vix, CASE WHEN vix < 15 THEN 'LOW' WHEN vix > 25 THEN 'HIGH' ELSE 'MEDIUM' END AS regime FROM vix)))""")
view("snapshots", """
    SELECT s.symbol, s.d, s.spot, s.iv, s.chain_size, CASE WHEN n >= 5 THEN CASE WHEN hi = lo THEN 50e0 ELSE (iv - lo) / (hi - lo) * 100e0 END END AS iv_rank, x.vix, x.regime, x.regime_days
    FROM (SELECT *, count(iv) OVER w AS n, min(iv) OVER w AS lo, max(iv) OVER w AS hi FROM snap_days WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) s
    LEFT JOIN vix_regimes x USING (d)""")


def snapshots(v):
    return ch.build_snapshots(v.quotes, v.vix, iv_min_obs=5)


query("d06_build_snapshots", f"SELECT symbol, d, {r('spot')} AS spot, {r('iv', 10)} AS iv, chain_size, {r('iv_rank', 10)} AS iv_rank, {r('vix')} AS vix, regime, regime_days FROM snapshots", 10)(snapshots)
query("d06_snapshots_on_calendar", f"""
    WITH k AS (SELECT symbol, d FROM (SELECT symbol, unnest(generate_series(min(quote_date), max(quote_date), INTERVAL 1 DAY))::DATE AS d FROM quotes GROUP BY symbol)
      WHERE isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN ('01-01', '07-04', '12-25'))
    SELECT k.symbol, k.d, {r('s.spot')} AS spot, {r('s.iv')} AS iv FROM k LEFT JOIN snap_days s ON s.symbol = k.symbol AND s.d = k.d AND day(s.d) % 5 <> 0""", 10)(
    lambda v: ch.build_snapshots(v.quotes.filter("day(quote_date) % 5 <> 0"), None, cal.calendar_spans(src.date_range(v.quotes, ["symbol"]), ["symbol"])).select("symbol", "d", "spot", "iv"))
query("u03_distinct_values", "SELECT DISTINCT symbol, quote_date, strike FROM quotes")(lambda v: v.quotes.select("symbol", "quote_date", "strike").distinct())
query("u02_common_strikes", "SELECT DISTINCT symbol, quote_date, strike FROM quotes WHERE option_type = 'call' AND bid > 0 INTERSECT SELECT symbol, quote_date, strike FROM quotes WHERE option_type = 'put' AND bid > 0")(
    lambda v: ch.put_call_pairs(v.quotes.filter("bid > 0").withColumn("expiration", F.lit("2024-01-01").cast("date"))).select("symbol", "quote_date", "strike"))

# ---- E: quality -----------------------------------------------------------------------------------
_RULES = [
    ("strike_not_positive", "error", "strike <= 0"), ("strike_null", "error", "strike IS NULL"), ("option_type_invalid", "error", "option_type NOT IN ('call', 'put')"),
    ("bid_negative", "error", "bid < 0"), ("ask_negative", "error", "ask < 0"), ("quote_inverted", "error", "bid > ask"),
    ("spread_wide", "warning", "bid + ask > 0 AND (ask - bid) / ((bid + ask) / 2) > 0.5"), ("iv_zero", "warning", "vol = 0"), ("iv_low", "warning", "vol > 0 AND vol < 0.01"),
    ("iv_high", "warning", "vol > 5"), ("iv_null", "warning", "vol IS NULL"), ("expiration_null", "error", "expiration IS NULL")]
query("e01_validate_option_data", " UNION ALL ".join(
    f"SELECT symbol, '{n}' AS rule, '{sv}' AS severity, count_if({cond}) AS violations, count_if({cond}) > 0 AND '{sv}' = 'error' AS is_error FROM quotes GROUP BY symbol" for n, sv, cond in _RULES))(
    lambda v: q.validate_option_data(v.quotes, ["symbol"]))
query("e02_quote_filter_report", " UNION ALL ".join(f"SELECT symbol, '{n}' AS rule, count_if({cond}) AS removed FROM quotes GROUP BY symbol" for n, cond in (
    ("low_bid", "bid < 0.05"), ("inverted", "bid > ask"), ("wide_spread", "coalesce((ask - bid) / ((bid + ask) / 2) > 0.06, true)"), ("iv_range", "vol < 0.01 OR vol > 5"), ("low_volume", "volume < 150"))))(
    lambda v: q.quote_filter_report(v.quotes, ["symbol"], min_bid=0.05, max_spread_pct=0.06, min_volume=150))
query("e03_validate_price_data", " UNION ALL ".join(f"SELECT symbol, '{n}' AS rule, 'error' AS severity, count_if(coalesce({cond}, false)) AS violations FROM dirty_bars GROUP BY symbol" for n, cond in (
    *[(f"{x}_negative", f"{x} < 0") for x in "ohlc"], *[(f"{x}_null", f"{x} IS NULL") for x in "ohlc"], ("high_violation", "h < o OR h < c"), ("low_violation", "l > o OR l > c"), ("volume_negative", "volume < 0"))))(
    lambda v: q.validate_price_data(v.bars.withColumns({"h": F.when(F.dayofmonth("d") % 6 == 0, F.col("l")).otherwise(F.col("h")), "c": F.when(F.dayofmonth("d") != 9, F.col("c"))}), ["symbol"]))
view("dirty_bars", "SELECT symbol, d, o, CASE WHEN day(d) % 6 = 0 THEN l ELSE h END AS h, l, CASE WHEN day(d) <> 9 THEN c END AS c, volume FROM bars")
query("e04_data_quality_report", f"""
    WITH a AS (SELECT count(*) AS n, count(DISTINCT symbol) AS u, min(quote_date) AS f, max(quote_date) AS l, count_if(vol IS NULL) AS k,
      {' + '.join(f'(CASE WHEN count_if({cond}) > 0 THEN 1 ELSE 0 END)' for _, _, cond in _RULES)} AS i FROM quotes)
    SELECT n AS total_rows, 14::INT AS total_columns, k AS total_nulls, u AS unique_symbols, f AS first_date, l AS last_date, i::BIGINT AS issues,
      {r('100 - least(30, k * 100e0 / (n * 14)) - least(40, i * 5e0)')} AS quality_score FROM a""")(
    lambda v: q.data_quality_report(v.quotes))
query("e05_check_arbitrage", """
    SELECT symbol, violation, count(*) AS violations FROM (
      SELECT symbol, CASE WHEN option_type = 'call' AND px > spot * 1.05 THEN 'call_above_spot' WHEN option_type = 'call' AND px < greatest(spot - strike, 0) * 0.95 THEN 'call_below_intrinsic'
          WHEN option_type = 'put' AND px > strike * 1.05 THEN 'put_above_strike' WHEN option_type = 'put' AND px < greatest(strike - spot, 0) * 0.95 THEN 'put_below_intrinsic' END AS violation
      FROM (SELECT *, CASE WHEN volume % 11 = 0 THEN mid * 0.5 WHEN volume % 13 = 0 THEN mid + 60 ELSE mid END AS px FROM quotes)) WHERE violation IS NOT NULL GROUP BY ALL""")(
    lambda v: q.check_arbitrage(v.quotes.withColumn("px", F.when(F.col("volume") % 11 == 0, F.col("mid") * 0.5).when(F.col("volume") % 13 == 0, F.col("mid") + 60.0).otherwise(F.col("mid"))), ["symbol"], price="px"))
query("e06_check_for_gaps", """
    SELECT sid, d, next_date, gap_days::INT AS gap_days, business_days FROM (
      SELECT sid, d, nx AS next_date, nx - d AS gap_days, (SELECT count(*) FROM generate_series(d::TIMESTAMP, nx - INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6) AS business_days
      FROM (SELECT sid, d, lead(d) OVER (PARTITION BY sid ORDER BY d) AS nx FROM (SELECT DISTINCT sid, d FROM equity)) WHERE nx - d > 3) WHERE business_days > 1""")(
    lambda v: q.check_for_gaps(v.equity, ["sid"], "d"))
query("e07_detect_stale_prices", f"""
    SELECT symbol, strike, expiration, option_type, quote_date, {r('px')} AS px, n::INT AS run_length FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol, strike, expiration, option_type, g ORDER BY quote_date) AS n FROM (
        SELECT *, sum(ch) OVER (PARTITION BY symbol, strike, expiration, option_type ORDER BY quote_date) AS g FROM (
          SELECT *, CASE WHEN px = lag(px) OVER (PARTITION BY symbol, strike, expiration, option_type ORDER BY quote_date) THEN 0 ELSE 1 END AS ch
          FROM (SELECT *, CASE WHEN day(quote_date) BETWEEN 10 AND 14 THEN 1e0 ELSE mid END AS px FROM quotes)))) WHERE n >= 3""")(
    lambda v: q.detect_stale_prices(v.quotes.withColumn("px", F.when(F.dayofmonth("quote_date").between(10, 14), F.lit(1.0)).otherwise(F.col("mid"))), price="px").select(
        "symbol", "strike", "expiration", "option_type", "quote_date", "px", "run_length"))
query("w11_price_history", "SELECT symbol, expiration, strike, option_type, count(*) AS n, max(quote_date) AS last_day FROM quotes GROUP BY ALL")(
    lambda v: s.price_history(v.quotes, ["symbol", "expiration", "strike", "option_type"], "quote_date", "mid").select(
        "symbol", "expiration", "strike", "option_type", F.size("history").cast("bigint").alias("n"), F.element_at("history", -1)["d"].alias("last_day")))


def _tree(v):
    """Quotes as a tree of files in the shared folder, read back for some symbols and days and typed again."""
    root = new_path(v.spark, "tree")
    columns = ["symbol", "quote_date", "expiration", "strike", "option_type", "bid", "ask", "vol", "volume"]
    tree.write_chain_tree(v.quotes.select(*columns), root).agg(F.sum("rows")).collect()
    back = tree.read_chain_tree(v.spark, root).filter(F.col("symbol").isin("S1", "S3", "S5") & (F.col("quote_date") >= F.lit("2024-01-08").cast("date")) & (F.col("quote_date") < F.lit("2024-01-20").cast("date")))
    return src.standardize_chain(back).select(*columns)


query("a09_read_chain_csv", f"SELECT symbol, quote_date, expiration, {r('strike')} AS strike, option_type, {r('bid')} AS bid, {r('ask')} AS ask, {r('vol')} AS vol, volume FROM quotes WHERE symbol IN ('S1', 'S3', 'S5') AND quote_date >= DATE '2024-01-08' AND quote_date < DATE '2024-01-20'")(_tree)


def _ordered(v):
    path = new_path(v.spark, "ordered")
    sinks.write_ordered(v.quotes.select(*CONTRACT, "bid"), path, ["quote_date", "symbol", "expiration", "strike", "option_type"], files=7)
    return sinks.read_ordered(v.spark, path).select(*CONTRACT, "position")


query("s04_ordered_output", f"SELECT {_CONTRACT}, row_number() OVER (ORDER BY quote_date, symbol, expiration, strike, option_type) AS position FROM quotes")(_ordered)
