"""H and J queries: prices, Greeks, kernels, smiles and multi-leg positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltable.functions import conditions as cond, instrument as ins, pricing as px
from voltable.functions.normal import norm_cdf, norm_pdf, norm_ppf
from voltable.operators import kernels as ker, structures as st, surface as sf, risk as k
from voltable.views import MONEY

from .base import query, r
from .sqlviews import bs, cdf, pdf, phi, ppf, view, num

_C = "symbol, quote_date, expiration, strike, option_type"
CONTRACT = ["symbol", "quote_date", "expiration", "strike", "option_type"]
_D1 = "((ln(spot / strike) + (4e-2 + 5e-1 * vol * vol) * t) / (vol * sqrt(t)))"


def greeks_of(source: str) -> str:
    """`source` (spot, strike, vol, t, option_type) with its closed-form Greeks."""
    return f"""SELECT *, w * {cdf('(w * d1)')} AS delta, {pdf('d1')} / (spot * vol * sqrt(t)) AS gamma,
      (-spot * {pdf('d1')} * vol / (2e0 * sqrt(t)) - w * 4e-2 * strike * disc * {cdf('(w * d2)')}) / 365e0 AS theta,
      spot * {pdf('d1')} * sqrt(t) / 100e0 AS vega, w * strike * t * disc * {cdf('(w * d2)')} / 100e0 AS rho
    FROM (SELECT *, {_D1} AS d1, {_D1} - vol * sqrt(t) AS d2, {phi()} AS w, exp(-4e-2 * t) AS disc FROM {source})"""


view("terms", f"SELECT *, {_D1} AS d1, {_D1} - vol * sqrt(t) AS d2, {phi()} AS w, exp(-4e-2 * t) AS disc FROM chain_px")
view("greeks", greeks_of("chain_px"))
GREEKS = ("delta", "gamma", "theta", "vega", "rho")
_G = ", ".join(f"{r(g)} AS {g}" for g in GREEKS)


def enriched(v):
    return px.enrich_greeks(v.chain_px)


def _normals(v):
    d1, d2 = px.d1_d2("spot", "strike", "t", 0.04, "vol")
    base = v.chain_px.select(*CONTRACT, d1.alias("d1"), d2.alias("d2"))
    return base.select(*CONTRACT, "d1", "d2", norm_cdf("d1").alias("cdf"), norm_pdf("d1").alias("pdf"))


query("h01_normal_terms", f"SELECT {_C}, {r('d1')} AS d1, {r('d2')} AS d2, {r(cdf('d1'))} AS cdf, {r(pdf('d1'))} AS pdf FROM terms")(_normals)
query("h01_norm_ppf", f"SELECT sid, d, {r(ppf('u'))} AS z FROM (SELECT sid, d, row_number() OVER (PARTITION BY sid ORDER BY d) / 1000e0 AS u FROM equity)")(
    lambda v: v.equity.withColumn("u", F.expr("row_number() over (partition by sid order by d)") / F.lit(1000.0)).select("sid", "d", norm_ppf("u").alias("z")))
# expired, zero-volatility and zero-spot rows exercise every edge rule
_EDGE = """SELECT * REPLACE (CASE WHEN day(quote_date) % 5 = 1 THEN 0e0 ELSE t END AS t, CASE WHEN day(quote_date) % 5 = 2 THEN 0e0 ELSE vol END AS vol,
    CASE WHEN day(quote_date) % 5 = 3 THEN 0e0 ELSE spot END AS spot) FROM chain_px"""
view("edges", _EDGE)


def edges(v):
    day = F.dayofmonth("quote_date") % 5
    zero = F.lit(0.0)
    return v.chain_px.withColumns({"t": F.when(day == 1, zero).otherwise(F.col("t")), "vol": F.when(day == 2, zero).otherwise(F.col("vol")),
                                   "spot": F.when(day == 3, zero).otherwise(F.col("spot"))})


query("h02_bs_price", f"""
    SELECT {_C}, {r(f"CASE WHEN t = 0 OR vol = 0 OR spot = 0 THEN greatest({phi()} * (spot - strike * exp(-4e-2 * t)), 0e0) ELSE {bs()} END")} AS price FROM edges""")(
    lambda v: px.price_chain(edges(v)).select(*CONTRACT, "price"))
query("h02_put_call_parity", f"SELECT symbol, quote_date, expiration, strike, {r('spot - strike * exp(-4e-2 * t)')} AS parity FROM chain_px WHERE option_type = 'call'")(
    lambda v: px.price_chain(v.chain_px).groupBy("symbol", "quote_date", "expiration", "strike").agg(F.sum(F.col("price") * F.when(F.col("option_type") == "call", 1.0).otherwise(-1.0)).alias("parity")))
for _g in GREEKS:
    query(f"h03_bs_{_g}", f"SELECT {_C}, {r(_g)} AS {_g} FROM greeks")(lambda v, g=_g: enriched(v).select(*CONTRACT, g))
query("h04_enrich_greeks", f"SELECT {_C}, {_G}, {r(bs())} AS price FROM greeks")(lambda v: px.enrich_greeks(v.chain_px, price="price").select(*CONTRACT, *GREEKS, "price"))
query("h05_price_chain_undiscounted", f"""
    SELECT {_C}, {r(f"CASE WHEN spot = 0 THEN greatest({phi()} * (0 - strike * exp(-4e-2 * t)), 0e0) WHEN t = 0 OR vol = 0 THEN greatest({phi()} * (spot - strike), 0e0) ELSE {bs()} END")} AS price FROM edges""")(
    lambda v: px.price_chain(edges(v), zero_vol="undiscounted").select(*CONTRACT, "price"))
# the price of a known volatility must give that price back everywhere, and the volatility itself where the price carries it
_TV = f"({bs()} - greatest({phi()} * (spot - strike * exp(-4e-2 * t)), 0e0))"
query("h06_implied_vol", f"SELECT {_C}, CASE WHEN {_TV} > 1e-2 THEN {r('vol')} END AS iv, {r(bs(), 5)} AS repriced FROM chain_px")(lambda v: _implied(v))


def _implied(v):
    told = F.col("price") - px.discounted_intrinsic("spot", "strike", "t", 0.04, "option_type") > 0.01
    back = px.price_chain(ker.implied_vol(px.price_chain(v.chain_px), "price"), sigma="iv", out="repriced")
    return back.select(*CONTRACT, F.when(told, F.col("iv")).alias("iv"), F.round("repriced", 5).alias("repriced"))


query("h06_implied_vol_reasons", f"""
    SELECT option_type, iv_reason, count(*) AS n FROM (SELECT option_type, CASE WHEN k = 0 AND low > 1e-2 THEN 'below_intrinsic' WHEN k = 1 THEN 'expired' WHEN k = 2 THEN 'zero_price' WHEN k = 3 THEN 'above_max' WHEN k = 4 THEN 'invalid_price'
        WHEN price < {num(ker.EPSILON)} THEN 'zero_price' ELSE 'ok' END AS iv_reason
      FROM (SELECT option_type, day(quote_date) % 6 AS k, greatest({phi()} * (spot - strike * exp(-4e-2 * t)), 0) AS low, {bs()} AS price FROM chain_px)) GROUP BY ALL""")(
    lambda v: _reasons(v))


def _reasons(v):
    k6 = F.dayofmonth("quote_date") % 6
    low = px.discounted_intrinsic("spot", "strike", "t", 0.04, "option_type")
    base = px.price_chain(v.chain_px).withColumns({
        "p": F.when((k6 == 0) & (low > 0.01), low - 0.005).when(k6 == 2, F.lit(0.0)).when(k6 == 3, F.lit(1000.0)).when(k6 == 4, F.lit(-1.0)).otherwise(F.col("price")),
        "t": F.when(k6 == 1, F.lit(0.0)).otherwise(F.col("t"))})
    # a zero price is only meaningful out of the money
    base = base.withColumn("spot", F.when(k6 == 2, F.when(F.col("option_type") == "call", F.col("strike") * 0.5).otherwise(F.col("strike") * 1.5)).otherwise(F.col("spot")))
    return ker.implied_vol(base, "p").groupBy("option_type", "iv_reason").agg(F.count(F.lit(1)).alias("n"))


query("h07_american_call_no_yield", f"SELECT {_C}, {r(bs())} AS american FROM chain_px WHERE option_type = 'call'")(
    lambda v: ker.american_price_baw(v.chain_px.filter("option_type = 'call'")).select(*CONTRACT, "american"))
_Q = "3e-2"
_QM, _QN = "(2e0 * 4e-2 / (vol * vol))", f"(2e0 * (4e-2 - {_Q}) / (vol * vol))"
_QP = f"((1e0 - {_QN} + w * sqrt(({_QN} - 1e0) * ({_QN} - 1e0) + 4e0 * {_QM} / (1e0 - exp(-4e-2 * t)))) / 2e0)"


def _qd1(x):
    return f"((ln({x} / strike) + (4e-2 - {_Q} + 5e-1 * vol * vol) * t) / (vol * sqrt(t)))"


def _qeuro(x):
    return f"(w * ({x} * exp(-{_Q} * t) * {cdf('(w * ' + _qd1(x) + ')')} - strike * exp(-4e-2 * t) * {cdf('(w * (' + _qd1(x) + ' - vol * sqrt(t)))')}))"


def _qprem(x):
    return f"(w * {x} / pw * (1e0 - exp(-{_Q} * t) * {cdf('(w * ' + _qd1(x) + ')')}))"


query("h07_american_price_baw", f"""
    WITH RECURSIVE baw AS (
      SELECT {_C}, spot, vol, t, {phi()} AS w, 0 AS i, CASE WHEN option_type = 'call' THEN strike ELSE 1e-10 END AS lo, CASE WHEN option_type = 'call' THEN strike * 10 ELSE strike END AS hi FROM chain_px
      UNION ALL
      SELECT {_C}, spot, vol, t, w, i + 1, CASE WHEN same THEN mid ELSE lo END, CASE WHEN same THEN hi ELSE mid END FROM (
        SELECT *, (w * (mid - strike) - {_qeuro('mid')} - {_qprem('mid')}) * w < 0 AS same FROM (
          SELECT *, (lo + hi) / 2e0 AS mid, {_QP} AS pw FROM baw WHERE i < 60)))
    SELECT {_C}, {r(f"CASE WHEN w * (spot - x) >= 0 THEN w * (spot - strike) ELSE {_qeuro('spot')} + {_qprem('x')} * pow(spot / x, pw) END", 5)} AS american
    FROM (SELECT *, (lo + hi) / 2e0 AS x, {_QP} AS pw FROM baw WHERE i = 60)""", 5)(
    lambda v: ker.american_price_baw(v.chain_px, q=0.03).select(*CONTRACT, "american"))


def _tree(source: str, steps: int, american=True) -> str:
    """`tree` of rows with `id`, s, strike, t, v, rate, w by recombining steps; a row that exercises early keeps the larger value."""
    step = "disc * (p * val[j + 1] + (1 - p) * val[j + 2])"
    value = f"greatest({step}, w * (s * exp(u * (n - 1 - 2 * j)) - strike))" if american else step
    return f"""WITH RECURSIVE par AS (
      SELECT *, v * sqrt(t / {steps}e0) AS u, exp(-rate * t / {steps}e0) AS disc, (exp(rate * t / {steps}e0) - exp(-v * sqrt(t / {steps}e0))) / (exp(v * sqrt(t / {steps}e0)) - exp(-v * sqrt(t / {steps}e0))) AS p FROM ({source})),
    tree AS (
      SELECT id, s, strike, w, u, disc, p, {steps} AS n, list_transform(range(0, {steps + 1}), lambda j: greatest(w * (s * exp(u * ({steps} - 2 * j)) - strike), 0e0)) AS val FROM par
      UNION ALL
      SELECT id, s, strike, w, u, disc, p, n - 1, list_transform(range(0, n), lambda j: {value}) FROM tree WHERE n > 0)
    SELECT id, val[1] AS tree FROM tree WHERE n = 0"""


_ID = "{" + ", ".join(f"'{c.strip()}': {c.strip()}" for c in _C.split(",")) + "}"
_IDS = ", ".join(f"id.{c.strip()} AS {c.strip()}" for c in _C.split(","))
_STEPS = 64


def _rows(s="spot", t="t", v="vol", rate="4e-2", extra="", where="true") -> str:
    return f"SELECT {_ID[:-1]}{extra}}} AS id, {s} AS s, strike, {t} AS t, {v} AS v, {rate} AS rate, {phi()} AS w FROM chain_px WHERE {where}"


query("h08_american_price_tree", f"SELECT {_IDS}, {r('tree')} AS tree FROM ({_tree(_rows(where=chr(39).join(('option_type = ', 'put', ''))), _STEPS)})")(
    lambda v: ker.american_price_tree(v.chain_px.filter("option_type = 'put'"), steps=_STEPS).select(*CONTRACT, "tree"))
query("h08_tree_call_no_dividend", f"SELECT {_C}, {r(bs())} AS tree FROM chain_px WHERE option_type = 'call'")(
    lambda v: ker.american_price_tree(v.chain_px.filter("option_type = 'call'")).select(*CONTRACT, "tree"))


_DIV = "greatest(spot - CASE WHEN t >= 5e-2 THEN 5e-1 * exp(-4e-2 * 5e-2) ELSE 0e0 END, 1e-10)"
query("h08_tree_with_dividends", f"SELECT {_IDS}, {r('tree')} AS tree FROM ({_tree(_rows(_DIV), _STEPS)})")(
    lambda v: ker.american_price_tree(v.chain_px.withColumn("divs", F.array(F.struct(F.lit(0.05).alias("time"), F.lit(0.5).alias("amount")))), steps=_STEPS, dividends="divs").select(*CONTRACT, "tree"))
_BUMPED = " UNION ALL ".join(_rows(*args, extra=f", 'k': '{k}', 'h': spot * {num(ker.SPOT_BUMP)}") for k, args in {
    "mid": (), "up": (f"spot * {num(1 + ker.SPOT_BUMP)}",), "down": (f"spot * {num(1 - ker.SPOT_BUMP)}",), "day": ("spot", f"t - {num(ker.DAY_BUMP)}"), "vol": ("spot", "t", f"vol + {num(ker.VOL_BUMP)}"),
    "rate": ("spot", "t", "vol", num(0.04 + ker.RATE_BUMP))}.items())
query("h09_american_greeks", f"""SELECT {_C}, {r('mid')} AS am_price, {r('(up - down) / (2 * h)')} AS am_delta, {r('(up - 2 * mid + down) / (h * h)')} AS am_gamma, {r('day - mid')} AS am_theta, {r('vol - mid')} AS am_vega, {r('rate - mid')} AS am_rho
    FROM (SELECT {_IDS}, id.h AS h, {', '.join(f"max(tree) FILTER (id.k = '{k}') AS {k}" for k in ('mid', 'up', 'down', 'day', 'vol', 'rate'))} FROM ({_tree(_BUMPED, 32)}) GROUP BY ALL)""")(
    lambda v: ker.american_greeks(v.chain_px, steps=32).select(*CONTRACT, *[f"am_{g}" for g in ("price", *GREEKS)]))
query("h10_early_exercise_premium", f"""SELECT {_IDS}, {r('greatest(a.tree - e.tree, 0e0)')} AS early_exercise FROM ({_tree(_rows(), _STEPS)}) a JOIN ({_tree(_rows(), _STEPS, False)}) e USING (id)""")(
    lambda v: ker.early_exercise_premium(v.chain_px, steps=_STEPS).select(*CONTRACT, "early_exercise"))
query("h11_exercise_boundary", None)(
    lambda v: ker.exercise_boundary(v.chain_px.filter("option_type = 'put'").groupBy("symbol", "expiration", "strike").agg(F.max("t").alias("t"), F.avg("vol").alias("vol")), points=5, steps=32, iterations=20))
view("svi", """SELECT DISTINCT symbol, quote_date, dte, 2e-2 + dte / 10000e0 AS a, 1e-1 + spot / 1000e0 AS b, -3e-1 AS rho, 1e-2 AS m, 2e-1 + dte / 1000e0 AS sigma FROM chain""")


def svi(v):
    d = F.col("dte").cast("double")
    return v.chain.select("symbol", "quote_date", "dte", "spot").distinct().select(
        "symbol", "quote_date", "dte", (d / 10000.0 + 0.02).alias("a"), (F.col("spot") / 1000.0 + 0.1).alias("b"), F.lit(-0.3).alias("rho"), F.lit(0.01).alias("m"),
        (d / 1000.0 + 0.2).alias("sigma"))


def _var(k, p):
    return f"({p}.a + {p}.b * ({p}.rho * ({k} - {p}.m) + sqrt(({k} - {p}.m) * ({k} - {p}.m) + {p}.sigma * {p}.sigma)))"


def _surface(points: str, cols: str) -> str:
    k = "ln(q.strike / q.spot)"
    return f"""
    SELECT {cols}, {r(f'''sqrt(least(greatest(CASE WHEN lo.dte IS NULL THEN {_var(k, 'hi')} WHEN hi.dte IS NULL THEN {_var(k, 'lo')}
        ELSE (1 - (q.dte - lo.dte) / (hi.dte - lo.dte)::DOUBLE) * {_var(k, 'lo')} + (q.dte - lo.dte) / (hi.dte - lo.dte)::DOUBLE * {_var(k, 'hi')} END, 1e-4), 4e0))''')} AS surface_iv
    FROM ({points}) q
    ASOF LEFT JOIN svi lo ON lo.symbol = q.symbol AND lo.quote_date = q.quote_date AND lo.dte <= q.dte
    ASOF LEFT JOIN svi hi ON hi.symbol = q.symbol AND hi.quote_date = q.quote_date AND hi.dte > q.dte"""


def _refit(v):
    """Smiles of known parameters, fitted again: the known volatility at every strike and how far the fit is from it."""
    points = v.chain.select("symbol", "quote_date", "spot", "strike", "dte").distinct()
    known = sf.surface_iv(points, svi(v), out="vol")
    fitted = sf.surface_iv(known, sf.fit_vol_surface(known), out="fitted")
    return fitted.select("symbol", "quote_date", "strike", "dte", F.col("vol").alias("surface_iv"), F.round(F.abs(F.col("fitted") - F.col("vol")), 3).alias("fit_error"))


query("h12_fit_vol_surface", f"SELECT *, 0e0 AS fit_error FROM ({_surface('SELECT DISTINCT symbol, quote_date, spot, strike, dte FROM chain', 'q.symbol, q.quote_date, q.strike, q.dte')})")(_refit)
query("h13_surface_iv", _surface("SELECT symbol, quote_date, spot, strike, unnest([10, 40, 60, 200]) AS dte FROM (SELECT DISTINCT symbol, quote_date, spot, strike FROM chain)", "q.symbol, q.quote_date, q.strike, q.dte"))(
    lambda v: sf.surface_iv(v.chain.select("symbol", "quote_date", "spot", "strike").distinct().withColumn("dte", F.explode(F.array(*map(F.lit, (10, 40, 60, 200))))), svi(v)).select(
        "symbol", "quote_date", "strike", "dte", "surface_iv"))
query("c06_surface_bracket", """
    SELECT q.symbol, q.quote_date, q.dte, max(s.dte) FILTER (s.dte <= q.dte)::DOUBLE AS below, min(s.dte) FILTER (s.dte > q.dte)::DOUBLE AS above
    FROM (SELECT DISTINCT symbol, quote_date, unnest([10, 40, 60, 200]) AS dte FROM chain) q JOIN svi s ON s.symbol = q.symbol AND s.quote_date = q.quote_date GROUP BY ALL""")(
    lambda v: sf.surface_bracket(v.chain.select("symbol", "quote_date").distinct().withColumn("dte", F.explode(F.array(*map(F.lit, (10, 40, 60, 200))))), svi(v)).select(
        "symbol", "quote_date", "dte", F.col("_lo.dte").alias("below"), F.col("_hi.dte").alias("above")))
query("h14_smile_grid", "SELECT symbol, quote_date, point, round(strike, 6) + 0e0 AS strike, round(moneyness, 6) + 0e0 AS moneyness, round(ln(moneyness), 6) + 0e0 AS log_moneyness, surface_iv AS iv FROM (" + _surface(
    "SELECT *, spot * moneyness AS strike FROM (SELECT symbol, d AS quote_date, spot, 45 AS dte, i::INT AS point, 8e-1 + i * (4e-1 / 9) AS moneyness FROM bars, range(10) t(i))",
    "q.symbol, q.quote_date, q.point, q.strike, q.moneyness") + ")")(
    lambda v: sf.smile_grid(v.bars.select("symbol", F.col("d").alias("quote_date"), "spot", F.lit(45).alias("dte")), svi(v), points=10).select(
        "symbol", "quote_date", "point", "strike", "moneyness", "log_moneyness", "iv"))
_W = phi()
query("h15_payoffs", f"""
    SELECT position_id, leg_no, {r(f'greatest({_W} * (spot - strike), 0)')} AS intrinsic, {r(f'greatest(entry_price - greatest({_W} * (spot - strike), 0), 0)')} AS time_value,
      {r(f'greatest({_W} * (spot * 11e-1 - strike), 0) * side * quantity * 100')} AS payoff, {r(f'(greatest({_W} * (spot * 11e-1 - strike), 0) - entry_price) * side * quantity * 100')} AS pnl FROM legs""")(
    lambda v: v.legs.select(
        "position_id", "leg_no", ins.intrinsic("spot", "strike", "option_type").alias("intrinsic"), ins.time_value("entry_price", "spot", "strike", "option_type").alias("time_value"),
        ins.payoff_at_expiry(F.col("spot") * 1.1, "strike", "option_type", "side", "quantity").alias("payoff"),
        ins.pnl_at_expiry(F.col("spot") * 1.1, "strike", "option_type", "side", "quantity", "entry_price").alias("pnl")))
query("h16_leg_values", f"""
    SELECT position_id, leg_no, {r('(m - entry_price) * quantity * 100 * side')} AS pnl, {r('CASE WHEN entry_price > 0 THEN (m - entry_price) * side / entry_price END')} AS ret,
      {r('m * quantity * 100 * side')} AS value, {r('strike * quantity * 100')} AS notional, {r('entry_price * quantity * 100 * side')} AS cost
    FROM (SELECT *, entry_price * 75e-2 + 1e-1 AS m FROM legs)""")(
    lambda v: v.legs.withColumn("m", F.col("entry_price") * 0.75 + 0.1).select(
        "position_id", "leg_no", ins.leg_pnl("m", "entry_price", "side", "quantity").alias("pnl"), ins.leg_return("m", "entry_price", "side", "quantity").alias("ret"),
        ins.market_value("m", "side", "quantity").alias("value"), ins.notional("strike", "quantity").alias("notional"), ins.entry_cost("entry_price", "side", "quantity").alias("cost")))
query("h17_year_fraction", f"""
    SELECT event_id, {r("greatest(date_diff('microsecond', ts, TIMESTAMP '2024-01-16') / (1e6 * 86400 * 365), 0)", 10)} AS years,
      {r("greatest(date_diff('microsecond', ts, TIMESTAMP '2024-01-16') / (1e6 * 86400 * 365), 0) * 252", 8)} AS trading_days, greatest(DATE '2024-01-16' - ts::DATE, 0)::INT AS days FROM events""", 10)(
    lambda v: v.table("events").withColumn("x", F.lit("2024-01-16").cast("date")).select(
        "event_id", ins.year_fraction("ts", "x").alias("years"), F.round(ins.trading_days_to_expiry("ts", "x"), 8).alias("trading_days"), ins.days_to_expiry(F.to_date("ts"), "x").alias("days")))
query("h18_option_id", f"SELECT {_C}, symbol || '_' || strike::INT || '_' || CASE WHEN option_type = 'call' THEN 'C' ELSE 'P' END || '_' || strftime(expiration, '%Y%m%d') AS option_id FROM chain")(
    lambda v: v.chain.select(*CONTRACT, ins.option_id("symbol", "strike", "option_type", "expiration").alias("option_id")))
query("h19_round_strike", f"SELECT symbol, d, round_even(spot / 5e0, 0) * 5e0 AS near, round_even(25e-1 * volume / 5e0, 0) * 5e0 AS tie FROM bars")(
    lambda v: v.bars.select("symbol", "d", ins.round_strike("spot").alias("near"), ins.round_strike(F.col("volume") * 2.5).alias("tie")))

# ---- J: structures --------------------------------------------------------------------------------
_TEMPLATES = ", ".join(f"('{s}', {i}, '{t}', {d}, {w}, {g})" for s, legs in st.LEG_TEMPLATES.items() for i, (t, d, w, g) in enumerate(legs, 1))
view("templates", f"SELECT * FROM (VALUES {_TEMPLATES}) t(structure_type, leg_no, option_type, side, w, g)")
view("every_legs0", """
    SELECT b.symbol || '_' || strftime(b.d, '%Y%m%d') || '_' || t.structure_type AS position_id, b.symbol, b.d AS entry_date, b.spot, t.structure_type, DATE '2024-02-16' AS expiration, (1 + length(t.structure_type) % 5)::INT AS quantity,
      t.leg_no, t.option_type, t.side, round_even(b.spot / 5e0, 0) * 5e0 + t.w * 10 + t.g * 5 AS strike, x.mid AS entry_price, x.vol
    FROM bars b CROSS JOIN templates t LEFT JOIN chain_px x ON x.symbol = b.symbol AND x.quote_date = b.d AND x.option_type = t.option_type AND x.expiration = DATE '2024-02-16'
      AND x.strike = round_even(b.spot / 5e0, 0) * 5e0 + t.w * 10 + t.g * 5""")
view("every_legs", "SELECT * FROM every_legs0 WHERE position_id NOT IN (SELECT position_id FROM every_legs0 WHERE entry_price IS NULL)")


def every_entries(v, width=10.0, wing=5.0):
    return v.bars.withColumn("structure_type", F.explode(F.array(*map(F.lit, st.LEG_TEMPLATES)))).select(
        F.concat_ws("_", "symbol", F.date_format("d", "yyyyMMdd"), "structure_type").alias("position_id"), "symbol", F.col("d").alias("entry_date"), "spot", "structure_type",
        F.lit("2024-02-16").cast("date").alias("expiration"), F.lit(width).cast("double").alias("width"), F.lit(wing).cast("double").alias("wing"),
        ins.round_strike("spot").alias("atm"), (F.length("structure_type") % 5 + 1).cast("int").alias("quantity"))


def priced_legs(v):
    """All legs of the entries, without a price where the strike is not listed."""
    quotes = v.chain_px.select("symbol", F.col("quote_date").alias("entry_date"), "expiration", "strike", "option_type", F.col("mid").alias("entry_price"), "vol")
    return st.build_structures(every_entries(v)).join(quotes, ["symbol", "entry_date", "expiration", "strike", "option_type"], "left")


def every_legs(v):
    return st.whole_structures(priced_legs(v))


query("j06_dropped_structures", """
    SELECT position_id, structure_type, count(*) AS num_legs, count(*) - count(entry_price) AS missing_legs, 'leg_not_listed' AS reason FROM every_legs0 GROUP BY ALL HAVING count(entry_price) < count(*)""")(
    lambda v: st.dropped_structures(priced_legs(v)))
for _jid, _types in (("j01_single_legs", ("long_call", "short_call", "long_put", "short_put")), ("j02_straddles", ("long_straddle", "short_straddle")), ("j03_strangles", ("long_strangle", "short_strangle")),
                     ("j04_spreads", ("bull_call_spread", "bear_put_spread", "bull_put_spread", "bear_call_spread")), ("j05_condors", ("iron_condor", "iron_butterfly"))):
    _in = ", ".join(f"'{t}'" for t in _types)
    query(_jid, f"SELECT position_id, leg_no, option_type, side, strike, {r('entry_price')} AS entry_price FROM every_legs WHERE structure_type IN ({_in})")(
        lambda v, ts=_types: every_legs(v).filter(F.col("structure_type").isin(*ts)).select("position_id", "leg_no", "option_type", "side", "strike", "entry_price"))
query("j06_build_structures_defaults", f"""
    SELECT b.symbol, b.d AS entry_date, t.structure_type, t.leg_no, t.option_type, t.side,
      {r("a + t.w * a * (CASE WHEN t.structure_type LIKE '%spread' THEN 2e-2 ELSE 5e-2 END) + t.g * a * 25e-3")} AS strike
    FROM (SELECT *, round_even(spot / 5e0, 0) * 5e0 AS a FROM bars) b CROSS JOIN templates t""")(
    lambda v: st.build_structures(every_entries(v, None, None)).select("symbol", "entry_date", "structure_type", "leg_no", "option_type", "side", "strike"))
query("j07_strikes_by_stddev", """
    SELECT symbol, d, ps AS put_sell, cs AS call_sell, round_even((ps - spot * 2e-2) / 5e0, 0) * 5e0 AS put_buy, round_even((cs + spot * 2e-2) / 5e0, 0) * 5e0 AS call_buy FROM (
      SELECT symbol, d, spot, round_even((spot - spot * 3e-1 * sqrt(45 / 365e0)) / 5e0, 0) * 5e0 AS ps, round_even((spot + spot * 3e-1 * sqrt(45 / 365e0)) / 5e0, 0) * 5e0 AS cs FROM bars)""")(
    lambda v: st.strikes_by_stddev(v.bars.withColumns({"iv": F.lit(0.3), "dte": F.lit(45)})).select("symbol", "d", "put_buy", "put_sell", "call_sell", "call_buy"))
query("j08_select_nearest_contract", """
    SELECT symbol, quote_date, b.expiration AS expiration, b.strike AS strike FROM (SELECT symbol, quote_date, arg_min({'expiration': expiration, 'strike': strike}, (abs(dte - 45), expiration, abs(strike - spot), strike)) AS b
      FROM chain WHERE dte BETWEEN 30 AND 60 GROUP BY ALL)""")(lambda v: st.select_nearest_contract(v.chain))
query("j09_select_strike_by_delta", "SELECT symbol, quote_date, expiration, option_type, arg_min(strike, (abs(abs(delta) - 3e-1), strike)) AS strike FROM greeks GROUP BY ALL")(
    lambda v: st.select_strike_by_delta(enriched(v), 0.3))
view("pos", "SELECT position_id, structure_type, sum(-side * entry_price * quantity) * 100 AS net_premium, max(quantity) AS q, max(strike) FILTER (option_type = 'call' AND side = 1) AS lc, "
     "max(strike) FILTER (option_type = 'call' AND side = -1) AS sc, max(strike) FILTER (option_type = 'put' AND side = 1) AS lp, max(strike) FILTER (option_type = 'put' AND side = -1) AS sp, "
     "count(*) AS n FROM every_legs GROUP BY ALL")
query("j10_net_premium", f"SELECT position_id, {r('net_premium')} AS net_premium FROM pos")(lambda v: st.net_premium(every_legs(v)))
view("full_pos", "SELECT *, abs(net_premium) / (q * 100) AS ps, CASE WHEN structure_type LIKE '%spread' THEN abs(coalesce(lc - sc, lp - sp)) WHEN structure_type LIKE 'iron%' THEN greatest(sp - lp, lc - sc) END AS width FROM pos")


_METRICS = {
    "max_profit": "CASE WHEN structure_type IN ('bull_call_spread', 'bear_put_spread') THEN width * q * 100 + net_premium WHEN structure_type LIKE 'long%' OR structure_type IN ('short_call', 'short_put') THEN NULL ELSE net_premium END",
    "max_loss": "CASE WHEN structure_type IN ('long_straddle', 'long_strangle', 'bull_call_spread', 'bear_put_spread') THEN -net_premium WHEN structure_type LIKE 'iron%' OR structure_type LIKE '%spread' THEN width * q * 100 - net_premium END",
    "lower_breakeven": "CASE WHEN structure_type IN ('long_straddle', 'long_strangle', 'bear_put_spread') THEN lp - ps WHEN structure_type IN ('short_straddle', 'short_strangle', 'bull_put_spread') OR structure_type LIKE 'iron%' THEN sp - ps END",
    "upper_breakeven": "CASE WHEN structure_type IN ('long_straddle', 'long_strangle', 'bull_call_spread') THEN lc + ps WHEN structure_type IN ('short_straddle', 'short_strangle', 'bear_call_spread') OR structure_type LIKE 'iron%' THEN sc + ps END"}
for _jid, _like in (("j11_straddle_metrics", "structure_type LIKE '%straddle'"), ("j12_spread_metrics", "structure_type LIKE '%strangle' OR structure_type LIKE '%spread'"), ("j13_condor_metrics", "structure_type LIKE 'iron%'")):
    query(_jid, f"SELECT position_id, structure_type, {r('net_premium')} AS net_premium, {r('width')} AS width, {', '.join(f'{r(e)} AS {n}' for n, e in _METRICS.items())} FROM full_pos WHERE {_like}")(
        lambda v, w=_like: st.structure_metrics(every_legs(v).filter(w)))
view("leg_greeks", "SELECT e.position_id, e.structure_type, e.symbol, e.entry_date, e.side, e.quantity, e.leg_no, e.entry_price, e.strike, e.option_type, e.spot, g.delta, g.gamma, g.theta, g.vega, g.rho FROM every_legs e "
     "JOIN greeks g ON g.symbol = e.symbol AND g.quote_date = e.entry_date AND g.expiration = e.expiration AND g.strike = e.strike AND g.option_type = e.option_type")


def leg_greeks(v):
    return px.enrich_greeks(every_legs(v), t=F.datediff("expiration", "entry_date") / 365.0)


_SG = ", ".join(f"{r(f'sum(side * quantity * {g})')} AS {g}" for g in GREEKS)
query("j14_net_greeks", f"SELECT position_id, {_SG}, abs(sum(side * quantity * delta)) <= 0.10 AS is_delta_neutral FROM leg_greeks GROUP BY ALL")(lambda v: st.net_greeks(leg_greeks(v)))
query("g17_portfolio_greeks", f"SELECT symbol, entry_date, {_SG} FROM leg_greeks GROUP BY ALL")(lambda v: k.portfolio_greeks(leg_greeks(v), ["symbol", "entry_date"]))
query("g17b_strategy_greeks", f"SELECT structure_type, {_SG.replace(', 6)', ', 4)')} FROM leg_greeks GROUP BY ALL", 4)(lambda v: k.portfolio_greeks(leg_greeks(v), ["structure_type"]))
query("j15_structure_pnl", f"""
    SELECT position_id, {r('sum((m - entry_price) * quantity * 100 * side)')} AS pnl, {r('sum(m * quantity * 100 * side)')} AS current_value, {r('sum(-side * entry_price * quantity) * 100')} AS net_premium,
      {r('sum((m - entry_price) * quantity * 100 * side) / nullif(abs(sum(-side * entry_price * quantity) * 100), 0)')} AS pnl_pct FROM (SELECT *, entry_price * 6e-1 + leg_no / 10e0 AS m FROM every_legs) GROUP BY position_id""")(
    lambda v: st.structure_pnl(every_legs(v).withColumn("mark", F.col("entry_price") * 0.6 + F.col("leg_no") / 10.0)))
query("j16_payoff_grid", f"""
    SELECT position_id, i::INT AS point, {r('spot * (5e-1 + i / 20e0)')} AS grid_spot, {r(f"sum(greatest({_W} * (spot * 5e-1 + i * (spot * 5e-2) - strike), 0) * side * quantity * 100)")} AS payoff,
      {r(f"sum((greatest({_W} * (spot * 5e-1 + i * (spot * 5e-2) - strike), 0) - entry_price) * side * quantity * 100)")} AS pnl FROM every_legs, range(21) t(i) GROUP BY position_id, i, spot""")(
    lambda v: st.payoff_grid(every_legs(v), points=21))
view("knots", f"""
    SELECT p.position_id, s, sum((greatest({_W} * (s - e.strike), 0) - e.entry_price) * e.side * e.quantity * 100) AS v
    FROM (SELECT DISTINCT position_id, strike AS s FROM every_legs UNION SELECT position_id, min(strike) * 1e-2 FROM every_legs GROUP BY 1 UNION SELECT position_id, max(strike) * 3e0 FROM every_legs GROUP BY 1) p
    JOIN every_legs e USING (position_id) GROUP BY ALL""")
query("j17_payoff_extremes", f"SELECT position_id, {r('max(v)')} AS max_profit, {r('min(v)')} AS max_loss FROM knots GROUP BY ALL")(lambda v: st.payoff_extremes(every_legs(v)))
query("j18_breakeven_points", f"""
    SELECT position_id, {r('s - v * (s2 - s) / (v2 - v)')} AS breakeven FROM (SELECT *, lead(s) OVER w AS s2, lead(v) OVER w AS v2 FROM knots WINDOW w AS (PARTITION BY position_id ORDER BY s)) WHERE v * v2 < 0 OR (v = 0 AND v2 <> 0)""")(
    lambda v: st.breakeven_points(every_legs(v)))
query("j19_expiration_span", "SELECT position_id, min(expiration) AS earliest, max(expiration) AS latest, min(expiration) = max(expiration) AS same_expiration, (min(expiration) - max(entry_date))::INT AS structure_dte FROM every_legs GROUP BY ALL")(
    lambda v: st.expiration_span(every_legs(v)))
query("j20_position_builders", """
    SELECT symbol, d, 1 AS leg_no, 'call' AS option_type, -1 AS side, round_even(spot / 5e0, 0) * 5e0 AS strike, 3e0 AS entry_price FROM bars
    UNION ALL SELECT symbol, d, 2, 'put', -1, round_even(spot / 5e0, 0) * 5e0, 25e-1 FROM bars""")(
    lambda v: st.short_straddle_at(v.bars.withColumns({"strike_atm": ins.round_strike("spot"), "call_price": F.lit(3.0), "put_price": F.lit(2.5)})).select("symbol", "d", "leg_no", "option_type", "side", "strike", "entry_price"))
query("j05_invalid_structures", "SELECT position_id, structure_type FROM pos WHERE structure_type LIKE 'iron%' AND NOT coalesce(lp < sp AND sp <= sc AND sc < lc, false)")(lambda v: st.invalid_structures(every_legs(v)))

# ---- margins and exposure over those positions ------------------------------------------------------
_NAKED = "greatest(spot * 20 + entry_price * 100 {otm}, strike * 10 + entry_price * 100, entry_price * 100)"


def _margin_sql(otm: bool) -> str:
    credit = "- (CASE WHEN option_type = 'call' THEN greatest(strike - spot, 0) ELSE greatest(spot - strike, 0) END) * 100" if otm else ""
    return f"""SELECT structure_type, position_id, net_premium, greatest(CASE WHEN net_premium > 0 THEN greatest(m - net_premium, net_premium) ELSE m END, 0) AS margin FROM (
      SELECT structure_type, position_id, sum((CASE WHEN side > 0 THEN entry_price * 100 ELSE {_NAKED.format(otm=credit)} END) * quantity) AS m, sum(-side * entry_price * quantity) * 100 AS net_premium FROM every_legs GROUP BY ALL)"""


view("margins", _margin_sql(True))
view("margins_flat", _margin_sql(False))


def _mlegs(v):
    return every_legs(v).withColumnRenamed("spot", "spot_at_entry")


query("g18_structure_margin", f"""
    SELECT structure_type, position_id, {r('net_premium')} AS net_premium, {r('CASE WHEN net_premium > 0 AND abs(ml) < abs(net_premium) * 5 THEN abs(ml) ELSE margin END')} AS margin
    FROM margins JOIN (SELECT position_id, min(v) AS ml FROM knots GROUP BY 1) USING (position_id)""")(
    lambda v: k.structure_margin(_mlegs(v), ["structure_type"], max_loss=st.payoff_extremes(every_legs(v))))
query("g18b_margin_requirement", f"SELECT structure_type, {r('sum(margin)', 4)} AS margin, count(*) AS positions FROM margins GROUP BY ALL", 4)(
    lambda v: k.margin_requirement(k.structure_margin(_mlegs(v), ["structure_type"]), ["structure_type"]))
query("g18c_margin_without_otm_credit", f"SELECT structure_type, {r('sum(margin)', 4)} AS margin, count(*) AS positions FROM margins_flat GROUP BY ALL", 4)(
    lambda v: k.margin_requirement(k.structure_margin(_mlegs(v), ["structure_type"], otm_credit=False), ["structure_type"]))
query("g20_total_exposure", f"SELECT structure_type, {r('sum(margin + CASE WHEN net_premium < 0 THEN -net_premium ELSE 0 END)', 4)} AS exposure FROM margins GROUP BY ALL", 4)(
    lambda v: k.total_exposure(k.structure_margin(_mlegs(v), ["structure_type"]), ["structure_type"]))
query("g19_position_limit_check", """
    SELECT symbol, count(*) <= 100 AS count_ok, max(margin) <= 2000 AS size_ok, sum(margin) <= 80000 AS utilization_ok, any_value(abs(delta)) <= 10 AS delta_ok, any_value(abs(vega)) <= 5 AS vega_ok
    FROM (SELECT split_part(position_id, '_', 1) AS symbol, margin FROM margins) JOIN (SELECT symbol, sum(side * quantity * delta) AS delta, sum(side * quantity * vega) AS vega FROM leg_greeks GROUP BY 1) USING (symbol) GROUP BY symbol""")(
    lambda v: k.position_limit_check(k.structure_margin(_mlegs(v), ["symbol"]), k.portfolio_greeks(leg_greeks(v), ["symbol"]), ["symbol"], max_positions=100, max_single=0.02, max_delta=10.0, max_vega=5.0))

# ---- Greeks histories -------------------------------------------------------------------------------
view("greeks_history", """
    SELECT symbol AS sid, quote_date AS d, any_value(spot) AS spot, arg_min(vol, k) AS vol, arg_min(delta, k) AS delta, arg_min(gamma, k) AS gamma, arg_min(theta, k) AS theta, arg_min(vega, k) AS vega, arg_min(rho, k) AS rho
    FROM (SELECT *, (abs(strike - spot), strike) AS k FROM greeks WHERE option_type = 'call' AND expiration = DATE '2024-03-15') GROUP BY ALL""")


def greeks_history(v):
    one = enriched(v).filter("option_type = 'call' and expiration = date'2024-03-15'").groupBy("symbol", "quote_date").agg(
        F.min_by(F.struct("spot", "vol", *GREEKS), F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))).alias("x"))
    return one.select(F.col("symbol").alias("sid"), F.col("quote_date").alias("d"), "x.*")


query("g05_greeks_over_time", " UNION ALL ".join(
    f"SELECT sid, '{g}' AS greek, {r(f'avg({g})')} AS mean, {r(f'stddev_samp({g})')} AS std, {r(f'min({g})')} AS min, {r(f'max({g})')} AS max, {r(f'max({g}) - min({g})')} AS range, {r(f'median({g})')} AS median, "
    f"{r(f'arg_max({g}, d)')} AS current, count({g}) AS count FROM greeks_history GROUP BY sid" for g in GREEKS))(lambda v: k.greeks_over_time(greeks_history(v), ["sid"]))
query("g05_greeks_correlation", "SELECT sid, " + ", ".join(f"{r(f'corr({a}, {b})')} AS {a}_{b}" for i, a in enumerate(GREEKS) for b in GREEKS[i + 1:]) + " FROM greeks_history GROUP BY sid")(
    lambda v: k.greeks_correlation(greeks_history(v), ["sid"]))
query("g06_greeks_pnl_attribution", f"""
    SELECT sid, {r('sum(pd * ds)')} AS delta_pnl, {r('sum(pg * ds * ds / 2)')} AS gamma_pnl, {r('sum(theta)')} AS theta_pnl, {r('sum(pv * dv)')} AS vega_pnl, {r('sum(spot)')} AS total_pnl,
      {r('sum(spot) - coalesce(sum(pd * ds), 0) - coalesce(sum(pg * ds * ds / 2), 0) - sum(theta) - coalesce(sum(pv * dv), 0)')} AS unexplained
    FROM (SELECT *, lag(delta) OVER w AS pd, lag(gamma) OVER w AS pg, lag(vega) OVER w AS pv, spot - lag(spot) OVER w AS ds, vol - lag(vol) OVER w AS dv FROM greeks_history WINDOW w AS (PARTITION BY sid ORDER BY d)) GROUP BY sid""")(
    lambda v: k.greeks_pnl_attribution(greeks_history(v), ["sid"], pnl="spot"))

# ---- position-day predicates (B10-B12, W09) on a daily mark series per position ----------------------
view("held", """
    SELECT l.position_id, q.quote_date AS d, l.entry_date, l.expiration, sum((q.mid - l.entry_price) * l.side * l.quantity * 100) AS pnl, sum(-l.side * l.entry_price * l.quantity) * 100 AS net_premium, (l.expiration - q.quote_date)::INT AS dte
    FROM legs l JOIN chain_px q ON q.symbol = l.symbol AND q.option_type = l.option_type AND q.expiration = l.expiration AND q.strike = l.strike AND q.quote_date >= l.entry_date
    GROUP BY l.position_id, q.quote_date, l.entry_date, l.expiration""")


def held(v):
    q = v.chain_px.select("symbol", "option_type", "expiration", "strike", F.col("quote_date").alias("d"), F.col("mid").alias("mark"))
    days = v.legs.join(q, ["symbol", "option_type", "expiration", "strike"]).filter("d >= entry_date")
    return st.structure_pnl(days, ["position_id", "d", "entry_date", "expiration"]).withColumn("dte", F.datediff("expiration", "d"))


# money as an exact DECIMAL, cast to DOUBLE once: a day exactly at a threshold must not depend on the order in which legs are added
view("held_exact", """
    SELECT l.position_id, q.quote_date AS d, l.entry_date, l.expiration, sum((q.mid::DECIMAL(18,4) - l.entry_price::DECIMAL(18,4)) * (l.side * l.quantity * 100))::DOUBLE AS pnl,
      sum(l.entry_price::DECIMAL(18,4) * (-l.side * l.quantity * 100))::DOUBLE AS net_premium, (l.expiration - q.quote_date)::INT AS dte
    FROM legs l JOIN chain_px q ON q.symbol = l.symbol AND q.option_type = l.option_type AND q.expiration = l.expiration AND q.strike = l.strike AND q.quote_date >= l.entry_date
    GROUP BY l.position_id, q.quote_date, l.entry_date, l.expiration""")


def held_exact(v):
    """`held` from prices of four decimals, with sums that are exact in whatever order the legs come."""
    q = v.chain_px.select("symbol", "option_type", "expiration", "strike", F.col("quote_date").alias("d"), F.col("mid").cast(MONEY).alias("mark"))
    days = v.legs.join(q, ["symbol", "option_type", "expiration", "strike"]).filter("d >= entry_date")
    entry, size = F.col("entry_price").cast(MONEY), (F.col("side") * F.col("quantity") * 100).cast("int")
    sums = days.groupBy("position_id", "d", "entry_date", "expiration").agg(
        F.sum((F.col("mark") - entry) * size).cast("double").alias("pnl"), F.sum(entry * -size).cast("double").alias("net_premium"))
    return sums.withColumns({"dte": F.datediff("expiration", "d"), "pnl_pct": F.when(F.abs("net_premium") > 0, F.col("pnl") / F.abs("net_premium"))})


query("b10_b12_exit_conditions", """
    SELECT position_id, d, coalesce(pnl / abs(net_premium) >= 0.5, false) AS target, coalesce(pnl / abs(net_premium) <= -2, false) AS stop, pnl <= -150 AS dollars, d - entry_date >= 10 AS old, dte <= 50 AS close_to_expiry FROM held_exact""")(
    lambda v: held_exact(v).select("position_id", "d", cond.profit_target(0.5).alias("target"), cond.stop_loss(2.0).alias("stop"), cond.fixed_stop_loss(150.0).alias("dollars"),
                             cond.holding_period(10).alias("old"), cond.expiration_approaching(50).alias("close_to_expiry")))
query("b11_trailing_stop", f"""
    SELECT position_id, d, {r('peak')} AS peak_pnl, coalesce(peak > 0 AND (peak - pnl) / peak >= 0.4, false) AS stop FROM (SELECT *, max(pnl) OVER (PARTITION BY position_id ORDER BY d) AS peak FROM held_exact)""")(
    lambda v: held_exact(v).withColumn("peak_pnl", cond.running_peak(["position_id"])).select("position_id", "d", "peak_pnl", cond.trailing_stop(0.4).alias("stop")))
query("w09_peak_pnl", f"SELECT position_id, d, {r('max(pnl) OVER (PARTITION BY position_id ORDER BY d)')} AS peak_pnl FROM held")(
    lambda v: __import__("voltable.operators.series", fromlist=["x"]).peak_pnl(held(v), ["position_id"]).select("position_id", "d", "peak_pnl"))
