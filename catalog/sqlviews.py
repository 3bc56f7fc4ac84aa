"""DuckDB text of the views in `voltable.views`, composed into WITH clauses by name."""

from __future__ import annotations

import re

from voltable.functions import normal
from voltable.views import EXPIRATIONS, STRIKES


def num(x: float) -> str:
    """A double literal (a plain decimal would be DECIMAL)."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def _horner(x: str, coeffs) -> str:
    acc = num(coeffs[0])
    for k in coeffs[1:]:
        acc = f"({acc} * {x} + {num(k)})" if k >= 0 else f"({acc} * {x} - {num(-k)})"
    return acc


def cdf(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-5e-1 * {a} * {a})"
    centre = f"{e} * {_horner(a, normal.CDF_NUM)} / {_horner(a, normal.CDF_DEN)}"
    tail = f"({a} + 65e-2)"
    for k in (4, 3, 2, 1):
        tail = f"({a} + {k}e0 / {tail})"
    low = f"(CASE WHEN {a} > 37 THEN 0e0 WHEN {a} < {num(normal.CDF_SPLIT)} THEN {centre} ELSE {e} / {tail} / {num(normal.SQRT_2PI)} END)"
    return f"(CASE WHEN {x} > 0 THEN 1e0 - {low} ELSE {low} END)"


def pdf(x: str) -> str:
    return f"(exp(-5e-1 * ({x}) * ({x})) / sqrt(2e0 * pi()))"


def ppf(p: str) -> str:
    def outer(q):
        u = f"sqrt(-2e0 * ln({q}))"
        return f"({_horner(u, normal.PPF_C)} / ({_horner(u, normal.PPF_D)} * {u} + 1e0))"

    z = f"({p} - 5e-1)"
    s = f"({z} * {z})"
    inner = f"({_horner(s, normal.PPF_A)} * {z} / ({_horner(s, normal.PPF_B)} * {s} + 1e0))"
    low = num(normal.PPF_LOW)
    return (f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {low} THEN {outer(p)} "
            f"WHEN {p} > 1e0 - {low} THEN -{outer(f'(1e0 - {p})')} ELSE {inner} END)")


def phi(t: str = "option_type") -> str:
    return f"(CASE WHEN {t} = 'call' THEN 1e0 ELSE -1e0 END)"


def bs(s="spot", k="strike", t="t", rate="4e-2", v="vol", w=None) -> str:
    """Closed form for positive inputs; both N() arguments carry the option's sign."""
    w = w or phi()
    d1 = f"((ln({s} / {k}) + ({rate} + 5e-1 * {v} * {v}) * {t}) / ({v} * sqrt({t})))"
    d2 = f"({d1} - {v} * sqrt({t}))"
    return f"greatest({w} * ({s} * {cdf(f'({w} * {d1})')} - {k} * exp(-{rate} * {t}) * {cdf(f'({w} * {d2})')}), 0e0)"


def mix32(x: str) -> str:
    h = f"(({x}) & 4294967295)"
    for _ in range(2):
        h = f"((xor({h}, {h} >> 16) * 73244475) & 4294967295)"
    return f"xor({h}, {h} >> 16)"


_EXP = ", ".join(f"DATE '{x}'" for x in EXPIRATIONS)
_K = ", ".join(num(k) for k in STRIKES)

VIEWS: dict[str, str] = {
    "bars": """
        SELECT 'S' || (user_id // 10) AS symbol, ts::DATE AS d, arg_min(value, event_id) AS o, max(value) AS h, min(value) AS l,
               arg_max(value, event_id) AS c, count(*) AS volume,
               floor(sum(value::DECIMAL(18,4))::DOUBLE / count(*) * 100e0 + 5e-1) / 100e0 AS spot
        FROM events GROUP BY ALL""",
    "bars_long": """
        SELECT symbol, d, c, 1e-1 + c / 999983e0 AS iv FROM (
          SELECT 'L' || (o_custkey // 100) AS symbol, o_orderdate::DATE AS d,
                 sum(o_totalprice::DECIMAL(18,4))::DOUBLE / count(*) AS c
          FROM orders GROUP BY ALL)""",
    "lines": """
        SELECT 'P' || l_suppkey AS sid, l_shipdate::DATE AS d,
               (l_extendedprice::DECIMAL(18,4) * (l_discount::DECIMAL(8,4) - 0.05::DECIMAL(8,4)))::DECIMAL(18,4) AS pnl,
               l_extendedprice::DECIMAL(18,4) AS cost, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
        FROM lineitem""",
    "equity": """
        SELECT sid, d, (1000000 + sum(p) OVER (PARTITION BY sid ORDER BY d))::DOUBLE AS equity
        FROM (SELECT sid, d, sum(pnl) AS p FROM lines GROUP BY sid, d)""",
    "returns": """
        SELECT *, CASE WHEN p <> 0 THEN equity / p - 1e0 END AS r
        FROM (SELECT *, lag(equity) OVER (PARTITION BY sid ORDER BY d) AS p FROM equity)""",
    "drawdowns": """
        SELECT *, (equity - peak) / peak AS dd, equity - peak AS dd_value
        FROM (SELECT *, max(equity) OVER (PARTITION BY sid ORDER BY d) AS peak FROM equity)""",
    "trades": """
        SELECT sid, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS trade_id,
               d - (l_partkey % 30 + 1)::INT AS entry_date, d AS exit_date, pnl::DOUBLE AS realized_pnl, pnl AS pnl_dec,
               cost::DOUBLE AS total_cost, l_quantity::INT AS contracts, l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM lines""",
    "chain": f"""
        SELECT symbol, d AS quote_date, spot, expiration, strike, option_type, (expiration - d)::INT AS dte,
               round(2e-1 + 3e-1 * ln(strike / spot) * ln(strike / spot) + (day(d) % 7) * 1e-2, 6) AS vol
        FROM bars, (SELECT unnest([{_EXP}]) AS expiration), (SELECT unnest([{_K}]) AS strike),
             (SELECT unnest(['call', 'put']) AS option_type)""",
    "chain_px": f"SELECT *, round({bs()}, 4) AS mid FROM (SELECT *, dte / 365e0 AS t FROM chain)",
    "quotes": """
        SELECT * EXCLUDE (vol, vol0, key, b, a),
               CASE WHEN key % 19 = 0 THEN 0e0 WHEN key % 17 = 0 THEN a ELSE b END AS bid,
               CASE WHEN key % 17 = 0 AND key % 19 <> 0 THEN b ELSE a END AS ask,
               CASE WHEN key % 23 <> 0 THEN vol0 END AS vol, volume * 5 AS open_interest
        FROM (SELECT *, vol AS vol0, strike::INT + day(quote_date) + substr(symbol, 2)::INT AS key, floor(mid * 98e-2 * 1e4 + 5e-1) / 1e4 AS b,
                     floor(mid * 102e-2 * 1e4 + 5e-1) / 1e4 AS a, (100 + (strike::INT * day(quote_date)) % 900)::BIGINT AS volume FROM chain_px)""",
    "vix": "SELECT ts::DATE AS d, 10e0 + count(*) % 20 AS vix FROM events GROUP BY 1",
    "benchmark_equity": """
        SELECT d, (100000000 + sum(p) OVER (ORDER BY d))::DOUBLE AS equity FROM (SELECT d, sum(pnl) AS p FROM lines GROUP BY d)""",
    "benchmark_returns": "SELECT d, equity / lag(equity) OVER (ORDER BY d) - 1e0 AS rb FROM benchmark_equity",
    "legs": """
        SELECT b.symbol || '_' || strftime(b.d, '%Y%m%d') AS position_id, b.symbol, b.d AS entry_date, b.spot, 'iron_condor' AS structure_type,
               x.expiration, 1 AS quantity, t.leg_no, x.option_type, t.side, x.strike, x.mid AS entry_price, x.vol AS iv_at_entry
        FROM bars b,
             (VALUES (1, 'put', 1, -15), (2, 'put', -1, -10), (3, 'call', -1, 10), (4, 'call', 1, 15)) t(leg_no, option_type, side, off)
        JOIN chain_px x ON x.symbol = b.symbol AND x.quote_date = b.d AND x.option_type = t.option_type
             AND x.expiration = DATE '2024-03-15' AND x.strike = round_even(b.spot / 5e0, 0) * 5e0 + t.off
        QUALIFY count(*) OVER (PARTITION BY b.symbol, b.d) = 4""",
}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(final: str) -> str:
    """Prefix `final` with the views it (transitively) names, in definition order."""
    need: set[str] = set()
    todo = [final]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", re.sub(r"'[^']*'", "''", text)):
                need.add(name)
                todo.append(VIEWS[name])
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in VIEWS if n in need)
    body = final.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
