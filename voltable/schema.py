"""Canonical table layouts; `sources.chains.standardize_chain` enforces them once, at the edge."""

from __future__ import annotations

CHAIN = {
    "symbol": "string", "quote_date": "date", "expiration": "date", "strike": "double", "option_type": "string",
    "bid": "double", "ask": "double", "vol": "double", "delta": "double", "gamma": "double", "theta": "double",
    "vega": "double", "rho": "double", "volume": "bigint", "open_interest": "bigint", "underlying_price": "double",
}
VOL_HISTORY = {
    "symbol": "string", "d": "date", "iv_current": "double", "hv_current": "double", "iv_year_high": "double",
    "iv_year_low": "double",
}
BARS = {"symbol": "string", "d": "date", "o": "double", "h": "double", "l": "double", "c": "double", "volume": "bigint"}
EQUITY_CURVE = {
    "strategy_id": "string", "d": "date", "equity": "double", "cash": "double", "positions_value": "double",
    "num_positions": "bigint", "realized_pnl": "double", "unrealized_pnl": "double",
}
TRADE_LOG = {
    "strategy_id": "string", "trade_id": "string", "structure_id": "string", "structure_type": "string",
    "underlying": "string", "action": "string", "d": "date", "num_legs": "bigint", "net_premium": "double",
    "total_cost": "double", "total_proceeds": "double", "commission": "double", "slippage": "double",
    "realized_pnl": "double", "exit_reason": "string",
}

# Spellings under which the usual providers name the canonical columns.
ALIASES = {
    "act_symbol": "symbol", "underlying": "symbol", "underlying_symbol": "symbol", "date": "quote_date",
    "call_put": "option_type", "type": "option_type", "implied_volatility": "vol", "iv": "vol", "spot": "underlying_price",
}


def ddl(layout: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in layout.items())
