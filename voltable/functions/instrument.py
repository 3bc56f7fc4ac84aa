"""Per-leg instrument arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import CONTRACT_MULTIPLIER, TRADING_DAYS, col_of, is_call, phi


def intrinsic(spot, strike, option_type) -> Column:
    return F.greatest(phi(option_type) * (col_of(spot) - col_of(strike)), F.lit(0.0))


def time_value(price, spot, strike, option_type) -> Column:
    return F.greatest(col_of(price) - intrinsic(spot, strike, option_type), F.lit(0.0))


def payoff_at_expiry(spot, strike, option_type, side, quantity) -> Column:
    return intrinsic(spot, strike, option_type) * col_of(side) * col_of(quantity) * CONTRACT_MULTIPLIER


def pnl_at_expiry(spot, strike, option_type, side, quantity, entry_price) -> Column:
    gain = intrinsic(spot, strike, option_type) - col_of(entry_price)
    return gain * col_of(side) * col_of(quantity) * CONTRACT_MULTIPLIER


def leg_pnl(mark, entry_price, side, quantity) -> Column:
    return (col_of(mark) - col_of(entry_price)) * col_of(quantity) * CONTRACT_MULTIPLIER * col_of(side)


def entry_cost(entry_price, side, quantity) -> Column:
    """Cash paid at entry: positive for a long leg, negative for a short one."""
    return col_of(entry_price) * col_of(quantity) * CONTRACT_MULTIPLIER * col_of(side)


def leg_return(mark, entry_price, side, quantity) -> Column:
    cost = F.abs(entry_cost(entry_price, side, quantity))
    return F.when(cost > 0, leg_pnl(mark, entry_price, side, quantity) / cost)


def market_value(mark, side, quantity) -> Column:
    return col_of(mark) * col_of(quantity) * CONTRACT_MULTIPLIER * col_of(side)


def notional(strike, quantity) -> Column:
    return col_of(strike) * col_of(quantity) * CONTRACT_MULTIPLIER


def moneyness(spot, strike) -> Column:
    return F.when(col_of(strike) > 0, col_of(spot) / col_of(strike))


def is_atm(spot, strike, threshold: float = 0.02) -> Column:
    return F.abs(moneyness(spot, strike) - 1.0) <= F.lit(threshold)


def is_itm(spot, strike, option_type) -> Column:
    return phi(option_type) * (col_of(spot) - col_of(strike)) > 0


def is_otm(spot, strike, option_type) -> Column:
    return phi(option_type) * (col_of(spot) - col_of(strike)) < 0


def moneyness_class(spot, strike, option_type, threshold: float = 0.02) -> Column:
    return (
        F.when(is_atm(spot, strike, threshold), F.lit("ATM"))
        .when(is_itm(spot, strike, option_type), F.lit("ITM"))
        .otherwise(F.lit("OTM"))
    )


def days_to_expiry(date, expiration) -> Column:
    return F.greatest(F.datediff(col_of(expiration), col_of(date)), F.lit(0))


def is_expiration_day(date, expiration) -> Column:
    return F.datediff(col_of(expiration), col_of(date)) == 0


def is_within_dte_range(date, expiration, low: int, high: int) -> Column:
    return days_to_expiry(date, expiration).between(low, high)


def year_fraction(ts, expiration) -> Column:
    """Calendar seconds to expiry over a 365-day year, floored at zero."""
    seconds = F.unix_micros(col_of(expiration).cast("timestamp")) - F.unix_micros(col_of(ts).cast("timestamp"))
    return F.greatest(seconds / F.lit(1e6 * 86400.0 * 365.0), F.lit(0.0))


def trading_days_to_expiry(ts, expiration) -> Column:
    return year_fraction(ts, expiration) * TRADING_DAYS


def option_id(symbol, strike, option_type, expiration) -> Column:
    letter = F.when(is_call(option_type), F.lit("C")).otherwise(F.lit("P"))
    return F.concat_ws(
        "_", col_of(symbol), F.format_string("%.0f", col_of(strike)), letter,
        F.date_format(col_of(expiration), "yyyyMMdd"),
    )


def round_strike(x, step: float = 5.0) -> Column:
    """Nearest listed strike, ties to even."""
    return F.bround(col_of(x) / step) * step
