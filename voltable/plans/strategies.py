"""Strategies as rows: templates, declarative conditions, sizing, validation, sweeps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.risk import flag_rows
from ..operators.structures import LEG_TEMPLATES

CONDITION = "struct<field: string, op: string, value: double, high: double, negate: boolean>"
COLUMNS = {
    "strategy_id": "string", "name": "string", "symbol": "string", "structure_type": "string", "min_dte": "int", "target_dte": "int", "max_dte": "int", "width": "double",
    "wing": "double", "combine": "string", "conditions": f"array<{CONDITION}>", "exit_dte": "int", "profit_target": "double", "loss_limit": "double", "exit_base": "string",
    "max_holding_days": "int", "regime_exit": "boolean", "trailing_stop": "double", "stop_dollars": "double", "max_positions": "int", "sizing_method": "string", "sizing_value": "double", "max_contracts": "int", "capital": "double",
}
LAYOUT = ", ".join(f"{n} {t}" for n, t in COLUMNS.items())
FIELDS = ("iv_rank", "vix", "iv", "spot", "regime_days", "weekday", "dte")
EXITS = ("exit_dte", "profit_target", "loss_limit", "max_holding_days", "trailing_stop", "stop_dollars")
OPERATORS = (">", ">=", "<", "<=", "==", "between")

# Sanity limits of a strategy definition.
CAPITAL_RANGE = (1_000.0, 100_000_000.0)
POSITIONS_RANGE = (1, 100)
DTE_RANGE = (0, 730)
NAME_LENGTH = (3, 100)
MAX_QUANTITY = 1000


def condition(field: str, op: str, value: float, high: float | None = None, negate: bool = False) -> dict:
    if field not in FIELDS or op not in OPERATORS:
        raise ValueError(f"unknown condition {field} {op}")
    return {"field": field, "op": op, "value": float(value), "high": None if high is None else float(high), "negate": negate}


def strategy(strategy_id: str, structure_type: str, conditions=(), **over) -> dict:
    """One strategies row with defaults."""
    row = dict(strategy_id=strategy_id, name=strategy_id, symbol=None, structure_type=structure_type, min_dte=30, target_dte=45, max_dte=730, width=None,
               wing=None, combine="and", conditions=list(conditions), exit_dte=7, profit_target=0.50, loss_limit=2.0, exit_base="max_profit", max_holding_days=None,
               regime_exit=False, trailing_stop=None, stop_dollars=None, max_positions=1, sizing_method="fixed", sizing_value=1.0, max_contracts=100, capital=100_000.0)
    unknown = set(over) - set(row)
    if unknown:
        raise ValueError(f"unknown strategy fields {sorted(unknown)}")
    return row | over


def short_straddle_rule(strategy_id="short_straddle", iv_rank=70.0, **over) -> dict:
    """K02."""
    return strategy(strategy_id, "short_straddle", [condition("iv_rank", ">=", iv_rank)], **({"min_dte": 30} | over))


def iron_condor_rule(strategy_id="iron_condor", iv_rank=50.0, **over) -> dict:
    """K03."""
    return strategy(strategy_id, "iron_condor", [condition("iv_rank", ">=", iv_rank)], **({"min_dte": 45} | over))


def volatility_regime_rules(prefix="regime", low=15.0, high=25.0, min_days=3, **over) -> list[dict]:
    """One row per regime and its structure, each gated on the regime's age."""
    gate = condition("regime_days", ">=", min_days)
    base = {"min_dte": 30, "regime_exit": True} | over
    return [
        strategy(f"{prefix}_high", "short_straddle", [condition("vix", ">", high), gate], **base),
        strategy(f"{prefix}_medium", "iron_condor", [condition("vix", "between", low, high), gate], **base),
        strategy(f"{prefix}_low", "long_straddle", [condition("vix", "<", low), gate], **base),
    ]


def template(name: str, symbol: str | None = None, **over) -> dict:
    """The five ready-made definitions."""
    # Thresholds, horizons and sizing of each definition.
    rows = {
        "high_iv_straddle": dict(structure_type="short_straddle", conditions=[condition("iv_rank", ">", 70)], min_dte=25, max_dte=45, target_dte=35, profit_target=0.50,
                                 loss_limit=2.0, exit_dte=7, max_positions=3, sizing_method="risk_percent", sizing_value=0.02),
        "iron_condor": dict(structure_type="iron_condor", conditions=[condition("iv_rank", ">", 50)], min_dte=30, max_dte=60, target_dte=45, profit_target=0.50,
                            loss_limit=2.0, exit_dte=14, max_positions=2, sizing_method="capital_percent", sizing_value=0.10, width=13.5, wing=6.75),
        "wheel": dict(structure_type="bear_put_spread", conditions=[], min_dte=30, max_dte=45, target_dte=37, profit_target=0.50, loss_limit=None, exit_dte=7,
                      max_positions=1, sizing_method="capital_percent", sizing_value=0.20, width=10.0),
        "earnings_straddle": dict(structure_type="long_straddle", conditions=[], min_dte=7, max_dte=21, target_dte=14, profit_target=0.25, loss_limit=0.50, exit_dte=None,
                                  max_holding_days=7, max_positions=5, sizing_method="risk_percent", sizing_value=0.01),
        "trend_following": dict(structure_type="bull_call_spread", conditions=[condition("vix", "between", 15, 25)], min_dte=45, max_dte=90, target_dte=67,
                                profit_target=1.0, loss_limit=0.50, exit_dte=21, max_positions=2, sizing_method="risk_percent", sizing_value=0.03, width=10.0),
    }
    kw = dict(rows[name]) | {"exit_base": "premium", "symbol": symbol} | over
    sid = kw.pop("strategy_id", name if symbol is None else f"{name}_{symbol}")
    return strategy(sid, kw.pop("structure_type"), kw.pop("conditions"), **kw)


def strategies_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of `strategy`, `template` or `StrategyBuilder.build` as a DataFrame."""
    return spark.createDataFrame(rows, LAYOUT)


def strategies_from_config(texts: DataFrame, column="config") -> DataFrame:
    """One JSON document per row with the fields of the strategies layout; absent fields get defaults."""
    defaults = strategy("x", "short_straddle")
    parsed = texts.select(F.from_json(column, LAYOUT).alias("s")).select("s.*")
    fill = {}
    for k, v in defaults.items():
        if k in ("strategy_id", "structure_type", "symbol", "width", "wing", "max_holding_days", "trailing_stop", "stop_dollars", "conditions"):
            continue
        fill[k] = F.coalesce(F.col(k), F.col("strategy_id") if k == "name" else F.lit(v))
    fill["conditions"] = F.coalesce("conditions", F.expr(f"cast(array() as array<{CONDITION}>)"))
    return parsed.withColumns(fill)


def for_symbols(rows: list[dict], symbols: DataFrame) -> DataFrame:
    """One strategy per definition and symbol. The definitions come from the caller's configuration, so
    they ride as one literal on the symbol rows; sweep parameters afterwards with `parameter_sweep`."""
    defs = F.from_json(F.lit(json.dumps(rows)), "array<struct<" + ", ".join(f"{n}: {t}" for n, t in COLUMNS.items()) + ">>")
    each = symbols.select(F.col("symbol").alias("_symbol")).distinct().select("_symbol", F.inline(defs))
    return each.withColumns({"symbol": F.col("_symbol"), "strategy_id": F.concat_ws("_", "strategy_id", "_symbol")}).drop("_symbol")


def parameter_sweep(strategies: DataFrame, grid: dict[str, list]) -> DataFrame:
    """Every combination of the given values, as rows named by their parameters."""
    out = strategies
    for name, values in grid.items():
        kind = dict(out.dtypes)[name]
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))
        out = out.withColumn("strategy_id", F.concat_ws("|", "strategy_id", F.concat(F.lit(f"{name}="), F.col(name).cast("string"))))
    return out


def entry_condition(conditions="conditions", combine="combine", custom: Column | None = None) -> Column:
    """The strategies' own condition lists over the columns of the day they are joined with.

    `custom` (X01, X02) is any further boolean Column over the same row; it must hold as well.
    """
    def one(cnd):
        x, v, op = F.element_at(F.col("_fields"), cnd["field"]), cnd["value"], cnd["op"]
        hit = (F.when(op == ">", x > v).when(op == ">=", x >= v).when(op == "<", x < v).when(op == "<=", x <= v).when(op == "==", x == v)
               .when(op == "between", x.between(v, cnd["high"])))
        hit = F.coalesce(hit, F.lit(False))
        return F.when(F.coalesce(cnd["negate"], F.lit(False)), ~hit).otherwise(hit)

    every, some = F.forall(conditions, one), F.exists(conditions, one)
    met = F.when(F.col(combine) == "or", some | (F.size(conditions) == 0)).otherwise(every)
    return met if custom is None else met & F.coalesce(custom, F.lit(False))


def day_fields() -> Column:
    """The map the conditions read (add as `_fields` before `entry_condition`)."""
    xs = [F.weekday("d").cast("double") if f == "weekday" else F.col(f).cast("double") for f in FIELDS]
    return F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*xs))


def position_size(method="sizing_method", value="sizing_value", capital="capital", max_loss="max_loss_per_contract", margin="margin_per_contract",
                  delta="delta_per_contract", premium="premium_per_contract", most="max_contracts") -> Column:
    """Contracts by method, whole, between 1 and the maximum."""
    m, v = F.col(method), F.col(value)

    def per(amount, unit, default):
        u = F.coalesce(F.col(unit), F.lit(default))
        return F.when(u > 0, F.floor(amount / u)).otherwise(F.lit(1))

    n = (
        F.when(m == "fixed", F.floor(v)).when(m == "risk_percent", per(F.col(capital) * v, max_loss, 1000.0))
        .when(m == "capital_percent", per(F.col(capital) * v, margin, 2000.0))
        .when(m == "delta_target", F.when(F.abs(F.coalesce(F.col(delta), F.lit(1.0))) > 0, F.floor(F.abs(v) / F.abs(F.coalesce(F.col(delta), F.lit(1.0))))).otherwise(F.lit(1)))
        .when(m == "premium_target", per(v, premium, 100.0)).otherwise(F.lit(1))
    )
    return F.greatest(F.least(n, F.col(most)), F.lit(1)).cast("int")


def validate_strategies(strategies: DataFrame) -> DataFrame:
    """(strategy_id, code, severity) rows."""
    c = F.col
    n = F.length(F.trim("name"))
    spread = c("structure_type").isin([s for s in LEG_TEMPLATES if "spread" in s or "iron" in s])
    return flag_rows(strategies, ["strategy_id"], [
        ("NAME_MISSING", "error", c("name").isNull() | (n == 0)), ("NAME_TOO_SHORT", "warning", (n > 0) & (n < NAME_LENGTH[0])), ("NAME_TOO_LONG", "warning", n > NAME_LENGTH[1]),
        ("CAPITAL_MISSING", "error", c("capital").isNull()), ("CAPITAL_TOO_LOW", "error", c("capital") < CAPITAL_RANGE[0]), ("CAPITAL_VERY_HIGH", "warning", c("capital") > CAPITAL_RANGE[1]),
        ("POSITIONS_TOO_FEW", "error", c("max_positions") < POSITIONS_RANGE[0]), ("POSITIONS_TOO_MANY", "warning", c("max_positions") > POSITIONS_RANGE[1]),
        ("MAX_POSITIONS_HIGH", "warning", c("max_positions") > 50),
        ("DTE_NEGATIVE", "error", c("target_dte") < DTE_RANGE[0]), ("DTE_VERY_LONG", "warning", c("target_dte") > DTE_RANGE[1]),
        ("STRUCTURE_MISSING", "error", c("structure_type").isNull()), ("STRUCTURE_UNKNOWN", "error", ~c("structure_type").isin(list(LEG_TEMPLATES))),
        ("ENTRY_CONDITION_MISSING", "error", c("conditions").isNull()),
        ("EXIT_CONDITION_MISSING", "error", F.coalesce(*[c(x).cast("double") for x in EXITS]).isNull()),
        ("TRAILING_STOP_INVALID", "error", (c("trailing_stop") <= 0) | (c("trailing_stop") >= 1)), ("STOP_DOLLARS_INVALID", "error", c("stop_dollars") <= 0),
        ("POSITION_SIZER_MISSING", "warning", c("sizing_method").isNull()), ("WIDTH_MISSING", "warning", spread & c("width").isNull()),
        ("QUANTITY_INVALID", "error", (c("sizing_method") == "fixed") & (c("sizing_value") < 1)), ("QUANTITY_VERY_HIGH", "warning", (c("sizing_method") == "fixed") & (c("sizing_value") > MAX_QUANTITY)),
    ])


class StrategyBuilder:
    """Fluent construction of one strategies row."""

    def __init__(self, strategy_id: str):
        self._over: dict = {}
        self._id, self._structure, self._conditions = strategy_id, None, []

    def underlying(self, symbol: str):
        return self._set(symbol=symbol)

    def initial_capital(self, amount: float):
        return self._set(capital=float(amount))

    def when(self, field: str, op: str, value: float, high: float | None = None, negate: bool = False):
        self._conditions.append(condition(field, op, value, high, negate))
        return self

    def any_condition(self):
        return self._set(combine="or")

    def structure(self, structure_type: str, dte: int = 30, width: float | None = None, wing: float | None = None):
        if structure_type not in LEG_TEMPLATES:
            raise ValueError(f"unknown structure {structure_type}")
        self._structure = structure_type
        return self._set(target_dte=dte, width=width, wing=wing)

    def dte_between(self, low: int, high: int):
        return self._set(min_dte=low, max_dte=high)

    def exit_at(self, profit_target=None, loss_limit=None, dte=None, holding_days=None, trailing=None, dollars=None):
        return self._set(profit_target=profit_target, loss_limit=loss_limit, exit_dte=dte, max_holding_days=holding_days, trailing_stop=trailing, stop_dollars=dollars, exit_base="premium")

    def position_size(self, method: str, value: float, most: int = 100):
        return self._set(sizing_method=method, sizing_value=float(value), max_contracts=most)

    def max_positions(self, n: int):
        return self._set(max_positions=n)

    def _set(self, **kw):
        self._over |= kw
        return self

    def build(self) -> dict:
        if self._structure is None:
            raise ValueError("a strategy needs a structure")
        return strategy(self._id, self._structure, self._conditions, **self._over)

    def to_json(self) -> str:
        return json.dumps(self.build())
