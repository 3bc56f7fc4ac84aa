"""Data-quality checks as aggregates: no row leaves the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.calendar import business_days_between
from .chain import quote_rules

REQUIRED_CHAIN = ("strike", "expiration", "option_type")
MAX_SPREAD_PCT = 0.50
MIN_IV, MAX_IV = 0.01, 5.0
MAX_DELTA = 1.0001
CONTRACT_KEYS = ["symbol", "strike", "expiration", "option_type"]


def _unpivot(counts: DataFrame, keys: list[str], rules: list[tuple[str, str]], out="violations") -> DataFrame:
    """One wide row of counts per key as (rule, severity, count) rows."""
    parts = ", ".join(f"'{r}', '{s}', `{r}`" for r, s in rules)
    return counts.select(*keys, F.expr(f"stack({len(rules)}, {parts}) as (rule, severity, {out})"))


def option_rules(df: DataFrame) -> list[tuple[str, str, Column]]:
    have = set(df.columns)
    c = F.col
    mid = (c("bid") + c("ask")) / 2.0
    rules = []
    if "strike" in have:
        rules += [("strike_not_positive", "error", c("strike") <= 0), ("strike_null", "error", c("strike").isNull())]
    if "option_type" in have:
        ok = F.lower(c("option_type")).isin("call", "put", "c", "p")
        rules.append(("option_type_invalid", "error", ~F.coalesce(ok, F.lit(False))))
    rules += [(f"{x}_negative", "error", c(x) < 0) for x in ("bid", "ask") if x in have]
    if {"bid", "ask"} <= have:
        rules += [("quote_inverted", "error", c("bid") > c("ask")),
                  ("spread_wide", "warning", (mid > 0) & ((c("ask") - c("bid")) / mid > MAX_SPREAD_PCT))]
    if "vol" in have:
        rules += [("iv_zero", "warning", c("vol") == 0), ("iv_low", "warning", (c("vol") > 0) & (c("vol") < MIN_IV)),
                  ("iv_high", "warning", c("vol") > MAX_IV), ("iv_null", "warning", c("vol").isNull())]
    if "delta" in have:
        rules.append(("delta_out_of_range", "error", F.abs("delta") > MAX_DELTA))
    if "gamma" in have:
        rules.append(("gamma_negative", "error", c("gamma") < 0))
    if "expiration" in have:
        rules.append(("expiration_null", "error", c("expiration").isNull()))
    return rules


def validate_option_data(df: DataFrame, keys: list[str] = (), strict: bool = False) -> DataFrame:
    """Violation counts per rule; missing required columns count as one error each.

    `is_error` is what invalidates the data: errors always, warnings too under `strict`.
    """
    rules = option_rules(df)
    counts = df.groupBy(*keys).agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(n) for n, _, cond in rules])
    for m in [x for x in REQUIRED_CHAIN if x not in df.columns]:
        counts = counts.withColumn(f"missing_{m}", F.lit(1).cast("bigint"))
        rules.append((f"missing_{m}", "error", F.lit(True)))
    out = _unpivot(counts, list(keys), [(n, s) for n, s, _ in rules])
    blocking = F.lit(True) if strict else F.col("severity") == "error"
    return out.withColumn("is_error", (F.col("violations") > 0) & blocking)


def quote_filter_report(df: DataFrame, keys: list[str] = (), **limits) -> DataFrame:
    """Rows each rule of B02 would remove, counted independently in one pass."""
    rules = quote_rules(df, **limits)
    counts = df.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    return _unpivot(counts, list(keys), [(n, "removed") for n in rules], "removed").drop("severity")


def validate_price_data(df: DataFrame, keys: list[str] = (), columns=("o", "h", "l", "c")) -> DataFrame:
    """Negatives, nulls, high/low out of order, negative volume."""
    have = [x for x in columns if x in df.columns]
    c = F.col
    rules = [(f"{x}_negative", c(x) < 0) for x in have] + [(f"{x}_null", c(x).isNull()) for x in have]
    if {"o", "h", "l", "c"} <= set(df.columns):
        rules += [("high_violation", (c("h") < c("o")) | (c("h") < c("c"))), ("low_violation", (c("l") > c("o")) | (c("l") > c("c")))]
    if "volume" in df.columns:
        rules.append(("volume_negative", c("volume") < 0))
    counts = df.groupBy(*keys).agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in rules])
    return _unpivot(counts, list(keys), [(n, "error") for n, _ in rules])


def data_quality_report(df: DataFrame, data_type="option", symbol="symbol", date="quote_date", approximate=False) -> DataFrame:
    """One row: rows, columns, nulls, symbols, date range, number of issues, score."""
    rules = [x for _, _, x in option_rules(df)] if data_type == "option" else None
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in df.columns]
    distinct = F.approx_count_distinct(symbol) if approximate else F.count_distinct(symbol)
    if rules is None:
        issue_counts = validate_price_data(df).agg(F.count_if(F.col("violations") > 0).alias("issues"))
    else:
        issue_counts = df.agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(f"_i{i}") for i, x in enumerate(rules)])
        hit = [F.when(F.col(f"_i{i}") > 0, 1).otherwise(0) for i in range(len(rules))]
        issue_counts = issue_counts.select(sum(hit[1:], hit[0]).cast("bigint").alias("issues"))
    base = df.agg(F.count(F.lit(1)).alias("total_rows"), distinct.alias("unique_symbols"),
                  F.min(date).alias("first_date"), F.max(date).alias("last_date"), *nulls)
    total_nulls = sum((F.col(f"_null_{c}") for c in df.columns[1:]), F.col(f"_null_{df.columns[0]}"))
    base = base.withColumns({"total_columns": F.lit(len(df.columns)), "total_nulls": total_nulls})
    # two single-row frames
    one = base.withColumn("_j", F.lit(1)).join(issue_counts.withColumn("_j", F.lit(1)), "_j")
    share = F.when(F.col("total_rows") > 0, F.col("total_nulls") * 100.0 / (F.col("total_rows") * F.col("total_columns"))).otherwise(F.lit(0.0))
    score = F.lit(100.0) - F.least(F.lit(30.0), share) - F.least(F.lit(40.0), F.col("issues") * 5.0)
    empty = F.when(F.col("total_rows") == 0, F.lit(0.0))
    return one.select("total_rows", "total_columns", "total_nulls", "unique_symbols", "first_date", "last_date", "issues",
                      F.coalesce(empty, F.greatest(score, F.lit(0.0))).alias("quality_score"))


def arbitrage_flag(spot="spot", price="mid") -> Column:
    """E05 per row: which bound a price breaks, else NULL."""
    s, k, p = F.col(spot), F.col("strike"), F.col(price)
    call = F.col("option_type") == "call"
    return (
        F.when(call & (p > s * 1.05), F.lit("call_above_spot"))
        .when(call & (p < F.greatest(s - k, F.lit(0.0)) * 0.95), F.lit("call_below_intrinsic"))
        .when(~call & (p > k * 1.05), F.lit("put_above_strike"))
        .when(~call & (p < F.greatest(k - s, F.lit(0.0)) * 0.95), F.lit("put_below_intrinsic"))
    )


def check_arbitrage(df: DataFrame, keys: list[str] = (), spot="spot", price="mid") -> DataFrame:
    """Violations per kind."""
    bad = df.withColumn("violation", arbitrage_flag(spot, price)).filter(F.col("violation").isNotNull())
    return bad.groupBy(*keys, "violation").agg(F.count(F.lit(1)).alias("violations"))


def check_for_gaps(df: DataFrame, keys: list[str], date="quote_date", max_gap_days=3, exclude_weekends=True) -> DataFrame:
    """Dates followed by a gap. Distinct dates per key are bounded by the calendar."""
    days = df.select(*keys, date).distinct()
    nxt = F.lead(date).over(W.partitionBy(*keys).orderBy(date))
    gaps = days.withColumn("next_date", nxt).withColumns({
        "gap_days": F.datediff("next_date", date), "business_days": business_days_between(F.col(date), F.col("next_date"))})
    long_ = F.col("gap_days") > max_gap_days
    return gaps.filter(long_ & (F.col("business_days") > 1) if exclude_weekends else long_)


def detect_stale_prices(df: DataFrame, threshold=3, price="mid", date="quote_date", keys=CONTRACT_KEYS) -> DataFrame:
    """Rows whose price repeats for at least `threshold` observations of one contract."""
    w = W.partitionBy(*keys).orderBy(date)
    change = F.when(F.col(price) == F.lag(price).over(w), 0).otherwise(1)
    runs = df.withColumn("_chg", change).withColumn("_run", F.sum("_chg").over(w.rowsBetween(W.unboundedPreceding, 0)))
    length = F.row_number().over(W.partitionBy(*keys, "_run").orderBy(date))
    return runs.withColumn("run_length", length).filter((F.col("run_length") >= threshold) & F.col(price).isNotNull()).drop("_chg", "_run")
