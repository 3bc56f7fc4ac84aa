"""Reading and requesting option chains, volatility history and bars.

Requests take literals (pushed to the scan) and always filter on stored columns: days-to-expiry bounds
are rewritten to expiration bounds, so Parquet statistics can skip row groups.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.common import finite
from ..schema import ALIASES, CHAIN, ddl

CHAIN_ORDER = ("expiration", "strike", "option_type")


def _date(x) -> dt.date:
    return x if isinstance(x, dt.date) and not isinstance(x, dt.datetime) else dt.date.fromisoformat(str(x)[:10])


def scan_option_chain(df: DataFrame, symbol: str, date, min_dte=0, max_dte=60, strikes=None, option_type=None,
                      ordered: bool = True) -> DataFrame:
    """One symbol's chain of one day, expirations between date + min_dte and date + max_dte."""
    day = _date(date)
    out = df.filter(
        (F.col("symbol") == symbol) & (F.col("quote_date") == F.lit(day))
        & F.col("expiration").between(F.lit(day + dt.timedelta(days=min_dte)), F.lit(day + dt.timedelta(days=max_dte)))
    )
    if strikes:
        out = out.filter(F.col("strike").isin([float(k) for k in strikes]))
    if option_type:
        out = out.filter(F.col("option_type") == option_type.lower())
    return out.orderBy(*CHAIN_ORDER) if ordered else out


def scan_option_chains(df: DataFrame, requests: DataFrame, min_dte=0, max_dte=60) -> DataFrame:
    """A01 for a table of (symbol, quote_date) requests."""
    wanted = requests.select("symbol", "quote_date").distinct()
    return df.join(wanted, ["symbol", "quote_date"], "left_semi").filter(
        F.datediff("expiration", "quote_date").between(min_dte, max_dte))


def scan_historical_options(df: DataFrame, symbol: str, start, end, strikes=None, expirations=None) -> DataFrame:
    """A02."""
    out = df.filter((F.col("symbol") == symbol) & F.col("quote_date").between(F.lit(_date(start)), F.lit(_date(end))))
    if strikes:
        out = out.filter(F.col("strike").isin([float(k) for k in strikes]))
    if expirations:
        out = out.filter(F.col("expiration").isin([_date(x) for x in expirations]))
    return out.orderBy("quote_date", *CHAIN_ORDER)


def scan_volatility_history(df: DataFrame, symbol: str, start, end) -> DataFrame:
    """A03."""
    return df.filter((F.col("symbol") == symbol) & F.col("d").between(F.lit(_date(start)), F.lit(_date(end)))).orderBy("d")


def scan_vix_history(df: DataFrame, start, end) -> DataFrame:
    """A04."""
    return scan_volatility_history(df, "VIX", start, end)


def query_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Free SQL over named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def available_symbols(df: DataFrame, date=None) -> DataFrame:
    """A06."""
    out = df.filter(F.col("quote_date") == F.lit(_date(date))) if date is not None else df
    return out.select("symbol").distinct().orderBy("symbol")


def date_range(df: DataFrame, keys: list[str], date="quote_date") -> DataFrame:
    """A07."""
    return df.groupBy(*keys).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def describe_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, position, column, type) rows; the catalogue is metadata, so no data is read."""
    rows = [(t, i, n, ty) for t, df in tables.items() for i, (n, ty) in enumerate(df.dtypes, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, column_type string")


def read_chain_csv(spark: SparkSession, root: str, layout: str = "auto") -> DataFrame:
    """SYM/2024-01-15.csv (nested) or SYM_20240115.csv (flat) trees in one distributed read.

    Symbol and date come from the path; both layouts may share a tree under `layout='auto'`.
    Headers are lower-cased and all values read as text, to be typed by `standardize_chain`.
    """
    globs = {"nested": f"{root}/*/*.csv", "flat": f"{root}/*.csv"}
    df = spark.read.option("header", True).option("recursiveFileLookup", layout == "auto").csv(
        root if layout == "auto" else globs[layout])
    df = df.toDF(*[c.lower() for c in df.columns])
    path = F.col("_metadata.file_path")
    nested = r"([^/]+)/(\d{4}-\d{2}-\d{2})\.csv$"
    flat = r"([^/_]+)_(\d{8})\.csv$"
    keep = [F.col(c) for c in df.columns if c not in ("symbol", "quote_date", "date")]
    sym = F.coalesce(F.nullif(F.regexp_extract(path, flat, 1), F.lit("")), F.regexp_extract(path, nested, 1))
    day = F.coalesce(
        F.try_to_date(F.nullif(F.regexp_extract(path, flat, 2), F.lit("")), "yyyyMMdd"),
        F.try_to_date(F.nullif(F.regexp_extract(path, nested, 2), F.lit("")), "yyyy-MM-dd"),
    )
    out = df.select(sym.alias("symbol"), day.alias("quote_date"), *keep)
    return out.filter((F.col("symbol") != "") & F.col("quote_date").isNotNull())


def standardize_chain(df: DataFrame) -> DataFrame:
    """Canonical names and types; unparseable values and NaN become NULL; option types `call`/`put`."""
    lower = df.toDF(*[c.lower() for c in df.columns])
    names = set(lower.columns)
    out = lower
    for old, new in ALIASES.items():
        if old in names and new not in names:
            out = out.withColumnRenamed(old, new)
            names = (names - {old}) | {new}
    cols = {}
    for n, t in CHAIN.items():
        if n not in names:
            continue
        x = F.col(n)
        if t == "double":
            x = finite(x.cast("string").try_cast("double"))
        elif t == "bigint":
            x = x.cast("string").try_cast("double").try_cast("bigint")
        elif t == "date":
            x = F.try_to_timestamp(x.cast("string")).cast("date")
        elif n == "option_type":
            low = F.lower(F.trim(x))
            x = F.when(low.isin("c", "call"), F.lit("call")).when(low.isin("p", "put"), F.lit("put"))
        cols[n] = x
    return out.withColumns(cols)


def coalesce_sources(sources: list[tuple[str, int, DataFrame]], override: str | None = None,
                     keys=("symbol", "quote_date")) -> DataFrame:
    """A10: per (symbol, day) the rows of the first source by priority (1 = first) that has any."""
    if override is not None:
        sources = [s for s in sources if s[0] == override]
    tagged = [df.withColumns({"source": F.lit(n), "_prio": F.lit(p)}) for n, p, df in sources]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    best = every.groupBy(*keys).agg(F.min("_prio").alias("_prio"))
    return every.join(best, [*keys, "_prio"], "left_semi").drop("_prio")


def source_counts(requests: DataFrame, chosen: DataFrame, keys=("symbol", "quote_date")) -> DataFrame:
    """A10: requests served per source; unserved ones under 'none'."""
    served = chosen.select(*keys, "source").distinct()
    return requests.select(*keys).distinct().join(served, list(keys), "left").groupBy(
        F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("requests"))


def resolve_underlying_price(requests: DataFrame, prices: DataFrame, chain: DataFrame) -> DataFrame:
    """Price file close, else the chain's underlying price, else its spot, else the median strike."""
    from ..operators.chain import spot_median_strike

    key = ["symbol", "quote_date"]
    maybe = [F.max(c).alias(f"_{c}") for c in ("underlying_price", "spot") if c in chain.columns]
    out = requests.select(*key).distinct().join(prices.select(*key, F.col("close").alias("_close")), key, "left")
    out = out.join(spot_median_strike(chain).withColumnRenamed("spot_median", "_median"), key, "left")
    picks = ["_close"]
    if maybe:
        out = out.join(chain.groupBy(*key).agg(*maybe), key, "left")
        picks += [f"_{c}" for c in ("underlying_price", "spot") if c in chain.columns]
    return out.select(*key, F.coalesce(*picks, "_median").alias("price"))


def volatility_snapshot(vol_history: DataFrame) -> DataFrame:
    """A12."""
    return vol_history.select("symbol", "d", "iv_current", "hv_current", "iv_year_high", "iv_year_low")


def load_bars(df: DataFrame, symbol: str | None, start, end, columns=("o", "h", "l", "c", "volume")) -> DataFrame:
    """A date range of bars with numeric coercion; requested columns that do not exist are left out."""
    out = df.filter(F.col("d").between(F.lit(_date(start)), F.lit(_date(end))))
    if symbol is not None:
        out = out.filter(F.col("symbol") == symbol)
    have = [c for c in columns if c in df.columns]
    return out.select("symbol", "d", *[finite(F.col(c).cast("string").try_cast("double")).alias(c) for c in have])


def empty_chain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ddl(CHAIN))
