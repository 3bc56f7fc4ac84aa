"""Options-market views over the star-schema tables, used by the query catalogue, tests and bench.

Every view is a pure function of the given tables and grows with them: symbols are groups of users,
strategies are suppliers, long price histories are groups of customers.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .functions.pricing import price_chain
from .functions.instrument import round_strike

RATE = 0.04
EXPIRATIONS = ("2024-02-16", "2024-03-15", "2024-04-19")
STRIKES = tuple(float(k) for k in range(30, 75, 5))
MONEY = "decimal(18,4)"


def snap(x: Column, digits: int) -> Column:
    """Round half up through plain double arithmetic, so that every engine agrees on ties."""
    unit = float(10**digits)
    return F.floor(x * unit + 0.5) / F.lit(unit)


class Views:
    """Lazily built DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        """symbol, d, o, h, l, c, volume, spot: daily bars of event values per group of ten users."""
        ev = self.table("events").select(
            F.concat(F.lit("S"), F.floor(F.col("user_id") / 10).cast("string")).alias("symbol"),
            F.to_date("ts").alias("d"), "event_id", "value",
        )
        cents = F.sum(F.col("value").cast(MONEY)).cast("double")
        return ev.groupBy("symbol", "d").agg(
            F.min_by("value", "event_id").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"),
            F.max_by("value", "event_id").alias("c"), F.count(F.lit(1)).alias("volume"),
            snap(cents / F.count(F.lit(1)), 2).alias("spot"),
        )

    @cached_property
    def bars_long(self) -> DataFrame:
        """symbol, d, c, iv: order values per group of a hundred customers, long enough for year windows."""
        o = self.table("orders").select(
            F.concat(F.lit("L"), F.floor(F.col("o_custkey") / 100).cast("string")).alias("symbol"),
            F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").cast(MONEY).alias("p"),
        )
        close = F.sum("p").cast("double") / F.count(F.lit(1))
        return o.groupBy("symbol", "d").agg(close.alias("c")).withColumn(
            "iv", F.lit(0.1) + F.col("c") / 999983.0
        )

    @cached_property
    def _lines(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("sid"),
            F.to_date("l_shipdate").alias("d"),
            (F.col("l_extendedprice").cast(MONEY) * (F.col("l_discount").cast(MONEY) - F.lit("0.05").cast(MONEY)))
            .cast(MONEY).alias("pnl"),
            F.col("l_extendedprice").cast(MONEY).alias("cost"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        )

    @cached_property
    def equity(self) -> DataFrame:
        """sid, d, equity: one daily curve per supplier."""
        # days are few in bytes, windows over them long: an explicit count keeps AQE from merging curves into few tasks
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        daily = self._lines.groupBy("sid", "d").agg(F.sum("pnl").alias("p")).repartition(tasks, "sid")
        w = W.partitionBy("sid").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
        total = F.lit("1000000").cast("decimal(28,4)") + F.sum("p").over(w)
        return daily.select("sid", "d", total.cast("double").alias("equity"))

    @cached_property
    def trades(self) -> DataFrame:
        """One closed trade per order line; the order columns give a total order within a day."""
        return self._lines.select(
            "sid",
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
            F.date_sub("d", (F.col("l_partkey") % 30 + 1).cast("int")).alias("entry_date"),
            F.col("d").alias("exit_date"), F.col("pnl").cast("double").alias("realized_pnl"),
            F.col("pnl").alias("pnl_dec"), F.col("cost").cast("double").alias("total_cost"),
            F.col("l_quantity").cast("int").alias("contracts"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )

    @cached_property
    def chain(self) -> DataFrame:
        """Contract-day grid with a smile in strike and a little noise in time."""
        # a handful of rows grows into a whole chain: fix the task count, or AQE would merge it into one task
        # (keys in another order than the aggregation's, else the planner drops this exchange as redundant)
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        grid = self.bars.select("symbol", F.col("d").alias("quote_date"), "spot").repartition(tasks, "quote_date", "symbol")
        grid = grid.withColumn("expiration", F.explode(F.array(*[F.lit(x).cast("date") for x in EXPIRATIONS])))
        grid = grid.withColumn("strike", F.explode(F.array(*map(F.lit, STRIKES))))
        grid = grid.withColumn("option_type", F.explode(F.array(F.lit("call"), F.lit("put"))))
        lm = F.log(F.col("strike") / F.col("spot"))
        noise = (F.dayofmonth("quote_date") % 7).cast("double") * 0.01
        return grid.withColumns(
            {"dte": F.datediff("expiration", "quote_date"),
             "vol": F.round(F.lit(0.2) + F.lit(0.3) * lm * lm + noise, 6)}
        )

    @cached_property
    def chain_px(self) -> DataFrame:
        timed = self.chain.withColumn("t", F.col("dte") / 365.0)
        return price_chain(timed, rate=RATE, out="_p").withColumn("mid", F.round("_p", 4)).drop("_p")

    @cached_property
    def quotes(self) -> DataFrame:
        """chain_px with bid/ask/volume and planted defects (inverted, zero bid, null IV)."""
        day = F.dayofmonth("quote_date")
        k = F.col("strike").cast("int")
        key = k + day + F.substring("symbol", 2, 9).cast("int")
        bid, ask = snap(F.col("mid") * 0.98, 4), snap(F.col("mid") * 1.02, 4)
        swap = key % 17 == 0
        volume = (F.lit(100) + (k * day) % 900).cast("bigint")
        return self.chain_px.withColumns(
            {"bid": F.when(key % 19 == 0, F.lit(0.0)).when(swap, ask).otherwise(bid),
             "ask": F.when(swap & (key % 19 != 0), bid).otherwise(ask),
             "vol": F.when(key % 23 != 0, F.col("vol")),
             "volume": volume, "open_interest": volume * 5}
        )

    @cached_property
    def vix(self) -> DataFrame:
        ev = self.table("events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
        return ev.select("d", (F.lit(10.0) + (F.col("n") % 20)).alias("vix"))

    @cached_property
    def benchmark_equity(self) -> DataFrame:
        """d, equity: all curves' daily flows summed."""
        flows = self._lines.groupBy("d").agg(F.sum("pnl").alias("p"))
        # one row per calendar day: the window's size is bounded by the calendar
        w = W.partitionBy(F.lit("benchmark")).orderBy("d").rowsBetween(W.unboundedPreceding, 0)
        total = F.lit("100000000").cast("decimal(28,4)") + F.sum("p").over(w)
        return flows.select("d", total.cast("double").alias("equity"))

    @cached_property
    def legs(self) -> DataFrame:
        """Iron-condor legs opened on every symbol-day whose four strikes are all listed, priced from the grid."""
        from .operators.structures import build_structures, whole_structures

        entries = self.bars.select(
            F.concat_ws("_", "symbol", F.date_format("d", "yyyyMMdd")).alias("position_id"), "symbol",
            F.col("d").alias("entry_date"), "spot", F.lit("iron_condor").alias("structure_type"),
            F.lit(EXPIRATIONS[1]).cast("date").alias("expiration"), F.lit(10.0).alias("width"), F.lit(5.0).alias("wing"),
            round_strike("spot").alias("atm"), F.lit(1).alias("quantity"),
        )
        legs = build_structures(entries)
        px = self.chain_px.select(
            "symbol", F.col("quote_date").alias("entry_date"), "expiration", "strike", "option_type",
            F.col("mid").alias("entry_price"), F.col("vol").alias("iv_at_entry"),
        )
        return whole_structures(legs.join(px, ["symbol", "entry_date", "expiration", "strike", "option_type"], "left"))
