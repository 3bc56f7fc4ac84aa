"""Trading calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

FIXED_HOLIDAYS = ("01-01", "07-04", "12-25")


def trading_calendar(spark: SparkSession, start, end, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays between two dates less the fixed and the given holidays (column `d`)."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}')")).alias("d"))
    return drop_closed(days, holidays)


def calendar_spans(spans: DataFrame, keys: list[str], holidays: DataFrame | None = None) -> DataFrame:
    """A15 per key: `spans` has (keys, first_date, last_date)."""
    # a span is a few bytes and becomes thousands of days: fix the task count, or AQE would merge the spans into one task
    # (one more than an aggregation's, else the planner drops this exchange as redundant)
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    days = spans.repartition(tasks, *keys).select(*keys, F.explode(F.sequence("first_date", "last_date")).alias("d"))
    return drop_closed(days, holidays)


def drop_closed(days: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    open_ = days.filter((F.weekday("d") < 5) & ~F.date_format("d", "MM-dd").isin(*FIXED_HOLIDAYS))
    return open_.join(holidays.select("d"), "d", "left_anti") if holidays is not None else open_


def with_next_trading_day(calendar: DataFrame, keys: list[str]) -> DataFrame:
    """The following open day per key; one row per calendar day, so the window is bounded."""
    return calendar.withColumn("next_day", F.lead("d").over(W.partitionBy(*keys).orderBy("d")))


def business_days_between(a: Column, b: Column) -> Column:
    """Weekdays in [a, b), in closed form."""
    def weekdays_before(x):
        # days since Monday 1969-12-29: whole weeks give five, the rest at most five
        n = F.unix_date(x) + 3
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return weekdays_before(b) - weekdays_before(a)


def trading_dates(bars: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Dates that actually have prices."""
    return bars.filter(F.col("c").isNotNull()).select(*keys, "d").distinct()
