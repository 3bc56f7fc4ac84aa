"""Sources, calendars, quality rules, conditions, marks and execution on small literal tables."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltable.functions import conditions as c
from voltable.operators import chain as ch, quality as q
from voltable.plans import execution as ex
from voltable.sources import calendar as cal, chains as src, sinks

D = dt.date


def test_csv_layouts_and_standard_names(spark, tmp_path):
    head = "Strike,Expiration,Call_Put,Bid,Ask,Vol,Delta\n"
    (tmp_path / "SPY").mkdir()
    (tmp_path / "SPY" / "2024-01-15.csv").write_text(head + "450,2024-03-15,Call,5.1,5.3,0.2,0.5\n450,2024-03-15,P,bad,5.0,nan,-0.5\n")
    (tmp_path / "QQQ_20240116.csv").write_text(head + "400,2024-03-15,c,4,4.2,0.25,0.4\n")
    df = src.standardize_chain(src.read_chain_csv(spark, str(tmp_path)))
    rows = {(r.symbol, r.quote_date, r.option_type): r for r in df.collect()}
    assert set(rows) == {("SPY", D(2024, 1, 15), "call"), ("SPY", D(2024, 1, 15), "put"), ("QQQ", D(2024, 1, 16), "call")}
    bad = rows[("SPY", D(2024, 1, 15), "put")]
    assert bad.bid is None and bad.vol is None and bad.strike == 450.0
    assert src.read_chain_csv(spark, str(tmp_path), "nested").count() == 2
    assert src.read_chain_csv(spark, str(tmp_path), "flat").count() == 1


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "strategy_id string, equity double")
    for fmt in ("parquet", "csv", "json"):
        sinks.write_results({"equity_curve": df}, f"{tmp_path}/{fmt}", fmt)
        back = sinks.read_results(spark, f"{tmp_path}/{fmt}", "equity_curve", fmt)
        assert {(r.strategy_id, float(r.equity)) for r in back.collect()} == {("a", 1.0), ("b", 2.0)}


def test_results_of_many_strategies_are_few_files(spark, tmp_path):
    df = spark.range(5000).selectExpr("concat('s', id % 700) AS strategy_id", "double(id) AS equity").repartition(5)
    sinks.write_results({"equity_curve": df}, str(tmp_path))
    files = list((tmp_path / "equity_curve").rglob("*.parquet"))
    assert len(files) <= 8 and sinks.read_results(spark, str(tmp_path), "equity_curve").exceptAll(df).count() == 0
    held = [spark.read.parquet(str(f)).select("strategy_id").distinct().count() for f in files]
    assert sum(held) == 700


def test_calendar_days_are_dealt_over_tasks(spark):
    """A span is a few bytes and grows to thousands of days: small spans must not end in one task."""
    spans = spark.range(0, 400, 1, 4).selectExpr("concat('L', id) AS symbol", "date'2020-01-01' AS d").groupBy("symbol").agg(F.min("d").alias("first_date"), (F.max("d") + F.expr("interval 400 days")).cast("date").alias("last_date"))
    days = cal.with_next_trading_day(cal.calendar_spans(spans, ["symbol"]), ["symbol"])
    tasks = {r.p for r in days.select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = [r for r in days.filter("symbol = 'L7'").orderBy("d").collect()]
    assert all(a.next_day == b.d for a, b in itertools.pairwise(one)) and one[-1].next_day is None


def test_catalogue_metadata(spark):
    df = spark.createDataFrame([("a", 1.0)], "symbol string, bid double")
    rows = src.describe_tables(spark, {"chain": df}).orderBy("position").collect()
    assert [(r.column_name, r.column_type) for r in rows] == [("symbol", "string"), ("bid", "double")]


def test_calendar_skips_weekends_and_holidays(spark):
    hol = spark.createDataFrame([(D(2024, 7, 5),)], "d date")
    days = [r.d for r in cal.trading_calendar(spark, "2024-07-03", "2024-07-09", hol).orderBy("d").collect()]
    assert days == [D(2024, 7, 3), D(2024, 7, 8), D(2024, 7, 9)]


def test_business_days_closed_form(spark):
    base = D(2023, 12, 28)
    rows = [(base + dt.timedelta(days=i), base + dt.timedelta(days=i + n)) for i in range(9) for n in range(0, 20)]
    df = spark.createDataFrame(rows, "a date, b date").select("a", "b", cal.business_days_between(F.col("a"), F.col("b")).alias("n"))
    for r in df.collect():
        assert r.n == np.busday_count(r.a, r.b)


def test_conditions_treat_unknown_as_false(spark):
    df = spark.createDataFrame([(None, 10.0), (30.0, None)], "vix double, iv_rank double")
    rows = df.select(c.vix_above(20).alias("a"), c.negate(F.col("vix") > 20).alias("n"), c.any_of(c.iv_rank_below(20), c.vix_above(99)).alias("o")).collect()
    assert [(r.a, r.n, r.o) for r in rows] == [(False, True, True), (True, False, False)]


def test_stale_prices_and_gaps(spark):
    rows = [("S", 50.0, D(2024, 3, 15), "call", D(2024, 1, i), p) for i, p in ((1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (9, 2.0), (10, None), (11, None), (12, None))]
    df = spark.createDataFrame(rows, "symbol string, strike double, expiration date, option_type string, quote_date date, mid double")
    assert [r.run_length for r in q.detect_stale_prices(df).orderBy("quote_date").collect()] == [3, 4]
    assert [r.quote_date for r in q.check_for_gaps(df, ["symbol"]).collect()] == [D(2024, 1, 4)]


def _chain(spark):
    e1, e2 = D(2024, 3, 15), D(2024, 3, 20)
    rows = [("S", D(2024, 1, 2), e1, 45.0, "call", 7.0, 7.2), ("S", D(2024, 1, 2), e1, 55.0, "call", 2.0, 2.2), ("S", D(2024, 1, 2), e2, 50.0, "call", 9.0, 9.2), ("S", D(2024, 1, 2), e1, 45.0, "put", 0.0, 1.0)]
    return spark.createDataFrame(rows, "symbol string, quote_date date, expiration date, strike double, option_type string, bid double, ask double")


def test_marks_use_every_fallback(spark):
    want = [(D(2024, 3, 15), 45.0, "call"), (D(2024, 3, 15), 48.0, "call"), (D(2024, 3, 15), 200.0, "call"), (D(2024, 3, 15), 45.0, "put")]
    df = spark.createDataFrame([("S", D(2024, 1, 2), o, e, k) for e, k, o in want], "symbol string, quote_date date, option_type string, expiration date, strike double")
    snaps = spark.createDataFrame([("S", D(2024, 1, 2), 50.0, 0.2)], "symbol string, d date, spot double, iv double")
    rows = {(r.strike, r.option_type): r for r in ch.mark_contracts(df, _chain(spark), snaps).collect()}
    assert rows[(45.0, "call")].mark == pytest.approx(7.1) and rows[(45.0, "call")].mark_source == "exact"
    assert rows[(45.0, "put")].mark == 1.0
    mixed = rows[(48.0, "call")]
    assert mixed.mark_source == "interpolated"
    near = (73 + 78) / 2
    assert mixed.mark == pytest.approx((7.1 + 0.6 * (9.1 - 7.1)) * (73 / near) ** 0.5)
    assert rows[(200.0, "call")].mark_source == "model" and rows[(200.0, "call")].mark == pytest.approx(0.01)


def test_fill_and_costs_by_hand(spark):
    legs = spark.createDataFrame([("p", 1, 1, 2, 4.0, 4.2, 4.1), ("p", 2, -1, 2, 1.0, 1.2, 1.1)], "position_id string, leg_no int, side int, quantity int, bid double, ask double, quote_mid double")
    row = ex.execute(legs, ["position_id"], "entry").collect()[0]
    assert row.total_premium == pytest.approx(-4.2 * 200 + 1.0 * 200) and row.commission == pytest.approx(2.6)
    assert row.total_cost == pytest.approx(640 + 2.6)
    double = ex.execute(legs, ["position_id"], "entry", slippage_pct=0.01).collect()[0]
    single = ex.execute(legs, ["position_id"], "entry", slippage_pct=0.01, slippage_mode="single").collect()[0]
    assert double.total_cost - single.total_cost == pytest.approx(double.slippage)
    unpriced = legs.withColumns({"bid": F.lit(None).cast("double"), "ask": F.lit(None).cast("double"), "quote_mid": F.lit(None).cast("double")})
    assert ex.execute(unpriced, ["position_id"], "entry").collect()[0].total_cost is None


def test_sources_by_priority(spark):
    a = spark.createDataFrame([("S", D(2024, 1, 2), 1)], "symbol string, quote_date date, x int")
    b = spark.createDataFrame([("S", D(2024, 1, 2), 2), ("S", D(2024, 1, 3), 3)], "symbol string, quote_date date, x int")
    got = src.coalesce_sources([("a", 1, a), ("b", 2, b)])
    assert sorted((r.x, r.source) for r in got.collect()) == [(1, "a"), (3, "b")]
    assert sorted(r.x for r in src.coalesce_sources([("a", 1, a), ("b", 2, b)], override="b").collect()) == [2, 3]


@pytest.mark.parametrize("layout", ["nested", "flat"])
def test_chain_trees_open_only_the_files_asked_for(spark, tmp_path, layout):
    from pyspark.sql import functions as F

    from voltable.sources import chain_csv as tree

    root = f"file://{tmp_path}/tree"
    rows = [(s, D(2024, 1, d), k / 3, "call", None if k == 2 else f"n{k}, \"x\"") for s in ("SPY", "QQQ") for d in (2, 3, 4) for k in (1, 2, 3)]
    chain = spark.createDataFrame(rows, "symbol string, quote_date date, strike double, option_type string, note string")
    written = tree.write_chain_tree(chain, root, layout).collect()
    assert {(r.symbol, r.quote_date, r["rows"]) for r in written} == {(s, D(2024, 1, d), 3) for s in ("SPY", "QQQ") for d in (2, 3, 4)}
    back = tree.read_chain_tree(spark, root, layout)
    assert back.columns == ["symbol", "quote_date", "strike", "option_type", "note"] and back.rdd.getNumPartitions() == 6
    assert sorted((r.symbol, r.quote_date, float(r.strike), r.option_type, r.note or "") for r in back.collect()) == sorted((*r[:4], r[4] or "") for r in rows)
    # files that are not asked for may be unreadable
    for path in (tmp_path / "tree").rglob("*.csv"):
        if "QQQ" in str(path) or "2024-01-04" in str(path) or "20240104" in str(path):
            path.write_bytes(b"a,b\n1\n\xff\n")
    some = back.filter((F.col("symbol") == "SPY") & (F.col("quote_date") < F.lit(D(2024, 1, 4))) & (F.col("strike") == "1.0"))
    assert {(r.symbol, r.quote_date, r.strike) for r in some.collect()} == {("SPY", D(2024, 1, d), "1.0") for d in (2, 3)}
    assert back.filter("symbol = 'none'").count() == 0
    fixed = tree.read_chain_tree(spark, root, layout, "symbol string, quote_date date, strike string, absent string").filter("symbol = 'SPY' AND quote_date = DATE'2024-01-02'")
    assert {(r.strike, r.absent) for r in fixed.collect()} == {("0.3333333333333333", None), ("0.6666666666666666", None), ("1.0", None)}


def test_ordered_output_keeps_places(spark, tmp_path):
    rows = spark.createDataFrame([((k * 37) % 101, k % 3) for k in range(500)], "x int, y int")
    sinks.write_ordered(rows, f"{tmp_path}/o", ["x", "y"], files=5)
    got = [(r.x, r.y) for r in sorted(sinks.read_ordered(spark, f"{tmp_path}/o").collect(), key=lambda r: r.position)]
    assert got == sorted(((k * 37) % 101, k % 3) for k in range(500))
    assert {r.position for r in sinks.read_ordered(spark, f"{tmp_path}/o").collect()} == set(range(1, 501))
