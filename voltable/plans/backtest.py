"""Strategy evaluation for many strategies, symbols and parameter sets in one job.

Path dependence is reduced to one fold. What a position does after entry depends on marks only, so
each candidate's exit is known without knowing which candidates are taken. Positions of different
strategies that are the same trade (symbol, day, structure, expiry, strikes) share one *instance*,
which is priced and marked once; a sweep over exit parameters adds no marking work.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.common import CONTRACT_MULTIPLIER
from ..functions.instrument import intrinsic, leg_pnl, market_value, round_strike
from ..functions.pricing import enrich_greeks
from ..operators.chain import CONTRACT, DAY, DEFAULT_IV, SERIES, array_quotes, listed_quotes, mark_contracts, mark_series, strike_key
from ..operators.joins import attach_by_key, attach_measured
from ..operators.kernels import implied_vol
from ..operators.risk import GREEKS, leg_margin, portfolio_greeks
from ..operators.series import running, sequence_number
from ..operators.structures import build_structures, net_premium_agg
from .execution import COMMISSION, execute
from .lineage import materialize
from .strategies import day_fields, entry_condition, position_size

INSTANCE = ["symbol", "entry_date", "structure_type", "expiration", "atm", "width", "wing"]
FAR = "9999-12-31"
GREEKS_RATE = 0.04
SALTS = 8
LISTED = ["symbol", "option_type", "expiration", "strike"]


def with_expiries(snapshots: DataFrame, chain: DataFrame) -> DataFrame:
    """The day's listed expirations as a sorted array (a bounded handful per symbol)."""
    ex = chain.groupBy("symbol", F.col("quote_date").alias("d")).agg(F.sort_array(F.collect_set("expiration")).alias("expiries"))
    return snapshots.join(ex, ["symbol", "d"])


def choose_expiration() -> Column:
    """The listed expiration nearest the target dte within the strategy's range."""
    ok = F.filter("expiries", lambda e: F.datediff(e, F.col("d")).between(F.col("min_dte"), F.col("max_dte")))
    ranked = F.transform(ok, lambda e: F.struct(F.abs(F.datediff(e, F.col("d")) - F.col("target_dte")).alias("gap"), e.alias("e")))
    return F.array_min(ranked)["e"]


def entry_signals(snapshots: DataFrame, strategies: DataFrame, custom: Column | None = None) -> DataFrame:
    """(strategy, symbol, day) rows whose entry condition holds and for which an expiration exists.

    `snapshots` carries `expiries`. A symbol's days are bounded by the calendar, its strategies are
    not, so the strategies are spread over salts.
    """
    # strategies and days are few in bytes, their pairs are many: both sides are dealt over a fixed number of tasks
    on, tasks = ["symbol", "_salt"], _tasks(strategies)
    left = strategies.withColumn("_salt", F.pmod(F.xxhash64("strategy_id"), F.lit(SALTS)).cast("int")).repartition(tasks, *on)
    right = snapshots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(tasks, *on)
    both = left.join(right.hint("merge"), on).drop("_salt")
    both = both.withColumn("expiration", choose_expiration()).withColumn("dte", F.datediff("expiration", "d"))
    return both.filter(F.col("expiration").isNotNull()).withColumn("_fields", day_fields()).filter(entry_condition(custom=custom)).drop("_fields", "expiries")


def with_instances(signals: DataFrame) -> DataFrame:
    """Name the trade each signal stands for."""
    from ..operators.structures import default_width

    named = signals.withColumnRenamed("d", "entry_date").withColumn("atm", round_strike("spot"))
    # as in `build_structures`: a given width is kept, a missing one is the structure's share, a missing wing half the width
    named = named.withColumn("width", F.coalesce(F.col("width"), default_width())).withColumn("wing", F.coalesce(F.col("wing"), F.col("width") * 0.5))
    return named.withColumn("instance_id", F.concat_ws("_", "symbol", F.date_format("entry_date", "yyyyMMdd"), "structure_type",
                                                       F.date_format("expiration", "yyyyMMdd"), F.format_string("%.2f_%.4f_%.4f", "atm", "width", "wing")))


def instance_legs(signals: DataFrame, chain: DataFrame) -> DataFrame:
    """J06 on distinct instances: one-contract legs with entry quotes; instances with an unquoted leg drop out.

    Instances are shuffled once, to their day and expiration, and become legs where the quotes of that day and expiration lie as
    one array; whether a leg is unquoted is known there as well.
    """
    on = ["symbol", "entry_date", "expiration"]
    inst = signals.select("instance_id", *INSTANCE, "spot").repartition(_tasks(signals), *on).distinct().withColumn("quantity", F.lit(1))
    legs = array_quotes(build_structures(inst.join(listed_quotes(chain, "entry_date").hint("merge"), on, "left"))).withColumn("entry_price", F.col("quote_mid"))
    bad = F.max(F.when(F.coalesce(F.col("entry_price"), F.lit(0.0)) <= 0, 1).otherwise(0)).over(W.partitionBy(*on, "instance_id"))
    return legs.withColumn("_bad", bad).filter("_bad = 0").drop("_bad")


def _tasks(df: DataFrame) -> int:
    """An explicit partition count keeps AQE from merging rows that are small in bytes but many, or become many."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def contract_days(legs: DataFrame, snapshots: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Once per contract, `_days`: the days on which some leg can hold it, with `columns` of the day by new names. They are the
    symbol's days from the first entry to expiration.

    A contract travels with the array of its days, bounded by the calendar, and becomes contract-days where all its days lie
    (by `SERIES`): groups and windows by contract over them shuffle them no more.
    """
    days = snapshots.groupBy("symbol").agg(F.collect_list(F.struct(F.col("d").alias("quote_date"), *[F.col(c).alias(n) for c, n in columns.items()])).alias("_days"))
    wanted = F.filter("_days", lambda x: (x["quote_date"] >= F.col("_first")) & (x["quote_date"] <= F.col("expiration")))
    first = legs.groupBy(*LISTED).agg(F.min("entry_date").alias("_first"))
    own = attach_by_key(first, days, ["symbol"], F.struct(*LISTED), SALTS).select(*LISTED, strike_key().alias("_strike"), wanted.alias("_days"))
    return own.repartition(_tasks(legs), *SERIES)


def held_days(legs: DataFrame, daily: DataFrame, columns: list[str], held: Callable[[Column], Column]) -> DataFrame:
    """Leg-days with `columns` of their contract-day in `daily`, for the days `d` of which `held` is true.

    `daily` lies by `SERIES` as `contract_days` deals it. A contract's days travel as one array, bounded by the calendar: legs are
    shuffled to their contracts and then with an array each to their instance, and become leg-days where all later groups of an
    instance already lie together.
    """
    tasks = _tasks(legs)
    series = daily.groupBy(*SERIES).agg(F.collect_list(F.struct("strike", F.col("quote_date").alias("d"), *columns)).alias("_series"))
    mine = F.filter("_series", lambda x: (x["strike"] == F.col("strike")) & held(x))
    # arrays are larger than Spark's estimate of them, so the side that holds them must not be broadcast
    own = legs.withColumn("_strike", strike_key()).repartition(tasks, *SERIES).join(series.hint("merge"), SERIES)
    own = own.withColumn("_series", F.transform(mine, lambda x: F.struct(*[x[c].alias(c) for c in ("d", *columns)]))).repartition(tasks, "instance_id")
    return own.select(*legs.columns, F.inline("_series")).withColumnRenamed("d", "quote_date")


def contract_greeks(each: DataFrame, rate=GREEKS_RATE) -> DataFrame:
    """Greeks of contract-days at the day's `_spot` and at-the-money volatility `_iv`; with `mark` at the volatility that the
    contract's own mark implies, where it implies one."""
    each = each.withColumns({"_years": F.datediff("expiration", "quote_date") / 365.0, "_sigma": F.when(F.col("_iv") > 0, F.col("_iv")).otherwise(F.lit(DEFAULT_IV))})
    if "mark" in each.columns:
        each = implied_vol(each, "mark", "_spot", "strike", "_years", rate, out="_own").withColumn("_sigma", F.coalesce("_own", "_sigma"))
    keep = [*CONTRACT, "strike", *[c for c in ("_strike",) if c in each.columns]]
    return enrich_greeks(each, "_spot", "strike", "_years", rate, "_sigma").select(*keep, *GREEKS)


def entry_greeks(legs: DataFrame, snapshots: DataFrame, rate=GREEKS_RATE, chain: DataFrame | None = None) -> DataFrame:
    """Net Greeks of one contract of each instance on its entry day: what sizes by delta need."""
    held = legs.filter("entry_date < expiration").select("instance_id", *LISTED, "side", "quantity", F.col("entry_date").alias("quote_date"))
    each = held.select(*CONTRACT, "strike").distinct()
    if chain is not None:
        each = mark_contracts(each, chain, snapshots).drop("mark_source")
    day = snapshots.select("symbol", F.col("d").alias("quote_date"), F.col("spot").alias("_spot"), F.col("iv").alias("_iv"))
    priced = contract_greeks(each.join(day, DAY), rate)
    return portfolio_greeks(held.join(priced, [*CONTRACT, "strike"]), ["instance_id"])


def instance_greeks(legs: DataFrame, snapshots: DataFrame, rate=GREEKS_RATE, chain: DataFrame | None = None) -> DataFrame:
    """`greeks`, per instance the net Greeks of one contract on each day from entry to the day before expiration, or before
    a leg's `until` where there is one.

    They are computed once per distinct contract-day (`contract_greeks`), however many instances hold it.
    """
    own = contract_days(legs, snapshots, {"spot": "_spot", "iv": "_iv"})
    each = own.select(*SERIES, "strike", F.inline("_days")) if chain is None else mark_series(own, chain).drop("mark_source")
    priced = contract_greeks(each.filter("quote_date < expiration"), rate)
    if chain is not None:  # solving for volatility leaves no trace of where rows lie
        priced = priced.repartition(_tasks(legs), *SERIES)
    legs = legs if "until" in legs.columns else legs.withColumn("until", F.col("expiration"))
    held = held_days(legs.select("instance_id", *LISTED, "side", "quantity", "entry_date", "until"), priced, GREEKS, lambda x: (x["d"] >= F.col("entry_date")) & (x["d"] < F.col("until")))
    per = portfolio_greeks(held, ["instance_id", "quote_date"])
    step = F.struct(F.col("quote_date").alias("d"), *GREEKS)
    return per.groupBy("instance_id").agg(F.array_sort(F.collect_list(step)).alias("greeks"))


def daily_paths(legs: DataFrame, chain: DataFrame, snapshots: DataFrame, settle="intrinsic") -> DataFrame:
    """K13 on instances: (instance, day) with value and P&L per contract, and the day's regime.

    A contract is marked once per day, whatever holds it; a day without a mark keeps the last one, if it is of a day after
    the leg's entry (`_since`).
    """
    marks = mark_series(contract_days(legs, snapshots, {"spot": "_spot", "iv": "_iv", "regime": "regime"}), chain)
    if settle == "intrinsic":
        done = (F.col("quote_date") >= F.col("expiration")) & F.col("_spot").isNotNull()
        marks = marks.withColumn("mark", F.when(done, intrinsic("_spot", "strike", "option_type")).otherwise(F.col("mark")))
    life = W.partitionBy(*SERIES, "strike").orderBy("quote_date").rowsBetween(W.unboundedPreceding, 0)  # at most the days to expiration
    known = F.last(F.when(F.col("mark").isNotNull(), F.struct("mark", F.col("quote_date").alias("d"))), ignorenulls=True).over(life)
    marks = marks.withColumn("_known", known).select(*SERIES, "strike", "quote_date", F.col("_known.mark").alias("_mark"), F.col("_known.d").alias("_since"), "regime")
    held = held_days(legs.select("instance_id", *LISTED, "side", "quantity", "entry_date", "entry_price"), marks, ["_mark", "_since", "regime"], lambda x: x["d"] > F.col("entry_date"))
    held = held.withColumn("mark", F.when(F.col("_since") > F.col("entry_date"), F.col("_mark")))
    per = held.groupBy("instance_id", "quote_date", "expiration").agg(
        F.sum(leg_pnl("mark", "entry_price", "side", "quantity")).alias("pnl"), F.sum(market_value("mark", "side", "quantity")).alias("value"),
        F.max("regime").alias("regime"), F.count("mark").alias("_n"), F.count(F.lit(1)).alias("_legs"))
    return per.filter("_n = _legs").select(
        "instance_id", F.col("quote_date").alias("d"), "pnl", "value", F.datediff("expiration", "quote_date").alias("dte"), "regime")


def path_arrays(paths: DataFrame) -> DataFrame:
    """Each instance's days as one ordered array with the running peak, bounded by the days to expiration."""
    life = W.partitionBy("instance_id").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    step = F.struct("d", "pnl", "value", "dte", "regime", "peak")
    return paths.withColumn("peak", F.max("pnl").over(life)).groupBy("instance_id").agg(F.array_sort(F.collect_list(step)).alias("path"))


def instance_facts(legs: DataFrame, greeks: DataFrame) -> DataFrame:
    """Premium, margin, risk and entry delta (`entry_greeks`) of one contract of each instance."""
    priced = legs.withColumn("spot_at_entry", F.col("spot"))
    f = priced.groupBy("instance_id").agg(
        net_premium_agg().alias("net_premium"), F.sum(leg_margin()).alias("_m"), F.count(F.lit(1)).alias("num_legs"), F.max("width").alias("_w"), F.max("wing").alias("_g"),
        F.max("structure_type").alias("_s"))
    c, inf = F.col("net_premium"), F.lit(None).cast("double")
    wing = F.when(F.col("_s") == "iron_condor", F.col("_g")).when(F.col("_s") == "iron_butterfly", F.col("_w")).when(F.col("_s").endswith("spread"), F.col("_w"))
    max_loss = F.when(wing.isNotNull() & (c > 0), wing * CONTRACT_MULTIPLIER - c).when(c <= 0, -c)
    margin = F.when(c > 0, F.greatest(F.col("_m") - c, c)).otherwise(F.col("_m"))
    f = f.join(greeks.select("instance_id", F.col("delta").alias("delta_per_contract")), "instance_id", "left")
    return f.select("instance_id", "net_premium", "num_legs", "delta_per_contract", F.coalesce(max_loss, inf).alias("max_loss_per_contract"),
                    F.greatest(margin, F.lit(0.0)).alias("margin_per_contract"), F.abs(c).alias("premium_per_contract"))


def exit_reason(day: Column, custom: Column | None = None) -> Column:
    """Why a position would close on one day of its path, or NULL. Order: expiry, profit, loss, dollars, trail, age, regime, `custom`."""
    base = F.when(F.col("exit_base") == "premium", F.abs("net_premium")).when(F.col("net_premium") > 0, F.col("net_premium"))
    ratio = day["pnl"] / F.when(base > 0, base)
    against = (F.col("structure_type").startswith("long") & (day["regime"] == "HIGH")) | (F.col("structure_type").startswith("short") & (day["regime"] == "LOW"))
    given_back = (day["peak"] - day["pnl"]) / F.when(day["peak"] > 0, day["peak"])
    reason = (
        F.when(day["dte"] <= F.coalesce(F.col("exit_dte"), F.lit(0)), F.lit("expiration"))
        .when(ratio >= F.col("profit_target"), F.lit("profit_target")).when(ratio <= -F.col("loss_limit"), F.lit("stop_loss"))
        .when(day["pnl"] * F.col("quantity") <= -F.col("stop_dollars"), F.lit("dollar_stop")).when(given_back >= F.col("trailing_stop"), F.lit("trailing_stop"))
        .when(F.datediff(day["d"], F.col("entry_date")) >= F.col("max_holding_days"), F.lit("holding_period"))
        .when(F.col("regime_exit") & against, F.lit("regime_change"))
    )
    return reason if custom is None else reason.when(F.coalesce(custom, F.lit(False)), F.lit("custom"))


def first_exit(signals: DataFrame, paths: DataFrame, facts: DataFrame, custom: Callable[[Column], Column] | Column | None = None) -> DataFrame:
    """Each candidate's size, first exit day and reason (NULL while open).

    An instance's path is one array bounded by the days to expiration; a candidate scans its own array instead of being
    joined to every later day. A path's running peak does not depend on the candidate and is part of the path.

    `custom` (X01) is an exit rule of the user's own over a candidate's columns and one day of its path (`d`, `pnl`, `value`,
    `peak` per contract, `dte`, `regime`): a function from the day to a boolean Column is evaluated inside the array; a
    boolean Column over `day`, for instance a vectorised pandas UDF of `day.pnl`, is evaluated on exploded (candidate, day)
    rows. Both close a position on the first day the rule holds.
    """
    return scan_exits(signals, facts.join(path_arrays(paths), "instance_id", "left"), custom)


def scan_exits(signals: DataFrame, instances: DataFrame, custom: Callable[[Column], Column] | Column | None = None) -> DataFrame:
    """`first_exit` from one table of instances: their facts and their `path`."""
    measured = signals.groupBy("instance_id").agg(F.count(F.lit(1)).alias("_rows"))

    def with_paths(candidates):
        return attach_measured(candidates, instances, ["instance_id"], F.col("strategy_id"), SALTS, measured=measured).withColumn("quantity", position_size())

    known = with_paths(signals)
    if isinstance(custom, Column):
        # the days the rule found come to the signals, which carry no paths yet
        rows = known.select("*", F.explode("path").alias("day")).filter(custom).groupBy("strategy_id", "instance_id").agg(F.min("day.d").alias("_custom"))
        known = with_paths(signals.join(rows, ["strategy_id", "instance_id"], "left"))
        met = lambda x: x["d"] == F.col("_custom")
    else:
        met = custom or (lambda x: None)
    reason = lambda x: exit_reason(x, met(x))
    out = known.withColumn("_hit", F.try_element_at(F.filter("path", lambda x: reason(x).isNotNull()), F.lit(1))).withColumns({
        "exit_date": F.col("_hit.d"), "exit_pnl": F.col("_hit.pnl"), "exit_reason": F.when(F.col("_hit").isNotNull(), reason(F.col("_hit")))})
    return out.drop("_hit", "_custom")


def acceptance_segments(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """`_segment` per key and entry date: a new one begins on each day on which no earlier candidate can still be open.

    On such a day an account is empty whatever was accepted before, so its segments are independent. One row per key and
    day goes through the window, which is bounded by the calendar; it carries the latest exit seen so far.
    """
    days = candidates.groupBy(*keys, "entry_date").agg(F.max("_leaves").alias("_last"))
    w = W.partitionBy(*keys).orderBy("entry_date")
    seen = F.max("_last").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(seen.isNull() | (seen <= F.col("entry_date")), 1).otherwise(0)
    return days.withColumn("_fresh", fresh).select(*keys, "entry_date", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_segment"))


def accept_entries(candidates: DataFrame, keys: list[str], per_symbol: int | None = None, size: str | None = None, max_single=0.20, max_utilization=0.80) -> DataFrame:
    """Greedy acceptance in (entry_date, symbol, position_id) order under the key's `max_positions`.

    A position that exits on a later day's date frees its slot that day before new ones are looked at; one opened today
    holds its slot for the rest of the day, also if it exits today. With `per_symbol` a symbol holds at most so many open
    positions. With `size` (a margin column) a single position may use at most `max_single` of `capital` and all open ones
    `max_utilization`.

    What is accepted depends on what was accepted before, but never across a day on which no earlier candidate can still be
    open (`acceptance_segments`). Each segment of an account is a group of its own, whose candidates are read in order, once,
    with the open positions as the only state: their number is bounded by `max_positions`, whatever the number of candidates.
    """
    rows = candidates.withColumns({"_leaves": F.coalesce(F.col("exit_date"), F.lit(FAR).cast("date")), "_need": F.col(size).cast("double") if size else F.lit(0.0)})
    rows = rows.join(acceptance_segments(rows, keys), [*keys, "entry_date"])
    group = [*keys, "_segment"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, "entry_date", "symbol", "position_id")
    read = [*group, "symbol", "entry_date", "_leaves", "_need", "max_positions", *(["capital"] if size else [])]

    def fold(batches):
        account, held = object(), []
        for b in batches:
            taken = []
            for i, row in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in read))):
                own, (symbol, entry, leaves, wants, most) = row[: len(group)], row[len(group): len(group) + 5]
                if own != account:
                    account, held = own, []
                held = [h for h in held if h[0] > entry or h[1] == entry]
                ok = len(held) < most and (per_symbol is None or sum(h[2] == symbol for h in held) < per_symbol)
                if ok and size is not None:
                    capital = float(row[-1])
                    ok = wants is not None and wants <= capital * max_single and sum(h[3] for h in held) + wants <= capital * max_utilization
                if ok:
                    held.append((leaves, entry, symbol, wants))
                    taken.append(i)
            yield b.take(pa.array(taken, pa.int64())).select(names)

    names = candidates.columns
    return rows.mapInArrow(fold, candidates.schema)


def exit_fills(accepted: DataFrame, legs: DataFrame, chain: DataFrame, commission, slippage_pct, slippage_mode) -> DataFrame:
    """K09 on distinct (instance, exit day): proceeds of closing one contract."""
    closes = accepted.filter(F.col("exit_date").isNotNull()).select("instance_id", "exit_date").distinct()
    wanted = legs.drop("bid", "ask", "quote_mid").join(closes, "instance_id")
    quoted = array_quotes(wanted.join(listed_quotes(chain, "exit_date").hint("merge"), ["symbol", "exit_date", "expiration"], "left"))
    return execute(quoted, ["instance_id", "exit_date"], "exit", commission, slippage_pct, slippage_mode, entry="entry_price")


def prepare_signals(strategies: DataFrame, chain: DataFrame, snapshots: DataFrame, custom: Column | None = None) -> DataFrame:
    """K01 with named instances, written once."""
    strategies = materialize(strategies, "strategies")
    return materialize(with_instances(entry_signals(with_expiries(snapshots, chain), strategies, custom)).drop("conditions", "combine"), "signals")


def prepare_instances(signals: DataFrame, chain: DataFrame, snapshots: DataFrame, rate=GREEKS_RATE, quoted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Legs, and per instance its facts and `path`, each written once: all that exits depend on."""
    legs = materialize(instance_legs(signals, chain), "legs")
    facts = instance_facts(legs, entry_greeks(legs, snapshots, rate, quoted))
    return legs, materialize(facts.join(path_arrays(daily_paths(legs, chain, snapshots)), "instance_id", "left"), "instances")


def prepare(strategies: DataFrame, chain: DataFrame, snapshots: DataFrame, custom: Column | None = None, rate=GREEKS_RATE, quoted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals, legs and instances: what a run knows before it accepts positions."""
    signals = prepare_signals(strategies, chain, snapshots, custom)
    return signals, *prepare_instances(signals, chain, snapshots, rate, quoted)


def run_backtest(strategies: DataFrame, chain: DataFrame, snapshots: DataFrame, commission=COMMISSION, slippage_pct=0.0, slippage_mode="double",
                 custom: Column | None = None, per_symbol: int | None = None, limit_margin=False, custom_exit: Callable[[Column], Column] | Column | None = None,
                 rate=GREEKS_RATE, greeks_from="day", prepared: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Signals, positions, daily marks, trade log, equity curve and Greeks history of every strategy.

    `custom` and `custom_exit` are entry and exit rules of the user's own; Greeks take the day's volatility (`greeks_from='day'`)
    or the one each contract's mark implies ('mark'). `prepared` is what `prepare` made of the same strategies. Signals, instance legs, instances, candidates, accepted ones and positions each feed several later stages, so each is written
    once and read back; everything downstream is a lazy DataFrame over those tables.
    """
    quoted = chain if greeks_from == "mark" else None
    signals, legs, instances = prepared or prepare(strategies, chain, snapshots, custom, rate, quoted)
    cand = scan_exits(signals, instances, custom_exit).withColumns({"position_id": F.concat_ws("|", "strategy_id", "instance_id"), "margin": F.col("margin_per_contract") * F.col("quantity")})
    cand = materialize(cand.select(
        "strategy_id", "position_id", "instance_id", "symbol", "structure_type", "expiration", "entry_date", "exit_date", "exit_reason", "exit_pnl", "quantity", "num_legs",
        "capital", "net_premium", "margin", "max_positions"), "candidates")
    taken = materialize(accept_entries(cand, ["strategy_id"], per_symbol, "margin" if limit_margin else None), "taken")
    # Greeks only of instances that somebody holds, and of days on which somebody does
    until = taken.groupBy("instance_id").agg(F.max(F.coalesce("exit_date", F.lit(FAR).cast("date"))).alias("until"))
    legs = legs.join(until, "instance_id")
    greeks = instance_greeks(legs, snapshots, rate, quoted)
    opened = execute(legs, ["instance_id"], "entry", commission, slippage_pct, slippage_mode, entry="entry_price").select(
        "instance_id", F.col("total_cost").alias("_cost"), F.col("commission").alias("_c0"), F.col("slippage").alias("_s0"))
    closed = exit_fills(taken, legs, chain, commission, slippage_pct, slippage_mode).select(
        "instance_id", "exit_date", F.col("total_proceeds").alias("_proceeds"), F.col("commission").alias("_c1"), F.col("slippage").alias("_s1"))
    q = F.col("quantity")
    paths = instances.select("instance_id", "path")
    # arrays join last, by instance: nothing that carries them is shuffled again
    pos = taken.join(closed, ["instance_id", "exit_date"], "left").join(opened.join(greeks, "instance_id", "left").join(paths, "instance_id", "left"), "instance_id")
    positions = pos.select(
        "strategy_id", "position_id", "instance_id", "symbol", "structure_type", "expiration", "entry_date", "exit_date", "exit_reason", "quantity", "num_legs", "capital",
        (F.col("net_premium") * q).alias("net_premium"), "margin", (F.col("_cost") * q).alias("total_cost"), (F.col("_proceeds") * q).alias("total_proceeds"),
        (F.col("_c0") * q).alias("entry_commission"), (F.col("_c1") * q).alias("exit_commission"), (F.col("_s0") * q).alias("entry_slippage"),
        (F.col("_s1") * q).alias("exit_slippage"), (F.col("exit_pnl") * q).alias("realized_pnl"), ((F.col("_proceeds") - F.col("_cost")) * q).alias("realized_pnl_fill"),
        F.datediff("exit_date", "entry_date").alias("hold_days"), *[F.filter(x, _before_exit).alias(x) for x in ("path", "greeks")])
    positions = materialize(positions, "positions")
    marks = mark_positions(positions)
    curve = equity_curve(positions, marks, strategies, snapshots)
    return {"signals": signals, "positions": positions.drop("path", "greeks"), "marks": marks, "trade_log": trade_log(positions),
            "equity_curve": curve, "greeks_history": curve.select("strategy_id", "d", *GREEKS)}


def _before_exit(x: Column) -> Column:
    return F.col("exit_date").isNull() | (x["d"] < F.col("exit_date"))


def mark_positions(positions: DataFrame) -> DataFrame:
    """One row per open position and day before its exit."""
    live = F.filter("path", _before_exit)
    days = positions.select("strategy_id", "position_id", "symbol", "quantity", F.explode(live).alias("_p"))
    return days.select("strategy_id", "position_id", "symbol", F.col("_p.d").alias("d"), (F.col("_p.value") * F.col("quantity")).alias("value"),
                       (F.col("_p.pnl") * F.col("quantity")).alias("pnl"), F.col("_p.dte").alias("dte"))


def trade_log(positions: DataFrame) -> DataFrame:
    """Open and close rows with consecutive ids per strategy (closes before opens within a day)."""
    base = [F.col("strategy_id"), F.col("position_id").alias("structure_id"), F.col("structure_type"), F.col("symbol").alias("underlying")]
    none = F.lit(None).cast("double")
    opens = positions.select(*base, F.lit("open").alias("action"), F.col("entry_date").alias("d"), "num_legs", "net_premium", "total_cost", none.alias("total_proceeds"),
                             F.col("entry_commission").alias("commission"), F.col("entry_slippage").alias("slippage"), none.alias("realized_pnl"), F.lit(None).cast("string").alias("exit_reason"))
    closes = positions.filter(F.col("exit_date").isNotNull()).select(
        *base, F.lit("close").alias("action"), F.col("exit_date").alias("d"), "num_legs", "net_premium", none.alias("total_cost"), "total_proceeds",
        F.col("exit_commission").alias("commission"), F.col("exit_slippage").alias("slippage"), "realized_pnl", "exit_reason")
    both = sequence_number(opens.unionByName(closes), ["strategy_id"], "d", ["action", "structure_id"], "_n")
    return both.withColumn("trade_id", F.concat(F.lit("T"), F.lpad(F.col("_n").cast("string"), 6, "0"))).drop("_n")


def equity_curve(positions: DataFrame, marks: DataFrame, strategies: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Cash, value of open positions, equity, P&L and net Greeks of the open positions per strategy and trading day.

    A strategy's days are those of its symbol, so the running sums are bounded by the calendar.
    A position is worth its mark, on the entry day its entry premium.
    """
    days = snapshots.groupBy("symbol").agg(F.sort_array(F.collect_set("d")).alias("_days"))
    # strategies are few in bytes, their days many: AQE would write all of them in one task
    own = strategies.select("strategy_id", "symbol", "capital").repartition(_tasks(positions), "strategy_id")
    grid = attach_by_key(own, days, ["symbol"], F.col("strategy_id"), SALTS).select(
        "strategy_id", "capital", F.explode("_days").alias("d"))
    opens = positions.select("strategy_id", F.col("entry_date").alias("d"), (-F.col("total_cost")).alias("flow"), (-F.col("net_premium")).alias("value"), F.lit(1).alias("open"))
    leave = positions.filter(F.col("exit_date").isNotNull()).select("strategy_id", F.col("exit_date").alias("d"), F.col("total_proceeds").alias("flow"), F.col("realized_pnl").alias("realized"))
    held = marks.select("strategy_id", "d", "value", F.col("pnl").alias("unreal"), F.lit(1).alias("open"))
    live = F.filter("greeks", _before_exit)
    exposed = positions.select("strategy_id", "quantity", F.explode(live).alias("_g")).select("strategy_id", F.col("_g.d").alias("d"), *[(F.col(f"_g.{g}") * F.col("quantity")).alias(g) for g in GREEKS])
    parts = opens.unionByName(leave, allowMissingColumns=True).unionByName(held, allowMissingColumns=True).unionByName(exposed, allowMissingColumns=True)
    sums = ["flow", "realized", "value", "unreal", "open", *GREEKS]
    per = parts.groupBy("strategy_id", "d").agg(*[F.sum(x).alias(f"_{x}") for x in sums])
    both = grid.join(per, ["strategy_id", "d"], "left").na.fill(0, [f"_{x}" for x in sums])
    w = running(["strategy_id"])
    return both.select("strategy_id", "d", (F.col("capital") + F.sum("_flow").over(w)).alias("cash"), F.col("_value").alias("positions_value"),
                       (F.col("capital") + F.sum("_flow").over(w) + F.col("_value")).alias("equity"), F.col("_open").cast("bigint").alias("num_positions"),
                       F.sum("_realized").over(w).alias("realized_pnl"), F.col("_unreal").alias("unrealized_pnl"), *[F.col(f"_{g}").alias(g) for g in GREEKS])


def close_records(positions: DataFrame) -> DataFrame:
    """K16."""
    p = F.abs("net_premium")
    return positions.filter(F.col("exit_date").isNotNull()).select(
        "strategy_id", "position_id", "structure_type", "symbol", "entry_date", "exit_date", "exit_reason", "net_premium", "realized_pnl",
        F.when(p > 0, F.col("realized_pnl") / p).otherwise(F.lit(0.0)).alias("return_pct"), F.datediff("exit_date", "entry_date").alias("hold_days"))


def position_summary(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and premium by strategy, underlying or structure."""
    open_ = F.col("exit_date").isNull()
    return positions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("positions"), F.count_if(open_).alias("open_positions"), F.sum("net_premium").alias("net_premium"),
        F.sum(F.when(open_, F.col("margin"))).alias("open_margin"), F.sum("realized_pnl").alias("realized_pnl"), F.sum("quantity").alias("contracts"))


def pnl_summary(curve: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Unrealized, realized and total P&L, return and utilisation per strategy and day."""
    total = F.col("realized_pnl") + F.col("unrealized_pnl")
    return curve.select("strategy_id", "d", "realized_pnl", "unrealized_pnl", total.alias("total_pnl"), (total / capital).alias("return_frac"), "equity",
                        F.when(F.col("equity") > 0, F.abs("positions_value") / F.col("equity")).alias("utilization"))


def lifecycle(positions: DataFrame, as_of) -> DataFrame:
    """State of each position on a date and whether its id occurs more than once."""
    day = F.lit(as_of).cast("date")
    state = F.when(F.col("exit_date") <= day, F.lit("closed")).when(F.col("entry_date") == day, F.lit("open")).when(F.col("entry_date") < day, F.lit("active")).otherwise(F.lit("pending"))
    copies = positions.groupBy("position_id").agg(F.count(F.lit(1)).alias("_n"))
    return positions.withColumn("state", state).join(copies, "position_id").select("strategy_id", "position_id", "state", (F.col("_n") > 1).alias("is_duplicate"))


def run_totals(result: dict[str, DataFrame]) -> DataFrame:
    """Counts and final equity per strategy."""
    last = result["equity_curve"].groupBy("strategy_id").agg(F.max_by("equity", "d").alias("final_equity"), F.max_by("realized_pnl", "d").alias("realized_pnl"))
    n = result["positions"].groupBy("strategy_id").agg(F.count(F.lit(1)).alias("trades_opened"), F.count("exit_date").alias("trades_closed"))
    return last.join(n, "strategy_id", "left").na.fill(0, ["trades_opened", "trades_closed"])


def portfolio_timeline(curve: DataFrame, marks: DataFrame) -> DataFrame:
    """Each equity row with the list of open positions (bounded by the strategy's slots)."""
    open_ = marks.groupBy("strategy_id", "d").agg(F.array_sort(F.collect_list(F.struct("position_id", "value", "pnl", "dte"))).alias("open_positions"))
    return curve.join(open_, ["strategy_id", "d"], "left")

