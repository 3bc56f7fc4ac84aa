"""Chain filters, contract look-ups, marking, spot and at-the-money volatility.

Everything here groups by (symbol, day) or finer. A hot symbol therefore spreads over its days, and
a single group is bounded by the contracts listed that day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.instrument import intrinsic
from ..functions.pricing import price_chain

DAY = ["symbol", "quote_date"]
CONTRACT = ["symbol", "quote_date", "option_type", "expiration"]
#: A contract over its days, by the strike's key (`strike_key`).
SERIES = ["symbol", "option_type", "expiration", "_strike"]
DEFAULT_IV = 0.20
MARK_RATE = 0.05
MIN_MARK = 0.01
DTE_BAND = 7


def mid_price(bid="bid", ask="ask") -> Column:
    """Mid of a two-sided quote, else the side that exists."""
    b, a = F.coalesce(F.col(bid), F.lit(0.0)), F.coalesce(F.col(ask), F.lit(0.0))
    return F.when((a > 0) & (b > 0), (a + b) / 2.0).when(a > 0, a).otherwise(b)


def with_chain_columns(df: DataFrame, spot: str | None = "spot") -> DataFrame:
    """Mid, spread, spread_pct, dte, and with a spot also moneyness and log-moneyness."""
    mid = (F.col("bid") + F.col("ask")) / 2.0
    cols = {
        "mid": mid, "spread": F.col("ask") - F.col("bid"),
        "spread_pct": F.when(mid > 0, (F.col("ask") - F.col("bid")) / mid).otherwise(F.lit(0.0)),
        "dte": F.datediff("expiration", "quote_date"),
    }
    if spot and spot in df.columns:
        cols["moneyness"] = F.when(F.col(spot) > 0, F.col("strike") / F.col(spot))
        cols["log_moneyness"] = F.when((F.col(spot) > 0) & (F.col("strike") > 0), F.log(F.col("strike") / F.col(spot)))
    return df.withColumns(cols)


def filter_bad_quotes(df: DataFrame, min_bid=0.01, min_open_interest=0, min_volume=0, max_iv=5.0, min_iv=0.01,
                      remove_inverted=True, max_spread_pct=None) -> DataFrame:
    """One pushed-down filter; a NULL volatility is kept."""
    return df.filter(~_any(quote_rules(df, min_bid, min_open_interest, min_volume, max_iv, min_iv, remove_inverted, max_spread_pct)))


def _any(rules: dict[str, Column]) -> Column:
    out = F.lit(False)
    for cond in rules.values():
        out = out | F.coalesce(cond, F.lit(True))
    return out


def quote_rules(df, min_bid=0.01, min_open_interest=0, min_volume=0, max_iv=5.0, min_iv=0.01, remove_inverted=True,
                max_spread_pct=None) -> dict[str, Column]:
    """Rejection predicates of B02; NULL (an unknown quote) rejects as well."""
    mid = (F.col("bid") + F.col("ask")) / 2.0
    rules = {"low_bid": F.col("bid") < min_bid}
    if remove_inverted:
        rules["inverted"] = F.col("bid") > F.col("ask")
    if max_spread_pct is not None:
        rules["wide_spread"] = F.when(mid > 0, (F.col("ask") - F.col("bid")) / mid > max_spread_pct).otherwise(F.lit(True))
    if "vol" in df.columns:
        rules["iv_range"] = F.coalesce((F.col("vol") < min_iv) | (F.col("vol") > max_iv), F.lit(False))
    if min_open_interest > 0 and "open_interest" in df.columns:
        rules["low_open_interest"] = F.col("open_interest") < min_open_interest
    if min_volume > 0 and "volume" in df.columns:
        rules["low_volume"] = F.col("volume") < min_volume
    return rules


def load_option_chain(df: DataFrame, dte_range=(7, 60), min_volume=None, min_open_interest=None, iv_range=None,
                      moneyness_range=None) -> DataFrame:
    """Chain rows by dte, volume, open interest, IV and strike/spot; spot by D02 where absent."""
    out = df.withColumn("dte", F.datediff("expiration", "quote_date")).filter(F.col("dte").between(*dte_range))
    if min_volume is not None and "volume" in df.columns:
        out = out.filter(F.col("volume") >= min_volume)
    if min_open_interest is not None and "open_interest" in df.columns:
        out = out.filter(F.col("open_interest") >= min_open_interest)
    if iv_range is not None:
        out = out.filter(F.col("vol").between(*iv_range))
    if moneyness_range is not None:
        if "spot" not in out.columns:
            out = out.join(spot_put_call(out).withColumnRenamed("spot_put_call", "spot"), DAY)
        out = out.filter((F.col("strike") / F.col("spot")).between(*moneyness_range))
    return out


# ---- look-ups and marks ------------------------------------------------------------------------

def strike_key(strike="strike") -> Column:
    """Strikes within a cent are the same listed strike."""
    return F.round(F.col(strike) * 100.0).cast("bigint")


def lookup_quotes(legs: DataFrame, chain: DataFrame, date="quote_date") -> DataFrame:
    """bid/ask/mid of each leg's contract on its day; unknown contracts keep NULLs."""
    px = chain.select(
        F.col("symbol"), F.col("quote_date").alias(date), "option_type", "expiration", strike_key().alias("_k"),
        F.col("bid").alias("bid"), F.col("ask").alias("ask"), F.lit(True).alias("_listed"),
        *[F.col(c).alias(c) for c in ("volume",) if c in chain.columns],
    )
    on = ["symbol", date, "option_type", "expiration", "_k"]
    # the mid follows from what is joined, so it is not shuffled with the chain
    found = legs.withColumn("_k", strike_key()).join(px, on, "left").withColumn("quote_mid", F.when(F.col("_listed"), mid_price()))
    return found.select(*legs.columns, "bid", "ask", "quote_mid", *[c for c in ("volume",) if c in chain.columns])


def listed_quotes(chain: DataFrame, date="quote_date") -> DataFrame:
    """`_quotes`: what is listed of a symbol, day and expiration as one array, a bounded set."""
    quote = F.struct("option_type", strike_key().alias("_k"), "bid", "ask")
    return chain.groupBy("symbol", F.col("quote_date").alias(date), "expiration").agg(F.collect_list(quote).alias("_quotes"))


def array_quotes(legs: DataFrame) -> DataFrame:
    """`lookup_quotes` for legs that carry the `listed_quotes` of their symbol, day and expiration; without the volume."""
    mine = F.filter("_quotes", lambda q: (q["option_type"] == F.col("option_type")) & (q["_k"] == strike_key()))
    px = F.transform(mine, lambda q: F.struct(q["bid"].alias("bid"), q["ask"].alias("ask"), F.lit(True).alias("_listed")))
    keep = [c for c in legs.columns if c != "_quotes"]
    return legs.select(*keep, F.inline_outer(px)).withColumn("quote_mid", F.when(F.col("_listed"), mid_price())).drop("_listed")


def interpolated_marks(missing: DataFrame, chain: DataFrame) -> DataFrame:
    """Strike neighbours within +-7 days of expiry, for contracts without a quote of their own.

    A missing contract asks the fifteen expirations around its own, which turns the dte band into an equality, so the
    chain is read as it is; neighbours are then read off one sorted pass per (day, type, wanted expiration), and no
    contract is ever paired with every other.
    """
    want = missing.select(*CONTRACT, "strike").distinct()
    asked = want.select(*CONTRACT).distinct().withColumn("_e", F.explode(F.sequence(F.date_sub("expiration", DTE_BAND), F.date_add("expiration", DTE_BAND))))
    listed = chain.select(*DAY, "option_type", F.col("expiration").alias("_e"), "strike", mid_price().alias("_px"))
    offered = asked.join(listed, [*DAY, "option_type", "_e"])
    nearness = F.struct(F.abs(F.datediff("_e", "expiration")), F.col("_e"))
    level = offered.groupBy(*CONTRACT, "strike").agg(F.min_by(F.struct("_px", "_e"), nearness).alias("_q")).select(
        *CONTRACT, strike_key().alias("_k"), F.struct("strike", "_q._px", "_q._e").alias("_q"))
    ask = want.select(*CONTRACT, strike_key().alias("_k"), F.col("strike").alias("_want"))
    mixed = ask.unionByName(level, allowMissingColumns=True)
    w = W.partitionBy(*CONTRACT).orderBy("_k")
    below = F.last("_q", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, -1))
    above = F.first("_q", ignorenulls=True).over(w.rangeBetween(1, W.unboundedFollowing))
    both = mixed.withColumns({"_lo": below, "_hi": above}).filter(
        F.col("_want").isNotNull() & (F.col("_lo._px") > 0) & (F.col("_hi._px") > 0))
    weight = (F.col("_want") - F.col("_lo.strike")) / (F.col("_hi.strike") - F.col("_lo.strike"))
    level_px = F.col("_lo._px") + weight * (F.col("_hi._px") - F.col("_lo._px"))
    near = (F.datediff("_lo._e", "quote_date") + F.datediff("_hi._e", "quote_date")) / 2.0
    own = F.datediff("expiration", "quote_date")
    scaled = F.when((near > 0) & (own > 0), level_px * F.sqrt(own / near)).otherwise(level_px)
    return both.select(*CONTRACT, F.col("_want").alias("strike"), F.greatest(scaled, F.lit(MIN_MARK)).alias("interp"))


def mark_contracts(wanted: DataFrame, chain: DataFrame, snapshots: DataFrame) -> DataFrame:
    """C02 for distinct contract-days: exact quote, else interpolation, else closed form.

    Marking contracts instead of legs keeps the work proportional to what is listed, however many
    strategies and parameter sets hold the same contract. `mark_source` tells which rule fired.
    """
    want = wanted.select(*CONTRACT, "strike").distinct().withColumn("_strike", strike_key())
    day = snapshots.select("symbol", F.col("d").alias("quote_date"), F.col("spot").alias("_spot"), F.col("iv").alias("_iv"))
    exact = want.join(_mids(chain), [*CONTRACT, "_strike"], "left")
    interp = interpolated_marks(exact.filter(F.col("exact").isNull()), chain)
    return _best_mark(exact.join(interp, [*CONTRACT, "strike"], "left").join(day, DAY, "left")).select(*CONTRACT, "strike", "mark", "mark_source")


def mark_series(own: DataFrame, chain: DataFrame) -> DataFrame:
    """`mark_contracts` for contracts (`SERIES` and strike) with the array `_days` of their days: one row per contract-day with
    the day's fields (`quote_date`, `_spot`, `_iv` and others), `mark` and `mark_source`.

    `own` lies by `SERIES` in as many tasks as the session shuffles to. Quotes come to a contract as one array, bounded by the
    calendar, and meet its days where they lie, so later groups by contract shuffle no contract-days.
    """
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = {f.name: f.dataType for f in own.schema["_days"].dataType.elementType.fields if f.name != "quote_date"}
    types = {**fields, "exact": "double", "interp": "double"}

    def arrays(rows, name, *columns):
        return rows.repartition(tasks, *SERIES).groupBy(*SERIES).agg(F.collect_list(F.struct("quote_date", *columns)).alias(name)).hint("merge")

    def part(array, given, asked=False):
        row = lambda x: F.struct(x["quote_date"].alias("quote_date"), *[(x[c] if c in given else F.lit(None)).cast(t).alias(c) for c, t in types.items()], F.lit(asked).alias("_asked"))
        return F.coalesce(F.transform(array, row), F.array())

    def met(contracts, *more):
        rows = contracts.select(*SERIES, "strike", F.inline(F.concat(part("_days", fields, True), part("_quotes", ["exact"]), *more)))
        return rows.groupBy(*SERIES, "strike", "quote_date").agg(*[F.max(c).alias(c) for c in types], F.max("_asked").alias("_asked")).filter("_asked").drop("_asked")

    quoted = own.join(arrays(_mids(chain), "_quotes", "exact"), SERIES, "left")
    known = F.transform(F.filter("_quotes", lambda x: x["exact"].isNotNull()), lambda x: x["quote_date"])
    missing = F.array_except(F.transform("_days", lambda x: x["quote_date"]), F.coalesce(known, F.array().cast("array<date>")))
    # with the strike in the condition both uses of the missing days read the same exchange
    missing = quoted.select(*SERIES, "strike", F.explode(F.when(F.col("strike").isNotNull(), missing)).alias("quote_date"))
    interp = interpolated_marks(missing, chain).withColumn("_strike", strike_key())
    both = quoted.join(arrays(interp, "_between", "strike", "interp"), SERIES, "left")
    # strikes within a cent share quotes, but not what is interpolated for them
    marked = met(both, part(F.filter("_between", lambda x: x["strike"] == F.col("strike")), ["interp"]))
    return _best_mark(marked).drop("exact", "interp")


def _mids(chain: DataFrame) -> DataFrame:
    return chain.select(*CONTRACT, strike_key().alias("_strike"), mid_price().alias("exact"))


def _best_mark(both: DataFrame) -> DataFrame:
    """`mark` and `mark_source` from `exact`, `interp` and the model at `_spot` and `_iv`."""
    dte = F.datediff("expiration", "quote_date")
    sigma = F.when(F.col("_iv") > 0, F.col("_iv")).otherwise(F.lit(DEFAULT_IV))
    modelled = price_chain(both, "_spot", "strike", F.greatest(dte, F.lit(0)) / 365.0, MARK_RATE, sigma, out="_bs")
    model = F.when(dte <= 0, intrinsic("_spot", "strike", "option_type")).otherwise(F.greatest("_bs", F.lit(MIN_MARK)))
    model = F.when(F.col("_spot") > 0, model)
    return modelled.withColumns({
        "mark": F.coalesce("exact", "interp", model),
        "mark_source": F.when(F.col("exact").isNotNull(), F.lit("exact")).when(F.col("interp").isNotNull(), F.lit("interpolated")).when(model.isNotNull(), F.lit("model")),
    }).drop("_bs")


def settled(marked: DataFrame, snapshots: DataFrame, settle="intrinsic") -> DataFrame:
    """Marks on and after expiration: the intrinsic value (`settle='intrinsic'`) or what they are (`'stale'`)."""
    if settle != "intrinsic":
        return marked
    day = snapshots.select("symbol", F.col("d").alias("quote_date"), F.col("spot").alias("_settle_spot"))
    out = marked.join(day, DAY, "left")
    done = (F.col("quote_date") >= F.col("expiration")) & F.col("_settle_spot").isNotNull()
    return out.withColumns({
        "mark": F.when(done, intrinsic("_settle_spot", "strike", "option_type")).otherwise(F.col("mark")),
        "mark_source": F.when(done, F.lit("settled")).otherwise(F.col("mark_source")),
    }).drop("_settle_spot")


def mark_legs(leg_days: DataFrame, chain: DataFrame, snapshots: DataFrame, position="position_id", settle="intrinsic") -> DataFrame:
    """C02 for leg-days (position, leg_no, contract, quote_date): the contract mark, else the leg's last one.

    On and after expiration the leg settles at intrinsic value (`settle='intrinsic'`) or keeps its last
    mark (`'stale'`).
    """
    marks = mark_contracts(leg_days, chain, snapshots)
    out = settled(leg_days.join(marks, [*CONTRACT, "strike"], "left"), snapshots, settle)
    # a leg lives a bounded number of days
    w = W.partitionBy(position, "leg_no").orderBy("quote_date").rowsBetween(W.unboundedPreceding, 0)
    return out.withColumns({
        "mark_source": F.when(F.col("mark").isNull(), F.lit("last")).otherwise(F.col("mark_source")),
        "mark": F.coalesce("mark", F.last("mark", ignorenulls=True).over(w)),
    })


def put_call_pairs(chain: DataFrame, price="mid") -> DataFrame:
    """Calls and puts on common strikes, one shuffle."""
    pick = lambda t: F.max(F.when(F.col("option_type") == t, F.col(price)))
    return chain.groupBy(*DAY, "expiration", "strike").agg(pick("call").alias("call_price"), pick("put").alias("put_price")).filter(
        F.col("call_price").isNotNull() & F.col("put_price").isNotNull())


def asof_spot(dates: DataFrame, bars: DataFrame, lookback: int = 5) -> DataFrame:
    """Last close on or before each (symbol, d), at most `lookback` days old.

    A bar offers itself to the days it can serve; the freshest offer wins. No sort of a whole symbol.
    """
    offers = bars.filter(F.col("c").isNotNull()).select(
        "symbol", F.col("d").alias("bar_date"), "c",
        F.explode(F.sequence("d", F.date_add("d", lookback))).alias("d"))
    best = offers.groupBy("symbol", "d").agg(F.max(F.struct("bar_date", "c")).alias("_b"))
    return dates.join(best, ["symbol", "d"], "left").select(*dates.columns, F.col("_b.c").alias("spot"), F.col("_b.bar_date").alias("bar_date"))


def attach_snapshot(df: DataFrame, snapshots: DataFrame, date="quote_date", columns=("spot", "iv")) -> DataFrame:
    """C08."""
    day = snapshots.select("symbol", F.col("d").alias(date), *columns)
    return df.join(day, ["symbol", date], "left")


# ---- spot and volatility of a chain-day --------------------------------------------------------

def _median_of_sorted(arr: str) -> Column:
    return F.expr(f"(element_at({arr}, int(floor((size({arr}) + 1) / 2))) + element_at({arr}, int(ceil((size({arr}) + 1) / 2)))) / 2D")


def spot_median_strike(chain: DataFrame, keys=DAY) -> DataFrame:
    """Median of the distinct strikes (a day's strikes are a bounded set)."""
    s = chain.groupBy(*keys).agg(F.sort_array(F.collect_set("strike")).alias("_ks"))
    return s.select(*keys, _median_of_sorted("_ks").alias("spot_median"))


def spot_put_call(chain: DataFrame, keys=DAY, price="mid") -> DataFrame:
    """The common strike where call and put are worth the same; else the median strike."""
    rows = put_call_pairs(chain, price)
    best = rows.groupBy(*keys).agg(
        F.min_by("strike", F.struct(F.abs(F.col("call_price") - F.col("put_price")), F.col("strike"))).alias("_pc"))
    fallback = chain.groupBy(*keys).agg(F.percentile("strike", F.lit(0.5)).alias("_med"))
    return fallback.join(best, list(keys), "left").select(*keys, F.coalesce("_pc", "_med").alias("spot_put_call"))


def nearest_rows(chain: DataFrame, n: int = 5, spot="spot", keys=DAY) -> DataFrame:
    """The n rows whose strikes lie nearest the spot."""
    w = W.partitionBy(*keys).orderBy(F.abs(F.col("strike") - F.col(spot)), "strike", "expiration", "option_type")
    return chain.withColumn("nearness", F.row_number().over(w)).filter(F.col("nearness") <= n)


def atm_iv_band(chain: DataFrame, spot="spot", band=0.02, keys=DAY, iv="vol") -> DataFrame:
    """Mean positive IV within the band; without rows there, of the five nearest; else 0.20."""
    w = W.partitionBy(*keys).orderBy(F.abs(F.col("strike") - F.col(spot)), "strike", "expiration", "option_type")
    ok = F.when(F.col(iv) > 0, F.col(iv))
    near = F.abs(F.col("strike") / F.col(spot) - 1.0) < band
    ranked = chain.select(*keys, ok.alias("_iv"), near.alias("_in"), F.row_number().over(w).alias("_rn"))
    inside, five = F.avg(F.when(F.col("_in"), F.col("_iv"))), F.avg(F.when(F.col("_rn") <= 5, F.col("_iv")))
    return ranked.groupBy(*keys).agg(
        F.coalesce(F.when(F.count_if("_in") > 0, inside).otherwise(five), F.lit(DEFAULT_IV)).alias("iv"))


def daily_atm_iv(chain: DataFrame, dte_target=30, use_atm=True, keys=DAY, iv="vol", price="mid", half_width=5) -> DataFrame:
    """Per day, the mean IV at the strike nearest the put-call spot, dte near the target."""
    dte = F.datediff("expiration", "quote_date")
    sel = chain.filter(dte.between(max(dte_target - half_width, 1), dte_target + half_width))
    if not use_atm:
        return sel.groupBy(*keys).agg(F.avg(iv).alias("iv")).filter(F.col("iv") > 0)
    per_strike = sel.groupBy(*keys, "strike").agg(F.avg(iv).alias("_iv"))
    spot = spot_put_call(sel, keys, price)
    at = per_strike.join(spot, list(keys)).groupBy(*keys).agg(
        F.min_by("_iv", F.struct(F.abs(F.col("strike") - F.col("spot_put_call")), F.col("strike"))).alias("iv"))
    return at.filter(F.col("iv") > 0)


def chain_iv(chain: DataFrame, strike: float | None = None, dte_range=(20, 40), keys=DAY, iv="vol") -> DataFrame:
    """Mean positive IV at one strike, or at the listed strike nearest the median strike."""
    dte = F.datediff("expiration", "quote_date")
    sel = chain.filter(dte.between(*dte_range) & (F.col(iv) > 0))
    if strike is not None:
        return sel.filter(F.col("strike") == float(strike)).groupBy(*keys).agg(F.avg(iv).alias("iv"))
    per_strike = sel.groupBy(*keys, "strike").agg(F.avg(iv).alias("_iv"))
    # distinct strikes of one day: a bounded group
    med = F.percentile("strike", F.lit(0.5)).over(W.partitionBy(*keys))
    return per_strike.withColumn("_m", med).groupBy(*keys).agg(
        F.min_by("_iv", F.struct(F.abs(F.col("strike") - F.col("_m")), F.col("strike"))).alias("iv"))


def chain_days(chain: DataFrame, price="mid", iv="vol", band=0.02, keys=DAY) -> DataFrame:
    """D02, D03 and the chain's size per day over one exchange by day: `spot`, `iv`, `chain_size`.

    Strikes are summed up inside a day first, so a day is one row with an array of its rows (a bounded set), from which the
    rows near the spot are read; they are sorted only where none lies within the band.
    """
    pick = lambda t: F.max(F.when(F.col("option_type") == t, F.col(price)))
    strikes = chain.repartition(*keys).groupBy(*keys, "expiration", "strike").agg(
        pick("call").alias("_c"), pick("put").alias("_p"), F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct("strike", "expiration", "option_type", F.col(iv).alias("iv"))).alias("_rows"))
    worth_same = F.struct(F.abs(F.col("_c") - F.col("_p")), F.col("strike"))
    day = strikes.groupBy(*keys).agg(
        F.coalesce(F.min_by("strike", F.when(F.col("_c").isNotNull() & F.col("_p").isNotNull(), worth_same)), F.percentile("strike", F.lit(0.5), F.col("_n"))).alias("spot"),
        F.sum("_n").alias("chain_size"), F.flatten(F.collect_list("_rows")).alias("_rows"))
    near = F.filter("_rows", lambda x: F.abs(x["strike"] / F.col("spot") - 1.0) < band)
    ranked = F.array_sort(F.transform("_rows", lambda x: F.struct(F.abs(x["strike"] - F.col("spot")).alias("gap"), x["strike"].alias("strike"), x["expiration"].alias("expiration"), x["option_type"].alias("option_type"), x["iv"].alias("iv"))))
    five = F.transform(F.slice(ranked, 1, 5), lambda x: x["iv"])
    day = day.withColumn("_near", F.transform(near, lambda x: x["iv"]))
    day = day.withColumn("_ivs", F.filter(F.when(F.size("_near") > 0, F.col("_near")).otherwise(five), lambda x: x > 0))
    mean = F.aggregate("_ivs", F.lit(0.0), lambda a, x: a + x) / F.when(F.size("_ivs") > 0, F.size("_ivs"))
    return day.select(*keys, "spot", F.coalesce(mean, F.lit(DEFAULT_IV)).alias("iv"), "chain_size")


def build_snapshots(chain: DataFrame, vix: DataFrame | None = None, calendar: DataFrame | None = None, iv_window=252,
                    iv_min_obs=30, price="mid") -> DataFrame:
    """One row per symbol-day: spot, IV, IV rank, chain size, VIX and its regime.

    With a `calendar` (symbol, d) missing days appear as rows with NULL spot; otherwise they are skipped.
    """
    from ..functions.conditions import regime
    from .series import iv_minmax_rank, regime_duration

    day = chain_days(chain, price).select("symbol", F.col("quote_date").alias("d"), "spot", "iv", "chain_size")
    if calendar is not None:
        day = calendar.select("symbol", "d").join(day, ["symbol", "d"], "left")
    day = iv_minmax_rank(day, ["symbol"], window=iv_window, min_obs=iv_min_obs)
    if vix is None:
        return day.withColumn("vix", F.lit(None).cast("double"))
    reg = regime_duration(vix.select("d", "vix", regime("vix").alias("regime"), F.lit("VIX").alias("_series")), ["_series"])
    return day.join(reg.drop("_series"), "d", "left")
