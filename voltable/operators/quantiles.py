"""Exact quantiles of groups of any size.

`percentile` keeps every distinct value of a group in one task's memory. That is fine for a daily
series (bounded by the calendar) and wrong for trades or quotes. Here the group is cut at sketch
boundaries, the cut's counts locate the wanted ranks, and only the few cells that contain a rank are
sorted. The answer is exact: the sketch only decides where to look.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .joins import attach_measured

COARSE = 16
CELLS = COARSE * COARSE
SKETCH_ACCURACY = 4096


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles named by `probs` per key; NULL values are ignored."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cuts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [i / CELLS for i in range(1, CELLS)], SKETCH_ACCURACY).alias("_cuts"),
    )
    # number of cuts below the value, by a coarse and then a fine scan
    top = F.transform(F.sequence(F.lit(1), F.lit(COARSE - 1)), lambda i: F.element_at("_cuts", i * COARSE))
    located = attach_measured(counts, cuts.withColumn("_top", top), keys, F.col("_v"), measured=cuts.select(*keys, F.col("_n").alias("_rows"))).withColumn(
        "_j", F.size(F.filter("_top", lambda x: x < F.col("_v"))) * COARSE)
    fine = F.size(F.filter(F.slice("_cuts", F.col("_j") + 1, F.lit(COARSE - 1)), lambda x: x < F.col("_v")))
    celled = located.select(*keys, "_v", "_c", (F.col("_j") + fine).alias("_cell"))
    per_cell = celled.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_cc"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_cell.withColumn("_off", F.coalesce(F.sum("_cc").over(before), F.lit(0)))
    totals = cuts.select(*keys, "_n")

    ranks = []
    for p in probs.values():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        ranks += [F.floor(at), F.ceil(at)]
    wanted = F.exists(F.array(*ranks), lambda k: (k >= F.col("_off")) & (k < F.col("_off") + F.col("_cc")))
    cells = offsets.join(totals, keys).filter(wanted)
    # cells without a wanted rank meet nothing, however many rows they have
    inside = W.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    located = (
        attach_measured(celled, cells.drop("_rows"), [*keys, "_cell"], F.col("_v"), measured=cells.select(*keys, "_cell", "_rows"))
        .withColumn("_end", F.col("_off") + F.sum("_c").over(inside))
    )
    aggs, outs = [], []
    for i, (name, p) in enumerate(probs.items()):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        aggs.append(F.min(F.when(F.col("_end") > F.floor(at), F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("_end") > F.ceil(at), F.col("_v"))).alias(f"_hi{i}"))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return located.groupBy(*keys, "_n").agg(*aggs).select(*keys, *outs)
