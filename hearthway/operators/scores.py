"""Robust scores, ranks, recommendations and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.operators.positions import ntiles, positions
from hearthway.sources.stage import settle


def robust_z(df: DataFrame, by: list[str], value: str, name: str = "z") -> DataFrame:
    """(x - median) / (1.4826 MAD) in each group; by the sample deviation where the MAD is 0; 0 where that is 0 too.

    Medians are aggregates by group that are joined back, so a large group is not held in a window.
    """
    med = df.groupBy(*by).agg(F.median(value).alias("_med"), F.stddev_samp(value).alias("_sd"))
    centred = df.join(med, by) if by else df.crossJoin(F.broadcast(med))
    dev = centred.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    scored = centred.join(dev, by) if by else centred.crossJoin(F.broadcast(dev))
    gap = F.col(value) - F.col("_med")
    z = F.when(F.col("_mad") > 0, gap / (1.4826 * F.col("_mad"))).when(F.col("_sd") > 0, gap / F.col("_sd")).otherwise(F.lit(0.0))
    return scored.withColumn(name, F.when(F.col(value).isNotNull(), z)).drop("_med", "_sd", "_mad")


def winsorise(df: DataFrame, value: str, q: float) -> DataFrame:
    """``value`` held between its ``q`` and 1 - ``q`` quantiles; nulls stay."""
    bounds = df.agg(F.percentile(value, F.array(F.lit(q), F.lit(1 - q))).alias("_q"))
    x = F.col(value)
    held = F.when(x < F.col("_q")[0], F.col("_q")[0]).when(x > F.col("_q")[1], F.col("_q")[1]).otherwise(x)
    return df.crossJoin(F.broadcast(bounds)).withColumn(value, held).drop("_q")


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, bits: int = 12) -> DataFrame:
    """First value of each group at which the cumulative weight reaches half of the total; rows without a value or weight are left out.

    Weights are summed by value, all values of all groups are placed in order by ranges, and their weights summed by
    stretches of places. Only the stretch in which a group passes its half is walked value by value, so no task sorts a group.
    """
    sums = df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    placed = settle(positions(sums, [*by, value], "_place").withColumn("_stretch", F.shiftright("_place", bits)))
    parts = placed.groupBy(*by, "_stretch").agg(F.sum("_w").alias("_part"))
    group = W.partitionBy(*by)
    before = F.coalesce(F.sum("_part").over(group.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "_half": F.sum("_part").over(group) / 2})
    crossed = parts.filter((F.col("_before") + F.col("_part") >= F.col("_half")) & ((F.col("_before") < F.col("_half")) | (F.col("_before") == 0)))
    upto = F.sum("_w").over(W.partitionBy(*by, "_stretch").orderBy("_place").rowsBetween(W.unboundedPreceding, 0))
    walked = placed.join(crossed, [*by, "_stretch"]).withColumn("_c", F.col("_before") + upto)
    return walked.filter(F.col("_c") >= F.col("_half")).groupBy(*by).agg(F.min(value).alias(value))


def average_rank(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Rank with ties averaged; null values have no rank. Distinct values are counted first and ranked by count."""
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(name, before + (F.col("_c") + 1) / 2).drop("_c")
    return df.join(ranks, [*by, value], "left")


def minmax_good_low(value: str, by: list[str]) -> Column:
    """100 for the smallest value of the group, 0 for the largest, 50 where all are equal."""
    w = W.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, 100 * (hi - F.col(value)) / (hi - lo)).otherwise(F.lit(50.0))


def recommend_homes(view: DataFrame, homes: DataFrame, least_coverage: float = 0.7, k: int = 10, cap: float = 62000.0, hourly: float = 10320.0) -> DataFrame:
    """Least burdened ``k`` homes by district among those with coverage, without the decile of fewest transactions.

    The burden is rent, fares of 42 rides at most ``cap`` (a missing fare counts as the cap) and the time of 42 rides at
    ``hourly``.
    """
    eligible = ntiles(homes, ["tx", "dong"], 10, "_d").filter("_d > 1").drop("_d", "tx")
    transport = F.coalesce(F.least(F.round("fare") * 42, F.lit(cap)), F.lit(cap))
    transport = F.when(F.col("fare").isNull(), F.lit(cap)).otherwise(transport)
    time = F.round(F.col("commute_min") * 42 / 60 * hourly)
    joined = view.filter(F.col("coverage") >= least_coverage).join(eligible, F.col("home") == F.col("dong")).drop("dong")
    costed = joined.withColumns({"transport": transport, "time_cost": time}).withColumn("cost", F.round(F.col("rent_cost") + F.col("transport") + F.col("time_cost"), 2))
    return costed.withColumn("k", F.row_number().over(W.partitionBy("district").orderBy("cost", "home"))).filter(F.col("k") <= k)


def workplace_score(df: DataFrame, inflow: str, measures: list[str], above_one: list[str], quantile: float = 0.85) -> DataFrame:
    """Add score (mean of the percentile ranks of the measures a row has), centre and absorbed.

    A centre has an inflow at or over the ``quantile`` and every one of ``above_one`` over 1; ``absorbed`` is the centres'
    share of all inflow. A missing measure is left out of the mean and makes no centre.
    """
    one = df.agg(F.percentile(inflow, F.lit(quantile)).alias("_cut"), F.sum(inflow).alias("_all"), *[F.count(c).alias(f"_n_{c}") for c in measures])
    for c in measures:
        df = average_rank(df, c, f"_r_{c}")
    df = df.crossJoin(F.broadcast(one))
    shares = F.array_compact(F.array(*[F.col(f"_r_{c}") / F.col(f"_n_{c}") for c in measures]))
    score = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(shares), F.lit(0))
    centre = F.col(inflow) >= F.col("_cut")
    for c in above_one:
        centre = centre & F.coalesce(F.col(c) > 1, F.lit(False))
    scored = df.withColumns({"score": score, "centre": F.coalesce(centre, F.lit(False))})
    held = scored.agg(F.sum(F.when(F.col("centre"), F.col(inflow)).otherwise(0)).alias("_held"))
    out = scored.crossJoin(F.broadcast(held)).withColumn("absorbed", F.col("_held") / F.col("_all"))
    return out.drop("_cut", "_all", "_held", *[f"_{p}_{c}" for c in measures for p in "nr"])
