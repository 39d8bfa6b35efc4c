"""Housing and commuting costs combined into a monthly burden, its ranks and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.functions.clean import sql_round
from hearthway.sources.stage import settle

WORK_DAYS = 21
HOURLY_VALUE = 10320
PASS_CAP = 62000


def clip_upper(value: Column, cap) -> Column:
    """``value`` but at most ``cap``; null stays null (``least`` would skip it)."""
    return F.when(value > cap, F.lit(cap)).otherwise(value)


def monthly(value: Column) -> Column:
    """Two ways on each working day."""
    return 2 * WORK_DAYS * value


def total_burden(df: DataFrame, hourly: float = HOURLY_VALUE, cap: float = PASS_CAP) -> DataFrame:
    """dong, rent_cost, oneway_min, fare, coverage, tx plus hours, transport, transport_pass and total (won a month).

    A missing fare leaves transport and total null.
    """
    hours, transport = sql_round(monthly(F.col("oneway_min")) / 60, 4), sql_round(monthly(F.col("fare")), 2)
    out = df.select("dong", "rent_cost", "oneway_min", "fare", "coverage", "tx", hours.alias("hours"), transport.alias("transport"))
    out = out.withColumn("transport_pass", clip_upper(F.col("transport"), float(cap)))
    return out.withColumn("total", sql_round(F.col("rent_cost") + F.col("transport") + F.col("hours") * hourly, 2))


def global_rank(df: DataFrame, order: Column, name: str, tie: str, parts: int = 64) -> DataFrame:
    """SQL RANK() of ``order`` over the whole table without one task that sorts it all.

    Distinct values are counted, ranged into ``parts`` by quantile sketches of a single pass, and each range is ranked
    by itself and moved by the counts of the ranges before. Nulls come first.
    """
    counts = df.groupBy(order.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cuts = counts.agg(F.percentile_approx("_v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10000).alias("c")).first()["c"] or []
    edges = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("_v"))) if edges else F.lit(0)
    ranged = counts.withColumn("_b", F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(bucket))
    sums = ranged.groupBy("_b").agg(F.sum("_c").alias("_s"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.coalesce(F.sum("_c").over(W.partitionBy("_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.withColumn("_in", inside).join(F.broadcast(base), "_b").select(F.col("_v").alias("_r"), (F.col("_base") + F.col("_in") + 1).cast("long").alias(name))
    return df.withColumn("_v", order).join(ranks, F.col("_v").eqNullSafe(F.col("_r"))).drop("_v", "_r")


def rank_gap(df: DataFrame) -> DataFrame:
    """Rank of rent and of total, their signed gap, and the type by the two medians.

    ``df`` is written once, as ranks and medians read it several times.
    """
    df = settle(df)
    ranked = global_rank(global_rank(df, F.col("rent_cost"), "rent_rank", "dong"), F.col("total"), "total_rank", "dong")
    medians = df.agg(F.median("rent_cost").alias("m_rent"), F.median("total").alias("m_total"))
    high_rent, high_total = F.col("rent_cost") > F.col("m_rent"), F.col("total") > F.col("m_total")
    kind = F.when(high_rent & high_total, "both high").when(high_rent, "rent high").when(high_total, "hidden cost").otherwise("both low")
    return ranked.crossJoin(F.broadcast(medians)).withColumn("rank_gap", F.col("rent_rank") - F.col("total_rank")).withColumn("kind", kind).drop("m_rent", "m_total")


def nearest_month(facts: DataFrame, rates: DataFrame, keys: list[str], ym: str = "ym", value: str = "rate") -> DataFrame:
    """Rate of the same month, else of the closest (ties: the earlier); adds ``value``, ``rate_ym`` and ``exact``.

    Rates are looked up once for each distinct (keys, month) of the facts, then joined back, so the comparison of months
    never runs over the facts. Facts without any rate keep nulls.
    """
    index = lambda c: F.floor(c / 100) * 12 + c % 100
    wanted = facts.select(*keys, ym).distinct()
    right = rates.select(*keys, F.col(ym).alias("rate_ym"), value)
    pairs = wanted.join(right, keys).withColumn("_d", F.abs(index(F.col(ym)) - index(F.col("rate_ym"))))
    best = pairs.groupBy(*keys, ym).agg(F.min_by(F.struct("rate_ym", value), F.struct("_d", "rate_ym")).alias("_best"))
    found = best.select(*keys, ym, F.col("_best.rate_ym").alias("rate_ym"), F.col(f"_best.{value}").alias(value))
    return facts.join(found, [*keys, ym], "left").withColumn("exact", F.col("rate_ym") == F.col(ym))


def surface_cost(rent: Column, deposit: Column, rate: Column) -> Column:
    """Monthly rent plus what the deposit costs a month."""
    return rent + deposit * rate / 12
