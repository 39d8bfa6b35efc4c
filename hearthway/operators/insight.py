"""Work-by-home comparisons: trade-offs, efficiency, recommendation scores, scenario and weight grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scores import minmax_good_low


def commute_table(routes: DataFrame, homes: DataFrame, hourly: float = 10320, factor: float = 1.0) -> DataFrame:
    """A row for each (work, home) with rent, monthly hours and fare, time cost and total; trips of 1 to 90 minutes.

    An internal trip has no fare of its own and takes the mean fare of its home.
    """
    known = routes.groupBy("home").agg(F.round(F.avg("fare"), 4).alias("_mean"))
    j = routes.join(known, "home").join(homes.select(F.col("dong").alias("home"), "rent_cost"), "home").filter(F.col("time_min").between(1, 90))
    hours = F.round(42 * F.col("time_min") / 60, 4)
    fare = F.round(42 * F.coalesce("fare", "_mean"), 2)
    j = j.select("work", "home", "rent_cost", "time_min", hours.alias("hours"), fare.alias("fare_cost"))
    j = j.withColumn("time_cost", F.round(F.col("hours") * hourly * factor, 2))
    return j.withColumn("total", F.round(F.col("rent_cost") + F.col("fare_cost") + F.col("time_cost"), 2))


def baseline_homes(table: DataFrame, minutes: float = 30) -> DataFrame:
    """For each work the home within ``minutes`` whose rent is nearest to their median (ties: smaller home)."""
    near = table.filter(F.col("time_min") <= minutes)
    med = near.groupBy("work").agg(F.median("rent_cost").alias("_m"))
    k = F.row_number().over(W.partitionBy("work").orderBy(F.abs(F.col("rent_cost") - F.col("_m")), "home"))
    return near.join(med, "work").withColumn("_k", k).filter("_k = 1").drop("_k", "_m")


def tradeoffs(table: DataFrame) -> DataFrame:
    """Against the baseline of the work: rent saving, added costs, net saving, verdict, net for each 100,000 saved."""
    base = baseline_homes(table).select("work", *[F.col(c).alias(f"b_{c}") for c in ("home", "rent_cost", "hours", "fare_cost", "time_cost")])
    j = table.join(base, "work")
    saving = F.round(F.col("b_rent_cost") - F.col("rent_cost"), 2)
    added = F.round(F.col("fare_cost") + F.col("time_cost") - F.col("b_fare_cost") - F.col("b_time_cost"), 2)
    j = j.withColumns({"saving": saving, "added": added})
    j = j.withColumn("net", F.round(F.col("saving") - F.col("added"), 2))
    verdict = F.when((F.col("saving") > 0) & (F.col("net") < 0), "illusion").when(F.col("net") > 0, "real saving").otherwise("no saving")
    per = F.when(F.col("saving") >= 10000, F.round(F.col("net") / F.col("saving") * 10000, 4))
    return j.select("work", "home", "saving", "added", "net", verdict.alias("verdict"), per.alias("net_per_10k"))


def efficiency(table: DataFrame) -> DataFrame:
    """Type by the work's medians, index = smallest total / total * 100, ranks by rent and by total and their change."""
    ref = table.groupBy("work").agg(F.median("rent_cost").alias("_mr"), F.median("hours").alias("_mh"), F.min("total").alias("_lo"))
    cheap, near = F.col("rent_cost") <= F.col("_mr"), F.col("hours") <= F.col("_mh")
    kind = F.when(cheap & near, "cheap and near").when(cheap, "cheap and far").when(near, "dear and near").otherwise("dear and far")
    rank = lambda c: F.rank().over(W.partitionBy("work").orderBy(c))
    j = table.join(ref, "work").withColumns({"kind": kind, "idx": F.round(F.col("_lo") / F.col("total") * 100, 4), "rent_rank": rank("rent_cost"), "total_rank": rank("total")})
    return j.withColumn("rank_change", F.col("rent_rank") - F.col("total_rank")).drop("_mr", "_mh", "_lo")


def recommendation_score(table: DataFrame, weights: tuple[float, float, float], by: list[str] | None = None) -> DataFrame:
    """Weighted min-max scores of rent, fare and time in each group; contributions, their shares and the rank."""
    by = by or ["work"]
    total = sum(weights)
    parts = {"rent": "rent_cost", "fare": "fare_cost", "time": "hours"}
    out = table.withColumns({f"s_{k}": minmax_good_low(c, by) for k, c in parts.items()})
    out = out.withColumns({f"c_{k}": F.round(F.col(f"s_{k}") * (w / total), 6) for (k, _), w in zip(parts.items(), weights, strict=True)})
    score = F.round(F.col("c_rent") + F.col("c_fare") + F.col("c_time"), 6)
    out = out.withColumn("score", score).withColumn("rent_part", F.when(F.col("score") > 0, F.round(F.col("c_rent") / F.col("score"), 6)))
    return out.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "home")))


def weight_grid(table: DataFrame, grid: DataFrame) -> DataFrame:
    """Scores for every weight of ``grid`` (rent weight ``w``; the rest is split 3:1 between fare and time)."""
    scored = table.withColumns({f"s_{c}": minmax_good_low(c, ["work"]) for c in ("rent_cost", "fare_cost", "hours")})
    rest = 1 - F.col("w")
    score = F.round(F.col("w") * F.col("s_rent_cost") + rest * 0.75 * F.col("s_fare_cost") + rest * 0.25 * F.col("s_hours"), 6)
    g = scored.crossJoin(F.broadcast(grid)).withColumn("score", score)
    return g.withColumn("place", F.row_number().over(W.partitionBy("w", "work").orderBy(F.desc("score"), "home"))).select("w", "work", "home", "score", "place")


def tops(table: DataFrame, axis: str, points: list[Column], cost: Callable[[Column], Column], keep: list[str], among: Callable[[Column], Column] | None = None) -> DataFrame:
    """(axis, work, home, keep): at each of ``points`` the home of a work that costs least among those that pass (nulls last, ties: smaller
    home). A work's rows are read once for all points and never repeated by them."""
    best = []
    for p in points:
        row = F.struct(cost(p).isNull().alias("none"), cost(p).alias("cost"), "home", *keep)
        best.append(F.struct(p.alias(axis), F.min(F.when(among(p), row) if among else row).alias("top")))
    each = table.groupBy("work").agg(F.array(*best).alias("_b")).select("work", F.explode("_b").alias("_b")).filter("_b.top is not null")
    return each.select(F.col(f"_b.{axis}").alias(axis), "work", F.col("_b.top.home").alias("home"), *[F.col(f"_b.top.{c}").alias(c) for c in keep])


def switches(tops: DataFrame, axis: str, group: str = "work", value: str = "home") -> DataFrame:
    """Points of ``axis`` at which the group's value is not the one before."""
    before = F.lag(value).over(W.partitionBy(group).orderBy(axis))
    return tops.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def first_switch(tops: DataFrame, axis: str, group: str = "work", value: str = "home") -> DataFrame:
    """For each group the first point of ``axis`` at which its value differs from that at the start."""
    w = W.partitionBy(group).orderBy(axis)
    changed = tops.withColumn("base", F.first(value).over(w)).filter(F.col("base") != F.col(value))
    return changed.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
