"""Origin-destination flows: weighted means, shares, threshold selection, coverage, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.functions.clean import sql_round


def weighted_od(trips: DataFrame, keys: list[str], weight: str, values: list[str], decimals: int = 6) -> DataFrame:
    """Sum of ``weight``, weighted means of ``values`` and row count by ``keys``; null keys are groups of their own."""
    means = [sql_round(F.sum(F.col(v) * F.col(weight)) / F.sum(weight), decimals).alias(v) for v in values]
    return trips.groupBy(*keys).agg(F.sum(weight).alias(weight), *means, F.count(F.lit(1)).alias("n_rows"))


def weighted_mean(value: str, weight: str) -> Column:
    """Mean over rows with a value and a positive weight; the plain mean where there is no such row."""
    valid = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.coalesce(F.try_divide(F.sum(F.when(valid, F.col(value) * F.col(weight))), F.sum(F.when(valid, F.col(weight)))), F.avg(value))


def available_mean(value: str, weight: str) -> Column:
    """Weighted mean renormalised over the rows that have the value; null if none has."""
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def coverage(value: str, weight: str) -> Column:
    """Share of the weight whose rows have the value."""
    return F.try_divide(F.sum(F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(F.lit(0))), F.sum(weight))


def running_share(od: DataFrame, home: str = "home", work: str = "work", flow: str = "flow") -> DataFrame:
    """Share, rank and cumulative share of each destination of a home, in order of flow (ties by destination)."""
    part = W.partitionBy(home)
    order = part.orderBy(F.col(flow).desc(), F.col(work))
    total = F.sum(flow).over(part)
    return od.withColumns({
        "share": F.col(flow) / total,
        "dest_rank": F.row_number().over(order),
        "cum_share": F.sum(flow).over(order.rowsBetween(W.unboundedPreceding, 0)) / total,
    })


def select_to_threshold(ranked: DataFrame, threshold: float) -> DataFrame:
    """Destinations up to and including the one that crosses ``threshold``; all where none does."""
    return ranked.filter(F.col("cum_share") - F.col("share") < threshold - 1e-12)


def renormalise(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add ``value`` as a share of its sum in ``key``."""
    return df.withColumn(name, F.col(value) / F.sum(value).over(W.partitionBy(key)))


def undirected(od: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges (a, b, flow) with a < b: both directions summed, internal flow left out. With ``parts`` the flows are dealt over so
    many tasks first: few pairs have both directions, so grouping before a shuffle would only hold memory."""
    ends = od.filter("home <> work").select(F.least("home", "work").alias("a"), F.greatest("home", "work").alias("b"), "flow")
    return (ends.repartition(parts, "a", "b") if parts else ends).groupBy("a", "b").agg(F.sum("flow").alias("flow"))


def node_flows(od: DataFrame, internal: bool = False) -> DataFrame:
    """Inflow, outflow, net and their ratio for every node that occurs on either side; 0 where there is none."""
    used = od if internal else od.filter("home <> work")
    into = used.groupBy(F.col("work").alias("node")).agg(F.sum("flow").alias("inflow"))
    out = used.groupBy(F.col("home").alias("node")).agg(F.sum("flow").alias("outflow"))
    both = into.join(out, "node", "full").na.fill(0, ["inflow", "outflow"])
    return both.withColumns({"net": F.col("inflow") - F.col("outflow"), "in_out_ratio": F.when(F.col("outflow") > 0, F.col("inflow") / F.col("outflow"))})


def concentration(od: DataFrame, home: str = "home", work: str = "work", flow: str = "flow", top: int = 5) -> DataFrame:
    """By home: HHI, entropy (also normalised), effective number, largest and top-3 share, names of the top destinations."""
    ranked = running_share(od, home, work, flow)
    p = F.col("share")
    entropy = F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0)))
    names = F.array_sort(F.collect_list(F.when(F.col("dest_rank") <= top, F.struct("dest_rank", F.col(work).cast("string").alias("name")))))
    out = ranked.groupBy(home).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p * p).alias("hhi"), entropy.alias("entropy"), F.max(p).alias("max_share"),
        F.sum(F.when(F.col("dest_rank") <= 3, p)).alias("top3_share"), names.alias("names"),
    )
    out = out.withColumns({
        "entropy_norm": F.when(F.col("n") > 1, F.col("entropy") / F.ln("n")).otherwise(F.lit(0.0)),
        "effective": F.exp("entropy"),
        "top_names": F.array_join(F.transform("names", lambda x: x["name"]), ", "),
    })
    return out.drop("names")


def internal_share(od: DataFrame) -> DataFrame:
    """Share of a home's flow that stays there."""
    return od.groupBy("home").agg((F.sum(F.when(F.col("home") == F.col("work"), F.col("flow")).otherwise(0)) / F.sum("flow")).alias("internal_share"))
