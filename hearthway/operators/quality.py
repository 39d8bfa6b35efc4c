"""Integrity checks, orphan handling and quality grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grades from best to worst.
GRADES = ["ok", "low_confidence", "unreliable", "no_data"]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; empty if the key is unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def row_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Rows of each table against what is expected."""
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n", F.lit(expected[k]).cast("long").alias("expected")) for k, d in tables.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("verdict", F.when(F.col("n") == F.col("expected"), "ok").otherwise("differs"))


def split_orphans(df: DataFrame, dim: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key the dimension has, and the others (a null key is an orphan)."""
    keys = dim.select(key).distinct()
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def failed_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, bad) for each named condition of a bad row; one pass."""
    one = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"c{i}").alias("bad")) for i, k in enumerate(checks)]))
    return one.select(rows.alias("r")).select("r.*")


def grade(df: DataFrame, rules: list[tuple[Column, str, str]]) -> DataFrame:
    """Add the worst ``status`` of the rules that hold and ``reasons``, in order of the rules."""
    level = F.greatest(F.lit(0), *[F.when(c, F.lit(GRADES.index(s))).otherwise(F.lit(0)) for c, s, _ in rules])
    status = F.element_at(F.array(*[F.lit(g) for g in GRADES]), level + 1)
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(why)) for c, _, why in rules]))
    return df.withColumn("status", status).withColumn("reasons", reasons)


def profile(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, nulls, mean, deviation, seven percentiles, CV and values outside the 1.5 IQR fences."""
    x = F.col(value)
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)]))
    stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), q.alias("q"))
    low, high = F.col("q")[2] - 1.5 * (F.col("q")[4] - F.col("q")[2]), F.col("q")[4] + 1.5 * (F.col("q")[4] - F.col("q")[2])
    fences = stats.withColumns({"lo": low, "hi": high})
    out = df.select(*by, value).join(fences.select(*by, "lo", "hi"), by).groupBy(*by).agg(F.count_if((x < F.col("lo")) | (x > F.col("hi"))).alias("outliers"))
    return fences.join(out, by).withColumn("cv", F.try_divide("sd", "mean"))


def geocode_audit(rows: DataFrame, ok: str, address: str, gu: str, point: list[str], city: str) -> DataFrame:
    """Counts of failures, of addresses outside the city, of found addresses without their district, of shared points.

    Points are counted first, so no task holds all rows of a hot one.
    """
    each = rows.groupBy(*point).agg(
        F.count(F.lit(1)).alias("k"), F.count_if(~F.col(ok)).alias("failed"), F.count_if(~F.coalesce(F.col(address), F.lit("")).startswith(city)).alias("outside"),
        F.count_if(F.col(ok) & ~F.coalesce(F.contains(F.col(address), F.concat(F.col(gu), F.lit(" "))), F.lit(False))).alias("other_gu"),
    )
    return each.agg(F.sum("k").alias("n"), *[F.sum(c).alias(c) for c in ("failed", "outside", "other_gu")], F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("repeated"))
