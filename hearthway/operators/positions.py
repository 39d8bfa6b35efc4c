"""Places of rows in a total order, from range partitions and their counts: no task sorts a whole table or a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.sources.stage import settle


def _columns(order: list) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """``df`` with a gapless place from 0 in ``order``; rows that are equal there get places in any order.

    Rows are dealt by ranges and sorted within them, then moved by the rows of the ranges before: one row a range, of
    which there are at most as many as partitions. The table is written once.
    """
    order = _columns(order)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = settle(ranged).withColumn("_range", F.shiftright("_at", 33))
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = held.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return moved.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_range", "_before")


def tile(position: Column, rows: Column, n: int) -> Column:
    """SQL's ntile: the number from 1 of the part that a place from 0 falls in; the first parts have one row more where rows remain."""
    small, more = F.floor(rows / n), rows % n
    big = more * (small + 1)
    return (F.when(position < big, F.floor(position / (small + 1))).otherwise(more + F.floor((position - big) / F.greatest(small, F.lit(1)))) + 1).cast("int")


def ntiles(df: DataFrame, order: list, n: int, name: str) -> DataFrame:
    """``df`` with its ntile over the whole table."""
    placed = positions(df, order, "_place")
    rows = placed.agg(F.count(F.lit(1)).alias("_rows"))
    return placed.crossJoin(F.broadcast(rows)).withColumn(name, tile(F.col("_place"), F.col("_rows"), n)).drop("_place", "_rows")


def ranks(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with SQL's rank of ``value`` over the whole table, nulls first: different values are placed with their counts."""
    counts = positions(df.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_c")), [F.col("_v").asc_nulls_first()], "_place")
    placed = settle(counts)
    # the rows before a value: by ranges of places, so that no task sums all values
    chunk = placed.withColumn("_chunk", F.shiftright("_place", 12))
    sums = chunk.groupBy("_chunk").agg(F.sum("_c").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("_c").over(W.partitionBy("_chunk").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = chunk.withColumn("_in", inside).join(F.broadcast(sums.select("_chunk", "_base")), "_chunk").select(F.col("_v").alias("_r"), (F.col("_base") + F.col("_in") + 1).cast("long").alias(name))
    return df.withColumn("_v", value).join(found, F.col("_v").eqNullSafe(F.col("_r"))).drop("_v", "_r")
