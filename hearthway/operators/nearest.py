"""Near points by cells: those within a radius, and the nearest ones by widening cells until nothing can be nearer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.sources.stage import forget, settle

EARTH_KM = 6371.0088


def sphere(lat: Column, lng: Column) -> dict[str, Column]:
    """A point on the globe in kilometres along three axes: the chord between two points grows with their distance."""
    a, b = F.radians(lat), F.radians(lng)
    return {"_x": EARTH_KM * F.cos(a) * F.cos(b), "_y": EARTH_KM * F.cos(a) * F.sin(b), "_z": EARTH_KM * F.sin(a)}


def _around(df: DataFrame, coords: list[str], width: Column | float) -> DataFrame:
    """A row for each cell beside or at a point's own: 3 to the power of the coordinates."""
    for i, c in enumerate(coords):
        df = df.withColumn(f"_c{i}", F.explode(F.sequence(F.floor(F.col(c) / width) - 1, F.floor(F.col(c) / width) + 1)))
    return df


def _in_cells(df: DataFrame, coords: list[str], width: float) -> DataFrame:
    return df.withColumns({f"_c{i}": F.floor(F.col(c) / width) for i, c in enumerate(coords)})


def _squared(coords: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.col(f"_o{c}"), 2) for c in coords])


def _others(points: DataFrame, on: list[str], coords: list[str], keep: list[str]) -> DataFrame:
    return points.select(*on, *[F.col(c).alias(f"_o{c}") for c in coords], *keep)


def within(left: DataFrame, right: DataFrame, on: list[str], coords: list[str], radius: float, keep: list[str]) -> DataFrame:
    """Pairs of ``left`` and ``right`` equal in ``on`` and at most ``radius`` apart, with ``keep`` of the right; ``_d2`` is their
    distance squared. Points meet only in neighbouring cells as wide as the radius."""
    cells = [f"_c{i}" for i in range(len(coords))]
    there = _in_cells(right, coords, radius)
    met = _around(left, coords, radius).join(_others(there, [*on, *cells], coords, keep), [*on, *cells])
    return met.withColumn("_d2", _squared(coords)).filter(F.col("_d2") <= radius * radius).drop(*cells)


def nearest(left: DataFrame, right: DataFrame, key: str, on: list[str], coords: list[str], k: int, keep: list[str], tie: str, digits: int = 9) -> DataFrame:
    """The ``k`` nearest of ``right`` (all where there are fewer) for each row of ``left``, among those equal in ``on``.

    ``key`` tells the rows of ``left`` apart; distances squared (``_d2``) are compared with ``digits`` decimals, then ``tie``
    (one of ``keep``); ``k`` numbers them. In a round a point meets the points of its own and the neighbouring cells. It is done once its
    k-th is nearer than the rim of these cells, which no other point lies within; else the next round doubles the cells.
    So a point meets a fixed number of cells a round, and the rounds grow with the logarithm of the extent.
    """
    cells = [f"_c{i}" for i in range(len(coords))]
    extent = right.agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(f"r{i}") for i, c in enumerate(coords)], *[F.max(F.abs(c)).alias(f"m{i}") for i, c in enumerate(coords)]).first()
    reach = max([float(extent[f"r{i}"] or 0) for i in range(len(coords))] + [1e-9])
    n = extent["n"]
    if not n:
        return left.select(key, *on).join(_others(right, on, coords, keep), on).select(key, *keep, F.lit(0.0).alias("_d2"), F.lit(1).alias("k"))
    # about k points a cell where they lie evenly; the last round is wide enough for any point to meet all
    width = reach / max(1.0, (n / k) ** (1 / len(coords)))
    wanted = settle(left.join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_all")), on))
    farthest = max(float(wanted.agg(F.max(F.abs(c))).first()[0] or 0) for c in coords) + max(float(extent[f"m{i}"] or 0) for i in range(len(coords)))
    found = []
    while True:
        last = width > 2 * farthest
        near = _around(wanted.withColumn("_rim", F.lit(float(width))), coords, width)
        met = near.join(_others(_in_cells(right, coords, width), [*on, *cells], coords, keep), [*on, *cells]).withColumn("_d2", F.round(_squared(coords), digits))
        ranked = met.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy("_d2", tie))).filter(F.col("k") <= k)
        ranked = settle(ranked.select(key, *keep, "_d2", "k", "_rim", "_all"))
        sure = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("_got"), F.max("_d2").alias("_far"), F.first("_all").alias("_every"), F.first("_rim").alias("_edge"))
        # a rounding of the k-th distance may not hide a point behind the rim
        enough = (F.col("_got") == F.col("_every")) | (F.col("_got") >= k) & (F.sqrt("_far") + 10.0 ** (-digits / 2) < F.col("_edge"))
        done = settle(sure.filter(F.lit(True) if last else enough).select(key))
        found.append(ranked.join(done, key, "left_semi").select(key, *keep, "_d2", "k"))
        rest = settle(wanted.join(done, key, "left_anti"))
        forget(wanted)
        wanted, width = rest, 2 * width
        if last or not wanted.limit(1).count():
            return reduce(DataFrame.unionByName, found)
