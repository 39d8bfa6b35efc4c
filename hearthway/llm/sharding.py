"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are linked when they belong to the same group (equal texts by default). Linked documents start in a hashed
shard and move, round by round, to the shard that holds most of their neighbours. Each shard admits only what its
quota of bytes allows. Small groups that are torn in the end are placed as a whole. Documents without
links cost no cut edge wherever they go, so they even the shards out at the end, large ones first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, numbered_within, settle, spread_join, uniform, with_row

#: Parts of the hash range that free documents are dealt by; a table of this many rows is summed up in one task.
BINS = 16384
#: Free documents are dealt in these steps, those over a fraction of a shard first, so that small ones close the gaps.
STEPS = (32, 512)
#: A group of at most this fraction of a shard moves as a whole.
WHOLE = 32


def _loads(df: DataFrame, shards: int) -> list[int]:
    """Bytes by shard: one number for each shard on the driver."""
    found = {r["shard"]: r["load"] for r in df.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    return [int(found.get(s) or 0) for s in range(shards)]


def _at(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + 1)


def propagate(linked: DataFrame, shards: int, quota: float, rounds: int = 6) -> DataFrame:
    """Move linked documents (row_no, size, group, group_bytes, shard) towards their neighbours' shards.

    In a round each group prefers the shard with most of its members among those with room. Its members elsewhere
    may move there if that shard holds more of them than their own. What would overfill a shard is thinned by hash:
    whole groups where they are small, documents where a group is large, so a hot group spreads over several shards.
    """
    for _ in range(rounds):
        room = [max(0.0, quota - x) for x in _loads(linked, shards)]
        held = linked.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("cnt"), F.sum("size").alias("bytes"), F.first("group_bytes").alias("group_bytes"))
        pull = F.struct(F.col("cnt"), F.xxhash64("group", "shard").alias("tie"), F.col("shard"))
        best = held.filter(_at(room, F.col("shard")) > 0).groupBy("group").agg(F.max(pull).alias("best"))
        plan = held.join(best, "group", "left")
        moves = (F.col("best.cnt") > F.col("cnt")) | ((F.col("best.cnt") == F.col("cnt")) & (F.col("best.tie") > F.xxhash64("group", "shard")))
        plan = settle(plan.withColumn("target", F.when(F.coalesce(moves, F.lit(False)), F.col("best.shard")).otherwise(F.col("shard"))).drop("best"), "shard-moves")
        asked = {r["target"]: float(r["b"]) for r in plan.filter("target <> shard").groupBy("target").agg(F.sum("bytes").alias("b")).collect()}
        if not asked:
            forget(plan)
            break
        admitted = [min(1.0, room[s] / asked[s]) if asked.get(s) else 1.0 for s in range(shards)]
        joined = spread_join(linked, plan.select("group", "shard", "cnt", "target"), ["group", "shard"], "cnt", F.col("row_no"))
        whole = F.col("group_bytes") <= F.lit(quota / WHOLE)
        draw = F.when(whole, uniform(F.col("group"), seed="admit")).otherwise(uniform(F.col("row_no"), seed="admit"))
        moved = joined.withColumn("shard", F.when(draw < _at(admitted, F.col("target")), F.col("target")).otherwise(F.col("shard"))).drop("cnt", "target")
        moved, last = settle(moved, "shard-state"), linked
        forget(plan)
        forget(last)
        linked = moved
    return linked


def _deal(free: DataFrame, room: list[float]) -> DataFrame:
    """Give free documents shards in proportion to ``room``: cut the hash range where its summed bytes say.

    Documents of one ``unit`` stay together.
    """
    total = sum(room) or 1.0
    edges = [sum(room[: s + 1]) / total for s in range(len(room) - 1)]
    binned = free.withColumn("_bin", F.floor(uniform(F.col("unit"), seed="deal") * BINS).cast("int"))
    sums = binned.groupBy("_bin").agg(F.sum("size").alias("_b"))
    upto = F.sum("_b").over(W.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
    every = F.sum("_b").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    middle = (upto - F.col("_b") / 2) / every
    shard = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>"), lambda e: e <= middle))
    # BINS rows at most, whatever the data
    return binned.join(F.broadcast(sums.select("_bin", shard.cast("int").alias("shard"))), "_bin").drop("_bin")


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None) -> DataFrame:
    """Put every row of ``docs`` into one of ``shards`` of nearly equal bytes, keeping groups together where they fit.

    Returns row_no, doc_id, size (UTF-8 bytes + 1; a null text counts as empty), text_crc32, group, shard and slot
    (gapless from 0 in the shard). ``group`` names what links documents: equal texts if not given; a null group links
    nothing. Repeated rows are rows of their own. An empty table gives no rows. Other columns are not read.
    """
    numbered, row = with_row(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.sha2(text.cast("binary"), 256) if group is None else group.cast("string")
    base = settle(numbered.select(F.col(row).alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(key, F.concat(F.lit("row "), F.col(row))).alias("group")), "shard-base")
    groups = settle(base.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("group_bytes")), "shard-groups")
    total, count = groups.agg(F.sum("group_bytes"), F.sum("n")).first()
    fair, count = (total or 0) / shards, count or 0
    joined = spread_join(base, groups, ["group"], "n", F.col("row_no"))
    start = F.floor(uniform(F.col("row_no"), seed="start") * shards).cast("int")
    state = settle(joined.withColumn("shard", F.when(F.col("n") > 1, start)), "shard-start")
    free = state.filter("n = 1").drop("n", "shard")
    linked = propagate(state.filter("n > 1").drop("n"), shards, fair, rounds)

    # small groups that no shard had room for are still torn: they are free to go elsewhere as a whole
    whole = F.col("group_bytes") <= F.lit(fair / WHOLE)
    torn = settle(linked.filter(whole).groupBy("group").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).filter("lo <> hi").select("group", F.lit(True).alias("torn")), "shard-torn")
    row_unit = F.concat_ws(" ", "group", "row_no")
    linked = linked.join(torn, "group", "left").withColumn("torn", F.coalesce("torn", F.lit(False)))
    linked = linked.withColumn("unit", F.when(whole, F.col("group")).otherwise(row_unit)).withColumn("unit_bytes", F.when(whole, F.col("group_bytes")).otherwise(F.col("size")))
    # and so is what still exceeds a shard's fair share: small groups as a whole, large ones by documents
    over = [max(0.0, x - fair) / x if x else 0.0 for x in _loads(linked.filter("not torn"), shards)]
    spilled = F.col("torn") | (uniform(F.col("unit"), seed="spill") < _at(over, F.col("shard")))
    free = free.withColumn("unit", row_unit).withColumn("unit_bytes", F.col("size"))
    stay, free = linked.filter(~spilled).drop("torn"), free.unionByName(linked.filter(spilled).drop("shard", "torn"))
    placed = settle(stay, "shard-linked")
    bounds = [None, *[fair / k for k in STEPS], 0.0]
    for high, low in zip(bounds, bounds[1:], strict=False):
        part = free.filter((F.col("unit_bytes") > low) & (F.col("unit_bytes") <= high if high is not None else F.lit(True)))
        room = [max(0.0, fair - x) for x in _loads(placed, shards)]
        dealt = _deal(part, room if sum(room) > 0 else [1.0] * shards)
        placed, last = settle(placed.unionByName(dealt), "shard-placed"), placed
        forget(last)
    parts = max(1, count // (shards * 4096))
    chunk = F.pmod(F.xxhash64("row_no"), F.lit(parts))
    return numbered_within(placed, ["shard"], chunk, name="slot", order=[F.col("doc_id"), F.col("row_no")]).drop("group_bytes", "unit", "unit_bytes")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shard_documents(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
