"""MinHash near-duplicates with HyperMinHash sketches.

A sketch has a register for each bucket of the hash range: the leading zeros of the bucket's smallest hash and the
mantissa bits behind them. Bands of compressed registers give candidates, a collision-corrected Jaccard estimate thins
them, and full shingle sets confirm them. Equal sets are one node from the start, so copies cost nothing.

Candidates of a bucket of near-copies are not all paired. First each member meets the bucket's smallest member; links
are confirmed and united. Only buckets that still hold several components go on: blocks of bounded size compare
registers, and forward a best-first forest over the pairs of different components. Members that may still link different
components after that meet once more with their full sets, and the task itself decides. So no link is lost, and no task
puts out more pairs than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import BlockedBloom
from .common import drop_rows, forget, let_go, settle, settled_rows, ship, spread_join, tidy
from .components import components

#: Registers, mantissa bits, registers in a band, members of a bucket that one task compares.
REGISTERS, MANTISSA, BAND, BLOCK = 256, 10, 8, 512
#: Standard errors that the estimate may fall below the threshold before a candidate is dropped.
SLACK = 4.0

_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = h + _MIX
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased; all words as one if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, len(h) if len(h) < size else size, dtype=np.uint64)
    for i in range(n):
        out = _mixed(out ^ h[i : len(h) - n + 1 + i])
    return np.unique(out)


def _fallback(k: int) -> np.ndarray:
    """For each bucket an order of all buckets: an empty one takes the register of the first that is not empty."""
    return np.argsort(np.random.default_rng(6).random((k, k)), axis=1).argsort(axis=1).astype(np.int32)


_orders: dict[int, np.ndarray] = {}


def sketch(hashes: np.ndarray, k: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """Registers of a set (not empty): leading zeros << mantissa | mantissa bits of the smallest hash in each bucket."""
    h = _mixed(hashes)
    p = np.uint64(k.bit_length() - 1)
    bucket, rest = (h >> (np.uint64(64) - p)).astype(np.int64), h << p >> p
    bits = 64 - int(p)
    least = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, bucket, rest)
    full = least != np.iinfo(np.uint64).max
    zeros = bits - 1 - np.frexp(np.maximum(least, 1).astype(np.float64))[1] + 1
    zeros = np.clip(zeros, 0, min(bits - mantissa - 1, 63))
    after = np.maximum(bits - 1 - zeros - mantissa, 0).astype(np.uint64)
    registers = (zeros.astype(np.uint64) << np.uint64(mantissa)) | ((least >> after) & np.uint64((1 << mantissa) - 1))
    registers = registers.astype(np.uint16)
    if not full.all():
        if k not in _orders:
            _orders[k] = _fallback(k)
        empty = np.flatnonzero(~full)
        order = np.where(full[None, :], _orders[k][empty], k + 1)
        registers[empty] = registers[order.argmin(axis=1)]
    return registers


def corrected(equal: np.ndarray, k: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """Jaccard estimate from shares of equal registers, less what unequal minima share by chance.

    Two different minima agree in leading zeros with probability 1/3 at most and then in the mantissa bits with
    2**-mantissa.
    """
    chance = 2.0**-mantissa / 3
    return np.maximum(0.0, (equal - chance) / (1 - chance))


def sketches(numbered: DataFrame, row: str, k: int, mantissa: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """row_no, doc_id, n_shingles, digest (of the set) and registers of each document; ``row`` numbers the documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            n, digests, registers = [], [], []
            for text in batch["text"]:
                hashes = shingle_hashes(text, size)
                n.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                registers.append(sketch(hashes, k, mantissa).tobytes() if len(hashes) else b"")
            yield pd.DataFrame({"row_no": batch["row_no"], "doc_id": batch["doc_id"].astype("Int64"), "n_shingles": n, "digest": digests, "registers": registers})
        tidy()

    source = numbered.select(F.col(row).alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInPandas(run, "row_no long, doc_id long, n_shingles long, digest binary, registers binary")


def _both(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Settled pairs (a, b) with ``column`` of both; a hub that many pairs share is split over several tasks."""
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).join(nodes.withColumnsRenamed({"node": "a", column: "one"}), "a")
    return spread_join(pairs, hubs, ["a"], "_n", F.col("b")).drop("_n").join(nodes.withColumnsRenamed({"node": "b", column: "two"}), "b")


def _estimated(pairs: DataFrame, nodes: DataFrame, floor: float, k: int, mantissa: int) -> DataFrame:
    """Pairs (a, b) whose estimate is at least ``floor``."""

    @F.pandas_udf("boolean")
    def near(one: pd.Series, two: pd.Series) -> pd.Series:
        if not len(one):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(s), k) for s in (one, two))
        return pd.Series(corrected((x == y).mean(axis=1), k, mantissa) >= floor)

    return _both(pairs, nodes, "registers").filter(near("one", "two")).select("a", "b")


def _common(a: bytes, b: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64), assume_unique=True))


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs with 100 * intersection >= threshold * union of the full sets."""

    @F.pandas_udf("long")
    def common(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([_common(a, b) for a, b in zip(one, two, strict=True)], dtype="int64")

    n = (F.octet_length("one") + F.octet_length("two")) / 8
    both = _both(pairs, sets, "set").withColumn("both", common("one", "two"))
    return both.filter(100 * F.col("both") >= threshold * (n - F.col("both"))).select("a", "b")


class _Union(dict):
    """Groups of components within a task."""

    def top(self, c: int) -> int:
        while self.setdefault(c, c) != c:
            self[c] = self[self[c]]
            c = self[c]
        return c

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _near_rows(x: np.ndarray, row: np.ndarray, floor: float, k: int, mantissa: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of registers ``x`` are near ``row`` by the estimate, and those estimates."""
    equal = np.ascontiguousarray(x == row).view(np.uint64).sum(axis=1)  # eight counts of at most k / 8 in each number
    est = corrected(equal.view(np.uint8).reshape(len(x), 8).sum(axis=1) / k, k, mantissa)
    near = np.flatnonzero(est >= floor)
    return near, est[near]


def _across(dealt: tuple[DataFrame, int], columns: list[DataFrame], floor: float, k: int, mantissa: int, band: int, threshold: int, how: str) -> DataFrame:
    """What (a, b) is found in the blocks that ``_dealt`` gave, over different components; ``columns`` (by node) bring the
    registers and, for "verify", the sets.

    ``how`` is "forest": a best-first forest of the pairs that pass the estimate; "open": the members of such pairs, each
    with itself; "verify": a forest of the pairs whose sets confirm it. A pair that shares several bands is looked at in the
    first of them only. Small blocks come to a task's function many at a time, and none puts out more rows than it has members.
    """

    def block(one: np.ndarray, two: np.ndarray, registers: np.ndarray, nodes: np.ndarray, components: np.ndarray, here: int, same: bool) -> list[tuple]:
        found: list[tuple] = []
        for i in one:
            others = two[(components[two] != components[i]) & ((nodes[two] > nodes[i]) if same else (nodes[two] != nodes[i]))]
            if not len(others):
                continue
            near, est = _near_rows(registers[others], registers[i], floor, k, mantissa)
            if len(near):
                near = others[near]
                first = (registers[near] == registers[i]).reshape(-1, k // band, band).all(axis=2).argmax(axis=1) == here
                found.extend((-e, min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), i, j) for e, j in zip(est[first].tolist(), near[first].tolist(), strict=True))
        return found

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "x", "y", "node"], ignore_index=True)
        registers = np.frombuffer(b"".join(pdf["registers"]), dtype=np.uint16).reshape(len(pdf), k)
        nodes, components, sides, bands = (pdf[c].to_numpy() for c in ("node", "component", "side", "band"))
        sets = pdf["set"].to_numpy() if how == "verify" else None
        cell = pdf[["key", "x", "y"]].to_numpy()
        cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        kept: list[tuple] = []
        for lo, hi in pairwise(cuts):
            if (components[lo:hi] == components[lo]).all():
                continue
            one, two = (lo + np.flatnonzero(s) for s in (sides[lo:hi] <= 1, sides[lo:hi] >= 1))
            if not len(one) or not len(two):
                continue
            found = block(one, two, registers, nodes, components, int(bands[lo]), sides[one[0]] == 1)
            if how == "open":
                kept.extend((n, n) for n in sorted({n for f in found for n in f[1:3]}))
                continue
            groups = _Union()
            for e in sorted(found):
                i, j = e[3:]
                if groups.top(int(components[i])) == groups.top(int(components[j])):
                    continue
                if how == "verify":
                    both = _common(sets[i], sets[j])
                    if 100 * both < threshold * ((len(sets[i]) + len(sets[j])) // 8 - both):
                        continue
                groups.join(int(components[i]), int(components[j]))
                kept.append(e[1:3])
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    members, rows = dealt
    for one in columns:
        members = members.join(one, "node")
    # sets are far longer than registers; a stated number of partitions is not coalesced, so the comparisons spread over all tasks
    many = max(1, -(-rows // (512 if how == "verify" else 4096)))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = members.withColumn("deal", F.pmod(F.xxhash64("key", "x", "y"), F.lit(many)))
    return members.repartition(parts, "deal").groupBy("deal").applyInPandas(run, "a long, b long")


def _dealt(placed: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Members of buckets that hold several components, once for each pair of blocks: key, band, node, component, x, y, side;
    and how many rows these are."""
    mixed = settle(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi").select("key", "m", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("blocks")), "mixed-buckets")
    rows = mixed.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
    members = spread_join(placed, mixed, ["key"], "m", F.col("node")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2)
    return paired.select("key", "band", "node", "component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side")), rows


def grouped(docs: DataFrame, threshold: int = 85, size: int = 5, k: int = REGISTERS, mantissa: int = MANTISSA, band: int = BAND, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """A row for each row of ``docs``: row_no, doc_id, n_shingles, component_id, component (a row number of the group).

    Documents link when 100 * intersection >= ``threshold`` * union of their sets of distinct ``size``-word shingles;
    component_id is the smallest doc_id reachable. Documents without words, and null texts, have an empty set and link
    with nothing. Bands of 8 out of 256 registers miss a pair just at the threshold of 0.85 with probability 4e-5.
    Repeated rows are rows of their own. A null id is a component's id only if all its members' are null. Other columns are not read; an empty table gives no rows. Texts are read twice:
    ``docs`` may bring the numbers of ``settled_rows`` as ``row_col``, else its texts are written once with theirs.
    """
    spark = docs.sparkSession
    ship(spark)
    share = threshold / 100
    floor = share - SLACK * (share * (1 - share) / k) ** 0.5
    numbered, row = (docs, row_col) if row_col else settled_rows(docs.select(id_col, text_col))
    table = settle(sketches(numbered, row, k, mantissa, size, id_col, text_col), "sketches")
    nodes = settle(
        table.filter("n_shingles > 0").groupBy("digest").agg(F.min("row_no").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("registers").alias("registers")),
        "sketch-nodes",
    )
    bands = F.array(*[F.xxhash64(F.substring("registers", 2 * band * i + 1, 2 * band), F.lit(i)) for i in range(k // band)])
    banded = nodes.select("node", F.posexplode(bands).alias("band", "key"))
    buckets = settle(banded.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("in_key")).filter("in_key > 1"), "buckets")
    bucketed = settle(spread_join(banded, buckets, ["key"], "in_key", F.col("node")), "bucket-members")
    wanted = settle(bucketed.select("node").distinct(), "bucket-nodes")
    held = settle(nodes.select("node", "registers").join(wanted, "node", "left_semi"), "bucket-registers")
    # Full sets of the nodes that share a bucket, from whole texts. A Bloom filter of those nodes saves a shuffle of the
    # texts; sets of others that it lets through are never asked for.
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(wanted, "node").words)

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            some = batch[BlockedBloom(bloom.value).passes(batch["hash"].to_numpy())]
            yield pd.DataFrame({"node": some["node"], "set": [shingle_hashes(t, size).tobytes() for t in some["text"]]})
        tidy()

    texts = numbered.select(F.col(row).alias("node"), F.xxhash64(row).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = settle(texts.mapInPandas(full, "node long, set binary"), "shingle-sets")
    if not row_col:
        forget(numbered)

    star = settle(bucketed.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    near = settle(_estimated(star, held, floor, k, mantissa), "pairs")
    links = [settle(_confirmed(near, sets, threshold), "links")]

    def placed(of: DataFrame) -> DataFrame:
        found = components(reduce(DataFrame.unionByName, links))
        joined = of.join(found.withColumnRenamed("id", "node"), "node", "left")
        return settle(joined.select("key", "band", "node", F.coalesce("component", "node").alias("component")), "bucket-components")

    forest = settle(_across(_dealt(placed(bucketed), block), [held], floor, k, mantissa, band, threshold, "forest"), "pairs")
    links.append(settle(_confirmed(forest.join(star, ["a", "b"], "left_anti"), sets, threshold), "links"))
    # what may still link different components is decided where its members meet, so that no pair is put out undecided
    rest = placed(bucketed)
    undecided = settle(_across(_dealt(rest, block), [held], floor, k, mantissa, band, threshold, "open").select(F.col("a").alias("node")).distinct(), "open-nodes")
    members = _dealt(rest.join(undecided, "node", "left_semi"), block)
    links.append(settle(_across(members, [held, sets], floor, k, mantissa, band, threshold, "verify"), "links"))
    for done in (star, near, forest, rest, undecided, bucketed, held, sets):
        forget(done)
    found = components(reduce(DataFrame.unionByName, links))
    classes = nodes.select("digest", "node", "least", "many").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = settle(classes.join(smallest, "component").select("digest", "many", "component_id", "component"), "near-classes")
    rows = table.select("row_no", "doc_id", "n_shingles", "digest")
    linked = spread_join(rows.filter("n_shingles > 0"), classes, ["digest"], "many", F.col("row_no")).select("row_no", "doc_id", "n_shingles", "component_id", "component")
    alone = rows.filter("n_shingles = 0").select("row_no", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row_no").alias("component"))
    return linked.unionByName(alone)


def near_documents(docs: DataFrame, **how) -> DataFrame:
    """A row for each row of ``docs``: row_no, doc_id, n_shingles, component_id, kept; see ``grouped``.

    Every row with its component's id is kept, and so is every row of a component without an id.
    """
    return grouped(docs, **how).drop("component").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each group of near-duplicates the one with the smallest id,
    of several such rows one."""
    numbered, row = settled_rows(docs)
    judged = settle(grouped(numbered, row_col=row, **how).select("row_no", "doc_id", "component"), "near-groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("least")
    stay = judged.groupBy("component").agg(least).select("least.row_no")
    return drop_rows(numbered, row, settle(judged.join(stay, "row_no", "left_anti").select("row_no"), "near-copies"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_documents(docs).select("doc_id", "n_shingles", "component_id", "kept")
