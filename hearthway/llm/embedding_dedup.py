"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors of a label are ordered lexicographically by the concatenated signs of random projections, and
each is compared with its neighbours in a bounded window. Verified links of all passes are united.

How many passes a label takes follows from its size and its density, which is measured first: signs tell less where all
vectors are alike. Passes are then doubled until a round joins nothing new, as a label may have parts that are denser than
its whole. Only labels whose windows would hold several times as many pairs as there are get their pairs compared block
against block instead. The links of each component are counted block against block, so a group of near-copies larger than
a window loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, numbered_within, settle, ship, spread_join, with_row
from .components import components

#: Projections in a key, vectors in a block of positions, and before it, that a window holds.
SIGNS, WINDOW, OVERLAP = 48, 2048, 256
#: Share of a label's links that its first passes shall find; times all pairs that windows may hold before blocks take over.
RECALL, EXCESS = 0.99, 8.0
#: Vectors in a block of an exact comparison.
BLOCK = 4096
#: Vectors that a task compares with all of the others at once.
STRIP = 512


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.vstack(vectors.to_numpy()).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def centres(vectors: DataFrame) -> DataFrame:
    """label, dim, centre: the mean of each label's unit vectors. Batches are summed up before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, dim), part in batch.groupby(["label", "dim"]):
                yield pd.DataFrame({"label": [label], "dim": [int(dim)], "total": [_unit(part["embedding"]).sum(axis=0)], "n": [len(part)]})

    sums = vectors.select("label", "dim", "embedding").mapInPandas(run, "label string, dim int, total array<double>, n long")
    each = sums.select("label", "dim", "n", F.posexplode("total").alias("i", "x")).groupBy("label", "dim", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    return each.groupBy("label", "dim").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select("label", "dim", F.col("c.x").alias("centre"))


def label_plan(vectors: DataFrame, threshold: float, window: int, overlap: int, recall: float) -> DataFrame:
    """label, dim, centre, n, passes: the passes after which a label is expected to have found ``recall`` of its links.

    The squared length of the centre is the label's mean cosine. Seen from the centre, vectors at a cosine of ``threshold``
    stand at an angle that grows with it; a sign tells them apart with the angle's share of a half turn. They meet in a
    pass if they agree on the signs that part the label into pieces of ``overlap`` vectors. A window's label needs one pass.
    """
    sizes = vectors.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    spread = F.greatest(F.lit(1e-9), 1 - F.aggregate("centre", F.lit(0.0), lambda t, x: t + x * x))
    agree = 1 - F.acos(F.greatest(F.lit(0.0), 1 - F.lit(1 - threshold) / spread)) / float(np.pi)
    meet = F.when(F.col("n") <= window, F.lit(1.0)).otherwise(F.pow(agree, F.log2(F.col("n") / F.lit(overlap))))
    passes = F.when(meet >= recall, F.lit(1)).otherwise(F.ceil(F.lit(float(np.log(1 - recall))) / F.log1p(-meet)))
    return sizes.join(centres(vectors), ["label", "dim"]).withColumn("passes", passes.cast("long"))


def sort_keys(vectors: DataFrame, plan: DataFrame, signs: int, seed: int) -> DataFrame:
    """A row for each vector and pass: rep, label, dim, pass, key; the key is the projections' signs as a number.

    ``plan`` has label, dim, centre and the passes from ``first`` to before ``last`` of each label. Vectors are projected
    from the centre of their label, so that the signs separate a dense label too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (dim, first, last), part in batch.groupby(["dim", "first", "last"]):
                x = _unit(part["embedding"]) - np.vstack(part["centre"].to_numpy())
                for at in range(int(first), int(last)):
                    planes = np.random.default_rng([seed, int(dim), at]).standard_normal((int(dim), signs))
                    key = (x @ planes > 0) @ (1 << np.arange(signs, dtype=np.int64)[::-1])
                    yield pd.DataFrame({"rep": part["rep"].to_numpy(), "label": part["label"].to_numpy(), "dim": int(dim), "pass": at, "key": key})

    placed = vectors.join(plan.select("label", "dim", "centre", "first", "last"), ["label", "dim"])
    return placed.select("rep", "label", "dim", "embedding", "centre", "first", "last").mapInPandas(run, "rep long, label string, dim int, pass int, key long")


def _forest(own: pd.DataFrame, every: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Edges (a, b) of a forest that connects what links between ``own`` and ``every``, compared in strips."""
    x, y, ids = _unit(own["embedding"]), _unit(every["embedding"]).T, every["rep"].to_numpy()
    place = {rep: i for i, rep in enumerate(ids)}
    starts = np.array([place.setdefault(rep, len(place)) for rep in own["rep"]])
    group, edges = np.arange(len(place)), []
    for at in range(0, len(x), STRIP):
        linked = x[at : at + STRIP] @ y >= threshold
        # no vector is a link of its own
        here = np.flatnonzero(starts[at : at + STRIP] < len(ids))
        linked[here, starts[at + here]] = False
        for i in np.flatnonzero(linked.any(axis=1)):
            js = np.flatnonzero(linked[i])
            for g, first in zip(*np.unique(group[js], return_index=True), strict=True):
                if g != group[starts[at + i]]:
                    edges.append((own["rep"].iat[at + i], ids[js[first]]))
                    group[group == g] = group[starts[at + i]]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def all_links(vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    """Edges (a, b) that connect all that links within each label and dimension: every pair of its blocks is compared."""
    group = ["label", "dim"]
    vectors = settle(vectors.select("rep", *group, "embedding", "n"), "embedding-all")
    numbered = numbered_within(vectors, group, F.pmod(F.xxhash64("rep"), F.lit(64)), name="k", order=[F.col("rep")])
    numbered = numbered.withColumn("own", F.floor(F.col("k") / block)).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)))
    paired = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("rep", *group, "embedding", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = (pdf[pdf["own"] == pdf[c].iat[0]].sort_values("rep") for c in ("x", "y"))
        return _forest(one, two, threshold)

    # a stated number of partitions is not coalesced, so the comparisons spread over all tasks
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paired.repartition(parts, *group, "x", "y").groupBy(*group, "x", "y").applyInPandas(forest, "a long, b long")


def window_links(vectors: DataFrame, plan: DataFrame, threshold: float, signs: int, window: int, overlap: int, seed: int) -> DataFrame:
    """Edges (a, b) that connect what the windows find: in each window and pass, a forest of the verified links.

    A window holds the vectors at positions k * window to (k + 1) * window of a pass and label, and the ``overlap``
    before them; so each vector goes to little more than one task a pass, and is compared with at least ``overlap``
    neighbours on either side.
    """
    group = ["pass", "label", "dim"]
    # positions: keys are dealt into ranges that samples even out, whose counts are summed before rows are numbered in theirs
    keys = settle(sort_keys(vectors, plan, signs, seed), "embedding-keys")
    ranged = settle(keys.repartitionByRange(*group, "key", "rep").withColumn("range", F.spark_partition_id()), "embedding-ranges")
    placed = numbered_within(ranged, group, F.col("range"), name="position", order=[F.col("key"), F.col("rep")])
    win = F.floor(F.col("position") / window)
    near_end = F.col("position") % window >= window - overlap
    wins = F.when(near_end, F.array(F.struct(win.alias("win"), F.lit(True).alias("own")), F.struct((win + 1).alias("win"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(win.alias("win"), F.lit(True).alias("own"))))
    windows = placed.select("rep", *group, F.explode(wins).alias("w")).select("rep", *group, "w.win", "w.own")
    filled = windows.join(vectors.select("rep", "embedding"), "rep")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["own"]].sort_values("rep")
        if not len(own):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        every = pd.concat([own, pdf[~pdf["own"]].sort_values("rep")])
        return _forest(own, every, threshold)

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = settle(filled.repartition(parts, *group, "win").groupBy(*group, "win").applyInPandas(forest, "a long, b long"), "embedding-links")
    forget(keys)
    forget(ranged)
    return links


def connecting_links(vectors: DataFrame, threshold: float, signs: int, window: int, overlap: int, recall: float, excess: float, block: int, seed: int) -> DataFrame:
    """Edges (a, b) that connect the links of ``vectors`` (settled), from as many passes as each label needs.

    All labels take the passes of their plan. Those of more than a window then take as many again, and are done when that
    joins nothing new; else they take twice as many, and so on. Labels whose passes would hold over ``excess`` times as
    many pairs as there are need no more of them: their blocks are compared pairwise, which loses no link.
    """
    group = ["label", "dim"]
    planned = settle(label_plan(vectors, threshold, window, overlap, recall), "embedding-plan")
    most = F.greatest(F.lit(1.0), F.lit(excess) * F.col("n") / F.lit(window + 2 * overlap))
    begun = planned.withColumn("first", F.lit(0).cast("long")).withColumn("last", F.when(F.col("n") <= window, F.lit(1)).otherwise(F.least("passes", F.ceil(most))).cast("long"))
    links = [window_links(vectors, begun, threshold, signs, window, overlap, seed)]
    left, found = begun.filter(F.col("n") > window), None
    while not left.isEmpty():
        some = settle(vectors.join(left.select(*group), group), "embedding-open")
        hard = left.filter(F.greatest("passes", "last") > most)
        if not hard.isEmpty():
            dense = some.join(hard.select(*group, "n"), group)
            links.append(settle(all_links(dense, threshold, block), "embedding-links"))
            left = left.filter(F.greatest("passes", "last") <= most)
        if not left.isEmpty():
            found = found if found is not None else components(reduce(DataFrame.unionByName, links))
            left = settle(left.withColumn("first", F.col("last")).withColumn("last", F.col("last") * 2), "embedding-labels")
            open_now = some.join(left.select(*group), group)
            links.append(window_links(open_now, left, threshold, signs, window, overlap, seed))
            before, found = found, components(reduce(DataFrame.unionByName, links))
            joined = found.join(before.withColumnRenamed("component", "was"), "id", "left").filter(~F.col("was").eqNullSafe(F.col("component")))
            news = some.join(joined.select(F.col("id").alias("rep")), "rep").select(*group).distinct()
            left = settle(left.join(news, group), "embedding-labels")
        forget(some)
    return reduce(DataFrame.unionByName, links)


def count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(rep, links): for each of members(rep, component, many, embedding) the vectors of its component at ``threshold``.

    Members are numbered in their component and dealt into blocks, sixteen unless that makes them smaller than block / 16
    or larger than ``block``; each pair of blocks is one small group, whose similarities are matrix products. Counts
    leave the task, not pairs.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    chunk = F.pmod(F.xxhash64("rep"), F.lit(64))
    numbered = numbered_within(settle(members, "embedding-members"), ["component"], chunk, name="k", order=[F.col("rep")])
    numbered = numbered.join(sizes, "component").withColumn("block", F.least(F.lit(block), F.greatest(F.lit(max(1, block // 16)), F.ceil(F.col("m") / 16))))
    numbered = numbered.withColumn("own", F.floor(F.col("k") / F.col("block"))).withColumn("blocks", F.ceil(F.col("m") / F.col("block")))
    paired = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("component", "rep", "many", "embedding", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iat[0]), int(pdf["y"].iat[0])
        one, two = pdf[pdf["own"] == x].sort_values("rep"), pdf[pdf["own"] == y].sort_values("rep")
        u, v, m, n = _unit(one["embedding"]), _unit(two["embedding"]).T, one["many"].to_numpy(), two["many"].to_numpy()
        of_one, of_two = np.zeros(len(one), dtype=np.int64), np.zeros(len(two), dtype=np.int64)
        for at in range(0, len(u), STRIP):
            linked = u[at : at + STRIP] @ v >= threshold
            of_one[at : at + STRIP] = linked @ n
            of_two += m[at : at + STRIP] @ linked
        rows = pd.DataFrame({"rep": one["rep"].to_numpy(), "links": of_one})
        return rows if x == y else pd.concat([rows, pd.DataFrame({"rep": two["rep"].to_numpy(), "links": of_two})])

    return paired.groupBy("component", "x", "y").applyInPandas(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, signs: int = SIGNS, window: int = WINDOW, overlap: int = OVERLAP, recall: float = RECALL, excess: float = EXCESS, block: int = BLOCK, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A row for each row of ``vectors``: row_no, vec_id, n_links, component_id, kept.

    Vectors with equal, non-null labels and equal dimensions link at a cosine of ``threshold`` or more, in double
    precision. Null, empty and zero vectors, and vectors with null or non-finite components, link with nothing. Equal
    vectors are compared once and counted as often as they occur; repeated ids are rows of their own, and a null id is
    never a component's id unless all its members' are null. An empty table gives no rows. Other columns are not read.
    """
    ship(vectors.sparkSession)
    numbered, row = with_row(vectors)
    e = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False)) & F.col(label_col).isNotNull()
    vector, label = F.when(sound, F.col(vector_col)), F.col(label_col).cast("string")
    # two hashes of 64 bits stand for the vector and its label in joins
    keys = [F.when(sound, F.xxhash64(F.lit(i), label, vector)).alias(f"h{i}") for i in (1, 2)]
    rows = settle(numbered.select(F.col(row).alias("row_no"), F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vector.alias("embedding"), *keys), "vectors")
    same = rows.filter("embedding is not null").groupBy("h1", "h2").agg(F.min("row_no").alias("rep"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    same = settle(same.withColumn("dim", F.size("embedding")), "vector-classes")
    edges = connecting_links(same, threshold, signs, window, overlap, recall, excess, block, seed)
    found = components(edges.distinct())
    members = same.select("rep", "least", "many", "embedding").join(found.withColumnRenamed("id", "rep"), "rep")
    links = count_links(members.select("rep", "component", "many", "embedding"), threshold, block)
    reached = same.select("rep", "least").join(found.withColumnRenamed("id", "rep"), "rep")
    smallest = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = reached.select("rep", "component").join(smallest, "component").join(links, "rep").select("rep", "component_id", F.col("links").alias("near"))
    # a vector counts all of its class but itself; its own class is among its links where it has any others
    classes = same.select("h1", "h2", "rep", "least", "many").join(placed, "rep", "left")
    classes = settle(classes.select("h1", "h2", "many", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("near", "many") - 1).alias("n_links")), "vector-links")
    slim = rows.select("row_no", "vec_id", "h1", "h2")
    linked = spread_join(slim.filter("h1 is not null"), classes, ["h1", "h2"], "many", F.col("row_no")).select("row_no", "vec_id", "n_links", "component_id")
    alone = slim.filter("h1 is null").select("row_no", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(m.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN many m ON m.a = e.vec_id
"""
