"""Clustering of scaled features: fits, fuzzy memberships, validity, stability, profiles and names."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.operators.positions import positions


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; 0 where there is no deviation."""
    stats = df.agg(*[f(c).alias(f"{p}{c}") for c in columns for f, p in ((F.avg, "_m_"), (F.stddev_pop, "_s_"))])
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*[f"{p}{c}" for c in columns for p in ("_m_", "_s_")])


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range; 0 where there is no range."""
    stats = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}") for c in columns])
    q = lambda c, i: F.col(f"_q_{c}")[i]
    scaled = {c: F.when(q(c, 2) > q(c, 0), (F.col(c) - q(c, 1)) / (q(c, 2) - q(c, 0))).otherwise(F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*[f"_q_{c}" for c in columns])


def balance_blocks(df: DataFrame, blocks: list[list[str]]) -> DataFrame:
    """Weight each block's columns by sqrt(0.5 / its number), so that blocks count alike."""
    return df.withColumns({c: F.col(c) * (0.5 / len(block)) ** 0.5 for block in blocks for c in block})


def vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="skip").transform(df)


def fit(df: DataFrame, columns: list[str], k: int, method: str = "kmeans", seed: int = 42, keep: DataFrame | None = None) -> DataFrame:
    """Labels of ``df`` (or of ``keep``) from a model fitted on ``df``: its columns and ``label``.

    Nulls of rows that are only labelled are filled with the fitted rows' means.
    """
    maker = {"kmeans": KMeans(k=k, seed=seed, featuresCol="v"), "bisecting": BisectingKMeans(k=k, seed=seed, featuresCol="v"), "mixture": GaussianMixture(k=k, seed=seed, featuresCol="v")}[method]
    model = maker.fit(vectors(df, columns))
    target = df
    if keep is not None:
        means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
        target = keep.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(c, F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])
    out = model.transform(vectors(target, columns)).withColumnRenamed("prediction", "label")
    return out.drop("v", "probability")


def k_scan(df: DataFrame, columns: list[str], ks: list[int], seed: int = 42) -> DataFrame:
    """For each k: inertia, silhouette, the smallest cluster, Calinski-Harabasz and Davies-Bouldin."""
    v = vectors(df, columns).select("v", *columns).persist(StorageLevel.DISK_ONLY)
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="v").fit(v)
        scores = validity(model.transform(v).withColumnRenamed("prediction", "label"), columns).first()
        rows.append((k, float(model.summary.trainingCost), scores["silhouette"], int(min(model.summary.clusterSizes)), scores["calinski_harabasz"], scores["davies_bouldin"]))
    v.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, smallest long, calinski_harabasz double, davies_bouldin double")


def _distance2(columns: list[str], other: str) -> Column:
    return reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.col(f"{other}{c}"), 2) for c in columns])


def fuzzy(df: DataFrame, key: str, columns: list[str], k: int, m: float = 1.5, error: float = 0.005, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Fuzzy c-means from KMeans centres: (key, cluster, u) for each row and cluster.

    A round is one pass: distances to the k broadcast centres, memberships, weighted sums by cluster. A row on a centre
    belongs to it alone. Ends when no centre moves by ``error``.
    """
    spark = df.sparkSession
    labelled = fit(df, columns, k, seed=seed)
    centres = sorted(tuple(r) for r in labelled.groupBy("label").agg(*[F.avg(c) for c in columns]).drop("label").collect())
    schema = "cluster int, " + ", ".join(f"c_{c} double" for c in columns)

    def memberships(centres: list[tuple]) -> DataFrame:
        table = F.broadcast(spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], schema))
        d = df.select(key, *columns).crossJoin(table).withColumn("_d", F.sqrt(_distance2(columns, "c_")))
        w = W.partitionBy(key)
        on = F.sum((F.col("_d") == 0).cast("int")).over(w)
        share = F.pow(F.col("_d"), -2 / (m - 1))
        u = F.when(on > 0, (F.col("_d") == 0).cast("double") / on).otherwise(share / F.sum(share).over(w))
        return d.withColumn("u", u)

    for _ in range(rounds):
        um = F.pow("u", m)
        new = [tuple(r)[1:] for r in memberships(centres).groupBy("cluster").agg(*[F.sum(um * F.col(c)) / F.sum(um) for c in columns]).orderBy("cluster").collect()]
        moved = max(abs(a - b) for x, y in zip(centres, new, strict=True) for a, b in zip(x, y, strict=True))
        centres = new
        if moved < error:
            break
    return memberships(centres).select(key, "cluster", "u", "_d")


def fuzzy_summary(members: DataFrame, key: str, ambiguous: float = 0.6) -> DataFrame:
    """For each row its cluster, largest membership and whether that is below ``ambiguous``."""
    best = members.groupBy(key).agg(F.max_by("cluster", F.struct("u", -F.col("cluster"))).alias("cluster"), F.max("u").alias("u"))
    return best.withColumn("ambiguous", F.col("u") < ambiguous)


def partition_coefficient(members: DataFrame, key: str) -> DataFrame:
    return members.agg((F.sum(F.col("u") * F.col("u")) / F.countDistinct(key)).alias("fpc"))


def component_counts(df: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.8, 0.9)) -> DataFrame:
    """For each share of the variance the fewest principal components that explain it, and what they explain."""
    _, explained = principal(df, columns, len(columns), [])
    rows = []
    for share in shares:
        total = 0.0
        for n, x in enumerate(explained, 1):
            total += x
            if total >= share - 1e-12:
                break
        rows.append((share, n, total))
    return df.sparkSession.createDataFrame(rows, "share double, components int, explained double")


def principal(df: DataFrame, columns: list[str], k: int, keep: list[str]) -> tuple[DataFrame, list[float]]:
    """Coordinates pc1.. of each row and the components' shares of variance."""
    v = vectors(df, columns)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(v)
    out = model.transform(v).withColumn("p", vector_to_array("p"))
    return out.select(*keep, *[F.col("p")[i].alias(f"pc{i + 1}") for i in range(k)]), [float(x) for x in model.explainedVariance]


def silhouette(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Mean silhouette over squared distances: each row meets sums by cluster, never other rows. A row alone scores 0."""
    length = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in columns])
    sums = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"), F.avg(length).alias("_q"), *[F.avg(c).alias(f"c_{c}") for c in columns])
    dot = reduce(lambda a, b: a + b, [F.col(c) * F.col(f"c_{c}") for c in columns])
    far = df.select(label, *columns, F.monotonically_increasing_id().alias("_row")).crossJoin(F.broadcast(sums)).withColumn("_d", F.greatest(length - 2 * dot + F.col("_q"), F.lit(0.0)))
    own = F.col("_l") == F.col(label)
    each = far.groupBy("_row").agg(F.max(F.when(own, F.col("_d") * F.col("_n") / F.nullif(F.col("_n") - 1, F.lit(0)))).alias("a"), F.min(F.when(~own, F.col("_d"))).alias("b"))
    score = F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(score).alias("silhouette"))


def validity(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Calinski-Harabasz, Davies-Bouldin and silhouette from sums by cluster; null where a figure is not defined, as with one
    cluster or with all rows at their centres."""
    centres = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"c_{c}") for c in columns])
    j = df.select(label, *columns).join(F.broadcast(centres), label).withColumn("_d2", _distance2(columns, "c_"))
    spread = j.groupBy(label).agg(F.avg(F.sqrt("_d2")).alias("s"), F.sum("_d2").alias("w"))
    c = centres.join(spread, label)
    o = c.select(F.col(label).alias("_l"), F.col("s").alias("_s"), *[F.col(f"c_{x}").alias(f"o_{x}") for x in columns])
    gap = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(f"c_{x}") - F.col(f"o_{x}"), 2) for x in columns]))
    db = c.join(o, F.col(label) != F.col("_l")).groupBy(label).agg(F.max(F.try_divide(F.col("s") + F.col("_s"), gap)).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    overall = df.agg(*[F.avg(x).alias(f"g_{x}") for x in columns])
    between = reduce(lambda a, b: a + b, [F.pow(F.col(f"c_{x}") - F.col(f"g_{x}"), 2) for x in columns])
    ch = c.crossJoin(F.broadcast(overall)).agg(F.sum(F.col("n") * between).alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return ch.select("k", "n", F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1)).alias("calinski_harabasz")).crossJoin(db).crossJoin(silhouette(df, columns, label))


def balance(df: DataFrame, label: str = "label", noise: int = -1) -> DataFrame:
    """Clusters, smallest and largest size and share, normalised entropy of the sizes, and the share of rows that are noise.

    Rows whose label is null or ``noise`` are in no cluster; sizes and shares are of the others.
    """
    out = F.col(label).isNull() | (F.col(label).cast("string") == str(noise))
    n = df.groupBy(F.when(~out, F.col(label)).alias("_l")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum(F.when(F.col("_l").isNotNull(), F.col("n"))).alias("t"), (F.coalesce(F.sum(F.when(F.col("_l").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("noise_share"))
    p = F.col("n") / F.col("t")
    one = n.filter("_l is not null").crossJoin(F.broadcast(total)).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.max(p).alias("largest_share"), (-F.sum(p * F.ln(p))).alias("h"), F.max("noise_share").alias("noise_share"))
    return one.withColumn("entropy", F.when(F.col("k") > 1, F.col("h") / F.ln("k")).otherwise(F.lit(0.0))).drop("h")


def profiles(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Size and means of each cluster."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def separation(profile: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Mean distance between the cluster centres."""
    o = profile.select(F.col(label).alias("_l"), *[F.col(c).alias(f"o_{c}") for c in columns])
    return profile.join(o, F.col(label) < F.col("_l")).agg(F.avg(F.sqrt(_distance2(columns, "o_"))).alias("separation"))


def named(profile: DataFrame, columns: list[str], rules: Callable[[], Column], label: str = "label") -> DataFrame:
    """Names by ``rules`` over the profile; a name given twice is told apart by the column that deviates most."""
    out = profile.withColumn("name", rules())
    w = W.partitionBy("name")
    top = F.array_sort(F.array(*[F.struct(-F.abs(F.col(c)), F.lit(c).alias("c")) for c in columns]))[0]["c"]
    twice = F.count(F.lit(1)).over(w) > 1
    place = F.row_number().over(w.orderBy(label)).cast("string")
    return out.withColumn("name", F.when(twice, F.concat_ws(" ", "name", F.lit("by"), top, place)).otherwise(F.col("name")))


def nearest_archetype(df: DataFrame, key: str, columns: list[str], archetypes: DataFrame) -> DataFrame:
    """The archetype (name and c_ columns, a short list) nearest to each row, and the distance."""
    j = df.select(key, *columns).crossJoin(F.broadcast(archetypes)).withColumn("_d", F.sqrt(_distance2(columns, "c_")))
    return j.groupBy(key).agg(F.min_by("name", F.struct("_d", "name")).alias("archetype"), F.min("_d").alias("distance"))


def representatives(df: DataFrame, key: str, columns: list[str], k: int = 5, boundary: float = 0.15, label: str = "label") -> DataFrame:
    """The ``k`` rows nearest to each centre, and rows whose two nearest centres are about as far (lowest 15%)."""
    centres = df.groupBy(F.col(label).alias("_l")).agg(*[F.avg(c).alias(f"c_{c}") for c in columns])
    d = df.select(key, label, *columns).crossJoin(F.broadcast(centres)).withColumn("_d", F.sqrt(_distance2(columns, "c_")))
    two = d.groupBy(key, label).agg(F.min(F.when(F.col("_l") == F.col(label), F.col("_d"))).alias("own"), F.slice(F.array_sort(F.collect_list("_d")), 1, 2).alias("near"))
    two = two.withColumn("gap", F.col("near")[1] - F.col("near")[0])
    cut = two.agg(F.percentile("gap", F.lit(boundary)).alias("cut"))
    place = F.row_number().over(W.partitionBy(label).orderBy("own", key))
    return two.withColumn("place", place).crossJoin(F.broadcast(cut)).select(key, label, "own", "gap", (F.col("place") <= k).alias("representative"), (F.col("gap") <= F.col("cut")).alias("boundary"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings."""
    c2 = lambda c: c * (c - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("n")), cells.groupBy(b).agg(F.sum("n").alias("n"))
    s = lambda d, name: d.agg(F.sum(c2(F.col("n"))).alias(name), F.sum("n").alias(f"t_{name}"))
    j = s(cells, "i").crossJoin(s(rows, "x")).crossJoin(s(cols, "y"))
    expected = F.col("x") * F.col("y") / c2(F.col("t_i"))
    top = (F.col("x") + F.col("y")) / 2
    return j.select(F.when(top == expected, F.lit(1.0)).otherwise((F.col("i") - expected) / (top - expected)).alias("ari"))


def bootstrapped(df: DataFrame, key: str, seed: int) -> DataFrame:
    """As many rows as ``df`` has on average: each as often as a Poisson draw of mean 1 says, by the hash of its key."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_003)) / 1_000_003
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(1, 8):
        total += p
        steps.append(total)
        p /= k
    times = F.size(F.filter(F.array(*[F.lit(x) for x in steps]), lambda x: x <= u))
    return df.withColumn("_times", F.explode(F.array_repeat(F.lit(0), times))).drop("_times")


def stability(df: DataFrame, key: str, columns: list[str], k: int, runs: int = 5, share: float = 0.85, seed: int = 42) -> DataFrame:
    """Refits on bootstrap samples and on subsamples, both by hash: (kind, runs, mean, std and lowest decile of ARI)."""
    full = fit(df, columns, k, seed=seed).select(key, F.col("label").alias("full"))
    rows = []
    for kind in ("bootstrap", "subsample"):
        found = []
        for i in range(runs):
            part = bootstrapped(df, key, seed + i) if kind == "bootstrap" else df.filter(F.pmod(F.xxhash64(F.lit(seed + i), F.col(key)), F.lit(1000)) < int(1000 * share))
            again = fit(part, columns, k, seed=seed + i).select(key, "label")
            found.append(float(adjusted_rand(again.join(full, key), "full", "label").first()["ari"]))
        mean = sum(found) / runs
        at = 0.1 * (runs - 1)
        low = sorted(found)[int(at) :][:2]
        rows.append((kind, runs, mean, (sum((x - mean) ** 2 for x in found) / runs) ** 0.5, low[0] + (low[-1] - low[0]) * (at - int(at))))
    return df.sparkSession.createDataFrame(rows, "kind string, runs int, mean_ari double, std_ari double, p10_ari double")


def permuted(df: DataFrame, key: str, columns: list[str], seed: int) -> DataFrame:
    """Each column dealt anew to the rows, independently, in hash order."""
    base = positions(df.select(key), [key], "_i")
    for n, c in enumerate(columns):
        dealt = positions(df.select(key, c), [F.xxhash64(F.lit(seed * 1000 + n), F.col(key)), key], "_i")
        base = base.join(dealt.select("_i", c), "_i")
    return base.drop("_i")


def permutation_baseline(df: DataFrame, key: str, columns: list[str], k: int, runs: int = 3, seed: int = 42) -> DataFrame:
    """Silhouette of the data against the mean and deviation of permuted ones."""
    score = lambda d: k_scan(d, columns, [k], seed).first()["silhouette"]
    null = [score(permuted(df, key, columns, seed + i)) for i in range(runs)]
    mean = sum(null) / runs
    sd = (sum((x - mean) ** 2 for x in null) / max(1, runs - 1)) ** 0.5
    real = score(df)
    return df.sparkSession.createDataFrame([(real, mean, sd, (real - mean) / sd if sd else None)], "silhouette double, null_mean double, null_sd double, z double")


def hopkins(df: DataFrame, key: str, columns: list[str], sample: int = 50, seed: int = 42) -> DataFrame:
    """Hopkins statistic: nearest distances of uniform points against those of sampled rows; about 0.5 without clusters.

    The sample is bounded, so each of its points meets all rows: a stated query set, not a join of the data with itself.
    """
    bounds = df.agg(*[f(c).alias(f"{p}{c}") for c in columns for f, p in ((F.min, "lo_"), (F.max, "hi_"))])
    picked = df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(sample)
    real = picked.select(F.lit("real").alias("kind"), F.col(key).alias("_p"), *[F.col(c).alias(f"c_{c}") for c in columns])
    u = lambda n: F.pmod(F.xxhash64(F.lit(seed + n + 1), F.col(key)), F.lit(1_000_003)) / 1_000_003
    uniform = picked.crossJoin(F.broadcast(bounds)).select(F.lit("uniform").alias("kind"), F.col(key).alias("_p"), *[(F.col(f"lo_{c}") + u(n) * (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).alias(f"c_{c}") for n, c in enumerate(columns)])
    points = F.broadcast(real.unionByName(uniform))
    d = df.select(key, *columns).crossJoin(points).filter((F.col("kind") == "uniform") | (F.col(key) != F.col("_p")))
    near = d.groupBy("kind", "_p").agg(F.min(F.sqrt(_distance2(columns, "c_"))).alias("d"))
    total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0.0))
    return near.agg((total("uniform") / (total("uniform") + total("real"))).alias("hopkins"))


def two_stage(df: DataFrame, key: str, first: list[str], second: list[str], k: int, parts: tuple[int, ...] = (2, 3), least: int = 20, seed: int = 42) -> DataFrame:
    """Clusters by ``first``, then within each of at least ``least`` rows by ``second``: as many of ``parts`` as have the best
    silhouette there (the fewest of equals)."""
    outer = fit(df, first, k, seed=seed).withColumnRenamed("label", "outer")
    sizes = {r["outer"]: r["n"] for r in outer.groupBy("outer").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for label, n in sorted(sizes.items()):
        part = outer.filter(F.col("outer") == label)
        if n < least:
            out.append(part.select(key, "outer", F.lit(0).alias("inner")))
            continue
        scored = k_scan(part, second, list(parts), seed).collect()
        best = max(scored, key=lambda r: (r["silhouette"], -r["k"]))["k"]
        out.append(fit(part, second, best, seed=seed).select(key, "outer", F.col("label").alias("inner")))
    return reduce(DataFrame.unionByName, out)


def eligible(table: DataFrame, strict: Column, relaxed: Column, least: int = 15) -> DataFrame:
    """Rows that meet ``strict``, or ``relaxed`` where fewer than ``least`` do; ``rule`` says which held."""
    n = table.agg(F.count_if(strict).alias("_n"))
    rule = F.when(F.col("_n") >= least, "strict").otherwise("relaxed")
    return table.crossJoin(F.broadcast(n)).withColumn("rule", rule).filter(F.when(F.col("rule") == "strict", strict).otherwise(relaxed)).drop("_n")


def weighted_score(table: DataFrame, weights: dict[str, tuple[float, bool]], name: str = "score") -> DataFrame:
    """Add a weighted sum of min-max scores (weight, higher is better); a column without spread scores 0.5."""
    bounds = table.agg(*[f(c).alias(f"{p}{c}") for c in weights for f, p in ((F.min, "_lo_"), (F.max, "_hi_"))])
    score = F.lit(0.0)
    for c, (w, up) in weights.items():
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        s = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.5))
        score = score + w * (s if up else 1 - s)
    return table.crossJoin(F.broadcast(bounds)).withColumn(name, score).drop(*[f"{p}{c}" for c in weights for p in ("_lo_", "_hi_")])


def best_of(table: DataFrame, by: list[str], score: str, keep: int, tie: list[str], name: str = "place") -> DataFrame:
    """The ``keep`` rows of each group with the highest ``score`` (ties by ``tie``) and their places."""
    return table.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), *tie))).filter(F.col(name) <= keep)
