"""Every registered query with SQL against DuckDB on the smallest tables; the others for shape and invariants."""

import collections
import datetime
import decimal
import math
import random

import duckdb
import numpy as np
import pytest

from hearthway.plans.registry import ORACLES, QUERIES
from hearthway.plans.tables import NAMES, Tables

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float) and not math.isfinite(v):
        return str(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def order(row):
    """Exact values first, then floats without their last digits, which may differ by a rounding."""
    return [str(x) for x in row if not isinstance(x, float)], [round(x, 2) for x in row if isinstance(x, float)]


def same(a, b):
    return all(math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4) if isinstance(x, float) and isinstance(y, (int, float)) else x == y for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(float(x) if isinstance(x, decimal.Decimal) else plain(x) for x in r) for r in rel.fetchall()), key=order)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    assert len(got) == len(want)
    odd = [(a, b) for a, b in zip(got, want, strict=True) if not same(a, b)]
    assert not odd, odd[:3]


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.01")


def test_communities_beat_single_nodes(spark, tables):
    from pyspark.sql import functions as F

    from hearthway.operators import flows, graph

    edges = flows.undirected(tables.od)
    labels, q = graph.communities(edges, passes=2, rounds=6)
    alone = labels.withColumn("community", F.col("node"))
    assert abs(graph.modularity(edges, labels).first()[0] - q) < 1e-9
    assert q > graph.modularity(edges, alone).first()[0]


def test_fuzzy_memberships_sum_to_one(spark):
    from pyspark.sql import functions as F

    from hearthway.operators import cluster

    df = spark.createDataFrame([(i, float(i % 2) * 10 + i * 0.01, float(i % 3)) for i in range(30)], "k long, x double, y double")
    members = cluster.fuzzy(df, "k", ["x", "y"], 2, rounds=10)
    assert all(abs(r.s - 1) < 1e-9 for r in members.groupBy("k").agg(F.sum("u").alias("s")).collect())
    assert 0.5 <= cluster.partition_coefficient(members, "k").first()["fpc"] <= 1
    assert cluster.fuzzy_summary(members, "k").count() == 30


def test_rand_of_equal_labels_is_one(spark):
    from hearthway.operators import cluster

    df = spark.createDataFrame([(i % 3, (i % 3 + 1) % 3) for i in range(30)], "a int, b int")
    assert cluster.adjusted_rand(df, "a", "b").first()["ari"] == 1.0
    assert cluster.k_scan(spark.createDataFrame([(float(i % 2),) for i in range(20)], "x double"), ["x"], [2]).first()["inertia"] < 1e-9


def points(spark, n=90, seed=5):
    """Three round groups of points far apart, with a key."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.standard_normal((n // 3, 2)) * 0.3 + c for c in ((0, 0), (6, 0), (0, 6))])
    rows = [(i, float(a), float(b), i // (n // 3)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "k long, x double, y double, truth int"), x


def rand_index(a, b):
    """Adjusted Rand index, counted over all pairs."""
    pairs = [(i, j) for i in range(len(a)) for j in range(i)]
    sa, sb = [a[i] == a[j] for i, j in pairs], [b[i] == b[j] for i, j in pairs]
    both, x, y, n = sum(p and q for p, q in zip(sa, sb, strict=True)), sum(sa), sum(sb), len(pairs)
    return (both - x * y / n) / ((x + y) / 2 - x * y / n) if (x + y) / 2 != x * y / n else 1.0


def test_communities_find_the_best_partition_of_small_graphs(spark):
    """Against every partition of seven nodes: two triangles and a tail; two cliques joined by an edge."""
    from hearthway.operators import graph

    def partitions(nodes):
        if not nodes:
            yield []
            return
        for rest in partitions(nodes[1:]):
            for i in range(len(rest)):
                yield [*rest[:i], [nodes[0], *rest[i]], *rest[i + 1 :]]
            yield [[nodes[0]], *rest]

    def quality(edges, groups):
        m = sum(w for _, _, w in edges)
        home = {n: i for i, g in enumerate(groups) for n in g}
        degree = [sum(w for a, b, w in edges for e in (a, b) if home[e] == i) for i in range(len(groups))]
        inside = [sum(w for a, b, w in edges if home[a] == home[b] == i) for i in range(len(groups))]
        return sum(w / m - (d / (2 * m)) ** 2 for w, d in zip(inside, degree, strict=True))

    for edges in ([(1, 2, 3.0), (2, 3, 3.0), (1, 3, 3.0), (4, 5, 2.0), (5, 6, 2.0), (4, 6, 2.0), (3, 4, 1.0), (6, 7, 1.0)], [(a, b, 1.0) for a in range(3) for b in range(a + 1, 3)] + [(a, b, 1.0) for a in range(3, 7) for b in range(a + 1, 7)] + [(2, 3, 1.0)]):
        labels, q = graph.communities(spark.createDataFrame(edges, "a long, b long, flow double"), passes=3, rounds=12)
        nodes = sorted({n for e in edges for n in e[:2]})
        assert q >= max(quality(edges, g) for g in partitions(nodes)) - 1e-9
        groups = {}
        for r in labels.collect():
            groups.setdefault(r.community, []).append(r.node)
        assert abs(quality(edges, list(groups.values())) - q) < 1e-9


def test_rounds_of_communities_leave_the_edges_where_they_are(spark, monkeypatch):
    """Moves, flows within and contraction by several blocks against plain sums; only the nodes' states are shuffled to the blocks."""
    from pyspark.sql import functions as F

    from hearthway.operators import graph

    monkeypatch.setattr(graph, "ENDS", 40)
    rng = np.random.default_rng(2)
    weight = {(int(a), int(b)): float(rng.integers(1, 5)) for a, b in rng.integers(0, 20, (90, 2)) if a < b}
    home, k, m = {n: n % 4 for e in weight for n in e}, {}, sum(weight.values())
    kin = {}
    for (a, b), w in weight.items():
        for x, y in ((a, b), (b, a)):
            k[x] = k.get(x, 0.0) + w
            kin[x, home[y]] = kin.get((x, home[y]), 0.0) + w
    tot = {c: sum(k[n] for n in k if home[n] == c) for c in range(4)}
    blocks = graph._Blocks(spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "a long, b long, flow double"))
    assert blocks.parts > 1
    states = spark.createDataFrame([(n, home[n], k[n], tot[home[n]]) for n in home], "node long, community long, k double, tot double")
    met = blocks.meet(states, graph._moves(m, 1.0), "node long, own long, to long, lead double")
    rows = met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(block") == 1
    gain = lambda n, c: (kin.get((n, c), 0.0) - (tot[c] - k[n] * (c == home[n])) * k[n] / (2 * m)) / m
    assert {r.node for r in rows} == set(home)
    for r in rows:
        most = max(gain(r.node, c) for c in range(4) if (r.node, c) in kin)
        assert r.own == home[r.node] and abs(gain(r.node, r.to) - most) < 1e-12 and abs(r.lead - most + gain(r.node, r.own)) < 1e-12
    sets = states.select("node", F.array("community", F.col("node") % 2).alias("sets"))
    got = {}
    for r in blocks.meet(sets, graph._within(2), "i long, v double").collect():
        got[r.i] = got.get(r.i, 0) + r.v
    assert got == {i: 2 * sum(w for (a, b), w in weight.items() if of(a) == of(b)) for i, of in enumerate((home.get, lambda n: n % 2))}
    small, want = {}, {}
    for r in blocks.meet(states.select("node", "community"), graph._between, "a long, b long, flow double").collect():
        small[r.a, r.b] = small.get((r.a, r.b), 0) + r.flow
    for (a, b), w in weight.items():
        pair = (min(home[a], home[b]), max(home[a], home[b]))
        want[pair] = want.get(pair, 0) + w
    assert small == want
    blocks.drop()


def test_communities_merge_a_small_graph_in_one_task_as_in_rounds(spark, monkeypatch):
    from hearthway.operators import graph
    from hearthway.sources import stage

    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)): float(w + (a % 4 == b % 4)) for (a, b), w in zip(rng.integers(0, 30, (120, 2)), rng.random(120), strict=True) if a <= b}
    df, written, settle = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, flow double"), [], stage.settle
    monkeypatch.setattr(stage, "settle", lambda x: written.append(1) or settle(x))
    found = []
    for size in (4, 2_000_000):
        monkeypatch.setattr(graph, "ENDS", size)
        written.clear()
        groups = {}
        for r in graph._merge(df, sum(edges.values()), 1.0).collect():
            groups.setdefault(r.community, set()).add(r.node)
        found.append({frozenset(g) for g in groups.values()})
    assert found[0] == found[1] and 1 < len(found[0]) < 15
    assert len(written) == 2


def test_blocks_of_edges_are_narrow_and_states_are_sent_by_home(spark, monkeypatch):
    from pyspark.sql import functions as F

    from hearthway.operators import graph

    monkeypatch.setattr(graph, "ENDS", 100)
    edges = [(a, b, w) for a in range(60) for b, w in ((a + 1, 3.0), (a + 7, 255.0), (a + 20, 4.0))]
    for more, kinds in ((0.0, "|u1 |u1"), (300.0, "|u1 <u2"), (0.5, "|u1 <f8")):
        blocks = graph._Blocks(spark.createDataFrame([(a, b, w + more) for a, b, w in edges], "a long, b long, flow double"))
        assert {r.kinds for r in blocks.edges.select("kinds").collect()} == {kinds}
        nodes = sorted({n for e in edges for n in e[:2]})
        got = blocks.meet(spark.createDataFrame([(n, [n % 3, 0]) for n in nodes], "node long, sets array<long>"), graph._within(2), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        assert {r.i: r.v for r in got} == {0: 2 * sum(w + more for a, b, w in edges if a % 3 == b % 3), 1: 2 * sum(w + more for _, _, w in edges)}
        # what is sent has a row for each pair of a home and a block that meets it, not for each node
        assert blocks.routes.count() <= blocks.parts**2 < blocks.edges.count() * len(nodes)
        blocks.drop()


def test_communities_of_the_flows_reach_a_greedy_partition(spark, tables):
    """On the given flows about what greedy merging of communities reaches."""
    from hearthway.operators import flows, graph

    edges = [(r.a, r.b, r.flow) for r in flows.undirected(tables.od).collect()]
    _, q = graph.communities(flows.undirected(tables.od))
    m = sum(w for _, _, w in edges)
    degree, weight = {}, {}
    for a, b, w in edges:
        weight[a, b] = weight.get((a, b), 0) + w / m
        for n in (a, b):
            degree[n] = degree.get(n, 0) + w / (2 * m)
    greedy = -sum(d * d for d in degree.values())
    while True:
        gain, pair = max(((w - 2 * degree[a] * degree[b], (a, b)) for (a, b), w in weight.items()), default=(0, None))
        if gain <= 0:
            break
        a, b = pair
        greedy += gain
        merged = {}
        for (x, y), w in weight.items():
            x, y = (a if n == b else n for n in (x, y))
            if x != y:
                merged[min(x, y), max(x, y)] = merged.get((min(x, y), max(x, y)), 0) + w
        weight = merged
        degree[a] += degree.pop(b)
    assert q >= 0.95 * greedy  # these flows are nearly even, so both are close to 0


def test_fits_recover_groups_and_their_figures(spark):
    from hearthway.operators import cluster

    df, x = points(spark)
    truth = [i // 30 for i in range(90)]
    for method in ("kmeans", "bisecting", "mixture"):
        got = {r.k: r.label for r in cluster.fit(df, ["x", "y"], 3, method).collect()}
        assert rand_index([got[i] for i in range(90)], truth) == 1.0
    scan = {r.k: r for r in cluster.k_scan(df, ["x", "y"], [2, 3]).collect()}
    inertia = sum(((x[30 * g : 30 * g + 30] - x[30 * g : 30 * g + 30].mean(axis=0)) ** 2).sum() for g in range(3))
    assert abs(scan[3].inertia - inertia) < 1e-6 and scan[3].smallest == 30 and scan[3].silhouette > scan[2].silhouette
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    group = np.array(truth)
    own = np.array([d2[i, group == group[i]].sum() / 29 for i in range(90)])
    other = np.array([min(d2[i, group == g].mean() for g in range(3) if g != group[i]) for i in range(90)])
    assert abs(scan[3].silhouette - ((other - own) / np.maximum(own, other)).mean()) < 1e-6


def test_rows_that_are_only_labelled(spark):
    """Rows left out of the fit are filled with the fitted rows' means and get the nearest centre."""
    from hearthway.operators import cluster

    df, x = points(spark)
    from pyspark.sql import functions as F

    keep = df.unionByName(spark.createDataFrame([(900, None, 6.1, None)], "k long, x double, y double, truth int"))
    got = {r.k: r.label for r in cluster.fit(df, ["x", "y"], 3, keep=keep).collect()}
    centres = {got[i]: x[30 * (i // 30) : 30 * (i // 30) + 30].mean(axis=0) for i in (0, 30, 60)}
    at = np.array([x[:, 0].mean(), 6.1])
    assert got[900] == min(centres, key=lambda c: ((centres[c] - at) ** 2).sum())
    assert df.filter(F.col("k") == 900).count() == 0


def test_principal_components_against_numpy(spark):
    from hearthway.operators import cluster

    df, x = points(spark)
    out, share = cluster.principal(df, ["x", "y"], 2, ["k"])
    values, axes = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(share, values[::-1] / values.sum())
    got = {r.k: (r.pc1, r.pc2) for r in out.collect()}
    want = x @ axes[:, ::-1]
    assert all(np.allclose(np.abs(got[i]), np.abs(want[i]), atol=1e-8) for i in range(90))


def test_fuzzy_memberships_follow_their_centres(spark):
    from hearthway.operators import cluster

    df, x = points(spark)
    members = cluster.fuzzy(df, "k", ["x", "y"], 3)
    u = np.zeros((90, 3))
    d = np.zeros((90, 3))
    for r in members.collect():
        u[r.k, r.cluster], d[r.k, r.cluster] = r.u, r._d
    want = d**-4 / (d**-4).sum(axis=1, keepdims=True)  # exponent 2 / (m - 1) of m = 1.5
    assert np.allclose(u, want) and rand_index(u.argmax(axis=1).tolist(), [i // 30 for i in range(90)]) == 1.0
    summary = {r.k: r for r in cluster.fuzzy_summary(members, "k").collect()}
    assert all(summary[i].cluster == u[i].argmax() and abs(summary[i].u - u[i].max()) < 1e-12 and summary[i].ambiguous == (u[i].max() < 0.6) for i in range(90))


def test_stability_and_its_figures(spark):
    from hearthway.operators import cluster

    df, _ = points(spark)
    got = {r.kind: r for r in cluster.stability(df, "k", ["x", "y"], 3, runs=2).collect()}
    assert set(got) == {"bootstrap", "subsample"} and all(r.mean_ari == r.p10_ari == 1.0 and r.std_ari == 0 for r in got.values())
    times = collections.Counter(r.k for r in cluster.bootstrapped(df, "k", 1).collect())
    assert 60 <= sum(times.values()) <= 120 and max(times.values()) >= 2 and len(times) < 80
    df = df.withColumn("other", (df.k * 7) % 3)
    rows = df.collect()
    assert abs(cluster.adjusted_rand(df, "truth", "other").first()["ari"] - rand_index([r.truth for r in rows], [r.other for r in rows])) < 1e-12


def test_permutation_baseline_and_hopkins_tell_groups_from_none(spark):
    from hearthway.operators import cluster

    df, x = points(spark)
    base = cluster.permutation_baseline(df, "k", ["x", "y"], 3, runs=2).first()
    assert base.silhouette > base.null_mean and abs(base.z - (base.silhouette - base.null_mean) / base.null_sd) < 1e-9
    dealt = cluster.permuted(df, "k", ["x", "y"], 3).collect()
    assert sorted(r.x for r in dealt) == sorted(x[:, 0]) and sorted(r.y for r in dealt) == sorted(x[:, 1]) and [r.x for r in sorted(dealt)] != x[:, 0].tolist()
    rng = np.random.default_rng(1)
    even = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((300, 2)))], "k long, x double, y double")
    assert cluster.hopkins(df, "k", ["x", "y"]).first()["hopkins"] > 0.8 and 0.35 < cluster.hopkins(even, "k", ["x", "y"]).first()["hopkins"] < 0.65


def test_consensus_imputation_and_two_stages_on_the_given_features(spark, tables):
    """The registered queries without SQL against their parts recomputed in numpy."""
    folder = tables.sf_dir
    fits = {r.dong: (r.bisecting, r.mixture) for r in QUERIES["m04_alternative_fits"](spark, folder).collect()}
    consensus = {r.method: r for r in QUERIES["m18_consensus"](spark, folder).collect()}
    order = sorted(fits)
    pair = rand_index([fits[d][0] for d in order], [fits[d][1] for d in order])
    for m in ("bisecting", "mixture"):
        assert consensus[m].min_ari - 1e-9 <= pair and consensus[m].min_ari <= consensus[m].mean_ari + 1e-12
    lowest = min(consensus[m].min_ari for m in consensus)
    assert lowest <= pair + 1e-9
    assert -1 <= QUERIES["m19_imputation_sensitivity"](spark, folder).first()["ari"] <= 1
    stages = QUERIES["m20_two_stage"](spark, folder).collect()
    sizes = collections.Counter(r.outer for r in stages)
    assert len(stages) == len(order) and all(r.inner == 0 for r in stages if sizes[r.outer] < 20)
    k = {r.k: r for r in QUERIES["m26_k_evaluation"](spark, folder).collect()}
    rank = lambda values: {i: sum(v < values[i] for v in values.values()) + (sum(v == values[i] for v in values.values()) + 1) / 2 for i in values}
    four = [rank({i: -r.silhouette for i, r in k.items()}), rank({i: -r.calinski_harabasz for i, r in k.items()}), rank({i: r.davies_bouldin for i, r in k.items()}), rank({i: r.inertia for i, r in k.items()})]
    assert all(abs(r.mean_rank - sum(x[i] for x in four) / 4) < 1e-12 for i, r in k.items()) and min(k.values(), key=lambda r: r.mean_rank).place == 1
    inner = collections.defaultdict(set)
    for r in stages:
        inner[r.outer].add(r.inner)
    assert all(len(inner[o]) in (2, 3) for o in sizes if sizes[o] >= 20)
    assignment = {r.dong: r.label for r in QUERIES["m02_kmeans_assignment"](spark, folder).collect()}
    assert set(assignment) == set(order) and set(assignment.values()) <= set(range(4))


def test_partition_coefficient_components_and_parts(spark):
    """Fuzzy fits run until their centres rest; component counts against numpy; parts by the better silhouette."""
    from hearthway.operators import cluster

    df, x = points(spark)
    members = cluster.fuzzy(df, "k", ["x", "y"], 3)
    u = np.zeros((90, 3))
    for r in members.collect():
        u[r.k, r.cluster] = r.u
    assert abs(cluster.partition_coefficient(members, "k").first()["fpc"] - (u**2).sum() / 90) < 1e-12
    centres = np.array([(u[:, [i]] ** 1.5 * x).sum(axis=0) / (u[:, i] ** 1.5).sum() for i in range(3)])
    told = {r.cluster: r._d for r in members.filter("k = 0").collect()}
    assert all(abs(np.linalg.norm(x[0] - centres[i]) - told[i]) < 0.01 for i in range(3))  # at rest within the error
    wide = df.selectExpr("k", "x", "y", "x + y * 0.01 AS z", "x - y AS w")
    values = np.sort(np.linalg.eigvalsh(np.cov(np.array([[r.x, r.y, r.z, r.w] for r in wide.collect()]).T)))[::-1]
    shares = np.cumsum(values) / values.sum()
    for r in cluster.component_counts(wide, ["x", "y", "z", "w"], (0.5, 0.8, 0.9, 1.0)).collect():
        n = int(np.argmax(shares >= r.share - 1e-9)) + 1
        assert (r.components, round(r.explained, 9)) == (n, round(float(shares[n - 1]), 9))
    stages = cluster.two_stage(df.withColumn("one", df.x * 0), "k", ["one"], ["x", "y"], 2).collect()
    assert len(stages) == 90 and max(len({r.inner for r in stages if r.outer == o}) for o in {r.outer for r in stages}) == 3


def test_validity_against_numpy(spark):
    from hearthway.operators import cluster

    df, x = points(spark)
    df = df.withColumn("label", (df.k * 7) % 4)
    group = np.array([r.label for r in df.orderBy("k").collect()])
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    own = np.array([d2[i, group == group[i]].sum() / ((group == group[i]).sum() - 1) for i in range(90)])
    other = np.array([min(d2[i, group == g].mean() for g in range(4) if g != group[i]) for i in range(90)])
    assert abs(cluster.validity(df, ["x", "y"]).first()["silhouette"] - ((other - own) / np.maximum(own, other)).mean()) < 1e-9
    alone = spark.createDataFrame([(0.0, 0), (5.0, 1), (6.0, 1)], "x double, label int")
    assert abs(cluster.silhouette(alone, ["x"]).first()["silhouette"] - (0 + 24 / 25 + 35 / 36) / 3) < 1e-12


def test_filters_share_one_search_of_components(spark, monkeypatch):
    """Components of nested filters: an edge is searched in one filter only, and chains against the order of ids settle."""
    from hearthway.operators import graph

    rng = random.Random(3)
    edges = [(a, b, float(rng.randint(1, 9))) for a, b in {tuple(sorted(rng.sample(range(90), 2))) for _ in range(80)}]
    searched = []
    plain = graph.components
    monkeypatch.setattr(graph, "components", lambda e: (searched.append(e.count()), plain(e))[1])
    rows = graph.filter_sensitivity(spark.createDataFrame(edges, "a long, b long, flow double"), [0.0, 0.25, 0.5]).collect()
    nodes = {x for e in edges for x in e[:2]}
    for r in rows:
        up = {n: n for n in nodes}
        for _ in nodes:
            for a, b, f in edges:
                if f >= r.cut:
                    up[a] = up[b] = min(up[a], up[b])
        assert r.components == len(set(up.values()))
        assert r.nodes_kept == len({x for a, b, f in edges if f >= r.cut for x in (a, b)}) / len(nodes)
    assert len(rows) == 3 and sum(searched) <= len(edges)
