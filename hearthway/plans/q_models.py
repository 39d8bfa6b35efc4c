"""Registered queries: statistics, clustering, graphs, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.operators import cluster as cs
from hearthway.operators import flows as fl
from hearthway.operators import graph as gr
from hearthway.operators import scores as sc
from hearthway.operators import statistics as st
from hearthway.sources.stage import stage_dir
from hearthway.streaming import jobs

from .tables import VIEWS, Tables, query

R = F.round
COLS = ["f1", "f2", "f3", "f4"]

VIEWS["scaled"] = "SELECT dong, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in COLS) + " FROM features"
VIEWS["labelled"] = "SELECT *, dong % 4 AS label FROM scaled"


def _scaled(t: Tables):
    return cs.standard_scale(t.features.withColumns({c: F.col(c).cast("double") for c in COLS}), COLS)


def _labelled(t: Tables):
    return _scaled(t).withColumn("label", F.col("dong") % 4)


@query("SELECT dong, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLS) + " FROM scaled")
def m01_standard_scale(t: Tables):
    return _scaled(t).select("dong", *[R(c, 6).alias(c) for c in COLS])


@query("SELECT dong, " + ", ".join(f"round(({c} - (SELECT median({c}) FROM features)) / (SELECT quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) FROM features) * {w}, 6) AS {c}" for c, w in zip(COLS, ("sqrt(0.5 / 1)", "sqrt(0.5 / 3)", "sqrt(0.5 / 3)", "sqrt(0.5 / 3)"), strict=True)) + " FROM features")
def m01_robust_scale_blocks(t: Tables):
    d = cs.balance_blocks(cs.robust_scale(t.features, COLS), [["f1"], ["f2", "f3", "f4"]])
    return d.select("dong", *[R(c, 6).alias(c) for c in COLS])


@query()
def m02_kmeans_assignment(t: Tables):
    s = _scaled(t)
    keep = s.withColumn("f3", F.when(F.col("dong") % 7 != 0, F.col("f3")))
    return cs.fit(s.filter("dong % 7 <> 0"), COLS, 4, keep=keep).select("dong", "label")


@query()
def m02_k_scan(t: Tables):
    return cs.k_scan(_scaled(t), COLS, [2, 3, 4, 5])


@query()
def m03_fuzzy_membership(t: Tables):
    return cs.fuzzy(_scaled(t), "dong", COLS, 3).select("dong", "cluster", "u")


@query()
def m03_fuzzy_summary(t: Tables):
    return cs.fuzzy_summary(cs.fuzzy(_scaled(t), "dong", COLS, 3), "dong")


@query()
def m03_partition_coefficient(t: Tables):
    return cs.partition_coefficient(cs.fuzzy(_scaled(t), "dong", COLS, 3), "dong")


@query()
def m04_alternative_fits(t: Tables):
    s = _scaled(t)
    a, b = cs.fit(s, COLS, 3, "bisecting").select("dong", F.col("label").alias("bisecting")), cs.fit(s, COLS, 3, "mixture").select("dong", F.col("label").alias("mixture"))
    return a.join(b, "dong")


@query()
def m05_principal_components(t: Tables):
    out, share = cs.principal(_scaled(t), COLS, 2, ["dong"])
    return out.withColumn("explained", F.lit(sum(share)))


@query()
def m05_component_counts(t: Tables):
    return cs.component_counts(_scaled(t), COLS)


CENTRES = "c AS (SELECT label, count(*) AS n, " + ", ".join(f"avg({x}) AS {x}" for x in COLS) + " FROM labelled GROUP BY label)"
D2 = " + ".join(f"(l.{x} - c.{x}) ** 2" for x in COLS)


@query(f"""WITH {CENTRES}, s AS (SELECT l.label, avg(sqrt({D2})) AS s, sum({D2}) AS w FROM labelled l JOIN c USING (label) GROUP BY l.label),
    r AS (SELECT a.label, max((sa.s + sb.s) / sqrt({' + '.join(f'(a.{x} - b.{x}) ** 2' for x in COLS)})) AS r FROM c a JOIN c b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY a.label),
    met AS (SELECT l.dong, l.label, o.label AS other, sum({' + '.join(f'(l.{x} - o.{x}) ** 2' for x in COLS)}) AS d, count(*) AS m FROM labelled l JOIN labelled o ON true GROUP BY 1, 2, 3),
    sil AS (SELECT dong, max(CASE WHEN label = other THEN d / nullif(m - 1, 0) END) AS a, min(CASE WHEN label <> other THEN d / m END) AS b FROM met GROUP BY 1)
    SELECT round((SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) FROM sil), 6) AS silhouette, count(*) AS k, sum(c.n) AS n, round((sum(c.n * ({' + '.join(f'(c.{x} - (SELECT avg({x}) FROM labelled)) ** 2' for x in COLS)})) / (count(*) - 1)) / (sum(w) / (sum(c.n) - count(*))), 6) AS calinski_harabasz, round((SELECT avg(r) FROM r), 6) AS davies_bouldin FROM c JOIN s USING (label)""")
def m06_validity(t: Tables):
    return cs.validity(_labelled(t), COLS).select("k", "n", R("calinski_harabasz", 6).alias("calinski_harabasz"), R("davies_bouldin", 6).alias("davies_bouldin"), R("silhouette", 6).alias("silhouette"))


@query("""WITH l AS (SELECT CASE WHEN dong % 11 <> 0 THEN gu END AS gu FROM dim_region) SELECT count(*) AS k, min(n) AS smallest, max(n) AS largest, round(max(n / t), 6) AS largest_share, round(-sum(n / t * ln(n / t)) / ln(count(*)), 6) AS entropy,
    round((SELECT count(*) - count(gu) FROM l) / (SELECT count(*) FROM l), 6) AS noise_share FROM (SELECT gu, count(*) AS n, sum(count(*)) OVER () AS t FROM l WHERE gu IS NOT NULL GROUP BY gu)""")
def m07_balance(t: Tables):
    """Every eleventh dong is noise."""
    b = cs.balance(t.dim_region.withColumn("gu", F.when(F.col("dong") % 11 != 0, F.col("gu"))), "gu")
    return b.select("k", "smallest", "largest", *[R(c, 6).alias(c) for c in ("largest_share", "entropy", "noise_share")])


@query(f"WITH {CENTRES} SELECT round(avg(sqrt({' + '.join(f'(a.{x} - b.{x}) ** 2' for x in COLS)})), 6) AS separation FROM c a JOIN c b ON a.label < b.label")
def m08_separation(t: Tables):
    return cs.separation(cs.profiles(_labelled(t), COLS), COLS).select(R("separation", 6).alias("separation"))


@query(f"WITH {CENTRES} SELECT label, n, " + ", ".join(f"round({x}, 6) AS {x}" for x in COLS) + " FROM c")
def m09_profiles(t: Tables):
    return cs.profiles(_labelled(t), COLS).select("label", "n", *[R(x, 6).alias(x) for x in COLS])


@query(f"""WITH {CENTRES}, x AS (SELECT *, CASE WHEN f1 > 0.05 THEN 'dear' WHEN f2 > 0.05 THEN 'far' ELSE 'plain' END AS name FROM c)
    SELECT label, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' by ' || CASE greatest(abs(f1), abs(f2), abs(f3), abs(f4)) WHEN abs(f1) THEN 'f1' WHEN abs(f2) THEN 'f2' WHEN abs(f3) THEN 'f3' ELSE 'f4' END || ' ' || row_number() OVER (PARTITION BY name ORDER BY label) ELSE name END AS name FROM x""")
def m10_names(t: Tables):
    rules = lambda: F.when(F.col("f1") > 0.05, "dear").when(F.col("f2") > 0.05, "far").otherwise("plain")
    return cs.named(cs.profiles(_labelled(t), COLS), COLS, rules).select("label", "name")


@query("""SELECT dong, name AS archetype, round(d, 6) AS distance FROM (SELECT dong, a.name, sqrt((f1 - a1) ** 2 + (f2 - a2) ** 2) AS d, row_number() OVER (PARTITION BY dong ORDER BY sqrt((f1 - a1) ** 2 + (f2 - a2) ** 2), a.name) AS k FROM scaled CROSS JOIN (VALUES ('hub', -1.0, -1.0), ('edge', 1.0, 1.0), ('mid', 0.0, 0.0)) a(name, a1, a2)) WHERE k = 1""")
def m11_nearest_archetype(t: Tables):
    a = t.spark.createDataFrame([("hub", -1.0, -1.0), ("edge", 1.0, 1.0), ("mid", 0.0, 0.0)], "name string, c_f1 double, c_f2 double")
    return cs.nearest_archetype(_scaled(t), "dong", ["f1", "f2"], a).select("dong", "archetype", R("distance", 6).alias("distance"))


@query(f"""WITH {CENTRES} SELECT label, name AS archetype, round(d, 6) AS distance FROM (SELECT label, a.name, sqrt((f1 - a1) ** 2 + (f2 - a2) ** 2) AS d, row_number() OVER (PARTITION BY label ORDER BY sqrt((f1 - a1) ** 2 + (f2 - a2) ** 2), a.name) AS k FROM c CROSS JOIN (VALUES ('hub', -1.0, -1.0), ('edge', 1.0, 1.0), ('mid', 0.0, 0.0)) a(name, a1, a2)) WHERE k = 1""")
def m11_archetype_of_clusters(t: Tables):
    a = t.spark.createDataFrame([("hub", -1.0, -1.0), ("edge", 1.0, 1.0), ("mid", 0.0, 0.0)], "name string, c_f1 double, c_f2 double")
    return cs.nearest_archetype(cs.profiles(_labelled(t), COLS), "label", ["f1", "f2"], a).select("label", "archetype", R("distance", 6).alias("distance"))


@query(f"""WITH {CENTRES}, d AS (SELECT l.dong, l.label, c.label AS o, sqrt({D2}) AS d FROM labelled l CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY dong ORDER BY d) AS k FROM d),
    g AS (SELECT dong, any_value(label) AS label, max(CASE WHEN o = label THEN d END) AS own, max(CASE WHEN k = 2 THEN d END) - max(CASE WHEN k = 1 THEN d END) AS gap FROM r GROUP BY dong)
    SELECT dong, label, round(own, 6) AS own, round(gap, 6) AS gap, row_number() OVER (PARTITION BY label ORDER BY own, dong) <= 5 AS representative, gap <= (SELECT quantile_cont(gap, 0.15) FROM g) AS boundary FROM g""")
def m12_representatives(t: Tables):
    return cs.representatives(_labelled(t), "dong", COLS).select("dong", "label", R("own", 6).alias("own"), R("gap", 6).alias("gap"), "representative", "boundary")


ARI = """WITH x AS (SELECT a, b, count(*)::DOUBLE AS n FROM (SELECT p_type AS a, p_size % 5 AS b FROM part) GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM x),
    ra AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM x GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM x GROUP BY b))
    SELECT round((i - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 9) AS ari FROM i, ra, rb"""


@query(ARI)
def m13_adjusted_rand(t: Tables):
    return cs.adjusted_rand(t.part.select(F.col("p_type").alias("a"), (F.col("p_size") % 5).alias("b")), "a", "b").select(R("ari", 9).alias("ari"))


@query()
def m14_stability(t: Tables):
    return cs.stability(_scaled(t), "dong", COLS, 3, runs=3)


@query()
def m15_permutation_baseline(t: Tables):
    return cs.permutation_baseline(_scaled(t), "dong", COLS, 3, runs=2)


@query()
def m16_hopkins(t: Tables):
    return cs.hopkins(_scaled(t), "dong", COLS)


CANDIDATES = """c AS (SELECT p_brand AS representation, 4 + p_size % 5 AS k, p_type AS method, count(*) AS smallest, avg(p_size) / 100 AS largest_share, stddev_samp(p_retailprice) / avg(p_retailprice) AS silhouette, sum(p_retailprice) AS ch,
      stddev_pop(p_size) AS db, avg(p_retailprice) AS balance, max(p_retailprice) - min(p_retailprice) AS separation, min(p_size) AS stability FROM part GROUP BY ALL),
    ok AS (SELECT *, (silhouette IS NOT NULL AND smallest >= 4 AND largest_share <= 0.22) AS strict, (silhouette IS NOT NULL AND smallest >= 2 AND largest_share <= 0.45) AS relaxed FROM c),
    e AS (SELECT *, CASE WHEN (SELECT count(*) FROM ok WHERE strict) >= 15 THEN 'strict' ELSE 'relaxed' END AS rule FROM ok WHERE CASE WHEN (SELECT count(*) FROM ok WHERE strict) >= 15 THEN strict ELSE relaxed END)"""


def _minmax(c: str, of: str = "") -> str:
    x = of or c
    return f"CASE WHEN max({x}) OVER () > min({x}) OVER () THEN ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) ELSE 0.5 END"


FIRST = f"0.15::DOUBLE * {_minmax('silhouette')} + 0.10::DOUBLE * {_minmax('ch', 'ln(1 + ch)')} + 0.10::DOUBLE * (1 - {_minmax('db')}) + 0.30::DOUBLE * {_minmax('balance')} + 0.35::DOUBLE * {_minmax('separation')}"
FINAL = f"0.25::DOUBLE * {_minmax('separation')} + 0.25::DOUBLE * {_minmax('balance')} + 0.20::DOUBLE * {_minmax('stability')} + 0.15::DOUBLE * {_minmax('silhouette')} + 0.10::DOUBLE * {_minmax('ch', 'ln(1 + ch)')} + 0.05::DOUBLE * (1 - {_minmax('db')})"


@query(f"""WITH {CANDIDATES}, s AS (SELECT *, round({FIRST}, 9) AS first_score FROM e), short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY representation, k ORDER BY first_score DESC, method) AS place FROM s) WHERE place <= 2), f AS (SELECT *, round({FINAL}, 9) AS final_score FROM short)
    SELECT representation, k, method, rule, round(first_score, 7) AS first_score, place, round(final_score, 7) AS final_score, row_number() OVER (PARTITION BY k ORDER BY final_score DESC, representation, method) = 1 AS best_of_k FROM f""")
def m17_candidate_scores(t: Tables):
    price, size = F.col("p_retailprice"), F.col("p_size")
    c = t.part.groupBy(F.col("p_brand").alias("representation"), (4 + size % 5).alias("k"), F.col("p_type").alias("method")).agg(
        F.count(F.lit(1)).alias("smallest"), (F.avg(size) / 100).alias("largest_share"), (F.stddev_samp(price) / F.avg(price)).alias("silhouette"), F.log1p(F.sum(price)).alias("ch"),
        F.stddev_pop(size).alias("db"), F.avg(price).alias("balance"), (F.max(price) - F.min(price)).alias("separation"), F.min(size).alias("stability"),
    )
    c = c.withColumn("silhouette", F.when(~F.isnan("silhouette"), F.col("silhouette")))
    rule = lambda least, most: F.col("silhouette").isNotNull() & (F.col("smallest") >= least) & (F.col("largest_share") <= most)
    e = cs.eligible(c, rule(4, 0.22), rule(2, 0.45))
    s = cs.weighted_score(e, {"silhouette": (0.15, True), "ch": (0.10, True), "db": (0.10, False), "balance": (0.30, True), "separation": (0.35, True)}, "first_score").withColumn("first_score", R("first_score", 9))
    short = cs.best_of(s, ["representation", "k"], "first_score", 2, ["method"])
    f = cs.weighted_score(short, {"separation": (0.25, True), "balance": (0.25, True), "stability": (0.20, True), "silhouette": (0.15, True), "ch": (0.10, True), "db": (0.05, False)}, "final_score").withColumn("final_score", R("final_score", 9))
    place = F.row_number().over(W.partitionBy("k").orderBy(F.desc("final_score"), "representation", "method"))
    return f.select("representation", "k", "method", "rule", R("first_score", 7).alias("first_score"), "place", R("final_score", 7).alias("final_score"), (place == 1).alias("best_of_k"))


@query()
def m18_consensus(t: Tables):
    s = _scaled(t)
    fits = {m: cs.fit(s, COLS, 3, m).select("dong", F.col("label").alias(m)) for m in ("kmeans", "bisecting", "mixture")}
    names = list(fits)
    rows = []
    for a in names:
        peers = [float(cs.adjusted_rand(fits[a].join(fits[b], "dong"), a, b).first()["ari"]) for b in names if b != a]
        rows.append((a, sum(peers) / len(peers), min(peers)))
    return t.spark.createDataFrame(rows, "method string, mean_ari double, min_ari double")


@query()
def m19_imputation_sensitivity(t: Tables):
    s = _scaled(t)
    whole, seen = cs.fit(s, COLS, 3).select("dong", F.col("label").alias("a")), cs.fit(s.filter("dong % 6 <> 1"), COLS, 3).select("dong", F.col("label").alias("b"))
    return cs.adjusted_rand(whole.join(seen, "dong"), "a", "b")


@query()
def m20_two_stage(t: Tables):
    return cs.two_stage(_scaled(t), "dong", ["f2", "f3"], ["f1", "f4"], 3)


@query("SELECT a, b, round(r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM features" for i, a in enumerate(COLS) for b in COLS[i + 1 :]) + ")")
def m21_correlations(t: Tables):
    return st.correlations(t.features, COLS).select("a", "b", R("r", 6).alias("r"))


RANKS = "SELECT {g}, {v}, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r FROM {t}"


COSTS = ["rent_cost", "oneway_min", "hours", "total"]


@query("SELECT a, b, round(r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM burden" for i, a in enumerate(COSTS) for b in COSTS[i + 1 :]) + ") WHERE abs(r) > 0.8")
def m21_strong_pairs(t: Tables):
    return st.correlations(t.burden, COSTS).filter(F.abs("r") > 0.8).select("a", "b", R("r", 6).alias("r"))


@query("""SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY rent_cost) + (count(*) OVER (PARTITION BY rent_cost) - 1) / 2.0 AS a, rank() OVER (ORDER BY oneway_min) + (count(*) OVER (PARTITION BY oneway_min) - 1) / 2.0 AS b FROM burden)""")
def m21_spearman(t: Tables):
    return st.spearman(t.burden, "rent_cost", "oneway_min").select("n", R("rho", 6).alias("rho"))


@query("SELECT zone, count(*) AS n, round(avg(tx), 4) AS mean, median(tx) AS med, round(stddev_samp(tx), 4) AS sd FROM burden JOIN dim_region USING (dong) GROUP BY zone")
def m22_posthoc_profile(t: Tables):
    return t.burden.join(t.dim_region, "dong").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), R(F.avg("tx"), 4).alias("mean"), F.median("tx").alias("med"), R(F.stddev_samp("tx"), 4).alias("sd"))


@query(f"""WITH r AS ({RANKS.format(g='p_type', v='p_size', t='part')}), q AS (SELECT sum(s * s / n) AS q, sum(n) AS n, count(*) AS groups FROM (SELECT p_type, sum(r) AS s, count(*) AS n FROM r GROUP BY 1)), ti AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM part GROUP BY p_size)),
    h AS (SELECT n, groups, (12 / (n * (n + 1.0::DOUBLE)) * q - 3 * (n + 1)) / (1 - ties / (n::DOUBLE ** 3 - n)) AS h FROM q, ti) SELECT n, groups, round(h, 6) AS h, round(h / (n - 1), 8) AS epsilon2 FROM h""")
def m23_kruskal(t: Tables):
    return st.kruskal(t.part, "p_type", "p_size").select("n", "groups", R("h", 6).alias("h"), R("epsilon2", 8).alias("epsilon2"))


@query(f"""WITH r AS ({RANKS.format(g='p_brand', v='p_size', t='part')}), q AS (SELECT sum(s * s / n) AS q, sum(n) AS n, count(*) AS groups FROM (SELECT p_brand, sum(r) AS s, count(*) AS n FROM r GROUP BY 1)), ti AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM part GROUP BY p_size)),
    h AS (SELECT n, groups, (12 / (n * (n + 1.0::DOUBLE)) * q - 3 * (n + 1)) / (1 - ties / (n::DOUBLE ** 3 - n)) AS h FROM q, ti)
    SELECT n, groups, round(h, 6) AS h, round(exp(-h / 2) * list_sum(list_transform(range(0, (groups - 1) // 2), lambda i: (h / 2) ** i / gamma(i + 1))), 8) AS p FROM h""")
def m23_kruskal_p(t: Tables):
    """Over brands: their number is odd, so that the tail is a finite sum in SQL."""
    return st.with_chi2_p(st.kruskal(t.part, "p_brand", "p_size"), "h").select("n", "groups", R("h", 6).alias("h"), R("p", 8).alias("p"))


@query("""WITH c AS (SELECT p_type AS a, p_size % 3 AS b, count(*) AS o FROM part GROUP BY 1, 2), e AS (SELECT c.o, (sum(o) OVER (PARTITION BY a)) * (sum(o) OVER (PARTITION BY b)) / (sum(o) OVER ())::DOUBLE AS e, sum(o) OVER () AS n FROM c)
    SELECT max(n) AS n, (SELECT count(DISTINCT a) FROM c) AS rows, (SELECT count(DISTINCT b) FROM c) AS columns, round(sum((o - e) ** 2 / e), 6) AS chi2, round(sqrt(sum((o - e) ** 2 / e) / (max(n) * 2)), 8) AS v FROM e""")
def m24_contingency(t: Tables):
    return st.contingency(t.part.select(F.col("p_type").alias("a"), (F.col("p_size") % 3).alias("b")), "a", "b").select("n", "rows", "columns", R("chi2", 6).alias("chi2"), R("v", 8).alias("v"))


@query(f"""WITH r AS ({RANKS.format(g="p_type = 'SMALL' AS g", v='p_retailprice', t='part')}), s AS (SELECT sum(g::INT)::DOUBLE AS n1, sum((NOT g)::INT)::DOUBLE AS n2, sum(CASE WHEN g THEN r END)::DOUBLE AS rs FROM r), ti AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM part GROUP BY p_retailprice)),
    u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u FROM s, ti), z AS (SELECT *, (u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u),
    h AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * abs(z) * list_sum(list_transform(range(0, 121), lambda k: exp(k * ln(greatest(z * z, 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) AS h FROM z)
    SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, u, round(2 * u / (n1 * n2) - 1, 8) AS rank_biserial, round(z, 6) AS z, round(CASE WHEN z > 6 THEN 0 WHEN z < -6 THEN 1 WHEN z >= 0 THEN 0.5 - h ELSE 0.5 + h END, 8) AS p FROM h""")
def m25_mann_whitney(t: Tables):
    m = st.mann_whitney(t.part.select((F.col("p_type") == "SMALL").alias("g"), "p_retailprice"), "g", "p_retailprice")
    return m.select("n1", "n2", "u", R("rank_biserial", 8).alias("rank_biserial"), R("z", 6).alias("z"), R("p", 8).alias("p"))


@query("""WITH x AS (SELECT *, 1 + (p_size > q[1])::INT + (p_size > q[2])::INT + (p_size > q[3])::INT AS quarter FROM part, (SELECT quantile_cont(p_size::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM part))
    SELECT *, round(flagged - other, 6) AS difference FROM (SELECT quarter, count(CASE WHEN p_type = 'SMALL' THEN 1 END) AS n1, count(CASE WHEN p_type <> 'SMALL' THEN 1 END) AS n2, median(CASE WHEN p_type = 'SMALL' THEN p_retailprice END) AS flagged, median(CASE WHEN p_type <> 'SMALL' THEN p_retailprice END) AS other FROM x GROUP BY quarter) WHERE n1 >= 3 AND n2 >= 3""")
def m25_by_quartile(t: Tables):
    m = st.medians_by_quartile(t.part.select((F.col("p_type") == "SMALL").alias("g"), "p_retailprice", "p_size"), "g", "p_retailprice", "p_size")
    return m.select("quarter", "n1", "n2", "flagged", "other", R("difference", 6).alias("difference"))


@query()
def m26_k_evaluation(t: Tables):
    from hearthway.operators.scores import average_rank

    k = cs.k_scan(_scaled(t), COLS, [2, 3, 4, 5]).withColumns({"_s": -F.col("silhouette"), "_h": -F.col("calinski_harabasz")})
    metrics = {"_s": "r1", "_h": "r2", "davies_bouldin": "r3", "inertia": "r4"}
    for metric, name in metrics.items():
        k = average_rank(k, metric, name)
    mean = (F.col("r1") + F.col("r2") + F.col("r3") + F.col("r4")) / 4
    return k.select("k", "silhouette", "calinski_harabasz", "davies_bouldin", "inertia", "smallest", mean.alias("mean_rank"), F.rank().over(W.orderBy(mean)).alias("place"))


VIEWS["structure"] = """SELECT dong, (inside - avg(inside) OVER ()) / stddev_pop(inside) OVER () AS inside, (entropy - avg(entropy) OVER ()) / stddev_pop(entropy) OVER () AS entropy FROM (
    SELECT f.dong, o.inside, o.entropy FROM features f JOIN (SELECT home AS dong, sum(CASE WHEN home = work THEN flow ELSE 0 END) / sum(flow) AS inside, -sum(share * ln(share)) / ln(count(*)) AS entropy FROM ranked_od GROUP BY home) o USING (dong))"""


@query("""WITH s AS (SELECT dong, f1 AS rent, (f2 + f3) / 2 AS commute, (f1 + f2 + f3) / 3 AS burden_, (inside - entropy) / 2 AS local_ FROM scaled JOIN structure USING (dong)),
    m AS (SELECT median(rent) AS h, median(commute) AS c, median(burden_) AS b, median(local_) AS s FROM s)
    SELECT dong, CASE WHEN rent <= h THEN 'low rent' ELSE 'high rent' END || ', ' || CASE WHEN commute <= c THEN 'low commute' ELSE 'high commute' END AS rent_commute,
    CASE WHEN burden_ <= b THEN 'low burden' ELSE 'high burden' END || ', ' || CASE WHEN local_ <= m.s THEN 'dispersed' ELSE 'local' END AS burden_structure FROM s, m""")
def c28_quadrants(t: Tables):
    o = fl.concentration(t.od).select(F.col("home").alias("dong"), F.col("entropy_norm").alias("entropy")).join(fl.internal_share(t.od).select(F.col("home").alias("dong"), F.col("internal_share").alias("inside")), "dong")
    structure = cs.standard_scale(t.features.select("dong").join(o, "dong"), ["inside", "entropy"])
    scores = {"rent": F.col("f1"), "commute": (F.col("f2") + F.col("f3")) / 2, "burden": (F.col("f1") + F.col("f2") + F.col("f3")) / 3, "local": (F.col("inside") - F.col("entropy")) / 2}
    s = _scaled(t).join(structure, "dong").select("dong", *[v.alias(k) for k, v in scores.items()])
    m = s.agg(*[F.median(k).alias(f"m_{k}") for k in scores])
    side = lambda k, low, high: F.when(F.col(k) <= F.col(f"m_{k}"), low).otherwise(high)
    grids = s.crossJoin(F.broadcast(m))
    return grids.select("dong", F.concat_ws(", ", side("rent", "low rent", "high rent"), side("commute", "low commute", "high commute")).alias("rent_commute"), F.concat_ws(", ", side("burden", "low burden", "high burden"), side("local", "dispersed", "local")).alias("burden_structure"))


@query("""WITH l AS (SELECT b.dong, b.tx, ln(b.rent_cost / z.m) AS x FROM burden b JOIN dim_region r USING (dong) JOIN (SELECT r.zone, median(rent_cost) AS m FROM burden b JOIN dim_region r USING (dong) GROUP BY 1) z ON z.zone = r.zone), m AS (SELECT median(x) AS med, stddev_samp(x) AS sd FROM l), d AS (SELECT median(abs(x - med)) AS mad FROM l, m),
    z AS (SELECT dong, tx, x, CASE WHEN mad > 0 THEN (x - med) / (1.4826 * mad) WHEN sd > 0 THEN (x - med) / sd ELSE 0 END AS z FROM l, m, d)
    SELECT dong, round(x, 6) AS log_ratio, round(z, 4) AS z, CASE WHEN abs(z) > 2.5 AND tx < 590 THEN 'odd and few' WHEN abs(z) > 2.5 THEN 'odd' WHEN tx < 590 THEN 'few' ELSE 'plain' END AS diagnosis FROM z""")
def c34_anomalies(t: Tables):
    b = t.burden.join(t.dim_region, "dong").select("dong", "zone", "rent_cost", "tx")
    return st.anomalies(b, "dong", "rent_cost", "zone", "tx", 590).select("dong", R("log_ratio", 6).alias("log_ratio"), R("z", 4).alias("z"), "diagnosis")


def _pct(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / (SELECT count({c}) FROM x) END"


@query(f"""WITH n AS (SELECT work AS dong, sum(flow) AS inflow FROM od WHERE home <> work GROUP BY 1), o AS (SELECT home AS dong, sum(flow) AS outflow FROM od WHERE home <> work GROUP BY 1),
    p AS (SELECT home AS dong, sum(CASE WHEN minute_of_day BETWEEN 540 AND 1079 THEN weight ELSE 0 END) / nullif(sum(CASE WHEN minute_of_day NOT BETWEEN 540 AND 1079 THEN weight ELSE 0 END), 0) AS day_night, sum(CASE WHEN dayofweek(ts) BETWEEN 1 AND 5 THEN weight ELSE 0 END) / sum(weight) AS weekday FROM mobility GROUP BY 1),
    x AS (SELECT r.dong, coalesce(inflow, 0) AS inflow, coalesce(inflow, 0) / nullif(coalesce(outflow, 0), 0) AS ratio, round(day_night, 9) AS day_night, round(weekday, 9) AS weekday FROM dim_region r LEFT JOIN n USING (dong) LEFT JOIN o USING (dong) LEFT JOIN p USING (dong)),
    q AS (SELECT *, {_pct('inflow')} AS r1, {_pct('ratio')} AS r2, {_pct('day_night')} AS r3, {_pct('weekday')} AS r4, inflow >= (SELECT quantile_cont(inflow::DOUBLE, 0.85) FROM x) AND coalesce(ratio > 1, false) AND coalesce(day_night > 1, false) AS centre FROM x)
    SELECT dong, round((coalesce(r1, 0) + coalesce(r2, 0) + coalesce(r3, 0) + coalesce(r4, 0)) / ((r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT + (r4 IS NOT NULL)::INT), 8) AS score, centre, round(sum(CASE WHEN centre THEN inflow ELSE 0 END) OVER () / sum(inflow) OVER (), 8) AS absorbed FROM q""")
def c25_workplace_score(t: Tables):
    n = fl.node_flows(t.od).select(F.col("node").alias("dong"), "inflow", F.col("in_out_ratio").alias("ratio"))
    day, weight = F.col("minute_of_day").between(540, 1079), F.col("weight")
    night = F.sum(F.when(~day, weight).otherwise(0))
    people = t.mobility.groupBy(F.col("home").alias("dong")).agg(R(F.sum(F.when(day, weight).otherwise(0)) / F.nullif(night, F.lit(0)), 9).alias("day_night"), R(F.sum(F.when(F.dayofweek("ts").between(2, 6), weight).otherwise(0)) / F.sum(weight), 9).alias("weekday"))
    x = t.dim_region.select("dong").join(n, "dong", "left").na.fill(0, ["inflow"]).join(people, "dong", "left")
    return sc.workplace_score(x, "inflow", ["inflow", "ratio", "day_night", "weekday"], ["ratio", "day_night"]).select("dong", R("score", 8).alias("score"), "centre", R("absorbed", 8).alias("absorbed"))


@query("""WITH names AS (SELECT 'Supplier#' || lpad((k * 9)::VARCHAR, 9, '0') AS name, 'D' || k % 3 AS district FROM (SELECT unnest(range(15)) AS k)) SELECT n.name, n.district, r.dong, CASE WHEN r.dong IS NULL THEN 'listed but missing' ELSE 'listed' END AS status FROM names n LEFT JOIN dim_region r ON r.dong_name = n.name""")
def c26_district_lists(t: Tables):
    k = F.col("id")
    names = t.spark.range(15).select(F.concat(F.lit("Supplier#"), F.lpad((k * 9).cast("string"), 9, "0")).alias("name"), F.concat(F.lit("D"), k % 3).alias("district"))
    j = F.broadcast(names).join(t.dim_region.select(F.col("dong_name").alias("name"), "dong"), "name", "left")
    return j.select("name", "district", "dong", F.when(F.col("dong").isNull(), "listed but missing").otherwise("listed").alias("status"))


EDGES = "e AS (SELECT least(home, work) AS a, greatest(home, work) AS b, sum(flow) AS flow FROM od WHERE home <> work GROUP BY 1, 2)"


CUTS = " UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, quantile_cont(flow::DOUBLE, {q}) AS cut FROM e" for q in (0.0, 0.1, 0.25, 0.5))


@query(f"""WITH RECURSIVE {EDGES}, q AS ({CUTS}), f AS (SELECT quantile, cut, sum(CASE WHEN flow >= cut THEN flow ELSE 0 END) / sum(flow) AS flow_kept, count(CASE WHEN flow >= cut THEN 1 END) / count(*) AS edges_kept FROM e, q GROUP BY 1, 2),
    v AS (SELECT a AS node FROM e UNION SELECT b FROM e), u AS (SELECT quantile, a AS x, b AS y FROM e, q WHERE flow >= cut UNION SELECT quantile, b, a FROM e, q WHERE flow >= cut),
    r(quantile, x, y) AS (SELECT quantile, node, node FROM v, q UNION SELECT r.quantile, r.x, u.y FROM r JOIN u ON u.quantile = r.quantile AND u.x = r.y),
    c AS (SELECT quantile, count(DISTINCT y) AS components FROM (SELECT quantile, x, min(y) AS y FROM r GROUP BY 1, 2) GROUP BY 1),
    n AS (SELECT quantile, count(DISTINCT x) / (SELECT count(*) FROM v) AS nodes_kept FROM u GROUP BY 1), k AS (SELECT * FROM f JOIN n USING (quantile) JOIN c USING (quantile))
    SELECT quantile, cut, flow_kept, edges_kept, nodes_kept, components, quantile = coalesce((SELECT max(quantile) FROM k WHERE flow_kept >= 0.95 AND nodes_kept >= 0.99), (SELECT min(quantile) FROM k)) AS selected FROM k""")
def g01_filter_sensitivity(t: Tables):
    return gr.filter_sensitivity(fl.undirected(t.od, t.parts), [0.0, 0.1, 0.25, 0.5])


@query("SELECT dong AS node, min(dong) OVER (PARTITION BY gu) AS component FROM (SELECT *, count(*) OVER (PARTITION BY gu) AS n FROM dim_region) WHERE n > 1")
def g02_components(t: Tables):
    """Chains of the dongs of each gu: the searched minimum has to travel along all of a chain."""
    w = W.partitionBy("gu").orderBy("dong")
    chain = t.dim_region.select(F.col("dong").alias("a"), F.lead("dong").over(w).alias("b")).filter("b is not null")
    return gr.components(chain)


@query(f"""WITH {EDGES}, l AS (SELECT dong AS node, gu AS community FROM dim_region), j AS (SELECT e.flow, x.community AS ca, y.community AS cb FROM e JOIN l x ON x.node = e.a JOIN l y ON y.node = e.b), m AS (SELECT sum(flow) AS m FROM e),
    d AS (SELECT c, sum(flow) AS deg FROM (SELECT ca AS c, flow FROM j UNION ALL SELECT cb, flow FROM j) GROUP BY 1), w AS (SELECT ca AS c, sum(flow) AS win FROM j WHERE ca = cb GROUP BY 1) SELECT round(sum(coalesce(win, 0) / m - (deg / (2 * m)) ** 2), 9) AS modularity FROM d LEFT JOIN w USING (c), m""")
def g04_modularity(t: Tables):
    labels = t.dim_region.select(F.col("dong").alias("node"), F.col("gu").alias("community"))
    return gr.modularity(fl.undirected(t.od, t.parts), labels).select(R("modularity", 9).alias("modularity"))


@query()
def g03_communities(t: Tables):
    return gr.communities(fl.undirected(t.od, t.parts))[0]


def _streamed(t: Tables, name: str, columns: list[str], files: int = 4):
    """A provided table dealt over several files, read file by file."""
    out = f"{stage_dir(t.spark)}/files-{uuid.uuid4().hex}"
    getattr(t, name).select(*columns).repartition(files).write.parquet(out)
    return jobs.stream_of(t.spark, out)


@query("SELECT l_suppkey AS dong, l_returnflag AS flag, sum(l_quantity) AS flow, count(*) AS n_rows, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY 1, 2")
def x01_streaming_flows(t: Tables):
    s = _streamed(t, "lineitem", ["l_suppkey", "l_returnflag", "l_quantity", "l_discount"]).withColumnsRenamed({"l_suppkey": "dong", "l_returnflag": "flag"})
    return jobs.running_flows(s, ["dong", "flag"], "l_quantity", "l_discount")


@query("SELECT 'valid' AS side, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'orphan', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def x02_streaming_quarantine(t: Tables):
    s = _streamed(t, "orders", ["o_orderkey", "o_custkey"])
    valid, orphan = jobs.split_stream(s, t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    n = lambda d, side: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return n(valid, "valid").unionByName(n(orphan, "orphan"))


@query("""WITH m AS (SELECT ts, value, event_id % 4 AS b FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN 420 AND 580), s AS (SELECT b, max(epoch_ms(ts)) AS top FROM m GROUP BY b),
    w AS (SELECT x.b, (SELECT max(top) FROM s y WHERE y.b < x.b) - 6 * 86400000 AS mark FROM s x), j AS (SELECT m.*, coalesce(epoch_ms(date_trunc('hour', ts)) + 3600000 <= mark, false) AS late FROM m JOIN w USING (b))
    SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (NOT late) AS n, round(coalesce(sum(value) FILTER (NOT late), 0), 2) AS volume, count(*) FILTER (late) AS late FROM j GROUP BY 1""")
def x03_streaming_morning_volume(t: Tables):
    """Four micro-batches that all span the whole time, with a lateness of six days: much of the later ones is late."""
    out = f"{stage_dir(t.spark)}/files-{uuid.uuid4().hex}"
    for b in range(4):
        t.events.filter(F.col("event_id") % 4 == b).select("ts", "value").repartition(4).write.mode("append").parquet(out)
    volumes, late = jobs.morning_volume(jobs.stream_of(t.spark, out, files=4), late="6 days")
    missed = late.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("late"))
    both = volumes.join(missed, "hour", "full").na.fill(0, ["n", "late", "volume"])
    return both.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n", R("volume", 2).alias("volume"), "late")
