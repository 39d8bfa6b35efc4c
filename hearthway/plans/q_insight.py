"""Registered queries: insight suite over work-by-home pairs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.operators import insight as ins
from hearthway.operators import positions
from hearthway.operators import scores as sc
from hearthway.operators import statistics as st

from .tables import VIEWS, Tables, query

R = F.round

VIEWS["pairs"] = """SELECT work, home, rent_cost, time_min, hours, fare_cost, time_cost, round(rent_cost + fare_cost + time_cost, 2) AS total FROM (
    SELECT *, round(hours * 10320, 2) AS time_cost FROM (SELECT r.work, r.home, c.rent_cost, r.time_min, round(42 * r.time_min / 60, 4) AS hours, round(42 * coalesce(r.fare, m.f), 2) AS fare_cost
    FROM route r JOIN (SELECT home, round(avg(fare), 4) AS f FROM route GROUP BY 1) m ON m.home = r.home JOIN costs c ON c.dong = r.home WHERE r.time_min BETWEEN 1 AND 90))"""
VIEWS["base_home"] = """SELECT work, home, rent_cost, hours, fare_cost, time_cost FROM (SELECT p.*, row_number() OVER (PARTITION BY p.work ORDER BY abs(rent_cost - m), home) AS k
    FROM pairs p JOIN (SELECT work, median(rent_cost) AS m FROM pairs WHERE time_min <= 30 GROUP BY 1) q ON p.work = q.work WHERE time_min <= 30) WHERE k = 1"""
VIEWS["scored"] = """SELECT *, CASE WHEN max(rent_cost) OVER w > min(rent_cost) OVER w THEN 100 * (max(rent_cost) OVER w - rent_cost) / (max(rent_cost) OVER w - min(rent_cost) OVER w) ELSE 50 END AS s_rent,
    CASE WHEN max(fare_cost) OVER w > min(fare_cost) OVER w THEN 100 * (max(fare_cost) OVER w - fare_cost) / (max(fare_cost) OVER w - min(fare_cost) OVER w) ELSE 50 END AS s_fare,
    CASE WHEN max(hours) OVER w > min(hours) OVER w THEN 100 * (max(hours) OVER w - hours) / (max(hours) OVER w - min(hours) OVER w) ELSE 50 END AS s_time FROM pairs WINDOW w AS (PARTITION BY work)"""


def _pairs(t: Tables):
    return ins.commute_table(t.route, t.costs)


def _by_work(t: Tables):
    """The pairs dealt by work: medians, ranks and tops of a work need no shuffle of their own, and a task's rows stay bounded."""
    return _pairs(t).repartition(t.parts, "work")


@query("SELECT work, home, rent_cost, hours, fare_cost, time_cost, total, round(rent_cost / total, 6) AS rent_share FROM pairs")
def c11_commute_table(t: Tables):
    return _pairs(t).select("work", "home", "rent_cost", "hours", "fare_cost", "time_cost", "total", R(F.col("rent_cost") / F.col("total"), 6).alias("rent_share"))


@query("SELECT work, home, rent_cost FROM base_home")
def c12_w12_baseline_home(t: Tables):
    return ins.baseline_homes(_by_work(t)).select("work", "home", "rent_cost")


TRADE = """t AS (SELECT work, home, saving, added, round(saving - added, 2) AS net FROM (SELECT p.work, p.home, round(b.rent_cost - p.rent_cost, 2) AS saving, round(p.fare_cost + p.time_cost - b.fare_cost - b.time_cost, 2) AS added FROM pairs p JOIN base_home b ON p.work = b.work))"""


@query(f"WITH {TRADE} SELECT *, CASE WHEN saving > 0 AND net < 0 THEN 'illusion' WHEN net > 0 THEN 'real saving' ELSE 'no saving' END AS verdict, CASE WHEN saving >= 10000 THEN round(net / saving * 10000, 4) END AS net_per_10k FROM t")
def c13_tradeoffs(t: Tables):
    return ins.tradeoffs(_by_work(t))


@query(f"WITH {TRADE} SELECT work, count(*) AS n, median(net) AS med_net, round(avg(CASE WHEN saving > 0 AND net < 0 THEN 1 ELSE 0 END), 6) AS illusion_ratio, round(avg(saving), 2) AS mean_saving FROM t GROUP BY work")
def a28_tradeoff_summary(t: Tables):
    x = ins.tradeoffs(_by_work(t))
    return x.groupBy("work").agg(F.count(F.lit(1)).alias("n"), F.median("net").alias("med_net"), R(F.avg((F.col("verdict") == "illusion").cast("int")), 6).alias("illusion_ratio"), R(F.avg("saving"), 2).alias("mean_saving"))


EFF = """e AS (SELECT p.work, p.home, p.rent_cost, p.hours, p.total, CASE WHEN p.rent_cost <= mr AND p.hours <= mh THEN 'cheap and near' WHEN p.rent_cost <= mr THEN 'cheap and far' WHEN p.hours <= mh THEN 'dear and near' ELSE 'dear and far' END AS kind,
    round(lo / total * 100, 4) AS idx, rank() OVER (PARTITION BY p.work ORDER BY p.rent_cost) AS rent_rank, rank() OVER (PARTITION BY p.work ORDER BY p.total) AS total_rank FROM pairs p JOIN (SELECT work, median(rent_cost) AS mr, median(hours) AS mh, min(total) AS lo FROM pairs GROUP BY 1) m ON m.work = p.work)"""


@query(f"WITH {EFF} SELECT work, home, kind, idx, rent_rank, total_rank, rent_rank::BIGINT - total_rank::BIGINT AS rank_change FROM e")
def c14_a29_efficiency(t: Tables):
    return ins.efficiency(_by_work(t)).select("work", "home", "kind", "idx", "rent_rank", "total_rank", "rank_change")


@query(f"WITH {EFF} SELECT work, count(*) AS n, round(corr(rent_rank, total_rank), 6) AS rho, round(avg(abs(rent_rank::BIGINT - total_rank::BIGINT)), 6) AS mean_change, round(avg(CASE WHEN total_rank::BIGINT - rent_rank::BIGINT > 10 THEN 1 ELSE 0 END), 6) AS hidden_share FROM e GROUP BY work HAVING count(*) >= 10")
def c15_rank_correlation(t: Tables):
    e = ins.efficiency(_by_work(t))
    return e.groupBy("work").agg(F.count(F.lit(1)).alias("n"), R(F.corr("rent_rank", "total_rank"), 6).alias("rho"), R(F.avg(F.abs("rank_change")), 6).alias("mean_change"), R(F.avg((F.col("rank_change") < -10).cast("int")), 6).alias("hidden_share")).filter("n >= 10")


@query("""SELECT wage, work, home, place FROM (SELECT v.wage, work, home, row_number() OVER (PARTITION BY v.wage, work ORDER BY round(rent_cost + fare_cost + hours * v.wage, 2), home) AS place FROM pairs CROSS JOIN (VALUES (5160), (10320), (20640)) v(wage)) WHERE place <= 10""")
def c16_scenarios_top10(t: Tables):
    v = t.spark.createDataFrame([(5160,), (10320,), (20640,)], "wage int")
    p = _by_work(t).crossJoin(F.broadcast(v)).withColumn("cost", R(F.col("rent_cost") + F.col("fare_cost") + F.col("hours") * F.col("wage"), 2))
    return p.withColumn("place", F.row_number().over(W.partitionBy("wage", "work").orderBy("cost", "home"))).filter("place <= 10").select("wage", "work", "home", "place")


@query("""SELECT d.district, c.home, c.mean_total, c.k, c.n FROM (SELECT DISTINCT zone AS district FROM dim_region) d LEFT JOIN (SELECT district, home, mean_total, n, rank() OVER (PARTITION BY district ORDER BY mean_total) AS k FROM (
    SELECT b.district, p.home, round(sum(b.weight * p.total) / sum(b.weight), 2) AS mean_total, count(*) AS n FROM pairs p JOIN bridge b ON b.dong = p.work WHERE p.time_min <= 60 AND p.rent_cost <= 260000 GROUP BY 1, 2)) c ON c.district = d.district""")
def c17_district_candidates(t: Tables):
    from hearthway.operators.flows import weighted_mean

    j = _pairs(t).filter("time_min <= 60 and rent_cost <= 260000").join(t.bridge.select(F.col("dong").alias("work"), "district", "weight"), "work")
    c = j.groupBy("district", "home").agg(R(weighted_mean("total", "weight"), 2).alias("mean_total"), F.count(F.lit(1)).alias("n"))
    c = c.withColumn("k", F.rank().over(W.partitionBy("district").orderBy("mean_total")))
    return t.dim_region.select(F.col("zone").alias("district")).distinct().join(c, "district", "left").select("district", "home", "mean_total", "k", "n")


TOPS = """x AS (SELECT work, home FROM (SELECT work, home, row_number() OVER (PARTITION BY work ORDER BY total, home) AS k FROM pairs) WHERE k <= 10)"""


@query(f"""WITH {TOPS}, n AS (SELECT work, count(*) AS n FROM x GROUP BY 1) SELECT a.work AS w1, b.work AS w2, count(*) AS common, round(count(*) / least(10, min(na.n), min(nb.n)), 6) AS overlap, string_agg(a.home::VARCHAR, ',' ORDER BY a.home) AS homes
    FROM x a JOIN x b ON a.home = b.home AND a.work < b.work JOIN n na ON na.work = a.work JOIN n nb ON nb.work = b.work GROUP BY 1, 2""")
def c18_t06_topk_overlap(t: Tables):
    k = F.row_number().over(W.partitionBy("work").orderBy("total", "home"))
    x = _by_work(t).withColumn("k", k).filter("k <= 10").select("work", "home")
    n = x.groupBy("work").agg(F.count(F.lit(1)).alias("n"))
    j = x.withColumnRenamed("work", "w1").join(x.withColumnRenamed("work", "w2"), "home").filter("w1 < w2").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("common"), F.array_join(F.transform(F.array_sort(F.collect_list("home")), lambda h: h.cast("string")), ",").alias("homes"))
    j = j.join(n.withColumnsRenamed({"work": "w1", "n": "n1"}), "w1").join(n.withColumnsRenamed({"work": "w2", "n": "n2"}), "w2")
    return j.select("w1", "w2", "common", R(F.col("common") / F.least(F.lit(10), "n1", "n2"), 6).alias("overlap"), "homes")


@query("""SELECT work, home, c_rent, c_fare, c_time, score, CASE WHEN score > 0 THEN round(c_rent / score, 6) END AS rent_part, row_number() OVER (PARTITION BY work ORDER BY score DESC, home) AS place
    FROM (SELECT *, round(c_rent + c_fare + c_time, 6) AS score FROM (SELECT work, home, round(s_rent * 0.5, 6) AS c_rent, round(s_fare * 0.25, 6) AS c_fare, round(s_time * 0.25, 6) AS c_time FROM scored))""")
def c19_recommendation_score(t: Tables):
    return ins.recommendation_score(_by_work(t), (2, 1, 1)).select("work", "home", "c_rent", "c_fare", "c_time", "score", "rent_part", "place")


WGRID = """g AS (SELECT w, work, home, row_number() OVER (PARTITION BY w, work ORDER BY round(w * s_rent + (1 - w) * 0.75 * s_fare + (1 - w) * 0.25 * s_time, 6) DESC, home) AS place FROM scored CROSS JOIN (VALUES (0.3::DOUBLE), (0.35::DOUBLE), (0.4::DOUBLE), (0.45::DOUBLE), (0.5::DOUBLE)) v(w))"""


def _wgrid(t: Tables):
    grid = t.spark.createDataFrame([(0.3,), (0.35,), (0.4,), (0.45,), (0.5,)], "w double")
    return ins.weight_grid(_by_work(t), grid)


@query(f"WITH {WGRID} SELECT w, work, home, place FROM g WHERE place <= 5")
def c20_weight_sensitivity(t: Tables):
    return _wgrid(t).filter("place <= 5").select("w", "work", "home", "place")


@query(f"WITH {WGRID}, top AS (SELECT w, work, home, first_value(home) OVER (PARTITION BY work ORDER BY w) AS base FROM g WHERE place = 1) SELECT work, base, w, home FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY w) AS k FROM top WHERE home <> base) WHERE k = 1")
def c20_w14_first_switch(t: Tables):
    return ins.first_switch(_wgrid(t).filter("place = 1"), "w").select("work", "base", "w", "home")


IGRID = """i AS (SELECT income, work, home, row_number() OVER (PARTITION BY income, work ORDER BY round(rent_cost + fare_cost + hours * income / 209 * 0.5, 2), home) AS place FROM pairs CROSS JOIN (SELECT unnest(range(2000000, 4000001, 100000)) AS income))"""


def _igrid(t: Tables):
    cost = lambda income: R(F.col("rent_cost") + F.col("fare_cost") + F.col("hours") * income / 209 * 0.5, 2)
    return ins.tops(_by_work(t), "income", [F.lit(i).cast("long") for i in range(2000000, 4000001, 100000)], cost, [])


@query(f"WITH {IGRID} SELECT income, work, home, before FROM (SELECT income, work, home, lag(home) OVER (PARTITION BY work ORDER BY income) AS before FROM i WHERE place = 1) WHERE before IS NOT NULL AND before <> home")
def c21_w13_income_switches(t: Tables):
    return ins.switches(_igrid(t), "income").select("income", "work", "home", "before")


@query("""SELECT budget, work, home, hours, lag(hours) OVER (PARTITION BY work ORDER BY budget) - hours AS saved_hours, lag(home) OVER (PARTITION BY work ORDER BY budget) AS before FROM (
    SELECT v.budget, work, home, hours, row_number() OVER (PARTITION BY v.budget, work ORDER BY hours, home) AS k FROM pairs JOIN (VALUES (240000), (250000), (260000), (270000), (280000)) v(budget) ON rent_cost <= v.budget) WHERE k = 1""")
def c22_w15_budget_effect(t: Tables):
    fits = lambda budget: F.col("rent_cost") <= budget
    top = ins.tops(_by_work(t), "budget", [F.lit(b) for b in range(240000, 280001, 10000)], lambda _: F.col("hours"), ["hours"], fits)
    w = W.partitionBy("work").orderBy("budget")
    return top.select("budget", "work", "home", "hours", (F.lag("hours").over(w) - F.col("hours")).alias("saved_hours"), F.lag("home").over(w).alias("before"))


@query(f"WITH {WGRID} SELECT a.w, count(*) AS n, round(corr(a.place, b.place), 6) AS rho, round(avg(abs(a.place::BIGINT - b.place::BIGINT)), 6) AS mean_change, round(sum(CASE WHEN a.place <= 5 AND b.place <= 5 THEN 1 ELSE 0 END) / sum(CASE WHEN b.place <= 5 THEN 1 ELSE 0 END), 6) AS top5_overlap FROM g a JOIN g b ON a.work = b.work AND a.home = b.home AND b.w = 0.4 GROUP BY a.w")
def c23_stability(t: Tables):
    g = _wgrid(t)
    base = g.filter("w = 0.4D").select("work", "home", F.col("place").alias("base"))
    in5 = lambda c: F.col(c) <= 5
    return g.join(base, ["work", "home"]).groupBy("w").agg(F.count(F.lit(1)).alias("n"), R(F.corr("place", "base"), 6).alias("rho"), R(F.avg(F.abs(F.col("place") - F.col("base"))), 6).alias("mean_change"), R(F.count_if(in5("place") & in5("base")) / F.count_if(in5("base")), 6).alias("top5_overlap"))


@query("SELECT work, home, rent_cost, hours, total FROM pairs WHERE work = 7 AND rent_cost <= 260000 AND hours <= 18 AND total <= 700000")
def c24_user_filter(t: Tables):
    return _pairs(t).filter("work = 7 and rent_cost <= 260000 and hours <= 18 and total <= 700000").select("work", "home", "rent_cost", "hours", "total")


@query("""WITH r AS (SELECT work, hours, rent_cost, rank() OVER (PARTITION BY work ORDER BY rent_cost) + (count(*) OVER (PARTITION BY work, rent_cost) - 1) / 2.0 AS a, rank() OVER (PARTITION BY work ORDER BY hours) + (count(*) OVER (PARTITION BY work, hours) - 1) / 2.0 AS b FROM pairs),
    g AS (SELECT work, count(*) AS n, regr_slope(hours, rent_cost) AS slope, regr_r2(hours, rent_cost) AS r2, corr(a, b) AS rho FROM r GROUP BY work HAVING count(*) >= 10),
    x AS (SELECT *, least(n - 2, 2000)::INT AS df, atan(abs(rho * sqrt((n - 2) / (1 - rho * rho))) / sqrt(least(n - 2, 2000))) AS th FROM g)
    SELECT work, n, round(slope * 100000, 4) AS slope, round(r2, 6) AS r2, round(rho, 6) AS rho, round(greatest(0, 1 - CASE WHEN df % 2 = 0
      THEN sin(th) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * cos(th) ** (2 * k)))
      ELSE 2 / pi() * (th + sin(th) * cos(th) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * cos(th) ** (2 * k))), 0)) END), 6) AS p FROM x""")
def a26_regression_summary(t: Tables):
    g = st.regression_summary(_by_work(t), "work", "rent_cost", "hours")
    return g.select("work", "n", R(F.col("slope") * 100000, 4).alias("slope"), R("r2", 6).alias("r2"), R("rho", 6).alias("rho"), R("p", 6).alias("p"))


@query("SELECT work, floor(rent_cost / 10000) * 10000 AS band, count(*) AS n, round(avg(hours), 7) AS hours, round(avg(fare_cost), 7) AS fare FROM pairs GROUP BY 1, 2")
def a27_rent_bands(t: Tables):
    return _by_work(t).groupBy("work", (F.floor(F.col("rent_cost") / 10000) * 10000).cast("double").alias("band")).agg(F.count(F.lit(1)).alias("n"), R(F.avg("hours"), 7).alias("hours"), R(F.avg("fare_cost"), 7).alias("fare"))


@query("""SELECT district, gu, n, mean_total, rank() OVER (PARTITION BY district ORDER BY mean_total) AS k FROM (SELECT b.district, r.gu, count(*) AS n, round(avg(p.total), 7) AS mean_total FROM pairs p JOIN bridge b ON b.dong = p.work JOIN dim_region r ON r.dong = p.home GROUP BY 1, 2)""")
def a30_zone_summary(t: Tables):
    j = _pairs(t).join(t.bridge.select(F.col("dong").alias("work"), "district"), "work").join(t.dim_region.select(F.col("dong").alias("home"), "gu"), "home")
    g = j.groupBy("district", "gu").agg(F.count(F.lit(1)).alias("n"), R(F.avg("total"), 7).alias("mean_total"))
    return g.withColumn("k", F.rank().over(W.partitionBy("district").orderBy("mean_total")))


@query("""SELECT home, district, (s - x) / (n - 1) - x AS advantage FROM (SELECT home, district, x, sum(x) OVER (PARTITION BY home) AS s, count(*) OVER (PARTITION BY home) AS n FROM (SELECT p.home, b.district, round(avg(p.total)) AS x FROM pairs p JOIN bridge b ON b.dong = p.work GROUP BY 1, 2)) WHERE n > 1""")
def a44_specialisation(t: Tables):
    g = _pairs(t).join(t.bridge.select(F.col("dong").alias("work"), "district"), "work").groupBy("home", "district").agg(R(F.avg("total")).alias("x"))
    w = W.partitionBy("home")
    g = g.withColumns({"s": F.sum("x").over(w), "n": F.count(F.lit(1)).over(w)}).filter("n > 1")
    return g.select("home", "district", ((F.col("s") - F.col("x")) / (F.col("n") - 1) - F.col("x")).alias("advantage"))


@query("""SELECT home, max(CASE WHEN district = 'ASIA' THEN x END) AS asia, max(CASE WHEN district = 'EUROPE' THEN x END) AS europe, max(CASE WHEN district = 'AFRICA' THEN x END) AS africa FROM (SELECT p.home, b.district, round(avg(p.total), 7) AS x FROM pairs p JOIN bridge b ON b.dong = p.work GROUP BY 1, 2) GROUP BY home""")
def r04_pivot_districts(t: Tables):
    g = _pairs(t).join(t.bridge.select(F.col("dong").alias("work"), "district"), "work").groupBy("home", "district").agg(R(F.avg("total"), 7).alias("x"))
    p = g.groupBy("home").pivot("district", ["ASIA", "EUROPE", "AFRICA"]).agg(F.first("x"))
    return p.select("home", F.col("ASIA").alias("asia"), F.col("EUROPE").alias("europe"), F.col("AFRICA").alias("africa"))


@query("SELECT work, home, rank() OVER (PARTITION BY work ORDER BY total) AS k FROM pairs")
def w02_rank_in_group(t: Tables):
    return _by_work(t).select("work", "home", F.rank().over(W.partitionBy("work").orderBy("total")).alias("k"))


@query("SELECT dong, decile FROM (SELECT dong, ntile(10) OVER (ORDER BY tx, dong) AS decile FROM burden) WHERE decile > 1")
def w03_w04_decile_filter(t: Tables):
    return positions.ntiles(t.burden.select("dong", "tx"), ["tx", "dong"], 10, "decile").filter("decile > 1").select("dong", "decile")


@query("SELECT work, home, round(total - avg(total) OVER (PARTITION BY work), 4) AS dev FROM pairs")
def w08_deviation_from_mean(t: Tables):
    return _by_work(t).select("work", "home", R(F.col("total") - F.avg("total").over(W.partitionBy("work")), 4).alias("dev"))


@query("""WITH r AS (SELECT dong, (rank() OVER (ORDER BY tx) + (count(*) OVER (PARTITION BY tx) - 1) / 2.0) / (SELECT count(*) FROM burden) AS p1, (rank() OVER (ORDER BY rent_cost) + (count(*) OVER (PARTITION BY rent_cost) - 1) / 2.0) / (SELECT count(*) FROM burden) AS p2 FROM burden)
    SELECT dong, round(p1, 8) AS p1, round(p2, 8) AS p2, round((p1 + p2) / 2, 8) AS score FROM r""")
def w09_w10_percentile_rank(t: Tables):
    n = t.burden.agg(F.count(F.lit(1)).alias("n"))
    r = sc.average_rank(sc.average_rank(t.burden.select("dong", "tx", "rent_cost"), "tx", "a1"), "rent_cost", "a2").crossJoin(F.broadcast(n))
    p1, p2 = F.col("a1") / F.col("n"), F.col("a2") / F.col("n")
    return r.select("dong", R(p1, 8).alias("p1"), R(p2, 8).alias("p2"), R((p1 + p2) / 2, 8).alias("score"))


@query("SELECT work, home, total FROM (SELECT work, home, total, row_number() OVER (PARTITION BY work ORDER BY total, home) AS k FROM pairs) WHERE k <= 3")
def w11_topk_per_group(t: Tables):
    return _by_work(t).withColumn("k", F.row_number().over(W.partitionBy("work").orderBy("total", "home"))).filter("k <= 3").select("work", "home", "total")


@query("SELECT work, home, round((rank() OVER (PARTITION BY work ORDER BY hours) + (count(*) OVER (PARTITION BY work, hours) - 1) / 2.0) / count(*) OVER (PARTITION BY work), 8) AS pct FROM pairs")
def w16_group_percentile(t: Tables):
    n = F.count(F.lit(1)).over(W.partitionBy("work"))
    return sc.average_rank(_by_work(t).select("work", "home", "hours"), "hours", "a", ["work"]).select("work", "home", R(F.col("a") / n, 8).alias("pct"))


@query("SELECT work, home, round(s_rent, 6) AS rent_score, round(s_fare, 6) AS fare_score FROM scored")
def w17_minmax_score(t: Tables):
    return _by_work(t).select("work", "home", R(sc.minmax_good_low("rent_cost", ["work"]), 6).alias("rent_score"), R(sc.minmax_good_low("fare_cost", ["work"]), 6).alias("fare_score"))


@query("""WITH x AS (SELECT d.dong, d.gu, CASE WHEN d.dong % 4 = 0 OR d.gu LIKE '%1' THEN NULL ELSE b.rent_cost END AS v FROM dim_region d LEFT JOIN burden b USING (dong)), g AS (SELECT gu, median(v) AS m FROM x GROUP BY 1)
    SELECT dong, coalesce(v, m, (SELECT median(v) FROM x)) AS v, CASE WHEN v IS NOT NULL THEN 'own' WHEN m IS NOT NULL THEN 'gu' ELSE 'all' END AS source FROM x JOIN g USING (gu)""")
def w18_group_median_imputation(t: Tables):
    x = t.dim_region.select("dong", "gu").join(t.burden.select("dong", "rent_cost"), "dong", "left").withColumn("v", F.when((F.col("dong") % 4 != 0) & ~F.col("gu").endswith("1"), F.col("rent_cost")))
    g, a = x.groupBy("gu").agg(F.median("v").alias("m")), x.agg(F.median("v").alias("all_m"))
    j = x.join(g, "gu").crossJoin(F.broadcast(a))
    return j.select("dong", F.coalesce("v", "m", "all_m").alias("v"), F.when(F.col("v").isNotNull(), "own").when(F.col("m").isNotNull(), "gu").otherwise("all").alias("source"))


@query("SELECT home, work, flow FROM od ORDER BY flow DESC, home, work LIMIT 50")
def t01_t02_ordered_limit(t: Tables):
    return t.od.select("home", "work", "flow").orderBy(F.desc("flow"), "home", "work").limit(50)


@query("SELECT 'most' AS side, dong, total FROM (SELECT * FROM burden WHERE total IS NOT NULL ORDER BY total DESC, dong LIMIT 5) UNION ALL SELECT 'least', dong, total FROM (SELECT * FROM burden WHERE total IS NOT NULL ORDER BY total, dong LIMIT 5)")
def t03_t05_extremes(t: Tables):
    b = t.burden.filter("total is not null").select("dong", "total")
    return b.orderBy(F.desc("total"), "dong").limit(5).select(F.lit("most").alias("side"), "dong", "total").unionByName(b.orderBy("total", "dong").limit(5).select(F.lit("least").alias("side"), "dong", "total"))


@query("SELECT dong, rent_cost - m AS gap FROM burden, (SELECT median(rent_cost) AS m FROM burden) ORDER BY abs(rent_cost - m) DESC, dong LIMIT 10")
def t04_t08_largest_gap(t: Tables):
    m = t.burden.agg(F.median("rent_cost").alias("m"))
    return t.burden.crossJoin(F.broadcast(m)).select("dong", (F.col("rent_cost") - F.col("m")).alias("gap")).orderBy(F.desc(F.abs("gap")), "dong").limit(10)
