"""Registered queries: flows, shares, thresholds, coverage, concentration."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.operators import flows as fl

from .tables import Tables, query

R = F.round


@query("SELECT home, work, flow, time_min, dist_km, n_rows FROM od")
def a01_od_aggregate(t: Tables):
    return t.od


@query("""SELECT s_nationkey AS k, count(*) AS n,
    round(coalesce(sum(CASE WHEN s_acctbal IS NOT NULL AND s_acctbal - 5000 > 0 THEN s_suppkey * (s_acctbal - 5000) END)
      / nullif(sum(CASE WHEN s_acctbal - 5000 > 0 THEN s_acctbal - 5000 END), 0), avg(s_suppkey)), 4) AS mean FROM supplier GROUP BY 1""")
def a02_weighted_mean_fallback(t: Tables):
    s = t.supplier.withColumn("w", F.col("s_acctbal") - 5000)
    return s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), R(fl.weighted_mean("s_suppkey", "w"), 4).alias("mean"))


@query("""SELECT home, round(sum(flow * fare) / sum(CASE WHEN fare IS NOT NULL THEN flow END), 4) AS fare,
    round(sum(CASE WHEN fare IS NOT NULL THEN flow ELSE 0 END) / sum(flow), 6) AS coverage FROM route GROUP BY home""")
def a03_available_mean(t: Tables):
    return t.route.groupBy("home").agg(R(fl.available_mean("fare", "flow"), 4).alias("fare"), R(fl.coverage("fare", "flow"), 6).alias("coverage"))


@query("""SELECT o.home, round(sum(CASE WHEN r.home IS NOT NULL THEN o.flow ELSE 0 END) / sum(o.flow), 6) AS route_coverage,
    round(sum(CASE WHEN r.fare IS NOT NULL THEN o.flow ELSE 0 END) / sum(o.flow), 6) AS fare_coverage
    FROM od o LEFT JOIN route r ON o.home = r.home AND o.work = r.work GROUP BY o.home""")
def a04_route_coverage(t: Tables):
    r = t.route.select("home", "work", "fare", F.lit(1).alias("has"))
    return t.od.select("home", "work", "flow").join(r, ["home", "work"], "left").groupBy("home").agg(R(fl.coverage("has", "flow"), 6).alias("route_coverage"), R(fl.coverage("fare", "flow"), 6).alias("fare_coverage"))


@query("SELECT home, sum(CASE WHEN home = work THEN flow ELSE 0 END) / sum(flow) AS internal_share FROM od GROUP BY home")
def a05_internal_share(t: Tables):
    return fl.internal_share(t.od)


@query("""SELECT district, home, round(sum(weight * fare) / sum(weight), 4) AS fare_known_only, round(sum(weight), 6) AS weight_sum, round(sum(weight * time_min) / sum(weight), 4) AS commute_min,
    round(sum(weight * fare) / sum(CASE WHEN fare IS NOT NULL THEN weight END), 4) AS fare
    FROM (SELECT b.district, r.home, b.weight, r.time_min, r.fare FROM route r JOIN bridge b ON r.work = b.dong) GROUP BY 1, 2""")
def a06_district_commute_view(t: Tables):
    j = t.route.drop("weight").join(t.bridge, F.col("work") == F.col("dong"))
    w, f = F.col("weight"), F.col("fare")
    return j.groupBy("district", "home").agg(R(F.sum(w * f) / F.sum(w), 4).alias("fare_known_only"), R(F.sum(w), 6).alias("weight_sum"), R(F.sum(w * F.col("time_min")) / F.sum(w), 4).alias("commute_min"), R(fl.available_mean("fare", "weight"), 4).alias("fare"))


@query("""SELECT dong, type, median(rent) AS med, count(*) AS n, count(*) < 30 AS small FROM txn GROUP BY 1, 2
    UNION ALL SELECT dong, 'ALL', median(rent), count(*), count(*) < 30 FROM txn GROUP BY 1""")
def a07_median_by_type(t: Tables):
    agg = lambda g: g.agg(F.median("rent").alias("med"), F.count(F.lit(1)).alias("n")).withColumn("small", F.col("n") < 30)
    return agg(t.txn.groupBy("dong", "type")).unionByName(agg(t.txn.groupBy("dong")).withColumn("type", F.lit("ALL")))


@query("""SELECT dong, string_agg(type || ':' || n, ', ' ORDER BY n DESC, type) AS mix FROM (SELECT dong, type, count(*) AS n FROM txn GROUP BY 1, 2) GROUP BY dong""")
def a08_category_mix(t: Tables):
    n = t.txn.groupBy("dong", "type").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "type", "n")))
    return n.groupBy("dong").agg(F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["type"], x["n"])), ", ").alias("mix"))


@query("""SELECT home, count(*) AS n, round(sum(share * share), 6) AS hhi, round(-sum(share * ln(share)), 6) AS entropy,
    round(CASE WHEN count(*) > 1 THEN -sum(share * ln(share)) / ln(count(*)) ELSE 0 END, 6) AS entropy_norm, round(exp(-sum(share * ln(share))), 4) AS effective,
    round(max(share), 6) AS max_share, round(sum(CASE WHEN dest_rank <= 3 THEN share END), 6) AS top3_share,
    string_agg(CASE WHEN dest_rank <= 5 THEN work::VARCHAR END, ', ' ORDER BY dest_rank) AS top_names FROM ranked_od GROUP BY home""")
def a14_concentration(t: Tables):
    c = fl.concentration(t.od)
    return c.select("home", "n", R("hhi", 6).alias("hhi"), R("entropy", 6).alias("entropy"), R("entropy_norm", 6).alias("entropy_norm"), R("effective", 4).alias("effective"), R("max_share", 6).alias("max_share"), R("top3_share", 6).alias("top3_share"), "top_names")


@query("""SELECT coalesce(i.node, o.node) AS node, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow, coalesce(inflow, 0) - coalesce(outflow, 0) AS net,
    CASE WHEN coalesce(outflow, 0) > 0 THEN coalesce(inflow, 0) / outflow END AS in_out_ratio
    FROM (SELECT work AS node, sum(flow) AS inflow FROM od WHERE home <> work GROUP BY 1) i
    FULL JOIN (SELECT home AS node, sum(flow) AS outflow FROM od WHERE home <> work GROUP BY 1) o ON i.node = o.node""")
def a15_in_out_flows(t: Tables):
    return fl.node_flows(t.od)


@query("""SELECT r.zone, count(*) AS members, sum(inflow) AS inflow, sum(outflow) AS outflow, sum(inflow - outflow) AS net,
    arg_max(n.node, struct_pack(a := inflow, b := -n.node)) AS representative,
    round(sum(b.rent_cost * n.outflow) / sum(CASE WHEN b.rent_cost IS NOT NULL THEN n.outflow END), 4) AS rent_cost,
    round(sum(b.oneway_min * n.outflow) / sum(CASE WHEN b.oneway_min IS NOT NULL THEN n.outflow END), 4) AS oneway_min,
    round(sum(b.total * n.outflow) / sum(CASE WHEN b.total IS NOT NULL THEN n.outflow END), 4) AS total FROM (
      SELECT w.node, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow FROM (SELECT work AS node, sum(flow) AS inflow FROM od WHERE home <> work GROUP BY 1) w
      LEFT JOIN (SELECT home AS node, sum(flow) AS outflow FROM od WHERE home <> work GROUP BY 1) h ON w.node = h.node) n
    JOIN dim_region r ON r.dong = n.node LEFT JOIN burden b ON b.dong = n.node GROUP BY r.zone""")
def a16_community_summary(t: Tables):
    metrics = ["rent_cost", "oneway_min", "total"]
    n = fl.node_flows(t.od).join(t.dim_region, F.col("node") == F.col("dong")).join(t.burden.select(F.col("dong").alias("node"), *metrics), "node", "left")
    means = [R(fl.available_mean(c, "outflow"), 4).alias(c) for c in metrics]
    return n.groupBy("zone").agg(F.count(F.lit(1)).alias("members"), F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"), F.sum("net").alias("net"), F.max_by("node", F.struct(F.col("inflow"), -F.col("node"))).alias("representative"), *means)


@query("""SELECT home, sum(CASE WHEN h = w THEN flow ELSE 0 END) / sum(flow) AS same_share, 1 - sum(CASE WHEN h = w THEN flow ELSE 0 END) / sum(flow) AS cross_share FROM (
    SELECT o.home, o.flow, a.zone AS h, b.zone AS w FROM od o JOIN dim_region a ON o.home = a.dong JOIN dim_region b ON o.work = b.dong) GROUP BY home""")
def a17_same_community_share(t: Tables):
    d = t.dim_region.select("dong", "zone")
    j = t.od.join(d.withColumnsRenamed({"dong": "home", "zone": "h"}), "home").join(d.withColumnsRenamed({"dong": "work", "zone": "w"}), "work")
    same = F.sum(F.when(F.col("h") == F.col("w"), F.col("flow")).otherwise(0)) / F.sum("flow")
    return j.groupBy("home").agg(same.alias("same_share"), (1 - same).alias("cross_share"))


@query("""SELECT home, zone, flow FROM (SELECT o.home, b.zone, sum(o.flow) AS flow, row_number() OVER (PARTITION BY o.home ORDER BY sum(o.flow) DESC, b.zone) AS k
    FROM od o JOIN dim_region b ON o.work = b.dong GROUP BY 1, 2) WHERE k = 1""")
def a17_dominant_destination(t: Tables):
    z = t.od.join(t.dim_region, F.col("work") == F.col("dong")).groupBy("home", "zone").agg(F.sum("flow").alias("flow"))
    return z.withColumn("k", F.row_number().over(W.partitionBy("home").orderBy(F.desc("flow"), "zone"))).filter("k = 1").drop("k")


@query("SELECT district, dong, inflow, round(weight, 8) AS weight, round(inflow / (SELECT sum(flow) FROM od WHERE home <> work), 8) AS share_of_all FROM bridge")
def a24_district_weights(t: Tables):
    total = t.od.filter("home <> work").agg(F.sum("flow").alias("total"))
    return t.bridge.crossJoin(F.broadcast(total)).select("district", "dong", "inflow", R("weight", 8).alias("weight"), R(F.col("inflow") / F.col("total"), 8).alias("share_of_all"))


@query("""SELECT th AS threshold, count(*) AS n_homes, sum(n) AS n_od, round(avg(n), 4) AS mean_n, median(n) AS med_n, min(n) AS min_n, max(n) AS max_n, round(avg(s), 6) AS mean_share
    FROM (SELECT th, home, count(*) AS n, sum(share) AS s FROM ranked_od, (VALUES (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) v(th) WHERE cum_share - share < th - 1e-12 GROUP BY 1, 2) GROUP BY 1""")
def a31_selection_summary(t: Tables):
    th = t.spark.createDataFrame([(0.7,), (0.8,), (0.9,)], "threshold double")
    chosen = t.ranked_od.crossJoin(F.broadcast(th)).filter(F.col("cum_share") - F.col("share") < F.col("threshold") - 1e-12)
    per = chosen.groupBy("threshold", "home").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("s"))
    return per.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_homes"), F.sum("n").alias("n_od"), R(F.avg("n"), 4).alias("mean_n"), F.median("n").alias("med_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), R(F.avg("s"), 6).alias("mean_share"))


def _representative(t: Tables, th: float, name: str):
    return fl.select_to_threshold(t.ranked_od, th).groupBy("home").agg(R(F.sum(F.col("flow") * F.col("time_min")) / F.sum("flow"), 4).alias(f"time_{name}"), R(F.sum(F.col("flow") * F.col("dist_km")) / F.sum("flow"), 4).alias(f"dist_{name}"))


@query("""WITH s AS (SELECT home, th, round(sum(flow * time_min) / sum(flow), 4) AS tm, round(sum(flow * dist_km) / sum(flow), 4) AS ds
    FROM ranked_od, (VALUES (70, 0.7::DOUBLE), (80, 0.8::DOUBLE), (90, 0.9::DOUBLE)) v(th, x) WHERE cum_share - share < x - 1e-12 GROUP BY 1, 2)
    SELECT home, max(CASE WHEN th = 70 THEN tm END) AS time_70, max(CASE WHEN th = 70 THEN ds END) AS dist_70, max(CASE WHEN th = 80 THEN tm END) AS time_80,
    max(CASE WHEN th = 80 THEN ds END) AS dist_80, max(CASE WHEN th = 90 THEN tm END) AS time_90, max(CASE WHEN th = 90 THEN ds END) AS dist_90,
    round(max(CASE WHEN th = 80 THEN tm END) - max(CASE WHEN th = 70 THEN tm END), 3) AS d_80_70, round(max(CASE WHEN th = 90 THEN tm END) - max(CASE WHEN th = 80 THEN tm END), 3) AS d_90_80 FROM s GROUP BY home""")
def a32_threshold_representatives(t: Tables):
    j = _representative(t, 0.7, "70").join(_representative(t, 0.8, "80"), "home", "full").join(_representative(t, 0.9, "90"), "home", "full")
    return j.withColumns({"d_80_70": R(F.col("time_80") - F.col("time_70"), 3), "d_90_80": R(F.col("time_90") - F.col("time_80"), 3)})


@query("SELECT home, work, flow, round(share, 8) AS share, dest_rank, round(cum_share, 8) AS cum_share FROM ranked_od")
def w05_running_share(t: Tables):
    return t.ranked_od.select("home", "work", "flow", R("share", 8).alias("share"), "dest_rank", R("cum_share", 8).alias("cum_share"))


@query("SELECT home, work, flow, dest_rank FROM ranked_od WHERE cum_share - share < 0.9 - 1e-12")
def w06_threshold_selection(t: Tables):
    return fl.select_to_threshold(t.ranked_od, 0.9).select("home", "work", "flow", "dest_rank")


@query("SELECT home, work, round(weight, 8) AS weight FROM route")
def w07_renormalised_weights(t: Tables):
    return t.route.select("home", "work", R("weight", 8).alias("weight"))


@query("SELECT least(home, work) AS a, greatest(home, work) AS b, sum(flow) AS flow FROM od WHERE home <> work GROUP BY 1, 2")
def r06_undirected_edges(t: Tables):
    return fl.undirected(t.od, t.parts)


@query("""SELECT node, max(name) AS name, count(DISTINCT name) AS names FROM (SELECT home AS node, 'H' || home % 7 AS name FROM od UNION ALL SELECT work, 'H' || work % 7 FROM od) GROUP BY node""")
def r07_node_list(t: Tables):
    side = lambda c: t.od.select(F.col(c).alias("node"), F.concat(F.lit("H"), F.col(c) % 7).alias("name"))
    return side("home").unionByName(side("work")).groupBy("node").agg(F.max("name").alias("name"), F.countDistinct("name").alias("names"))


@query("""SELECT d.dong, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow FROM dim_region d
    LEFT JOIN (SELECT work, sum(CASE WHEN flow > 100 THEN flow END) AS inflow FROM od GROUP BY 1) i ON i.work = d.dong LEFT JOIN (SELECT home, sum(CASE WHEN flow > 100 THEN flow END) AS outflow FROM od GROUP BY 1) o ON o.home = d.dong""")
def j06_all_nodes_zero_filled(t: Tables):
    big = F.when(F.col("flow") > 100, F.col("flow"))
    i, o = t.od.groupBy(F.col("work").alias("dong")).agg(F.sum(big).alias("inflow")), t.od.groupBy(F.col("home").alias("dong")).agg(F.sum(big).alias("outflow"))
    return t.dim_region.select("dong").join(i, "dong", "left").join(o, "dong", "left").na.fill(0)


@query("""SELECT o.home, o.work, o.flow, a.dong_name AS home_name, a.gu AS home_gu, b.dong_name AS work_name, b.gu AS work_gu FROM od o LEFT JOIN dim_region a ON o.home = a.dong LEFT JOIN dim_region b ON o.work = b.dong""")
def j02_name_both_ends(t: Tables):
    d = t.dim_region.select("dong", "dong_name", "gu")
    return t.od.select("home", "work", "flow").join(d.withColumnsRenamed({"dong": "home", "dong_name": "home_name", "gu": "home_gu"}), "home", "left").join(d.withColumnsRenamed({"dong": "work", "dong_name": "work_name", "gu": "work_gu"}), "work", "left")


@query("""SELECT o.home, o.work, round((a.dong % 37) * 0.01 + 37.5, 4) AS home_lat, round((b.dong % 37) * 0.01 + 37.5, 4) AS work_lat FROM od o LEFT JOIN dim_region a ON o.home = a.dong LEFT JOIN dim_region b ON o.work = b.dong""")
def j23_coordinates_both_ends(t: Tables):
    c = t.dim_region.select("dong", R((F.col("dong") % 37) * 0.01 + 37.5, 4).alias("lat"))
    return t.od.select("home", "work").join(c.withColumnsRenamed({"dong": "home", "lat": "home_lat"}), "home", "left").join(c.withColumnsRenamed({"dong": "work", "lat": "work_lat"}), "work", "left")


@query("SELECT user_id % 100 AS home, event_type, count(*) AS n, round(sum(value), 2) AS volume FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN 420 AND 580 GROUP BY 1, 2")
def p19_morning_peak(t: Tables):
    return t.mobility.filter(F.col("minute_of_day").between(420, 580)).groupBy("home", "event_type").agg(F.count(F.lit(1)).alias("n"), R(F.sum("weight"), 2).alias("volume"))


@query("""SELECT home, work, round(o.time_min * 2 * 21 / 60, 4) AS hours, CASE WHEN home = work THEN 'internal' ELSE 'external' END AS kind, home || '_' || work AS key, CASE WHEN home <> work THEN 'not called' END AS status, NULL::DOUBLE AS fare FROM od o""")
def p38_route_requests(t: Tables):
    inside = F.col("home") == F.col("work")
    return t.od.select("home", "work", R(F.col("time_min") * 2 * 21 / 60, 4).alias("hours"), F.when(inside, "internal").otherwise("external").alias("kind"), F.concat_ws("_", "home", "work").alias("key"), F.when(~inside, F.lit("not called")).alias("status"), F.lit(None).cast("double").alias("fare"))
