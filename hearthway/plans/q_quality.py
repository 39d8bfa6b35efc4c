"""Registered queries: integrity, orphans, quality grades, lookups, accuracy studies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.operators import positions
from hearthway.operators import quality as ql

from .tables import Tables, query

R = F.round


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q01_duplicate_keys(t: Tables):
    return ql.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""SELECT name, n, expected, CASE WHEN n = expected THEN 'ok' ELSE 'differs' END AS verdict FROM (SELECT 'region' AS name, (SELECT count(*) FROM region) AS n, 5 AS expected
    UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 25 UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), 427 UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 60000)""")
def q02_row_counts(t: Tables):
    return ql.row_counts({k: getattr(t, k) for k in ("region", "nation", "supplier", "lineitem")}, {"region": 5, "nation": 25, "supplier": 427, "lineitem": 60000})


@query("""SELECT side, count(*) AS orphans FROM (SELECT 'home' AS side, home AS c FROM od UNION ALL SELECT 'work', work FROM od) WHERE c NOT IN (SELECT dong FROM dim_region WHERE zone <> 'ASIA') GROUP BY side""")
def q03_j07_orphans(t: Tables):
    known = t.dim_region.filter("zone <> 'ASIA'").select(F.col("dong").alias("c"))
    both = t.od.select(F.lit("home").alias("side"), F.col("home").alias("c")).unionByName(t.od.select(F.lit("work").alias("side"), F.col("work").alias("c")))
    return ql.split_orphans(both, known, "c")[1].groupBy("side").agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT district, round(sum(weight), 6) AS total, abs(sum(weight) - 1) > 0.001 AS bad, count(*) AS n FROM bridge GROUP BY district")
def q03_a23_weight_sums(t: Tables):
    s = F.sum("weight")
    return t.bridge.groupBy("district").agg(R(s, 6).alias("total"), (F.abs(s - 1) > 0.001).alias("bad"), F.count(F.lit(1)).alias("n"))


@query("""SELECT b.district, round(sum(CASE WHEN r.home IS NOT NULL THEN o.flow ELSE 0 END) / sum(o.flow), 6) AS coverage, count(*) AS pairs FROM od o JOIN bridge b ON o.work = b.dong LEFT JOIN route r ON r.home = o.home AND r.work = o.work GROUP BY 1""")
def q03_district_coverage(t: Tables):
    from hearthway.operators.flows import coverage

    j = t.od.select("home", "work", "flow").join(t.bridge.select(F.col("dong").alias("work"), "district"), "work").join(t.route.select("home", "work", F.lit(1).alias("has")), ["home", "work"], "left")
    return j.groupBy("district").agg(R(coverage("has", "flow"), 6).alias("coverage"), F.count(F.lit(1)).alias("pairs"))


@query("""SELECT count(*) AS n, count(CASE WHEN stored <> r THEN 1 END) AS mismatches, CASE WHEN count(CASE WHEN stored <> r THEN 1 END) = 0 THEN 'equal' WHEN count(CASE WHEN stored <> r THEN 1 END) <= 10 THEN 'tolerable' ELSE 'differs' END AS verdict
    FROM (SELECT dong, rank() OVER (ORDER BY total NULLS FIRST) AS r, row_number() OVER (ORDER BY round(total, -2) NULLS FIRST, dong) AS stored FROM burden)""")
def q04_rank_reproduction(t: Tables):
    r = positions.positions(positions.ranks(t.burden.select("dong", "total"), F.col("total"), "r"), [R("total", -2).asc_nulls_first(), "dong"], "place").withColumn("stored", F.col("place") + 1)
    m = F.count_if(F.col("stored") != F.col("r"))
    return r.agg(F.count(F.lit(1)).alias("n"), m.alias("mismatches"), F.when(m == 0, "equal").when(m <= 10, "tolerable").otherwise("differs").alias("verdict"))


@query("""SELECT count(*) AS n, count(CASE WHEN abs(a - b) > 2000 THEN 1 END) AS drifted FROM (SELECT dong, sum(deposit) AS a FROM txn GROUP BY 1) JOIN (SELECT l_suppkey AS dong, sum(l_extendedprice * (1 - l_discount / 100)) AS b FROM lineitem GROUP BY 1) USING (dong)""")
def q05_aggregate_drift(t: Tables):
    a = t.txn.groupBy("dong").agg(F.sum("deposit").alias("a"))
    b = t.lineitem.groupBy(F.col("l_suppkey").alias("dong")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount") / 100)).alias("b"))
    return a.join(b, "dong").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("a") - F.col("b")) > 2000).alias("drifted"))


@query("SELECT home, abs(sum(share) - 1) < 1e-8 AS sums_to_one, abs(max(cum_share) - 1) < 1e-6 AS ends_at_one FROM ranked_od GROUP BY home")
def q06_share_sums(t: Tables):
    return t.ranked_od.groupBy("home").agg((F.abs(F.sum("share") - 1) < 1e-8).alias("sums_to_one"), (F.abs(F.max("cum_share") - 1) < 1e-6).alias("ends_at_one"))


@query("""SELECT 'negative flow' AS "check", count(CASE WHEN flow < 0 THEN 1 END) AS bad FROM route UNION ALL SELECT 'no fare outside', count(CASE WHEN fare IS NULL AND home <> work THEN 1 END) FROM route
    UNION ALL SELECT 'fare inside', count(CASE WHEN fare IS NOT NULL AND home = work THEN 1 END) FROM route UNION ALL SELECT 'long trip', count(CASE WHEN time_min > 40 THEN 1 END) FROM route""")
def q07_range_checks(t: Tables):
    c = F.col
    return ql.failed_checks(t.route, {"negative flow": c("flow") < 0, "no fare outside": c("fare").isNull() & (c("home") != c("work")), "fare inside": c("fare").isNotNull() & (c("home") == c("work")), "long trip": c("time_min") > 40})


@query("SELECT year, dong, households, singles FROM panel WHERE singles < 0 OR singles > households OR singles * 100.0 / households > 60")
def q08_logical_errors(t: Tables):
    c = F.col
    return t.panel.filter((c("singles") < 0) | (c("singles") > c("households")) | (c("singles") * 100.0 / c("households") > 60)).select("year", "dong", "households", "singles")


@query("""SELECT 'missing' AS kind, dong FROM dim_region WHERE dong NOT IN (SELECT dong FROM panel GROUP BY 1 HAVING bool_or(year = 1996 AND households > 20)) UNION ALL SELECT 'extra', dong FROM (SELECT dong FROM panel GROUP BY 1 HAVING bool_or(year = 1996 AND households > 20)) WHERE dong NOT IN (SELECT dong FROM dim_region)""")
def q09_t07_code_audit(t: Tables):
    source, master = t.panel.groupBy("dong").agg(F.expr("bool_or(year = 1996 AND households > 20)").alias("listed")).filter("listed").select("dong"), t.dim_region.select("dong")
    return master.join(source, "dong", "left_anti").select(F.lit("missing").alias("kind"), "dong").unionByName(source.join(master, "dong", "left_anti").select(F.lit("extra").alias("kind"), "dong"))


@query("""WITH cand AS (SELECT m.dong AS missing, c.dong AS candidate FROM dim_region m JOIN dim_region c ON m.gu = c.gu AND m.dong <> c.dong WHERE m.dong % 10 = 0 AND c.dong % 10 <> 0)
    SELECT (SELECT count(*) FROM cand) AS n, (SELECT count(DISTINCT missing) FROM cand) AS covered, (SELECT count(*) FROM dim_region WHERE dong % 10 = 0) AS missing""")
def q10_fallback_candidates(t: Tables):
    d = t.dim_region
    m, c = d.filter("dong % 10 = 0").select(F.col("dong").alias("missing"), "gu"), d.filter("dong % 10 <> 0").select(F.col("dong").alias("candidate"), "gu")
    j = m.join(c, "gu")
    return j.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("missing").alias("covered")).crossJoin(m.agg(F.count(F.lit(1)).alias("missing")))


@query("""SELECT count(*) AS n, count(CASE WHEN p_name IS NULL THEN 1 END) AS nulls, count(CASE WHEN trim(p_name) = '' THEN 1 END) AS blanks, count(DISTINCT p_name) AS distinct_n, count(CASE WHEN regexp_matches(p_name, '[^a-z ]') THEN 1 END) AS odd, string_agg(DISTINCT length(p_name)::VARCHAR, ',' ORDER BY length(p_name)::VARCHAR) AS lengths FROM part""")
def q11_format_profile(t: Tables):
    c = F.col("p_name")
    return t.part.agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("nulls"), F.count_if(F.trim(c) == "").alias("blanks"), F.countDistinct(c).alias("distinct_n"), F.count_if(c.rlike("[^a-z ]")).alias("odd"), F.array_join(F.array_sort(F.collect_set(F.length(c).cast("string"))), ",").alias("lengths"))


@query("""WITH g AS (SELECT n_name AS gu, c_acctbal >= 0 AS ok, CASE WHEN c_custkey % 7 = 0 THEN 'Busan' ELSE 'Seoul' END || ' NATION_' || (CASE WHEN c_custkey % 11 = 0 THEN c_nationkey + 30 ELSE c_nationkey END) || ' ' || c_custkey AS address, round(c_acctbal, -2) AS x, c_custkey % 40 AS y FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT count(*) AS n, count(CASE WHEN NOT ok THEN 1 END) AS failed, count(CASE WHEN NOT starts_with(address, 'Seoul') THEN 1 END) AS outside, count(CASE WHEN ok AND NOT contains(address, gu || ' ') THEN 1 END) AS other_gu, count(CASE WHEN k > 1 THEN 1 END) AS repeated
    FROM (SELECT *, count(*) OVER (PARTITION BY x, y) AS k FROM g)""")
def q12_geocode_audit(t: Tables):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    address = F.concat(F.when(key % 7 == 0, "Busan").otherwise("Seoul"), F.lit(" NATION_"), F.when(key % 11 == 0, nation + 30).otherwise(nation), F.lit(" "), key)
    g = t.customer.join(F.broadcast(t.nation), nation == F.col("n_nationkey")).select(F.col("n_name").alias("gu"), (F.col("c_acctbal") >= 0).alias("ok"), address.alias("address"), R("c_acctbal", -2).alias("x"), (key % 40).alias("y"))
    return ql.geocode_audit(g, "ok", "address", "gu", ["x", "y"], "Seoul")


@query("""SELECT count(*) AS n, count(CASE WHEN bad THEN 1 END) AS lost, round(100.0 * count(CASE WHEN bad THEN 1 END) / count(*), 4) AS lost_pct, round(100 * sum(CASE WHEN bad THEN deposit ELSE 0 END) / sum(deposit), 4) AS amount_pct,
    CASE WHEN 100.0 * count(CASE WHEN bad THEN 1 END) / count(*) <= 0.5 THEN 'acceptable' ELSE 'too much' END AS verdict FROM (SELECT deposit, dong % 50 = 7 AS bad FROM txn)""")
def a43_quarantine_loss(t: Tables):
    good = t.dim_region.filter("dong % 50 <> 7").select("dong", F.lit(True).alias("ok"))
    j = t.txn.join(good, "dong", "left").withColumn("bad", F.col("ok").isNull())
    pct = 100.0 * F.count_if("bad") / F.count(F.lit(1))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("lost"), R(pct, 4).alias("lost_pct"), R(100 * F.sum(F.when(F.col("bad"), F.col("deposit")).otherwise(0)) / F.sum("deposit"), 4).alias("amount_pct"), F.when(pct <= 0.5, "acceptable").otherwise("too much").alias("verdict"))


@query("SELECT 'kept' AS part, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'orphan', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j08_j09_orphan_split(t: Tables):
    kept, orphan = ql.split_orphans(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer.filter("c_acctbal > 0"), "c_custkey")
    total = lambda d, n: d.agg(F.count(F.lit(1)).alias("n"), R(F.sum("o_totalprice"), 2).alias("amount")).select(F.lit(n).alias("part"), "n", "amount")
    return total(kept, "kept").unionByName(total(orphan, "orphan"))


GRADED = """graded AS (SELECT d.dong, b.coverage, b.tx, CASE WHEN d.dong % 17 = 0 OR b.dong IS NULL THEN 'no_data' WHEN b.coverage < 0.85 THEN 'unreliable' WHEN b.tx < 590 THEN 'low_confidence' ELSE 'ok' END AS status,
    concat_ws(' / ', CASE WHEN d.dong % 17 = 0 OR b.dong IS NULL THEN 'no rent' END, CASE WHEN b.coverage < 0.85 THEN 'few fares' END, CASE WHEN b.tx < 590 THEN 'few contracts' END) AS reason FROM dim_region d LEFT JOIN burden b USING (dong))"""


def _graded(t: Tables):
    b = t.burden.select("dong", "coverage", "tx", "total", F.lit(True).alias("has"))
    j = t.dim_region.select("dong", "gu", "dong_name").join(b, "dong", "left")
    rules = [((F.col("dong") % 17 == 0) | F.col("has").isNull(), "no_data", "no rent"), (F.col("coverage") < 0.85, "unreliable", "few fares"), (F.col("tx") < 590, "low_confidence", "few contracts")]
    return ql.grade(j, rules)


@query(f"WITH {GRADED} SELECT dong, coverage, tx, status, reason FROM graded")
def c27_reliability_grade(t: Tables):
    return _graded(t).select("dong", "coverage", "tx", "status", F.array_join("reasons", " / ").alias("reason"))


@query(f"""WITH {GRADED}, req AS (SELECT DISTINCT c_custkey % ((SELECT count(*) FROM supplier) + 20) AS code FROM customer),
    alt AS (SELECT m.dong, string_agg(c.dong::VARCHAR, ',' ORDER BY c.dong) AS alternatives FROM dim_region m JOIN dim_region c ON m.gu = c.gu AND m.dong <> c.dong JOIN graded g ON g.dong = c.dong AND g.status <> 'no_data' GROUP BY m.dong)
    SELECT r.code, coalesce(g.status, 'not_found') AS status, CASE WHEN g.status <> 'no_data' THEN b.total END AS total, CASE WHEN g.status = 'no_data' THEN a.alternatives END AS alternatives
    FROM req r LEFT JOIN graded g ON g.dong = r.code LEFT JOIN burden b ON b.dong = r.code LEFT JOIN alt a ON a.dong = r.code""")
def c29_lookup_batch(t: Tables):
    g = _graded(t)
    req = t.customer.select((F.col("c_custkey") % (t.n_dongs + 20)).alias("code")).distinct()
    have = g.filter("status <> 'no_data'").select(F.col("dong").alias("cand"), "gu")
    alt = g.filter("status = 'no_data'").select("dong", "gu").join(have, "gu").filter("dong <> cand").groupBy("dong").agg(F.array_join(F.transform(F.array_sort(F.collect_list("cand")), lambda x: x.cast("string")), ",").alias("alternatives"))
    j = req.join(g.select(F.col("dong").alias("code"), "status", "total"), "code", "left").join(alt.withColumnRenamed("dong", "code"), "code", "left")
    return j.select("code", F.coalesce("status", F.lit("not_found")).alias("status"), F.when(F.col("status") != "no_data", F.col("total")).alias("total"), "alternatives")


@query("""WITH n AS (SELECT p_name AS name, p_partkey FROM part), req AS (SELECT DISTINCT p_name AS q FROM part UNION SELECT 'no such name')
    SELECT q, count(p_partkey) AS matches, CASE WHEN count(p_partkey) = 0 THEN 'not_found' WHEN count(p_partkey) = 1 THEN 'unique' ELSE 'ambiguous' END AS status, min(p_partkey) AS first FROM req LEFT JOIN n ON n.name = req.q GROUP BY q""")
def c30_name_lookup(t: Tables):
    req = t.part.select(F.col("p_name").alias("q")).union(t.spark.createDataFrame([("no such name",)], "q string")).distinct()
    m = t.part.groupBy(F.col("p_name").alias("q")).agg(F.count(F.lit(1)).alias("m"), F.min("p_partkey").alias("first"))
    n = F.coalesce("m", F.lit(0))
    return req.join(m, "q", "left").select("q", n.alias("matches"), F.when(n == 0, "not_found").when(n == 1, "unique").otherwise("ambiguous").alias("status"), "first")


@query("""SELECT a.dong AS base, b.dong AS target, CASE WHEN b.rent_cost < a.rent_cost AND b.total > a.total THEN 'illusion' WHEN b.rent_cost < a.rent_cost AND b.total <= a.total THEN 'saving' ELSE 'mixed' END AS verdict FROM burden a JOIN dim_region r ON r.dong = a.dong JOIN dim_region s ON s.gu = r.gu AND s.dong <> r.dong JOIN burden b ON b.dong = s.dong""")
def c31_move_verdict(t: Tables):
    g = t.burden.select("dong", "rent_cost", "total").join(t.dim_region.select("dong", "gu"), "dong")
    pair = g.select([F.col(c).alias(f"a_{c}") for c in g.columns]).join(g, F.col("a_gu") == F.col("gu")).filter("a_dong <> dong")
    cheaper = F.col("rent_cost") < F.col("a_rent_cost")
    verdict = F.when(cheaper & (F.col("total") > F.col("a_total")), "illusion").when(cheaper & (F.col("total") <= F.col("a_total")), "saving").otherwise("mixed")
    return pair.select(F.col("a_dong").alias("base"), F.col("dong").alias("target"), verdict.alias("verdict"))


STUDY = "study AS (SELECT p_partkey, CASE WHEN p_size < 20 THEN 'street' WHEN p_size < 35 THEN 'road' ELSE 'other' END AS road, p_brand, p_partkey % 7 <> 0 AS correct, p_size % 3 = 0 AS sampled FROM part)"


def _study(t: Tables):
    road = F.when(F.col("p_size") < 20, "street").when(F.col("p_size") < 35, "road").otherwise("other")
    return t.part.select("p_partkey", road.alias("road"), "p_brand", (F.col("p_partkey") % 7 != 0).alias("correct"), (F.col("p_size") % 3 == 0).alias("sampled"))


@query(f"WITH {STUDY} SELECT road, p_brand, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM study WHERE sampled GROUP BY 1, 2")
def a38_stratified_accuracy(t: Tables):
    return _study(t).filter("sampled").groupBy("road", "p_brand").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


@query(f"""WITH {STUDY}, acc AS (SELECT road, avg(correct::INT) AS acc, count(*) AS n FROM study WHERE sampled AND road <> 'other' GROUP BY 1), pop AS (SELECT road, count(*) AS n FROM study GROUP BY 1)
    SELECT round(sum(pop.n * acc) / sum(pop.n), 6) AS accuracy, count(*) AS strata, (SELECT count(*) FROM pop) - count(*) AS dropped, sum(acc.n) AS sample_n FROM pop JOIN acc USING (road)""")
def c32_a39_poststratified_accuracy(t: Tables):
    s = _study(t)
    acc = s.filter("sampled and road <> 'other'").groupBy("road").agg(F.avg(F.col("correct").cast("int")).alias("acc"), F.count(F.lit(1)).alias("k"))
    pop = s.groupBy("road").agg(F.count(F.lit(1)).alias("n"))
    j = pop.join(acc, "road", "left")
    ok = F.col("acc").isNotNull()
    return j.agg(R(F.sum(F.when(ok, F.col("n") * F.col("acc"))) / F.sum(F.when(ok, F.col("n"))), 6).alias("accuracy"), F.count_if(ok).alias("strata"), F.count_if(~ok).alias("dropped"), F.sum("k").alias("sample_n"))


@query("""SELECT th, count(CASE WHEN share >= th / 100.0 THEN 1 END) AS n FROM (SELECT dong, sum(CASE WHEN type = 'SMALL' THEN 1 ELSE 0 END) / count(*) AS share FROM txn GROUP BY dong) CROSS JOIN (SELECT unnest([10, 12, 14, 16, 18, 20, 22]) AS th) GROUP BY th""")
def a37_threshold_sweep(t: Tables):
    s = t.txn.groupBy("dong").agg((F.count_if(F.col("type") == "SMALL") / F.count(F.lit(1))).alias("share"))
    th = t.spark.createDataFrame([(x,) for x in range(10, 24, 2)], "th int")
    return s.crossJoin(F.broadcast(th)).groupBy("th").agg(F.count_if(F.col("share") >= F.col("th") / 100.0).alias("n"))


@query("SELECT l_suppkey AS dong, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders_n FROM lineitem GROUP BY 1")
def a40_distinct_counts(t: Tables):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("dong")).agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders_n"))


@query("""SELECT d.dong, d.dong IN (SELECT dong FROM panel GROUP BY 1 HAVING bool_or(year = 1996 AND households > 22)) AS in_panel, d.dong IN (SELECT work FROM od GROUP BY 1 HAVING bool_or(flow > 300)) AS in_od, d.dong IN (SELECT dong FROM bridge) AS in_bridge FROM dim_region d""")
def a42_coverage_matrix(t: Tables):
    out = t.dim_region.select("dong")
    any_ = lambda df, c, rule: df.groupBy(F.col(c).alias("dong")).agg(F.expr(f"bool_or({rule})").alias("has")).filter("has").select("dong")
    for name, src in (("in_panel", any_(t.panel, "dong", "year = 1996 AND households > 22")), ("in_od", any_(t.od, "work", "flow > 300")), ("in_bridge", t.bridge.select("dong").distinct())):
        out = out.join(src.withColumn(name, F.lit(True)), "dong", "left")
    return out.na.fill(False)


@query("""SELECT type, count(*) AS n, count(*) - count(deposit) AS missing, round(avg(deposit), 2) AS mean, round(quantile_cont(deposit, 0.5), 3) AS p50, round(quantile_cont(deposit, 0.95), 3) AS p95, round(stddev_samp(deposit) / avg(deposit), 6) AS cv,
    count(CASE WHEN deposit < lo OR deposit > hi THEN 1 END) AS outliers FROM txn JOIN (SELECT type AS ty, quantile_cont(deposit, 0.25) - 1.5 * (quantile_cont(deposit, 0.75) - quantile_cont(deposit, 0.25)) AS lo, quantile_cont(deposit, 0.75) + 1.5 * (quantile_cont(deposit, 0.75) - quantile_cont(deposit, 0.25)) AS hi FROM txn GROUP BY 1) ON ty = type GROUP BY type""")
def a35_profile(t: Tables):
    p = ql.profile(t.txn, "deposit", ["type"])
    return p.select("type", "n", "missing", R("mean", 2).alias("mean"), R(F.col("q")[3], 3).alias("p50"), R(F.col("q")[5], 3).alias("p95"), R("cv", 6).alias("cv"), "outliers")


@query("""SELECT value, n, pct FROM (SELECT coalesce(p_name, '(null)') AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM part GROUP BY 1) ORDER BY n DESC, value LIMIT 20""")
def a36_top_values(t: Tables):
    n = t.part.groupBy(F.coalesce("p_name", F.lit("(null)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("value", "n", R(100.0 * F.col("n") / F.col("t"), 4).alias("pct")).orderBy(F.desc("n"), "value").limit(20)


@query("""SELECT p_brand AS bjd, count(DISTINCT p_type) AS candidates, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS names, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) ELSE coalesce(max(CASE WHEN p_type = 'PROMO' THEN p_type END), min(p_type)) END AS primary_name, count(DISTINCT p_type) > 1 AS guessed FROM part GROUP BY 1""")
def a41_candidate_list(t: Tables):
    c = t.part.groupBy(F.col("p_brand").alias("bjd")).agg(F.array_sort(F.collect_set("p_type")).alias("c"))
    same = F.get(F.filter("c", lambda x: x == "PROMO"), F.lit(0))
    return c.select("bjd", F.size("c").alias("candidates"), F.array_join("c", ",").alias("names"), F.when(F.size("c") == 1, F.col("c")[0]).otherwise(F.coalesce(same, F.col("c")[0])).alias("primary_name"), (F.size("c") > 1).alias("guessed"))


@query("SELECT user_id, event_type, ts, count(*) OVER (PARTITION BY user_id, event_type, date_trunc('day', ts)) > 1 AS repeated FROM events")
def w19_duplicate_flag(t: Tables):
    return t.events.select("user_id", "event_type", "ts", (F.count(F.lit(1)).over(W.partitionBy("user_id", "event_type", F.date_trunc("day", "ts"))) > 1).alias("repeated"))


@query("""SELECT d.dong, CASE WHEN f.dong IS NULL THEN 'insufficient' ELSE 'typed' END AS status, CASE WHEN f.f2 > (SELECT median(f2) FROM features) THEN 'far' WHEN f.dong IS NOT NULL THEN 'near' END AS kind FROM dim_region d LEFT JOIN features f ON f.dong = d.dong AND d.dong % 11 <> 3""")
def c35_restore_missing(t: Tables):
    m = t.features.agg(F.median("f2").alias("m"))
    f = t.features.filter("dong % 11 <> 3").crossJoin(F.broadcast(m)).select("dong", F.when(F.col("f2") > F.col("m"), "far").otherwise("near").alias("kind"))
    return t.dim_region.select("dong").join(f, "dong", "left").select("dong", F.when(F.col("kind").isNull(), "insufficient").otherwise("typed").alias("status"), "kind")
