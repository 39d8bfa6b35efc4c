"""Registered queries: rents, rates, price index, burden suite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.functions import clean as cl
from hearthway.operators import burden as bd
from hearthway.operators import matching
from hearthway.operators import scores as sc
from hearthway.operators import statistics as st

from .tables import Tables, query

R = F.round


@query("""SELECT dong, rent_cost, total, rank() OVER (ORDER BY rent_cost NULLS FIRST) AS rent_rank, rank() OVER (ORDER BY total NULLS FIRST) AS total_rank,
    rank() OVER (ORDER BY rent_cost NULLS FIRST)::BIGINT - rank() OVER (ORDER BY total NULLS FIRST)::BIGINT AS rank_gap,
    CASE WHEN rent_cost > (SELECT median(rent_cost) FROM burden) AND total > (SELECT median(total) FROM burden) THEN 'both high'
         WHEN rent_cost > (SELECT median(rent_cost) FROM burden) THEN 'rent high' WHEN total > (SELECT median(total) FROM burden) THEN 'hidden cost' ELSE 'both low' END AS kind FROM burden""")
def c03_rank_gap(t: Tables):
    return bd.rank_gap(t.burden.select("dong", "rent_cost", "total"))


@query("SELECT dong, rent_cost, hours, transport, transport_pass, total, coverage < 0.7 AS low_coverage, round(rent_cost / total, 6) AS rent_share FROM burden")
def c02_total_burden(t: Tables):
    return t.burden.select("dong", "rent_cost", "hours", "transport", "transport_pass", "total", (F.col("coverage") < 0.7).alias("low_coverage"), R(F.col("rent_cost") / F.col("total"), 6).alias("rent_share"))


@query("""WITH f AS (SELECT x.*, n_regionkey AS zone_key FROM txn x JOIN supplier ON dong = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    w AS (SELECT DISTINCT zone_key, type, ym FROM f),
    m AS (SELECT w.zone_key, w.type, w.ym, r.ym AS rate_ym, r.rate, row_number() OVER (PARTITION BY w.zone_key, w.type, w.ym
      ORDER BY abs((w.ym // 100 * 12 + w.ym % 100) - (r.ym // 100 * 12 + r.ym % 100)), r.ym) AS k FROM w JOIN rate r ON w.zone_key = r.zone_key AND w.type = r.type)
    SELECT f.dong, f.ym, count(*) AS n, min(m.rate_ym) AS rate_ym_min, max(m.rate_ym) AS rate_ym_max, count(CASE WHEN m.rate_ym = f.ym THEN 1 END) AS exact_n, round(avg(f.rent + f.deposit * m.rate / 12), 7) AS cost
    FROM f LEFT JOIN m ON f.zone_key = m.zone_key AND f.type = m.type AND f.ym = m.ym AND m.k = 1 GROUP BY 1, 2""")
def c01_surface_cost_nearest_month(t: Tables):
    zones = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("dong"), F.col("n_regionkey").alias("zone_key"))
    facts = bd.nearest_month(t.txn.join(zones, "dong"), t.rate, ["zone_key", "type"])
    cost = bd.surface_cost(F.col("rent"), F.col("deposit"), F.col("rate"))
    return facts.groupBy("dong", "ym").agg(F.count(F.lit(1)).alias("n"), F.min("rate_ym").alias("rate_ym_min"), F.max("rate_ym").alias("rate_ym_max"), F.count_if("exact").alias("exact_n"), R(F.avg(cost), 7).alias("cost"))


@query("""WITH z AS (SELECT zone_key, ym, avg(rate) AS sub FROM rate WHERE type = 'SMALL' GROUP BY 1, 2)
    SELECT p.type, q.zone_key, q.ym, round(coalesce(r.rate, q.sub), 6) AS rate, r.rate IS NULL AS substituted FROM (SELECT DISTINCT p_type AS type FROM part) p CROSS JOIN z q
    LEFT JOIN (SELECT * FROM rate WHERE type <> 'PROMO') r ON r.type = p.type AND r.zone_key = q.zone_key AND r.ym = q.ym""")
def j16_substitute_rate(t: Tables):
    sub = t.rate.filter("type = 'SMALL'").groupBy("zone_key", "ym").agg(F.avg("rate").alias("sub"))
    grid = t.part.select(F.col("p_type").alias("type")).distinct().crossJoin(F.broadcast(sub))
    own = t.rate.filter("type <> 'PROMO'")
    return grid.join(own, ["type", "zone_key", "ym"], "left").select("type", "zone_key", "ym", R(F.coalesce("rate", "sub"), 6).alias("rate"), F.col("rate").isNull().alias("substituted"))


@query("""SELECT count(*) AS n, min(rent) AS lo, max(rent) AS hi, round(avg(rent), 4) AS mean FROM txn WHERE type <> 'PROMO' AND area <= 40 AND deposit <= 60000 AND rent > 0
    AND rent BETWEEN (SELECT round(quantile_cont(rent::DOUBLE, 0.01), 0) FROM txn WHERE type <> 'PROMO' AND area <= 40 AND deposit <= 60000 AND rent > 0)
    AND (SELECT round(quantile_cont(rent::DOUBLE, 0.99) / 10, 0) * 10 FROM txn WHERE type <> 'PROMO' AND area <= 40 AND deposit <= 60000 AND rent > 0)""")
def p21_rent_filter_chain(t: Tables):
    base = t.txn.filter("type <> 'PROMO' and area <= 40 and deposit <= 60000 and rent > 0")
    q = base.agg(F.percentile("rent", F.array(F.lit(0.01), F.lit(0.99))).alias("q")).select(R(F.col("q")[0], 0).alias("lo"), (R(F.col("q")[1] / 10, 0) * 10).alias("hi"))
    kept = base.crossJoin(F.broadcast(q)).filter(F.col("rent").between(F.col("lo"), F.col("hi")))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.min("rent").alias("lo"), F.max("rent").alias("hi"), R(F.avg("rent"), 4).alias("mean"))


@query("SELECT l_orderkey, l_linenumber, dong, rent, coalesce(CASE WHEN area % 5 <> 0 THEN area END, area + 3) AS size, area < 14 AS tiny, count(*) OVER (PARTITION BY dong) < 30 AS small_sample FROM txn")
def p22_p23_measure_and_flags(t: Tables):
    size = F.coalesce(F.when(F.col("area") % 5 != 0, F.col("area")), F.col("area") + 3)
    n = t.txn.groupBy("dong").agg((F.count(F.lit(1)) < 30).alias("small_sample"))
    return t.txn.join(n, "dong").select("l_orderkey", "l_linenumber", "dong", "rent", size.alias("size"), (F.col("area") < 14).alias("tiny"), "small_sample")


@query("""SELECT dong, industry, round(sum(amount) / sum(cnt), 9) AS price, sum(cnt) AS cnt FROM sales WHERE cnt > 0 GROUP BY 1, 2 HAVING sum(cnt) > 0""")
def a09_unit_price(t: Tables):
    return t.sales.filter("cnt > 0").groupBy("dong", "industry").agg(R(F.sum("amount") / F.sum("cnt"), 9).alias("price"), F.sum("cnt").alias("cnt"))


PRICES = "p AS (SELECT dong, industry, round(sum(amount) / sum(cnt), 9) AS price FROM sales WHERE cnt > 0 GROUP BY 1, 2)"
ROBUST = f"""{PRICES}, m AS (SELECT industry, median(price) AS med, stddev_samp(price) AS sd FROM p GROUP BY 1),
    d AS (SELECT p.industry, median(abs(price - med)) AS mad FROM p JOIN m USING (industry) GROUP BY 1),
    z AS (SELECT p.dong, p.industry, CASE WHEN mad > 0 THEN (price - med) / (1.4826 * mad) WHEN sd > 0 THEN (price - med) / sd ELSE 0 END AS z FROM p JOIN m USING (industry) JOIN d USING (industry))"""


@query(f"WITH {ROBUST} SELECT dong, industry, round(z, 4) AS z FROM z")
def a10_robust_z(t: Tables):
    z = sc.robust_z(a09_unit_price(t), ["industry"], "price")
    return z.select("dong", "industry", R("z", 4).alias("z"))


@query(f"WITH {PRICES} SELECT dong, industry, round(CASE WHEN z < -3 THEN -3 WHEN z > 3 THEN 3 ELSE z END, 4) AS z FROM (SELECT dong, industry, (price - avg(price) OVER (PARTITION BY industry)) / stddev_samp(price) OVER (PARTITION BY industry) AS z FROM p)")
def a11_mean_std_z(t: Tables):
    w = W.partitionBy("industry")
    z = (F.col("price") - F.avg("price").over(w)) / F.stddev_samp("price").over(w)
    return a09_unit_price(t).select("dong", "industry", R(cl.clip(z, -3.0, 3.0), 4).alias("z"))


@query(f"WITH {ROBUST} SELECT dong, round(avg(CASE WHEN z < -3 THEN -3 WHEN z > 3 THEN 3 ELSE z END), 4) AS idx, count(*) AS members, count(*) < 5 AS shortage FROM z GROUP BY dong")
def a12_price_index(t: Tables):
    z = sc.robust_z(a09_unit_price(t), ["industry"], "price").withColumn("z", cl.clip(F.col("z"), -3.0, 3.0))
    return z.groupBy("dong").agg(R(F.avg("z"), 4).alias("idx"), F.count(F.lit(1)).alias("members"), (F.count(F.lit(1)) < 5).alias("shortage"))


def _variant(t: Tables, name: str, amount: str, cnt: str):
    return t.sales.filter(F.col(cnt) > 0).groupBy("dong").agg(R(F.sum(amount) / F.sum(cnt), 4).alias(name))


@query("""SELECT coalesce(a.dong, b.dong, c.dong) AS dong, a.v AS all_days, b.v AS weekend, c.v AS youth FROM (SELECT dong, round(sum(amount) / sum(cnt), 4) AS v FROM sales WHERE cnt > 0 GROUP BY 1) a
    FULL JOIN (SELECT dong, round(sum(weekend_amount) / sum(weekend_cnt), 4) AS v FROM sales WHERE weekend_cnt > 0 GROUP BY 1) b ON a.dong = b.dong
    FULL JOIN (SELECT dong, round(sum(youth_amount) / sum(youth_cnt), 4) AS v FROM sales WHERE youth_cnt > 0 GROUP BY 1) c ON coalesce(a.dong, b.dong) = c.dong""")
def a13_j05_index_variants(t: Tables):
    return _variant(t, "all_days", "amount", "cnt").join(_variant(t, "weekend", "weekend_amount", "weekend_cnt"), "dong", "full").join(_variant(t, "youth", "youth_amount", "youth_cnt"), "dong", "full")


@query("""SELECT quarter, dong, industry, cnt FROM sales WHERE cnt >= greatest((SELECT quantile_cont(cnt::DOUBLE, 0.05) FROM sales WHERE cnt > 0), 1)""")
def p24_low_count_trim(t: Tables):
    cut = t.sales.filter("cnt > 0").agg(F.greatest(F.percentile("cnt", F.lit(0.05)), F.lit(1.0)).alias("cut"))
    return t.sales.crossJoin(F.broadcast(cut)).filter("cnt >= cut").select("quarter", "dong", "industry", "cnt")


@query("""SELECT l_orderkey, l_linenumber, dong, round(least(greatest(deposit, lo), hi), 4) AS deposit FROM txn, (SELECT quantile_cont(deposit::DOUBLE, 0.01) AS lo, quantile_cont(deposit::DOUBLE, 0.99) AS hi FROM txn)""")
def p25_winsorise(t: Tables):
    return sc.winsorise(t.txn, "deposit", 0.01).select("l_orderkey", "l_linenumber", "dong", R("deposit", 4).alias("deposit"))


@query("SELECT dong, CASE WHEN transport > 62000 THEN 62000.0 ELSE transport END AS clipped FROM burden")
def p26_clip_upper(t: Tables):
    return t.burden.select("dong", bd.clip_upper(F.col("transport"), 62000.0).alias("clipped"))


@query("SELECT dong, CASE WHEN v < -3 THEN -3 WHEN v > 3 THEN 3 ELSE v END AS z FROM (SELECT dong, round((rent_cost - 250000) / 10000, 4) AS v FROM burden)")
def p27_fixed_clip(t: Tables):
    return t.burden.select("dong", cl.clip(R((F.col("rent_cost") - 250000) / 10000, 4), -3.0, 3.0).alias("z"))


@query("""SELECT quarter, dong, industry, CASE WHEN r < 0 THEN 0 WHEN r > 1 THEN 1 ELSE r END AS ratio FROM (SELECT quarter, dong, industry, round(CASE WHEN weekend_cnt <> 0 THEN youth_cnt / weekend_cnt END, 6) AS r FROM sales)""")
def p28_safe_ratio(t: Tables):
    return t.sales.select("quarter", "dong", "industry", cl.clip(R(cl.safe_ratio(F.col("youth_cnt"), F.col("weekend_cnt")), 6), 0.0, 1.0).alias("ratio"))


@query("SELECT dong, CASE WHEN g > 5 AND total_rank <= 210 THEN 'cheap but heavy' WHEN g < -5 THEN 'dear but light' ELSE 'steady' END AS label FROM (SELECT dong, rank() OVER (ORDER BY total NULLS FIRST) AS total_rank, rank() OVER (ORDER BY total NULLS FIRST)::BIGINT - rank() OVER (ORDER BY rent_cost NULLS FIRST)::BIGINT AS g FROM burden)")
def p30_rank_gap_case(t: Tables):
    r = bd.rank_gap(t.burden.select("dong", "rent_cost", "total"))
    g = -F.col("rank_gap")
    return r.select("dong", F.when((g > 5) & (F.col("total_rank") <= 210), "cheap but heavy").when(g < -5, "dear but light").otherwise("steady").alias("label"))


@query("""SELECT dong, round(sum(med * n) / sum(n), 4) AS weighted_mean FROM (SELECT dong, type, median(rent) AS med, count(*) AS n FROM txn GROUP BY 1, 2) GROUP BY dong""")
def a34_weighted_mean_of_medians(t: Tables):
    m = t.txn.groupBy("dong", "type").agg(F.median("rent").alias("med"), F.count(F.lit(1)).alias("n"))
    return m.groupBy("dong").agg(R(F.sum(F.col("med") * F.col("n")) / F.sum("n"), 4).alias("weighted_mean"))


@query("""SELECT zone, min(v) AS wmedian FROM (SELECT zone, v, sum(n) OVER (PARTITION BY zone ORDER BY v, dong ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY zone) AS tot
    FROM (SELECT zone, dong, median(rent) AS v, count(*) AS n FROM txn JOIN dim_region USING (dong) GROUP BY 1, 2)) WHERE c >= tot / 2 GROUP BY zone""")
def a33_weighted_median(t: Tables):
    m = t.txn.join(t.dim_region, "dong").groupBy("zone", "dong").agg(F.median("rent").alias("v"), F.count(F.lit(1)).alias("n"))
    return sc.weighted_median(m, ["zone"], "v", "n").withColumnRenamed("v", "wmedian")


@query("""SELECT k.component, min(v) AS lo, median(v) AS med, max(v) AS hi, max(v) - min(v) AS spread FROM (SELECT 'rent' AS component, rent_cost AS v FROM burden UNION ALL SELECT 'transport', transport FROM burden UNION ALL SELECT 'hours', hours FROM burden) k WHERE v IS NOT NULL GROUP BY 1""")
def a48_cost_spread(t: Tables):
    long = t.burden.select(F.explode(F.create_map(F.lit("rent"), "rent_cost", F.lit("transport"), "transport", F.lit("hours"), "hours")).alias("component", "v")).filter("v is not null")
    return long.groupBy("component").agg(F.min("v").alias("lo"), F.median("v").alias("med"), F.max("v").alias("hi"), (F.max("v") - F.min("v")).alias("spread"))


@query("""WITH r AS (SELECT *, rank() OVER (ORDER BY rent_cost) AS rr, rank() OVER (ORDER BY total) AS tr, rank() OVER (ORDER BY rent_cost) + (count(*) OVER (PARTITION BY rent_cost) - 1) / 2.0 AS ra, rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0 AS ta FROM burden WHERE total IS NOT NULL)
    SELECT count(*) AS n, round(median(rent_cost / total), 6) AS rent_share, round(median((total - rent_cost) / total), 6) AS commute_share, round(corr(ra, ta), 6) AS rho, count(CASE WHEN abs(rr - tr) >= 50 THEN 1 END) AS moved, round(count(CASE WHEN abs(rr - tr) >= 50 THEN 1 END) / count(*), 6) AS moved_share FROM r""")
def a48_cost_report(t: Tables):
    b = t.burden.filter("total is not null")
    moved = F.count_if(F.abs("rank_gap") >= 50)
    one = bd.rank_gap(b).agg(F.count(F.lit(1)).alias("n"), R(F.median(F.col("rent_cost") / F.col("total")), 6).alias("rent_share"), R(F.median((F.col("total") - F.col("rent_cost")) / F.col("total")), 6).alias("commute_share"), moved.alias("moved"), R(moved / F.count(F.lit(1)), 6).alias("moved_share"))
    return one.crossJoin(st.spearman(b, "rent_cost", "total").select(R("rho", 6).alias("rho")))


@query("SELECT b.dong, round(b.hours * p.hourly + b.rent_cost + b.transport, 2) AS total, p.code, b.coverage < 0.7 AS flagged FROM burden b CROSS JOIN (VALUES ('min', 10320), ('half', 5160)) p(code, hourly) WHERE p.code = 'half'")
def c04_j10_cost_view(t: Tables):
    p = t.spark.createDataFrame([("min", 10320), ("half", 5160)], "code string, hourly int").filter("code = 'half'")
    return t.burden.crossJoin(F.broadcast(p)).select("dong", R(F.col("hours") * F.col("hourly") + F.col("rent_cost") + F.col("transport"), 2).alias("total"), "code", (F.col("coverage") < 0.7).alias("flagged"))


RECOMMEND = """rec AS (SELECT *, round(rent_cost + transport + time_cost, 2) AS cost FROM (SELECT v.district, v.home, v.commute_min, v.fare, v.coverage, b.rent_cost,
      CASE WHEN v.fare IS NULL THEN 62000.0 ELSE least(round(v.fare) * 42, 62000.0) END AS transport, round(v.commute_min * 42 / 60 * 10320) AS time_cost
    FROM (SELECT district, home, round(sum(weight * time_min) / sum(weight), 4) AS commute_min, round(sum(weight * fare) / sum(CASE WHEN fare IS NOT NULL THEN weight END), 4) AS fare, round(sum(weight), 6) AS coverage
      FROM (SELECT x.district, r.home, x.weight, r.time_min, r.fare FROM route r JOIN bridge x ON r.work = x.dong) GROUP BY 1, 2) v
    JOIN (SELECT dong, rent_cost, ntile(10) OVER (ORDER BY tx, dong) AS decile FROM burden) b ON b.dong = v.home WHERE v.coverage >= 0.7 AND b.decile > 1)),
    top AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY cost, home) AS k FROM rec)"""


def _recommended(t: Tables):
    from .q_flows import a06_district_commute_view

    view = a06_district_commute_view(t).select("district", "home", "commute_min", "fare", F.col("weight_sum").alias("coverage"))
    return sc.recommend_homes(view, t.burden.select("dong", "rent_cost", "tx"), least_coverage=0.7, k=10)


@query(f"WITH {RECOMMEND} SELECT district, home, commute_min, fare, coverage, rent_cost, transport, time_cost, cost, k FROM top WHERE k <= 10")
def c05_home_recommendation(t: Tables):
    return _recommended(t)


@query(f"WITH {RECOMMEND} SELECT a.district AS d1, b.district AS d2, count(*) AS common FROM top a JOIN top b ON a.home = b.home AND a.district < b.district WHERE a.k <= 10 AND b.k <= 10 GROUP BY 1, 2")
def c06_j12_overlap(t: Tables):
    r = _recommended(t).select("district", "home")
    return r.withColumnRenamed("district", "d1").join(r.withColumnRenamed("district", "d2"), "home").filter("d1 < d2").groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("common"))


@query("""SELECT i.income, l.base, count(*) AS n, sum(CASE WHEN i.income - b.total - l.base >= 0.2 * i.income THEN 1 ELSE 0 END) AS reach, round(avg((i.income - b.total - l.base) / i.income), 6) AS mean_rate
    FROM burden b CROSS JOIN (VALUES (500000), (600000), (700000), (800000)) i(income) CROSS JOIN (VALUES (50000), (100000)) l(base) GROUP BY 1, 2""")
def c07_j11_savings_grid(t: Tables):
    i = t.spark.createDataFrame([(500000,), (600000,), (700000,), (800000,)], "income int")
    base = t.spark.createDataFrame([(50000,), (100000,)], "base int")
    left = F.col("income") - F.col("total") - F.col("base")
    g = t.burden.crossJoin(F.broadcast(i)).crossJoin(F.broadcast(base))
    return g.groupBy("income", "base").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(left >= 0.2 * F.col("income"), 1).otherwise(0)).alias("reach"), R(F.avg(left / F.col("income")), 6).alias("mean_rate"))


#: Users are customers (income: balance, rent: a hundredth of the mean order), policies are parts; a limit or target is null for some.
USERS = """u AS (SELECT c_custkey AS usr, 18 + c_custkey % 50 AS age, c_acctbal AS income, round(avg(o_totalprice) / 100, 2) AS rent, c_nationkey AS target FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 5),
    p AS (SELECT p_partkey AS rule, CASE WHEN p_size % 5 < 2 THEN 19 + p_partkey % 15 END AS age_min, CASE WHEN p_size % 5 IN (1, 2) THEN 34 + p_partkey % 20 END AS age_max, CASE WHEN p_size % 3 = 1 THEN p_partkey % 10000 END AS income_max,
    CASE WHEN p_size % 2 = 1 THEN p_retailprice END AS rent_max, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 25 END AS target, p_brand, p_name, p_retailprice / 10 AS benefit FROM part)"""


def _policies(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    limits = {"age_min": (size % 5 < 2, 19 + key % 15), "age_max": ((size % 5).isin(1, 2), 34 + key % 20), "income_max": (size % 3 == 1, key % 10000), "rent_max": (size % 2 == 1, F.col("p_retailprice")), "target": (key % 2 == 1, key % 25)}
    return t.part.select(key.alias("rule"), "p_brand", "p_name", (F.col("p_retailprice") / 10).alias("benefit"), *[F.when(some, value).alias(c) for c, (some, value) in limits.items()])


def _users(t: Tables) -> DataFrame:
    rent = t.orders.groupBy(F.col("o_custkey").alias("user")).agg(R(F.avg("o_totalprice") / 100, 2).alias("rent"))
    who = t.customer.select(F.col("c_custkey").alias("user"), (18 + F.col("c_custkey") % 50).alias("age"), F.col("c_acctbal").alias("income"), F.col("c_nationkey").cast("long").alias("target"))
    return who.join(rent, "user", "left")


@query(f"""WITH {USERS} SELECT usr AS c_custkey, count(*) AS rules, min(rule) AS first_rule FROM u JOIN p ON (age_min IS NULL OR age_min <= age) AND (age_max IS NULL OR age_max >= age)
    AND (income_max IS NULL OR income_max >= income) AND (rent_max IS NULL OR rent_max >= rent) AND (p.target IS NULL OR p.target = u.target) GROUP BY 1""")
def c08_j13_p33_policy_match(t: Tables):
    return matching.match_policies(_users(t), _policies(t)).select(F.col("user").alias("c_custkey"), "rules", F.col("first").alias("first_rule"))


@query(f"""WITH {USERS} SELECT dong_name, p_brand AS category, p_name AS policy_name, benefit, rent_cost, round(rent_cost - coalesce(benefit, 0)) AS after_support FROM burden JOIN dim_region USING (dong) JOIN p ON (p.target IS NULL OR p.target = dong % 25)
    AND (rent_max IS NULL OR rent_max >= rent_cost / 200) AND (age_min IS NULL OR age_min <= 29) AND (age_max IS NULL OR age_max >= 29) AND (income_max IS NULL OR income_max >= 2800) WHERE dong_name = 'Supplier#000000004'""")
def p33_policies_of_a_home(t: Tables):
    """All policies for one user (age 29, income 2800) in one dong, with the cost that support leaves."""
    home = t.burden.join(t.dim_region, "dong").filter(F.col("dong_name") == "Supplier#000000004").select("dong_name", "dong", "rent_cost")
    fits = matching.policies_of(_policies(t), 29, 2800, F.col("rent_cost") / 200, F.col("dong") % 25)
    out = _policies(t).join(F.broadcast(home.limit(1)), fits)
    return out.select("dong_name", F.col("p_brand").alias("category"), F.col("p_name").alias("policy_name"), "benefit", "rent_cost", F.round(F.col("rent_cost") - F.coalesce("benefit", F.lit(0))).alias("after_support"))


@query("""SELECT district, count(*) AS n, CASE WHEN NOT isnan(regr_slope(y, x)) THEN round(regr_slope(y, x) * -100000, 6) END AS slope_100k, CASE WHEN regr_slope(y, x) < 0 THEN 'cheaper is farther' ELSE 'no trade-off' END AS verdict FROM (
    SELECT r.zone AS district, b.oneway_min AS y, b.rent_cost AS x FROM burden b JOIN dim_region r USING (dong)) GROUP BY 1""")
def c09_a25_tradeoff_slope(t: Tables):
    j = t.burden.join(t.dim_region, "dong").withColumnRenamed("zone", "district")
    s = F.regr_slope("oneway_min", "rent_cost")
    return j.groupBy("district").agg(F.count(F.lit(1)).alias("n"), R(s * -100000, 6).alias("slope_100k"), F.when(s < 0, "cheaper is farther").otherwise("no trade-off").alias("verdict"))


@query("""SELECT c.pair, a.dong AS home, b.dong AS work, h.total, r.fare, o.time_min, CASE WHEN a.dong IS NULL OR b.dong IS NULL THEN 'name unknown' WHEN h.dong IS NULL THEN 'no burden' WHEN r.home IS NULL THEN 'no route' ELSE 'ok' END AS status
    FROM (SELECT s_suppkey AS pair, s_name AS home_name, 'Supplier#' || lpad(((s_suppkey * 7 + 3) % 130)::VARCHAR, 9, '0') AS work_name FROM supplier) c
    LEFT JOIN dim_region a ON a.dong_name = c.home_name LEFT JOIN dim_region b ON b.dong_name = c.work_name LEFT JOIN burden h ON h.dong = a.dong
    LEFT JOIN route r ON r.home = a.dong AND r.work = b.dong LEFT JOIN od o ON o.home = a.dong AND o.work = b.dong""")
def c10_j14_case_recompute(t: Tables):
    name = F.concat(F.lit("Supplier#"), F.lpad(((F.col("s_suppkey") * 7 + 3) % 130).cast("string"), 9, "0"))
    cases = t.supplier.select(F.col("s_suppkey").alias("pair"), F.col("s_name").alias("home_name"), name.alias("work_name"))
    d = t.dim_region
    j = cases.join(d.select(F.col("dong").alias("home"), F.col("dong_name").alias("home_name")), "home_name", "left").join(d.select(F.col("dong").alias("work"), F.col("dong_name").alias("work_name")), "work_name", "left")
    j = j.join(t.burden.select(F.col("dong").alias("home"), "total", F.lit(True).alias("has_burden")), "home", "left").join(t.route.select("home", "work", "fare", F.lit(True).alias("has_route")), ["home", "work"], "left").join(t.od.select("home", "work", "time_min"), ["home", "work"], "left")
    status = F.when(F.col("home").isNull() | F.col("work").isNull(), "name unknown").when(F.col("has_burden").isNull(), "no burden").when(F.col("has_route").isNull(), "no route").otherwise("ok")
    return j.select("pair", "home", "work", "total", "fare", "time_min", status.alias("status"))
