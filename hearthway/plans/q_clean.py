"""Registered queries: sources, cleaning, reshaping and joins. Messy text is derived from the provided tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.functions import clean as cl
from hearthway.operators import cluster as cs
from hearthway.operators import positions
from hearthway.operators import reshape as rs
from hearthway.sources import readers as rd

from .tables import Tables, query

R = F.round


@query("SELECT l_suppkey AS dong, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1")
def i06_i07_pruned_partial_aggregation(t: Tables):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("dong")).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))


@query("""SELECT code, arg_max(name, tag) AS name, max(tag) AS tag FROM (SELECT lpad((c_custkey % 500)::VARCHAR, 8, '0') AS code, 'old' || (c_custkey % 500) AS name, '2023' AS tag FROM customer
    UNION ALL SELECT lpad(s_suppkey::VARCHAR, 8, '0'), s_name, '2024' FROM supplier) GROUP BY code""")
def i04_code_list_union(t: Tables):
    old = t.customer.select(F.lpad((F.col("c_custkey") % 500).cast("string"), 8, "0").alias("code"), F.concat(F.lit("old"), (F.col("c_custkey") % 500).cast("string")).alias("name"), F.lit("2023").alias("tag"))
    new = t.supplier.select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("code"), F.col("s_name").alias("name"), F.lit("2024").alias("tag"))
    return rd.latest(old.unionByName(new), ["code"], "tag")


@query("SELECT event_type AS k1, (user_id % 10)::VARCHAR AS k2, 'k' AS k3, count(*) AS n, sum((props->>'k')::BIGINT) AS total FROM events WHERE (props->>'k')::BIGINT % 5 <> 0 GROUP BY 1, 2")
def i08_key_map(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    sep = F.when(k % 5 == 0, "||").otherwise("|||")
    text = F.concat(F.lit('{"'), "event_type", sep, (F.col("user_id") % 10).cast("string"), sep, F.lit('k":"'), k.cast("string"), F.lit('"}'))
    m = rd.key_map(t.events.select(text.alias("j")), "j")
    return m.groupBy("k1", "k2", "k3").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


def _responses(t: Tables) -> DataFrame:
    c = lambda x: F.col(x).cast("string")
    leg = lambda mode, secs, route: F.concat(F.lit(f'{{"mode":"{mode}","sectionTime":'), secs, F.lit(',"start":{"name":"a"},"end":{"name":"b"},"route":'), route, F.lit("}"))
    legs = F.concat_ws(",", leg("WALK", c("l_linenumber"), F.lit("null")), leg("BUS", (F.col("l_partkey") % 1000).cast("string"), F.concat(F.lit('"B'), c("l_suppkey"), F.lit('"'))), F.when(F.col("l_linenumber") % 2 == 0, leg("SUBWAY", c("l_suppkey"), F.concat(F.lit('{"name":"S'), c("l_linenumber"), F.lit('"}')))))
    head = F.concat(F.lit('{"metaData":{"plan":{"itineraries":[{"totalTime":'), (F.col("l_quantity") * 60).cast("long").cast("string"), F.lit(',"totalDistance":'), (F.col("l_quantity") * 100).cast("long").cast("string"), F.lit(',"totalWalkTime":'), (F.col("l_linenumber") * 30).cast("string"), F.lit(',"transferCount":'), (F.col("l_linenumber") % 2).cast("string"))
    fare = F.when(F.col("l_linenumber") > 2, F.concat(F.lit(',"fare":{"regular":{"totalFare":'), (1250 + F.col("l_suppkey") * 50).cast("string"), F.lit("}}"))).otherwise(F.lit(""))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.concat(head, fare, F.lit(',"legs":['), legs, F.lit("]}]}}}")).alias("response"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS minutes, round(l_quantity / 10, 2) AS km, CASE WHEN l_linenumber > 2 THEN 1250 + l_suppkey * 50 END AS fare, round(l_linenumber / 2.0, 1) AS walk_min, l_linenumber % 2 AS transfers,
    1 AS bus_legs, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS subway_legs, CASE WHEN l_linenumber % 2 = 0 THEN 'WALK → BUS → SUBWAY' ELSE 'WALK → BUS' END AS modes, CASE WHEN l_linenumber % 2 = 0 THEN 'B' || l_suppkey || ' → S' || l_linenumber ELSE 'B' || l_suppkey END AS routes FROM lineitem""")
def i09_first_route(t: Tables):
    return _responses(t).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *rd.first_route(F.col("response")))


@query("""SELECT mode, leg, count(*) AS n, count(route) AS named, max(route) AS last FROM (SELECT 1 AS leg, 'WALK' AS mode, NULL AS route FROM lineitem UNION ALL SELECT 2, 'BUS', 'B' || l_suppkey FROM lineitem UNION ALL SELECT 3, 'SUBWAY', 'S' || l_linenumber FROM lineitem WHERE l_linenumber % 2 = 0) GROUP BY 1, 2""")
def i10_leg_explode(t: Tables):
    return rd.legs(_responses(t), "response", ["l_orderkey"]).groupBy("mode", "leg").agg(F.count(F.lit(1)).alias("n"), F.count("route").alias("named"), F.max("route").alias("last"))


@query("SELECT r_name, row_number() OVER (ORDER BY r_name) AS district_id, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region")
def i13_surrogate_key(t: Tables):
    n = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("nations"))
    return rd.surrogate_key(t.region, "r_name", "district_id").join(n, "r_regionkey").select("r_name", "district_id", "nations")


@query("SELECT o.o_orderstatus, p.label, sum(o.o_totalprice > p.cut) AS over FROM orders o CROSS JOIN (VALUES ('low', 100000), ('high', 300000)) p(label, cut) GROUP BY 1, 2")
def i14_inline_parameters(t: Tables):
    p = t.spark.createDataFrame([("low", 100000), ("high", 300000)], "label string, cut int")
    return t.orders.crossJoin(F.broadcast(p)).groupBy("o_orderstatus", "label").agg(F.count_if(F.col("o_totalprice") > F.col("cut")).alias("over"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)")
def i16_remaining_work(t: Tables):
    return rd.remaining(t.orders.select(F.col("o_custkey").alias("k")), t.customer.filter("c_acctbal > 1000").select(F.col("c_custkey").alias("k")), ["k"])


@query("""SELECT k, coalesce(n.v, o.v, s.v) AS v FROM (SELECT c_custkey AS k FROM customer) LEFT JOIN (SELECT c_custkey AS k, 'old' || c_nationkey AS v FROM customer WHERE c_custkey % 3 = 0) o USING (k) LEFT JOIN (SELECT c_custkey AS k, 'new' || c_nationkey AS v FROM customer WHERE c_custkey % 5 = 0) n USING (k)
    LEFT JOIN (SELECT c_custkey AS k, 'two' || c_nationkey AS v FROM customer WHERE c_custkey % 2 = 0) s USING (k) WHERE coalesce(n.v, o.v, s.v) IS NOT NULL""")
def i17_cache_fold_back(t: Tables):
    part = lambda m, w: t.customer.filter(F.col("c_custkey") % m == 0).select(F.col("c_custkey").alias("k"), F.concat(F.lit(w), "c_nationkey").alias("v"))
    return rd.fold_back(part(3, "old"), part(5, "new"), part(2, "two"), ["k"], "v")


@query("""SELECT 'region' AS "table", (SELECT count(*) FROM region) AS n, 'r_regionkey' AS "column", 'int' AS type, (SELECT r_regionkey::VARCHAR FROM region LIMIT 1) AS sample UNION ALL SELECT 'region', (SELECT count(*) FROM region), 'r_name', 'string', (SELECT r_name FROM region LIMIT 1)
    UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 'c_custkey', 'bigint', (SELECT c_custkey::VARCHAR FROM customer LIMIT 1) UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 'segment', 'string', (SELECT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' LIMIT 1)""")
def i18_catalogue(t: Tables):
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return rd.catalogue({"region": t.region, "customer": t.customer.select("c_custkey", segment.alias("segment"))})


@query("""WITH a AS (SELECT o_custkey AS k, year(o_orderdate) AS batch, o_orderstatus <> 'F' AS ok, round(max(o_totalprice), 2) AS price FROM orders GROUP BY 1, 2, 3),
    l AS (SELECT *, row_number() OVER (PARTITION BY k, ok ORDER BY batch DESC) AS n FROM a), done AS (SELECT k, batch, price FROM l WHERE ok AND n = 1)
    SELECT k, batch, price, 'done' AS state FROM done UNION ALL SELECT k, batch, price, 'failed' FROM l WHERE NOT ok AND n = 1 AND k NOT IN (SELECT k FROM done)
    UNION ALL SELECT c_custkey, NULL, NULL, 'remaining' FROM customer WHERE c_custkey NOT IN (SELECT k FROM done)""")
def i19_latest_batch(t: Tables):
    attempts = t.orders.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("batch"), (F.col("o_orderstatus") != "F").alias("ok")).agg(R(F.max("o_totalprice"), 2).alias("price"))
    return rd.merge_attempts(attempts, t.customer.select(F.col("c_custkey").alias("k")), ["k"], "batch", "ok")


@query("""SELECT year, dong, coalesce(y1, 0) + coalesce(y2, 0) + coalesce(y3, 0) + coalesce(y4, 0) AS youth, households - (coalesce(y1, 0) + coalesce(y2, 0) + coalesce(y3, 0) + coalesce(y4, 0)) AS rest FROM (SELECT *, nullif(b1, 0) AS y1, nullif(b2, 0) AS y2, nullif(b3, 0) AS y3, nullif(b4, 0) AS y4 FROM panel)
    WHERE NOT (y1 IS NULL AND y2 IS NULL AND y3 IS NULL AND y4 IS NULL)""")
def p01_p02_panel_bands(t: Tables):
    bands = [F.nullif(F.col(f"b{i}"), F.lit(0)) for i in range(1, 5)]
    total = reduce(lambda a, b: a + b, [F.coalesce(b, F.lit(0)) for b in bands])
    youth = F.when(F.coalesce(*bands).isNotNull(), total)
    return t.panel.select("year", "dong", youth.alias("youth"), (F.col("households") - youth).alias("rest")).filter("youth is not null")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 2, 3) THEN NULL ELSE round(o_totalprice, 2) END AS v FROM orders")
def p04_number_parse(t: Tables):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 1, "").when(k == 2, "nan").when(k == 3, " - ").otherwise(F.format_number("o_totalprice", 2))
    return t.orders.select("o_orderkey", cl.to_number(text).alias("v"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS v FROM orders")
def p05_strict_number_parse(t: Tables):
    return t.orders.select("o_orderkey", cl.strict_number(F.format_number("o_totalprice", 2)).alias("v"))


@query("SELECT c_custkey, substr(lpad((1111065000 + c_custkey * 100)::VARCHAR, 10, '0'), 1, 8) AS code FROM customer")
def p06_code8(t: Tables):
    return t.customer.select("c_custkey", cl.code8(F.concat((F.lit(1111065000) + F.col("c_custkey") * 100).cast("string"), F.lit(".0"))).alias("code"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN (11110000 + c_custkey)::VARCHAR || '00' WHEN 1 THEN (11110000 + c_custkey)::VARCHAR || '00' WHEN 2 THEN (1111000000 + c_custkey)::VARCHAR END AS code FROM customer")
def p07_code10(t: Tables):
    k, c = F.col("c_custkey") % 4, F.col("c_custkey")
    eight = (F.lit(11110000) + c).cast("string")
    text = F.when(k == 0, eight).when(k == 1, F.concat(F.lit("00"), eight)).when(k == 2, F.concat((F.lit(1111000000) + c).cast("string"), F.lit(".0"))).otherwise(F.lit("11"))
    return t.customer.select("c_custkey", cl.code10(text).alias("code"))


@query("SELECT c_custkey, '종로' || (c_custkey % 9) || '.' || (c_custkey % 7) || '가동' AS name FROM customer")
def p08_p11_name_repair(t: Tables):
    dots = F.array(F.lit("?"), *[F.lit(chr(code)) for code in cl.NUMBER_DOTS])
    dot = F.element_at(dots, (F.col("c_custkey") % (1 + len(cl.NUMBER_DOTS)) + 1).cast("int"))
    text = F.concat(F.lit("서울 종로구  종로"), F.col("c_custkey") % 9, dot, F.col("c_custkey") % 7, F.lit("가동 "))
    return t.customer.select("c_custkey", cl.repair_name(text).alias("name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '창신동' WHEN c_custkey % 3 = 0 THEN '창신제' || (c_custkey % 4) || '동' ELSE '숭인' || (c_custkey % 4) || '동' END AS name FROM customer")
def p09_official_name(t: Tables):
    official = t.nation.filter("n_nationkey < 4").select(F.concat(F.lit("창신제"), "n_nationkey", F.lit("동")).alias("o")).union(t.nation.filter("n_nationkey < 4").select(F.concat(F.lit("숭인"), "n_nationkey", F.lit("동"))))
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.lit("창신동")).when(k % 3 == 0, F.concat(F.lit("창신"), k % 4, F.lit("동"))).otherwise(F.concat(F.lit("숭인제"), k % 4, F.lit("동")))
    return rs.official_names(t.customer.select("c_custkey", raw.alias("raw")), "raw", official, "o").select("c_custkey", "name")


@query("SELECT p_partkey, 'x' || (p_partkey % 10) || '동' AS name FROM part")
def p10_drop_ordinal(t: Tables):
    return t.part.select("p_partkey", cl.drop_ordinal(F.concat(F.lit("x제"), F.col("p_partkey") % 10, F.lit("동"))).alias("name"))


@query("SELECT s_suppkey, '서울' AS city, n_name AS gu, s_name || ' ' || s_suppkey AS rest FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def p12_split_address(t: Tables):
    a = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws(" ", F.lit(" 서울"), "n_name", "s_name", F.col("s_suppkey").cast("string")).alias("a"))
    return a.select("s_suppkey", *cl.split_address(F.col("a")))


@query("SELECT s_suppkey, lpad((1100000000 + s_suppkey)::VARCHAR, 10, '0') AS code, '서울 ' || n_name || ' ' || s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0")
def p13_code_in_parentheses(t: Tables):
    a = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    place = F.concat_ws(" ", F.lit("서울"), F.when(F.col("s_suppkey") % 3 != 1, F.col("n_name")), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")))
    text = F.concat(place, F.lit(" ("), (F.lit(1100000000) + F.col("s_suppkey")).cast("string"), F.lit(")"))
    x = a.select("s_suppkey", cl.code_in_parentheses(text).alias("code"), cl.without_code(text).alias("name"))
    return x.filter(F.size(F.split("name", " ")) == 3)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_size - 10 > 0 THEN (p_size - 10)::VARCHAR END AS lot FROM part")
def p14_lot_number(t: Tables):
    return t.part.select("p_partkey", cl.lot_number(F.when(F.col("p_partkey") % 3 == 0, "산").otherwise((F.col("p_size") - 10).cast("string"))).alias("lot"))


@query("SELECT p_type, p_name, CASE WHEN contains(p_name, 'ring') THEN 'A' WHEN contains(p_name, 'bolt') THEN 'B' ELSE 'other' END AS kind, CASE WHEN regexp_matches(p_name, 'widget$') THEN 'W' WHEN regexp_matches(p_name, '^(red|blue)') THEN 'C' ELSE 'other' END AS road, count(*) AS n FROM part GROUP BY ALL")
def p15_p16_p17_classes(t: Tables):
    c = F.col("p_name")
    return t.part.select("p_type", "p_name", cl.category(c, {"ring": "A", "bolt": "B"}).alias("kind"), cl.by_pattern(c, [(r"widget$", "W"), (r"^(red|blue)", "C")]).alias("road")).groupBy("p_type", "p_name", "kind", "road").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT home, work, flow FROM od WHERE starts_with(home::VARCHAR, '1') AND starts_with(work::VARCHAR, '1')")
def p18_prefix_filter(t: Tables):
    one = lambda c: F.col(c).cast("string").startswith("1")
    return t.od.filter(one("home") & one("work")).select("home", "work", "flow")


@query("SELECT event_id, CASE WHEN user_id % 30 < 24 AND event_id % 70 < 60 THEN lpad((user_id % 30)::VARCHAR, 2, '0') || ':' || lpad((event_id % 70)::VARCHAR, 2, '0') END AS code, CASE WHEN user_id % 30 < 24 AND event_id % 70 < 60 THEN user_id % 30 * 60 + event_id % 70 END AS minute FROM events")
def p20_time_codes(t: Tables):
    code = cl.time_code((F.col("user_id") % 30) * 100 + F.col("event_id") % 70)
    return t.events.select("event_id", code.alias("code"), cl.minutes(code).cast("long").alias("minute"))


@query("SELECT p_brand, p_type, CASE WHEN p_brand > 'Brand#2' THEN CASE WHEN p_type > 'M' THEN 'both' ELSE 'brand' END WHEN p_type > 'M' THEN 'type' ELSE 'none' END AS q, count(*) AS n FROM part GROUP BY ALL")
def p29_quadrants(t: Tables):
    a, b = F.col("p_brand") > "Brand#2", F.col("p_type") > "M"
    return t.part.groupBy("p_brand", "p_type", F.when(a & b, "both").when(a, "brand").when(b, "type").otherwise("none").alias("q")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT home, work, CASE WHEN (home + work) % 5 = 0 THEN true WHEN (home + work) % 5 = 1 THEN true WHEN (home + work) % 5 = 2 THEN false ELSE home = work END AS internal FROM od")
def p31_mixed_boolean(t: Tables):
    k = (F.col("home") + F.col("work")) % 5
    text = F.when(k == 0, " TRUE ").when(k == 1, "예").when(k == 2, "n").when(k == 3, "?")
    return t.od.select("home", "work", cl.to_flag(text, F.col("home") == F.col("work")).alias("internal"))


@query("SELECT p_partkey, round(p_retailprice * 12 / 12) AS monthly, CASE p_type WHEN 'SMALL' THEN 'rent' WHEN 'LARGE' THEN 'deposit' ELSE 'other' END AS category FROM part")
def p32_policy_normalise(t: Tables):
    m = F.create_map(F.lit("SMALL"), F.lit("rent"), F.lit("LARGE"), F.lit("deposit"))
    return t.part.select("p_partkey", R(F.col("p_retailprice") * 12 / 12).alias("monthly"), F.coalesce(F.try_element_at(m, F.col("p_type")), F.lit("other")).alias("category"))


@query("SELECT home, work, time_min FROM od WHERE time_min IS NOT NULL AND nullif(home, 5) IS NOT NULL")
def p34_not_null_gate(t: Tables):
    return t.od.withColumn("h", F.nullif("home", F.lit(5))).na.drop(subset=["h", "time_min"]).select("home", "work", "time_min")


@query("SELECT DISTINCT p_brand, p_type, p_size FROM part")
def p35_exact_duplicates(t: Tables):
    return t.part.select("p_brand", "p_type", "p_size").dropDuplicates()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def p36_keep_last(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.o_orderkey", "r.o_totalprice")


@query("SELECT dong, format('{:,}', rent_cost::BIGINT) || ' → ' || format('{:,}', tx) AS text, round(coverage * 100)::BIGINT || '%' AS pct FROM burden")
def p37_format(t: Tables):
    return t.burden.select("dong", F.concat(F.format_number(F.col("rent_cost").cast("long"), 0), F.lit(" → "), F.format_number("tx", 0)).alias("text"), F.concat(R(F.col("coverage") * 100).cast("long"), F.lit("%")).alias("pct"))


@query("SELECT type, zone_key, ym, round(rate, 6) * 100 AS pct FROM rate")
def r01_months_to_rows(t: Tables):
    months = sorted(r["ym"] for r in t.rate.select("ym").distinct().collect())  # as many as the calendar has
    wide = t.rate.groupBy("type", "zone_key").pivot("ym", months).agg(F.first(R("rate", 6)))
    wide = wide.select("type", "zone_key", *[F.col(str(m)).alias(f"{m // 100}년 {m % 100}월") for m in months])
    return rs.months_to_rows(wide, ["type", "zone_key"]).select("type", "zone_key", "ym", (F.col("value") * 100).alias("pct"))


@query("SELECT dong, year, households FROM panel")
def r02_years_to_rows(t: Tables):
    years = sorted(r["year"] for r in t.panel.select("year").distinct().collect())
    wide = t.panel.groupBy("dong").pivot("year", years).agg(F.first("households"))
    return wide.unpivot(["dong"], [str(y) for y in years], "year", "households").withColumn("year", F.col("year").cast("int")).filter("households is not null")


@query("SELECT dong, sum(type = 'SMALL')::BIGINT AS small, sum(type = 'PROMO')::BIGINT AS promo, 0::BIGINT AS absent, count(*) AS total, round(sum(type = 'SMALL') / count(*), 6) AS small_share FROM txn GROUP BY dong")
def r03_pivot_tiers(t: Tables):
    p = rs.pivot_counts(t.txn, "dong", "type", ["SMALL", "PROMO", "ABSENT"])
    n = t.txn.groupBy("dong").agg(F.count(F.lit(1)).alias("total"))
    return p.join(n, "dong").select("dong", F.col("SMALL").alias("small"), F.col("PROMO").alias("promo"), F.col("ABSENT").alias("absent"), "total", R(F.col("SMALL") / F.col("total"), 6).alias("small_share"))


@query("SELECT l_returnflag AS a, sum(l_linestatus = 'O')::BIGINT AS o, sum(l_linestatus = 'F')::BIGINT AS f FROM lineitem GROUP BY 1")
def r05_crosstab(t: Tables):
    p = rs.pivot_counts(t.lineitem, "l_returnflag", "l_linestatus", ["O", "F"])
    return p.select(F.col("l_returnflag").alias("a"), F.col("O").alias("o"), F.col("F").alias("f"))


@query("SELECT n_nationkey AS legacy, c AS current FROM (SELECT n_nationkey, unnest([n_nationkey * 10, n_nationkey * 10 + 1, n_nationkey * 10 + 2]) AS c FROM nation) WHERE c % 10 <= n_nationkey % 3")
def r08_successors(t: Tables):
    k = F.col("n_nationkey")
    text = F.array_join(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: (k * 10 + i).cast("string")), "; ")
    return rs.successors(t.nation.select(F.col("n_nationkey").alias("legacy"), text.alias("codes")), "legacy", "codes").select("legacy", F.col("current").cast("long").alias("current"))


@query("SELECT coalesce(c.dong, b.dong) AS dong, c.rent_cost, b.oneway_min, CASE WHEN c.dong IS NULL THEN 'commute only' WHEN b.dong IS NULL THEN 'rent only' ELSE 'both' END AS side FROM (SELECT * FROM costs WHERE dong % 9 <> 0) c FULL JOIN (SELECT * FROM commute WHERE dong % 8 <> 0) b ON c.dong = b.dong")
def j01_one_side_report(t: Tables):
    c, b = t.costs.filter("dong % 9 <> 0").select("dong", "rent_cost"), t.commute.filter("dong % 8 <> 0").select("dong", "oneway_min")
    return c.join(b, "dong", "full").withColumn("side", F.when(F.col("rent_cost").isNull(), "commute only").when(F.col("oneway_min").isNull(), "rent only").otherwise("both"))


@query("SELECT s.s_suppkey, s.s_nationkey, r.n FROM supplier s LEFT JOIN (SELECT n_regionkey AS rk, n_nationkey AS nk, 'N' AS city, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) r ON r.city = 'N' AND r.nk = s.s_nationkey AND r.rk = s.s_nationkey % 5")
def j03_multi_key_join(t: Tables):
    r = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("rk"), F.col("n_nationkey").alias("nk"), F.lit("N").alias("city")).agg(F.count(F.lit(1)).alias("n"))
    left = t.supplier.select("s_suppkey", "s_nationkey", F.lit("N").alias("city"), F.col("s_nationkey").alias("nk"), (F.col("s_nationkey") % 5).alias("rk"))
    return left.join(r, ["city", "nk", "rk"], "left").select("s_suppkey", "s_nationkey", "n")


@query("SELECT s_suppkey, coalesce(a.n_name, b.n_name) AS gu FROM supplier LEFT JOIN nation a ON a.n_nationkey = s_nationkey AND s_suppkey % 4 <> 0 LEFT JOIN nation b ON b.n_name = 'NATION_' || (s_suppkey % 30)")
def j04_code_then_name(t: Tables):
    n = F.broadcast(t.nation)
    left = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("code"), F.concat(F.lit("NATION_"), F.col("s_suppkey") % 30).alias("name"))
    j = left.join(n.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("by_code")), "code", "left").join(n.select(F.col("n_name").alias("name"), F.col("n_name").alias("by_name")), "name", "left")
    return j.select("s_suppkey", F.coalesce("by_code", "by_name").alias("gu"))


@query("""SELECT p.p_partkey, CASE WHEN p.p_size < 25 OR p.p_type NOT IN ('SMALL', 'LARGE') THEN p.p_brand ELSE coalesce(l.v, r.v, p.p_brand) END AS resolved FROM part p LEFT JOIN (SELECT p_partkey, 'lot' || p_size AS v FROM part WHERE p_partkey % 3 = 0) l USING (p_partkey) LEFT JOIN (SELECT p_name, min('road' || p_size) AS v FROM part WHERE p_size > 40 GROUP BY 1) r USING (p_name)""")
def j17_priority_resolution(t: Tables):
    lot = t.part.filter("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("lot"), "p_size").alias("lot"))
    road = t.part.filter("p_size > 40").groupBy("p_name").agg(F.min(F.concat(F.lit("road"), "p_size")).alias("road"))
    j = t.part.join(lot, "p_partkey", "left").join(road, "p_name", "left")
    clear = (F.col("p_size") < 25) | ~F.col("p_type").isin("SMALL", "LARGE")
    return j.select("p_partkey", F.when(clear, F.col("p_brand")).otherwise(F.coalesce("lot", "road", "p_brand")).alias("resolved"))


@query("SELECT count(*) AS n, count(*) - count(d.dong) AS failed, count(CASE WHEN d.dong <> x.s_suppkey THEN 1 END) AS changed FROM (SELECT s_suppkey, s_name, 'NATION_' || ((s_suppkey * 7) % 25) AS gu FROM supplier) x LEFT JOIN (SELECT gu, min(dong) AS dong FROM dim_region GROUP BY 1) d USING (gu)")
def j18_rekey_by_name(t: Tables):
    d = t.dim_region.groupBy("gu").agg(F.min("dong").alias("dong"))
    j = t.supplier.withColumn("gu", F.concat(F.lit("NATION_"), (F.col("s_suppkey") * 7) % 25)).join(F.broadcast(d), "gu", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dong").isNull()).alias("failed"), F.count_if(F.col("dong") != F.col("s_suppkey")).alias("changed"))


LINKS = "SELECT DISTINCT l_suppkey AS dong, l_partkey AS bjd FROM lineitem"


@query(f"WITH m AS ({LINKS}) SELECT a.dong, b.dong AS neighbour, count(*) AS shared, string_agg(a.bjd::VARCHAR, ',' ORDER BY a.bjd) AS names FROM m a JOIN m b ON a.bjd = b.bjd AND a.dong <> b.dong GROUP BY 1, 2")
def j19_shared_neighbours(t: Tables):
    m = t.lineitem.select(F.col("l_suppkey").alias("dong"), F.col("l_partkey").alias("bjd")).distinct()
    return rs.shared_neighbours(m, m, "dong", "bjd").select("dong", "neighbour", "shared", F.array_join("names", ",").alias("names"))


@query("WITH m AS (SELECT DISTINCT l_suppkey AS dong, l_partkey % 2000 AS road, l_returnflag AS gu FROM lineitem) SELECT a.dong, count(DISTINCT b.dong) AS neighbours FROM m a JOIN m b ON a.road = b.road AND a.gu = b.gu AND a.dong <> b.dong GROUP BY 1")
def j20_road_adjacency(t: Tables):
    m = t.lineitem.select(F.col("l_suppkey").alias("dong"), (F.col("l_partkey") % 2000).alias("road"), F.col("l_returnflag").alias("gu")).distinct()
    return rs.neighbour_counts(m, "dong", ["road", "gu"])


GEO = "SELECT dong, gu, 37.5 + (dong * 37 % 100) * 0.0006 AS lat, 126.9 + (dong * 53 % 100) * 0.0008 AS lng FROM dim_region"


@query(f"""WITH g AS ({GEO}), d AS (SELECT a.dong, b.dong AS c, 2 * 6371.0088 * asin(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lng - a.lng) / 2) ** 2)) AS km FROM g a JOIN g b ON a.gu = b.gu AND a.dong <> b.dong WHERE a.dong % 5 = 0 AND b.dong % 5 <> 0)
    SELECT dong, {", ".join(f"count(CASE WHEN km <= {r} THEN 1 END) AS within{r}" for r in (1, 2, 3, 5))}, round(min(km), 4) AS nearest, count(*) AS candidates FROM d GROUP BY dong""")
def j21_haversine(t: Tables):
    g = t.dim_region.select("dong", "gu", (37.5 + (F.col("dong") * 37 % 100) * 0.0006).alias("lat"), (126.9 + (F.col("dong") * 53 % 100) * 0.0008).alias("lng"))
    table = rs.radius_table(g.filter("dong % 5 = 0"), g.filter("dong % 5 <> 0"), "dong", "gu", [1, 2, 3, 5])
    return table.withColumn("nearest", R("nearest", 4))


SCALED = ", ".join(f"(f.{c} - (SELECT median({c}) FROM features)) / (SELECT quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) FROM features) AS {c}" for c in ("f2", "f4"))


@query(f"""WITH x AS (SELECT f.dong, r.gu, r.zone, f.f1, {SCALED} FROM features f JOIN dim_region r USING (dong)), p AS (SELECT a.dong, b.dong AS donor, b.f1 AS donor_value, CASE WHEN a.gu = b.gu THEN 1 WHEN a.zone = b.zone THEN 2 ELSE 3 END AS lvl, round((a.f2 - b.f2) ** 2 + (a.f4 - b.f4) ** 2, 9) AS d FROM x a JOIN x b ON b.dong % 5 <> 0 WHERE a.dong % 5 = 0),
    s AS (SELECT dong, CASE WHEN count(CASE WHEN lvl = 1 THEN 1 END) >= 3 THEN 1 WHEN count(CASE WHEN lvl <= 2 THEN 1 END) >= 3 THEN 2 ELSE 3 END AS scope FROM p GROUP BY 1)
    SELECT dong, donor, scope, k, donor_value, median(donor_value) OVER (PARTITION BY dong) AS imputed FROM (SELECT p.dong, donor, donor_value, scope, row_number() OVER (PARTITION BY p.dong ORDER BY d, donor) AS k FROM p JOIN s ON s.dong = p.dong AND lvl <= scope) WHERE k <= 5""")
def j22_widening_donors(t: Tables):
    scaled = cs.robust_scale(t.features.select("dong", "f1", F.col("f2").cast("double").alias("f2"), F.col("f4").cast("double").alias("f4")), ["f2", "f4"])
    x = scaled.join(t.dim_region.select("dong", "gu", "zone"), "dong")
    return rs.widening_donors(x.filter("dong % 5 = 0"), x.filter("dong % 5 <> 0"), ["f2", "f4"], "f1")


@query("WITH m AS (SELECT n_nationkey AS legacy, count(*) AS k, min(n_nationkey * 2) AS cur FROM nation WHERE n_nationkey % 3 = 0 GROUP BY 1) SELECT s_suppkey, coalesce(cur, s_nationkey) AS code, cur IS NOT NULL AS mapped FROM supplier LEFT JOIN m ON legacy = s_nationkey")
def j24_legacy_codes(t: Tables):
    m = t.nation.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") * 2).alias("cur"))
    return t.supplier.join(F.broadcast(m), "s_nationkey", "left").select("s_suppkey", F.coalesce("cur", "s_nationkey").alias("code"), F.col("cur").isNotNull().alias("mapped"))


@query("SELECT name, n FROM (SELECT 'a' AS name, count(*) AS n FROM dim_region WHERE dong IN (SELECT home FROM od GROUP BY 1 HAVING bool_or(flow > 400)) UNION ALL SELECT 'b', count(*) FROM dim_region WHERE dong IN (SELECT work FROM od GROUP BY 1 HAVING bool_or(flow > 350))) ORDER BY n DESC, name LIMIT 1")
def j25_best_source(t: Tables):
    keys = t.dim_region.select("dong")
    has = lambda c, least: t.od.groupBy(F.col(c).alias("dong")).agg(F.bool_or(F.col("flow") > least).alias("has")).filter("has").select("dong")
    return rs.best_source(keys, {"a": has("home", 400), "b": has("work", 350)}, "dong")


@query("SELECT home, work, coalesce(CASE WHEN (home + work) % 4 <> 0 THEN fare END, CASE WHEN (home + work) % 8 = 0 THEN fare + 100 END, CASE WHEN home <> work THEN 1250.0 END) AS fare, CASE WHEN home = work THEN 'internal' WHEN (home + work) % 4 <> 0 THEN 'route' WHEN (home + work) % 8 = 0 THEN 'supplement' ELSE 'min-fare repair' END AS method FROM route")
def j26_c33_route_fares(t: Tables):
    k = F.col("home") + F.col("work")
    one = t.route.filter(k % 4 != 0).select("home", "work", F.col("fare").alias("f1"))
    two = t.route.filter(k % 8 == 0).select("home", "work", (F.col("fare") + 100).alias("f2"))
    j = t.route.select("home", "work").join(one, ["home", "work"], "left").join(two, ["home", "work"], "left")
    inside = F.col("home") == F.col("work")
    method = F.when(inside, "internal").when(F.col("f1").isNotNull(), "route").when(F.col("f2").isNotNull(), "supplement").otherwise("min-fare repair")
    return j.select("home", "work", F.coalesce("f1", "f2", F.when(~inside, F.lit(1250.0))).alias("fare"), method.alias("method"))


@query("""SELECT dong, sum(singles) AS singles, sum(households) AS households, count(*) AS years, min(year) AS lo, max(year) AS hi, round(sum(singles) / sum(households), 6) AS ratio, count(*) = 7 AS complete, arg_max('d' || households, year) AS last_name FROM panel GROUP BY dong""")
def a18_year_rollup(t: Tables):
    return t.panel.groupBy("dong").agg(F.sum("singles").alias("singles"), F.sum("households").alias("households"), F.count(F.lit(1)).alias("years"), F.min("year").alias("lo"), F.max("year").alias("hi"), R(F.sum("singles") / F.sum("households"), 6).alias("ratio"), (F.count(F.lit(1)) == 7).alias("complete"), F.max_by(F.concat(F.lit("d"), "households"), "year").alias("last_name"))


@query("SELECT year, dong, round(CASE WHEN households > 0 THEN singles * 100.0 / households END, 4) AS of_households, round(CASE WHEN b1 > 0 THEN singles * 100.0 / b1 END, 4) AS of_b1 FROM panel")
def a19_guarded_ratios(t: Tables):
    p = lambda d: R(F.when(F.col(d) > 0, F.col("singles") * 100.0 / F.col(d)), 4)
    return t.panel.select("year", "dong", p("households").alias("of_households"), p("b1").alias("of_b1"))


@query("SELECT p.year, dong, households, households <= q AS low, households <= (SELECT quantile_cont(households::DOUBLE, 0.05) FROM panel) AS low_overall FROM panel p JOIN (SELECT year, quantile_cont(households::DOUBLE, 0.05) AS q FROM panel GROUP BY 1) y ON y.year = p.year")
def a20_quantile_flag(t: Tables):
    y, a = t.panel.groupBy("year").agg(F.percentile("households", F.lit(0.05)).alias("q")), t.panel.agg(F.percentile("households", F.lit(0.05)).alias("qa"))
    return t.panel.join(F.broadcast(y), "year").crossJoin(F.broadcast(a)).select("year", "dong", "households", (F.col("households") <= F.col("q")).alias("low"), (F.col("households") <= F.col("qa")).alias("low_overall"))


@query("SELECT zone, count(*) AS n, round(avg(rent_cost), 4) AS mean, string_agg(DISTINCT gu, ', ' ORDER BY gu) AS gus FROM burden JOIN dim_region USING (dong) GROUP BY zone")
def a22_type_profile(t: Tables):
    return t.burden.join(t.dim_region, "dong").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), R(F.avg("rent_cost"), 4).alias("mean"), F.array_join(F.array_sort(F.collect_set("gu")), ", ").alias("gus"))


@query("SELECT zone, round(avg(v), 8) AS external FROM (SELECT zone_key AS zone, rate AS v, row_number() OVER (PARTITION BY zone_key, type ORDER BY ym) AS i FROM rate) WHERE i % 2 = 1 GROUP BY zone")
def a45_alternating_months(t: Tables):
    i = F.row_number().over(W.partitionBy("zone_key", "type").orderBy("ym"))
    return t.rate.withColumn("i", i).filter("i % 2 = 1").groupBy(F.col("zone_key").alias("zone")).agg(R(F.avg("rate"), 8).alias("external"))


@query("SELECT industry, arg_max(dong, quarter * 100000 + dong) AS latest FROM sales GROUP BY industry")
def a46_latest_code(t: Tables):
    return t.sales.groupBy("industry").agg(F.max_by("dong", F.col("quarter") * 100000 + F.col("dong")).alias("latest"))


@query("SELECT year, sum(households) AS households, round(avg(singles / households), 6) AS mean_of_ratios, round(sum(singles) / sum(households), 6) AS ratio_of_sums, count(CASE WHEN households < 15 THEN 1 END) AS low_n FROM panel GROUP BY year")
def a47_yearly_summary(t: Tables):
    return t.panel.groupBy("year").agg(F.sum("households").alias("households"), R(F.avg(F.col("singles") / F.col("households")), 6).alias("mean_of_ratios"), R(F.sum("singles") / F.sum("households"), 6).alias("ratio_of_sums"), F.count_if(F.col("households") < 15).alias("low_n"))


@query("SELECT dong, rank() OVER (ORDER BY rent_cost DESC) AS r1, rank() OVER (ORDER BY oneway_min DESC) AS r2, rank() OVER (ORDER BY rent_cost DESC)::BIGINT - rank() OVER (ORDER BY oneway_min DESC)::BIGINT AS gap FROM burden")
def w01_rank_gap(t: Tables):
    ranked = positions.ranks(positions.ranks(t.burden.select("dong", "rent_cost", "oneway_min"), -F.col("rent_cost"), "r1"), -F.col("oneway_min"), "r2")
    return ranked.select("dong", "r1", "r2", (F.col("r1") - F.col("r2")).alias("gap"))
