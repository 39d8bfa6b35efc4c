"""Registered queries: files written from the provided tables and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthway.sources import readers as rd
from hearthway.sources.stage import stage_dir

from .tables import Tables, query


def _folder(t: Tables) -> str:
    return f"{stage_dir(t.spark)}/files-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, '구' || n_name AS gu, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def i01_i11_csv_encoding(t: Tables):
    out = _folder(t)
    src = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("구"), "n_name").alias("gu"), "s_acctbal")
    rd.allow_charsets(t.spark)
    src.write.option("header", True).option("encoding", "x-windows-949").csv(out)
    back = rd.read_csv_any(t.spark, out, "s_suppkey long, gu string, s_acctbal double")
    return back.select("s_suppkey", "gu", "s_acctbal")


@query("SELECT p_partkey AS no, p_name AS name FROM part")
def i02_preamble_csv(t: Tables):
    out = _folder(t)
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name")
    text = t.part.groupBy((F.col("p_partkey") % 7).alias("file")).agg(F.concat_ws("\n", F.lit("report"), F.concat(F.lit("made of part "), F.col("file")), F.lit("NO,name"), F.array_join(F.collect_list(line), "\n")).alias("value"))
    text.select("value").write.option("maxRecordsPerFile", 1).text(out)
    return rd.read_after_preamble(t.spark, out, ["no", "name"]).select(F.col("no").cast("long").alias("no"), "name")


@query("SELECT lower(c_mktsegment) || '_deals' AS source_file, c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY', 'FURNITURE') GROUP BY 1, 2")
def i03_listed_files(t: Tables):
    out = _folder(t)
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    for segment in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        for kind in ("deals", "summary"):  # what earlier runs put out lies beside the input
            rows.filter(F.col("segment") == segment).write.option("header", True).csv(f"{out}/{segment.lower()}_{kind}")
    read = rd.read_listed(t.spark, out, ("household", "machinery", "furniture"), "deals", "c_custkey long, segment string")
    return read.groupBy("source_file", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT month(o_orderdate) AS m, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def p03_month_from_name(t: Tables):
    out = _folder(t)
    name = F.concat(F.lit("od_"), F.month("o_orderdate"), F.lit("월"))
    t.orders.select("o_orderkey", name.alias("file")).write.partitionBy("file").parquet(out)
    read = t.spark.read.option("recursiveFileLookup", True).schema("o_orderkey long").parquet(out)
    tagged = read.select("o_orderkey", rd.month_of_file(F.input_file_name()).cast("long").alias("m"))
    return tagged.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT p_partkey, p_brand FROM part")
def i05_label_rows(t: Tables):
    labels = t.spark.createDataFrame([("code", "name"), ("(number)", "(text)")], "p_partkey string, p_brand string")
    mixed = labels.unionByName(t.part.select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_brand"))
    return rd.drop_label_rows(mixed, "p_partkey", ["code", "(number)"]).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand")


@query("SELECT 1 AS place, 'dim_region' AS name, (SELECT count(*) FROM dim_region) AS n UNION ALL SELECT 2, 'burden', (SELECT count(*) FROM burden) UNION ALL SELECT 3, 'od', (SELECT count(*) FROM od) UNION ALL SELECT 4, 'bridge', (SELECT count(*) FROM bridge)")
def i12_i15_publish_tables(t: Tables):
    out = _folder(t)
    parents = {"burden": ["dim_region"], "od": ["dim_region"], "bridge": ["dim_region", "od"]}
    tables = {"bridge": t.bridge, "burden": t.burden, "dim_region": t.dim_region, "od": t.od}
    rd.publish(tables, out, parents)
    names = rd.publish(tables, out, parents)  # a second load replaces the first
    found = rd.published(t.spark, out)
    parts = [found[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("place"), F.lit(n).alias("name"), "n") for i, n in enumerate(names, 1)]
    return reduce(DataFrame.unionByName, parts)


@query("""WITH w AS (SELECT zone_key, type, ym FROM (SELECT DISTINCT zone_key, type FROM rate) CROSS JOIN (SELECT unnest([199502, 199503, 199509, 199512, 199605, 200112]) AS ym)), m AS (SELECT w.*, r.ym AS rate_ym, r.rate, row_number() OVER (PARTITION BY w.zone_key, w.type, w.ym ORDER BY abs(w.ym // 100 * 12 + w.ym % 100 - r.ym // 100 * 12 - r.ym % 100), r.ym) AS k FROM w JOIN rate r ON r.zone_key = w.zone_key AND r.type = w.type)
    SELECT zone_key, type, ym, rate_ym, rate, rate_ym = ym AS exact FROM m WHERE k = 1""")
def j15_nearest_month(t: Tables):
    from hearthway.operators.burden import nearest_month

    months = t.spark.createDataFrame([(m,) for m in (199502, 199503, 199509, 199512, 199605, 200112)], "ym int")
    facts = t.rate.select("zone_key", "type").distinct().crossJoin(F.broadcast(months))
    return nearest_month(facts, t.rate, ["zone_key", "type"])


@query("SELECT i AS income, count(CASE WHEN total <= i * 0.7 THEN 1 END) AS affordable, round(avg(CASE WHEN total <= i * 0.7 THEN 1.0 ELSE 0 END), 6) AS rate FROM burden CROSS JOIN (SELECT unnest([500000, 700000, 900000]) AS i) GROUP BY 1")
def a21_conditional_rate(t: Tables):
    i = t.spark.createDataFrame([(500000,), (700000,), (900000,)], "income int")
    ok = F.col("total") <= F.col("income") * 0.7
    return t.burden.crossJoin(F.broadcast(i)).groupBy("income").agg(F.count_if(ok).alias("affordable"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("rate"))
