"""Provided tables and the base views that the registered queries share, with the SQL of the same views."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthway.functions.clean import sql_round
from hearthway.sources.stage import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: SQL of the base views, in an order in which each uses only earlier ones.
VIEWS = {
    "dim_region": "SELECT s_suppkey AS dong, s_name AS dong_name, n_name AS gu, r_name AS zone FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "od": """SELECT c_custkey % (SELECT count(*) FROM supplier) AS home, l_suppkey AS work, sum(l_quantity) AS flow,
        round(sum((5 + 500 * l_tax) * l_quantity) / sum(l_quantity), 6) AS time_min,
        round(sum(200 * l_discount * l_quantity) / sum(l_quantity), 6) AS dist_km, count(*) AS n_rows
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "ranked_od": """SELECT *, flow / sum(flow) OVER (PARTITION BY home) AS share,
        row_number() OVER (PARTITION BY home ORDER BY flow DESC, work) AS dest_rank,
        sum(flow) OVER (PARTITION BY home ORDER BY flow DESC, work ROWS UNBOUNDED PRECEDING) / sum(flow) OVER (PARTITION BY home) AS cum_share FROM od""",
    "route": """SELECT home, work, flow, time_min, dist_km, flow / sum(flow) OVER (PARTITION BY home) AS weight,
        CASE WHEN home <> work THEN 1250 + 50 * ceil(dist_km) END AS fare
        FROM ranked_od WHERE cum_share - share < 0.8 - 1e-12""",
    "txn": """SELECT l_orderkey, l_linenumber, l_suppkey AS dong, p_type AS type, p_brand AS brand, year(l_shipdate) * 100 + month(l_shipdate) AS ym,
        l_extendedprice AS deposit, l_quantity AS rent, p_size AS area FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "rate": """SELECT n_regionkey AS zone_key, p_type AS type, year(o_orderdate) * 100 + month(o_orderdate) AS ym, round(avg(l_discount), 8) AS rate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        WHERE month(o_orderdate) IN (1, 4, 7, 10) GROUP BY 1, 2, 3""",
    "sales": """SELECT year(o_orderdate) * 10 + quarter(o_orderdate) AS quarter, l_suppkey AS dong, p_brand AS industry,
        sum(l_extendedprice) AS amount, sum(l_quantity) AS cnt,
        sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS youth_amount, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS youth_cnt,
        sum(CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN l_extendedprice END) AS weekend_amount, sum(CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN l_quantity END) AS weekend_cnt
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "panel": """SELECT year(o_orderdate) AS year, c_custkey % (SELECT count(*) FROM supplier) AS dong, count(*) AS households,
        sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS singles,
        count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS b1, count(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END) AS b2,
        count(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 END) AS b3, count(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 END) AS b4
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "bridge": """SELECT dong, zone AS district, inflow, inflow / sum(inflow) OVER (PARTITION BY zone) AS weight FROM (
        SELECT work AS dong, sum(flow) AS inflow, row_number() OVER (ORDER BY sum(flow) DESC, work) AS k FROM od WHERE home <> work GROUP BY work)
        JOIN dim_region USING (dong) WHERE k <= 40""",
    "costs": "SELECT dong, round(median(rent) * 10000, 0) AS rent_cost, count(*) AS tx FROM txn GROUP BY dong",
    "commute": """SELECT home AS dong, round(sum(flow * time_min) / sum(flow), 6) AS oneway_min,
        round(sum(flow * fare) / sum(CASE WHEN fare IS NOT NULL THEN flow END), 6) AS fare,
        round(sum(CASE WHEN fare IS NOT NULL THEN flow ELSE 0 END) / sum(flow), 6) AS coverage FROM route GROUP BY home""",
    "burden": """SELECT dong, rent_cost, oneway_min, fare, coverage, tx, round(2 * 21 * oneway_min / 60, 4) AS hours, round(2 * 21 * fare, 2) AS transport,
        CASE WHEN 2 * 21 * fare > 62000 THEN 62000.0 ELSE round(2 * 21 * fare, 2) END AS transport_pass,
        round(rent_cost + round(2 * 21 * fare, 2) + round(2 * 21 * oneway_min / 60, 4) * 10320, 2) AS total FROM costs JOIN commute USING (dong)""",
    "zindex": "SELECT dong, round(avg(amount / cnt), 4) AS price FROM sales WHERE cnt > 0 GROUP BY dong",
    "features": """SELECT b.dong, b.rent_cost / 10000 AS f1, b.oneway_min AS f2, coalesce(b.fare, 0) / 1000 AS f3, z.price / 1000 AS f4
        FROM burden b JOIN zindex z USING (dong)""",
    "mobility": "SELECT event_id, ts, user_id % 100 AS home, event_type, value AS weight, hour(ts) * 60 + minute(ts) AS minute_of_day FROM events",
}


def with_views(sql: str) -> str:
    """``sql`` behind the base views that it names."""
    import re

    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    return f"WITH {ctes},\n{body[4:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


def query(sql: str | None = None):
    """Register a function of ``Tables`` as the query of its name, with its DuckDB SQL."""

    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


#: Lines in a task of the base views: what it sorts and groups fits in memory, so that it does not spill.
LINES = 400_000

#: Base views written so far, by application, folder, state of the folder's tables and name.
_published: dict[tuple, DataFrame] = {}


def published(view: Callable[[Tables], DataFrame]) -> cached_property:
    """A base view that is written once for each state of its tables and then read by every query that needs it."""

    @wraps(view)
    def read(self: Tables) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.state, view.__name__)
        if key not in _published:
            _published[key] = settle(view(self))
        return _published[key]

    return cached_property(read)


class Tables:
    """The provided tables of a folder as attributes, and the base views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def state(self) -> tuple:
        """Times and sizes of the tables under the base views: a view is written again when one of them changes."""
        out = []
        for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
            status = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(at)
            out.append((status.getModificationTime(), status.getLen()))
        return tuple(out)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n_dongs(self) -> int:
        return self.supplier.count()

    @cached_property
    def parts(self) -> int:
        """Partitions that the lines are dealt over: a task holds about LINES of them, however many there are."""
        return max(1, -(-self.lineitem.count() // LINES))

    @cached_property
    def dim_region(self) -> DataFrame:
        joined = self.supplier.join(F.broadcast(self.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(F.col("s_suppkey").alias("dong"), F.col("s_name").alias("dong_name"), F.col("n_name").alias("gu"), F.col("r_name").alias("zone"))

    @published
    def od(self) -> DataFrame:
        from hearthway.operators.flows import weighted_od

        lines = self.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_tax", "l_discount").repartition(self.parts, "l_orderkey")
        trips = (
            lines.join(self.orders.select("o_orderkey", "o_custkey").repartition(self.parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select((F.col("o_custkey") % self.n_dongs).alias("home"), F.col("l_suppkey").alias("work"), F.col("l_quantity").alias("flow"), (5 + 500 * F.col("l_tax")).alias("time_min"), (200 * F.col("l_discount")).alias("dist_km"))
        )
        # nearly every line is a pair of its own: grouping before the shuffle would only hold memory
        return weighted_od(trips.repartition(self.parts, "home"), ["home", "work"], "flow", ["time_min", "dist_km"], decimals=6)

    @cached_property
    def ranked_od(self) -> DataFrame:
        from hearthway.operators.flows import running_share

        return running_share(self.od.repartition(self.parts, "home"))

    @published
    def route(self) -> DataFrame:
        from hearthway.operators.flows import renormalise, select_to_threshold

        chosen = renormalise(select_to_threshold(self.ranked_od, 0.8), "home", "flow", "weight")
        fare = F.when(F.col("home") != F.col("work"), 1250 + 50 * F.ceil("dist_km").cast("double"))
        return chosen.select("home", "work", "flow", "time_min", "dist_km", "weight", fare.alias("fare"))

    @cached_property
    def txn(self) -> DataFrame:
        joined = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        ym = F.year("l_shipdate") * 100 + F.month("l_shipdate")
        return joined.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("dong"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"), ym.alias("ym"), F.col("l_extendedprice").alias("deposit"), F.col("l_quantity").alias("rent"), F.col("p_size").alias("area"))

    @published
    def rate(self) -> DataFrame:
        lines = self.lineitem.join(self.orders.filter(F.month("o_orderdate").isin(1, 4, 7, 10)), F.col("l_orderkey") == F.col("o_orderkey")).join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        zoned = lines.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(self.nation), F.col("s_nationkey") == F.col("n_nationkey"))
        ym = F.year("o_orderdate") * 100 + F.month("o_orderdate")
        return zoned.groupBy(F.col("n_regionkey").alias("zone_key"), F.col("p_type").alias("type"), ym.alias("ym")).agg(sql_round(F.avg("l_discount"), 8).alias("rate"))

    @published
    def sales(self) -> DataFrame:
        lines = self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_quantity").repartition(self.parts, "l_orderkey")
        quarter = F.year("o_orderdate") * 10 + F.quarter("o_orderdate")
        orders = self.orders.select("o_orderkey", quarter.alias("quarter"), F.dayofweek("o_orderdate").isin(1, 7).alias("weekend")).repartition(self.parts, "o_orderkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
        # grouped after the shuffle only: a dong sells an industry little more than once a quarter
        lines = lines.join(self.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey").repartition(self.parts, "l_suppkey")
        youth, weekend = F.col("l_returnflag") == "A", F.col("weekend")
        sums = [F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("cnt")]
        for name, cond in (("youth", youth), ("weekend", weekend)):
            sums += [F.sum(F.when(cond, F.col("l_extendedprice"))).alias(f"{name}_amount"), F.sum(F.when(cond, F.col("l_quantity"))).alias(f"{name}_cnt")]
        return lines.groupBy("quarter", F.col("l_suppkey").alias("dong"), F.col("p_brand").alias("industry")).agg(*sums)

    @published
    def panel(self) -> DataFrame:
        bands = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
        return self.orders.groupBy(F.year("o_orderdate").alias("year"), (F.col("o_custkey") % self.n_dongs).alias("dong")).agg(
            F.count(F.lit(1)).alias("households"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("singles"), *[F.count_if(F.col("o_orderpriority") == b).alias(f"b{i}") for i, b in enumerate(bands, 1)]
        )

    @published
    def bridge(self) -> DataFrame:
        inflow = self.od.filter("home <> work").groupBy(F.col("work").alias("dong")).agg(F.sum("flow").alias("inflow")).orderBy(F.desc("inflow"), "dong").limit(40)
        placed = inflow.join(self.dim_region, "dong").withColumnRenamed("zone", "district")
        return placed.select("dong", "district", "inflow", (F.col("inflow") / F.sum("inflow").over(W.partitionBy("district"))).alias("weight"))

    @published
    def costs(self) -> DataFrame:
        lines = self.lineitem.select("l_partkey", F.col("l_suppkey").alias("dong"), F.col("l_quantity").alias("rent"))
        rents = lines.join(self.part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select("dong", "rent")
        return rents.repartition(self.parts, "dong").groupBy("dong").agg(F.round(F.median("rent") * 10000, 0).alias("rent_cost"), F.count(F.lit(1)).alias("tx"))

    @cached_property
    def commute(self) -> DataFrame:
        from hearthway.operators.flows import available_mean, coverage

        return self.route.groupBy(F.col("home").alias("dong")).agg(
            sql_round(F.sum(F.col("flow") * F.col("time_min")) / F.sum("flow"), 6).alias("oneway_min"), sql_round(available_mean("fare", "flow"), 6).alias("fare"), sql_round(coverage("fare", "flow"), 6).alias("coverage")
        )

    @published
    def burden(self) -> DataFrame:
        from hearthway.operators.burden import total_burden

        return total_burden(self.costs.join(self.commute, "dong"))

    @published
    def zindex(self) -> DataFrame:
        return self.sales.filter("cnt > 0").groupBy("dong").agg(sql_round(F.avg(F.col("amount") / F.col("cnt")), 4).alias("price"))

    @cached_property
    def features(self) -> DataFrame:
        return self.burden.join(self.zindex, "dong").select("dong", (F.col("rent_cost") / 10000).alias("f1"), F.col("oneway_min").alias("f2"), (F.coalesce("fare", F.lit(0.0)) / 1000).alias("f3"), (F.col("price") / 1000).alias("f4"))

    @cached_property
    def mobility(self) -> DataFrame:
        return self.events.select("event_id", "ts", (F.col("user_id") % 100).alias("home"), "event_type", F.col("value").alias("weight"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute_of_day"))
