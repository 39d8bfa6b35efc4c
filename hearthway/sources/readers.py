"""Reading and writing: encodings, preambles, label rows, JSON maps, route responses, catalogues, caches."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import settle

ENCODINGS = ("UTF-8", "x-windows-949")

LEG = T.StructType([T.StructField("mode", T.StringType()), T.StructField("sectionTime", T.LongType()), T.StructField("route", T.StringType()), T.StructField("start", T.StructType([T.StructField("name", T.StringType())])), T.StructField("end", T.StructType([T.StructField("name", T.StringType())]))])
ITINERARY = T.StructType([T.StructField("totalTime", T.LongType()), T.StructField("totalDistance", T.DoubleType()), T.StructField("totalWalkTime", T.LongType()), T.StructField("transferCount", T.IntegerType()), T.StructField("fare", T.StructType([T.StructField("regular", T.StructType([T.StructField("totalFare", T.LongType())]))])), T.StructField("legs", T.ArrayType(LEG))])
RESPONSE = T.StructType([T.StructField("metaData", T.StructType([T.StructField("plan", T.StructType([T.StructField("itineraries", T.ArrayType(ITINERARY))]))]))])


def csv_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line of the file is valid UTF-8, else the Korean code page, of which EUC-KR is a part.

    Spark checks the bytes of all lines where they are read; the first line that is no UTF-8 ends the search.
    """
    odd = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    return ENCODINGS[0] if odd.isEmpty() else ENCODINGS[1]


def allow_charsets(spark: SparkSession) -> None:
    """Let the CSV source take every charset of the JVM, which the Korean code pages need."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_csv_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header, in whichever of the known encodings."""
    encoding = csv_encoding(spark, path)
    if encoding != ENCODINGS[0]:
        allow_charsets(spark)
    reader = spark.read.option("header", True).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_after_preamble(spark: SparkSession, path: str, names: list[str], first: str = "NO", most: int = 30) -> DataFrame:
    """CSV lines after the header, the first line (of ``most``) whose first cell is ``first``; adds source_file.

    Lines keep the place of their split and their place in it, written once, so a file of any size is read in parts.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("place"), F.rtrim("value", F.lit("\r")).alias("line"))
    lines = settle(read)
    top = F.when(F.col("place.block") == 0, F.col("place.n"))
    titled = F.split("line", ",")[0].isin(first, f'"{first}"')
    head = lines.groupBy("source_file").agg(F.min(top).alias("start"), F.min(F.when(titled, F.col("place"))).alias("head"))
    head = head.filter((F.col("head.block") == 0) & (F.col("head.n") - F.col("start") < most)).select("source_file", "head")
    body = lines.join(head, "source_file").filter((F.col("place") > F.col("head")) & (F.trim("line") != ""))
    cells = F.from_csv("line", ", ".join(f"`{c}` string" for c in names))
    return body.select("source_file", cells.alias("c")).select("source_file", "c.*")


def listed(spark: SparkSession, folder: str, prefixes: tuple[str, ...], contains: str) -> list[str]:
    """Paths in ``folder`` whose name starts with one of ``prefixes`` and contains ``contains``; only names are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith(tuple(prefixes)) and contains in f.getPath().getName())


def read_listed(spark: SparkSession, folder: str, prefixes: tuple[str, ...], contains: str, schema: str) -> DataFrame:
    """Union of the listed CSV files (or folders of parts) of ``folder``, with the name each row comes from; see ``listed``."""
    parts = [spark.read.option("header", True).schema(schema).csv(p).withColumn("source_file", F.lit(p.rsplit("/", 1)[-1])) for p in listed(spark, folder, prefixes, contains)]
    if not parts:
        return spark.createDataFrame([], f"{schema}, source_file string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def month_of_file(name: Column) -> Column:
    """The month that a file's name gives before its sign for months; null without one."""
    return F.regexp_extract(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"(\d+)월", 1).try_cast("int")


def drop_label_rows(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Without the rows below the header that repeat labels or units."""
    return df.filter(~F.coalesce(F.trim(F.col(column)).isin(labels), F.lit(False)))


def key_map(df: DataFrame, column: str) -> DataFrame:
    """(k1, k2, k3, value) from JSON objects "k1|||k2|||k3" -> value; null values and malformed keys are left out."""
    pairs = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("k", "value"))
    parts = pairs.withColumn("p", F.split("k", r"\|\|\|")).filter((F.size("p") == 3) & F.col("value").isNotNull())
    return parts.select(F.col("p")[0].alias("k1"), F.col("p")[1].alias("k2"), F.col("p")[2].alias("k3"), "value")


def first_route(response: Column) -> list[Column]:
    """Minutes, km, fare, walk minutes, transfers, legs by mode and the mode and route sequences of the first itinerary."""
    it = F.get(F.from_json(response, RESPONSE)["metaData"]["plan"]["itineraries"], F.lit(0))
    legs = it["legs"]
    count = lambda mode: F.size(F.filter(legs, lambda x: x["mode"] == mode))
    names = F.filter(F.transform(legs, lambda x: route_name(x["route"])), lambda x: x.isNotNull())
    return [
        F.round(it["totalTime"] / 60, 1).alias("minutes"), F.round(it["totalDistance"] / 1000, 2).alias("km"), it["fare"]["regular"]["totalFare"].alias("fare"), F.round(it["totalWalkTime"] / 60, 1).alias("walk_min"),
        it["transferCount"].alias("transfers"), count("BUS").alias("bus_legs"), count("SUBWAY").alias("subway_legs"), F.array_join(F.transform(legs, lambda x: x["mode"]), " → ").alias("modes"), F.array_join(names, " → ").alias("routes"),
    ]


def route_name(route: Column) -> Column:
    """A route that is a string or an object with a name."""
    return F.coalesce(F.get_json_object(route, "$.name"), F.when(~route.startswith("{"), route))


def legs(df: DataFrame, response: str, keys: list[str]) -> DataFrame:
    """A row for each leg of the first itinerary: keys, leg, mode, minutes, from, to, route."""
    it = F.get(F.from_json(response, RESPONSE)["metaData"]["plan"]["itineraries"], F.lit(0))
    x = df.select(*keys, F.posexplode_outer(it["legs"]).alias("leg", "x"))
    return x.select(*keys, (F.col("leg") + 1).alias("leg"), "x.mode", F.round(F.col("x.sectionTime") / 60, 1).alias("minutes"), F.col("x.start.name").alias("start"), F.col("x.end.name").alias("end"), route_name(F.col("x.route")).alias("route"))


def remaining(keys: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys that are not done yet."""
    return keys.select(*on).distinct().join(done, on, "left_anti")


def fold_back(cache: DataFrame, new: DataFrame, second: DataFrame, on: list[str], value: str) -> DataFrame:
    """The cache with new values before old ones, and values of a second source where there is none."""
    j = cache.withColumnRenamed(value, "_old").join(new.withColumnRenamed(value, "_new"), on, "full").join(second.withColumnRenamed(value, "_two"), on, "full")
    return j.select(*on, F.coalesce("_new", "_old", "_two").alias(value))


def latest(batches: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """For each key the row of the last batch."""
    rest = [c for c in batches.columns if c not in keys]
    best = batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), batch).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_attempts(attempts: DataFrame, targets: DataFrame, keys: list[str], batch: str, ok: str) -> DataFrame:
    """Latest success of each key, latest failure of keys without one, and targets without a success, told apart by ``state``.

    A target that only failed is in both of the last: its failure is on record, and its work remains.
    """
    rest = [c for c in attempts.columns if c not in (*keys, ok)]
    done = latest(attempts.filter(F.col(ok)).drop(ok), keys, batch)
    failed = latest(attempts.filter(~F.col(ok)).drop(ok), keys, batch).join(done, keys, "left_anti")
    remain = remaining(targets, done, keys)
    for c in rest:
        remain = remain.withColumn(c, F.lit(None).cast(attempts.schema[c].dataType))
    state = lambda d, name: d.select(*keys, *rest, F.lit(name).alias("state"))
    return state(done, "done").unionByName(state(failed, "failed")).unionByName(state(remain, "remaining"))


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, n, sample): rows and the first value that is not null of every column; one pass a table."""
    out = None
    for name, df in tables.items():
        placed = df.select(F.monotonically_increasing_id().alias("row"), F.struct(*df.columns).alias("v"))
        sample = lambda c: F.min(F.when(F.col(f"v.{c}").isNotNull(), F.struct("row", F.col(f"v.{c}").cast("string").alias("value"))))["value"]
        one = placed.agg(F.count(F.lit(1)).alias("n"), *[sample(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("type"), F.col(f"c{i}").alias("sample")) for i, (c, k) in enumerate(df.dtypes)]))
        part = one.select(F.lit(name).alias("table"), "n", rows.alias("r")).select("table", "n", "r.*")
        out = part if out is None else out.unionByName(part)
    return out


def load_order(parents: dict[str, list[str]]) -> list[str]:
    """Names so that each comes after the tables it refers to; by name where that leaves a choice."""
    left, out = {n: set(p) for n, p in parents.items()}, []
    while left:
        free = sorted(n for n, p in left.items() if not p - set(out))
        if not free:
            raise ValueError(f"tables refer to each other in a circle: {sorted(left)}")
        out += free
        left = {n: p for n, p in left.items() if n not in free}
    return out


def publish(tables: dict[str, DataFrame], folder: str, parents: dict[str, list[str]] | None = None, keep: int = 2) -> list[str]:
    """Load all tables as a new version below ``folder``, each after what it refers to, and make it the one that readers see.

    Each load writes into a folder of its own. Only when every table is whole does a manifest that names them take the
    next number by one rename; a load that stops anywhere before leaves the last version as it was, and of two loads at a
    time one fails. Versions older than the last ``keep``, and what stopped loads left, go afterwards. Returns the order
    of loading.
    """
    order = [n for n in load_order({n: [p for p in (parents or {}).get(n, []) if p in tables] for n in tables}) if n in tables]
    spark = next(iter(tables.values())).sparkSession
    store, version = _Versions(spark, folder), uuid.uuid4().hex
    started, there = store.numbers(), store.names("versions")
    for name in order:
        tables[name].write.parquet(f"{folder}/versions/{version}/{name}")
    store.commit((started[-1] if started else 0) + 1, {"version": version, "tables": order})
    store.expire(keep, there)
    return order


def published(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last whole version by name, in order of loading; none where nothing was published yet."""
    store = _Versions(spark, folder)
    numbers = store.numbers()
    if not numbers:
        return {}
    told = store.manifest(numbers[-1])
    return {name: spark.read.parquet(f"{folder}/versions/{told['version']}/{name}") for name in told["tables"]}


class _Versions:
    """Manifests ``manifests/<number>.json`` and the versions that they name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.path = spark, folder, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, inside: str) -> list[str]:
        where = self.path(f"{self.folder}/{inside}")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names("manifests") if re.fullmatch(r"\d+\.json", n))

    def manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{number:012d}.json", wholetext=True).first()[0])

    def commit(self, number: int, told: dict) -> None:
        made, name = (self.path(f"{self.folder}/{x}") for x in (f"manifests/_{told['version']}", f"manifests/{number:012d}.json"))
        out = self.fs.create(made, False)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if self.fs.exists(name) or not self.fs.rename(made, name):
            self.fs.delete(made, False)
            raise RuntimeError(f"another load has published version {number}")

    def expire(self, keep: int, there: list[str]) -> None:
        """Delete old versions, and of those in ``there`` what no manifest names: a load that was under way when the last one
        began can't publish any more, as its number is taken."""
        numbers = self.numbers()
        told = {n: self.manifest(n)["version"] for n in numbers}
        for n in numbers[:-keep]:
            self.fs.delete(self.path(f"{self.folder}/manifests/{n:012d}.json"), False)
        for v in {*(told[n] for n in numbers[:-keep]), *(set(there) - set(told.values()))}:
            self.fs.delete(self.path(f"{self.folder}/versions/{v}"), True)


def surrogate_key(df: DataFrame, order: str, name: str) -> DataFrame:
    """A gapless number from 1 in the order of a dimension's name; for dimensions, not facts."""
    from pyspark.sql import Window as W

    return df.withColumn(name, F.row_number().over(W.orderBy(order)))
