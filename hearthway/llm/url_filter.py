"""URL filters: a blocked Bloom filter passes possible hits on to an exact hash join.

A rule is a host and a path prefix; it fits the host with all its subdomains, and the longest fitting rule wins. The
rules' canonical keys (host + path) are hashed into a blocked Bloom filter, built by Spark: bits are OR-ed by block.
For each url only the host suffixes and path prefixes of lengths that some rule has are looked up, so their number
depends on the rules alone. Keys that the filter passes are joined to the rules, which removes false positives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import BlockedBloom
from .common import settle, ship, with_row

def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first "://", A-Z lower-cased) and path (up to ? or #); both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each row of ``pages``: row_no, page_id, host, path, rule (host + path of the winner, or null), verdict.

    ``rules`` has host, path and verdict; rules with a null or an empty host are ignored, of equal rules the smaller
    verdict counts. A null url, or one without "://", has an empty host and path and gets ``default``. Repeated rows are
    judged each for itself. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    listed = rules.filter("host is not null and host <> '' and path is not null").groupBy(F.concat("host", "path").alias("rule")).agg(F.min("verdict").alias("listed"), F.first("host").alias("h"), F.first("path").alias("p"))
    listed = settle(listed, "url-rules")
    depth, lengths = listed.agg(F.max(F.size(F.split("h", r"\."))), F.array_sort(F.collect_set(F.length("p")))).first()
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(listed, "rule").words)

    @F.pandas_udf("array<boolean>")
    def passes(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        flat = np.concatenate([np.asarray(h, dtype=np.int64) for h in hashes]) if sizes.sum() else np.empty(0, dtype=np.int64)
        hit = BlockedBloom(bloom.value).passes(flat)
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1])).map(list)

    numbered, row = with_row(pages)
    host, path = url_parts(F.col(url_col))
    urls = numbered.select(F.col(row).alias("row_no"), F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth or 1))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths or [0]]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(ends, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    urls = urls.withColumn("keys", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(keys))
    tested = urls.withColumn("pass", passes(F.transform("keys", lambda k: F.xxhash64(k))))
    hits = F.transform(F.filter(F.arrays_zip("keys", "pass"), lambda x: x["pass"]), lambda x: x["keys"])
    # a url without a hit gets a key of its own that no rule has, so that such urls do not meet in one task
    possible = tested.select("row_no", "page_id", "host", "path", F.explode_outer(hits).alias("key"))
    possible = possible.withColumn("key", F.coalesce("key", F.concat(F.lit("\0"), F.col("row_no"))))
    exact = possible.join(listed.select("rule", "listed"), possible["key"] == listed["rule"], "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("listed"))))
    judged = exact.groupBy("row_no").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return judged.select("row_no", "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.listed", F.lit(default)).alias("verdict"))


#: The rules of the registered query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH rules(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM rest),
fits AS (
  SELECT p.n, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.k = 1
"""
