"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the text. A batch is grouped by digest (partial
aggregation, so a hot group shrinks before the shuffle), anti-joined to the index by a sort-merge join that needs no
shuffle of the index, and its new digests are appended.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import BlockedBloom
from .common import delete, settle, shared_dir, ship, spread_join, unused, with_row

INDEX_SCHEMA = "text_sha256 string, keep_id long, keep_row long, batch string"


class DigestIndex:
    """Digests of all texts seen so far, each with the document that stays.

    Within a batch the row with the largest id stays (of rows equal in id as well, one). A text that an earlier
    batch brought keeps its earlier document, and all its rows in the new batch are dropped. Admitting a batch again
    under the same name gives the same answer and appends nothing, so a job that failed half-way can be run again.
    With a ``path`` in the shared file system the index outlives the session: a later one that opens the path goes on from
    what it holds, also where its catalog has never heard of the table.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.table, self.path = spark, table, path
        if not spark.catalog.tableExists(table):
            self._register(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
        self.buckets = int(told["Num Buckets"])

    def _register(self, buckets: int) -> None:
        """Make the catalog know the index: what an earlier session left at ``path``, or an empty one.

        The folder's name tells the number of buckets, which holds for the index as long as it lives. Nothing is written
        here, and a folder that holds anything else is an error.
        """
        place = ""
        if self.path:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            found = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
            if found and not (len(found) == 1 and re.fullmatch(r"buckets-\d+", found[0])):
                raise ValueError(f"{self.path} holds more than a digest index: {sorted(found)[:3]}")
            folder = found[0] if found else f"buckets-{buckets}"
            buckets = int(folder.removeprefix("buckets-"))
            place = f"LOCATION '{self.path.rstrip('/')}/{folder}'"
            fs.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{folder}"))
        self.spark.sql(f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS {place}")

    def _write(self, df: DataFrame) -> None:
        df.write.format("parquet").mode("append").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.table)

    def drop(self) -> None:
        """Remove the index: its table and, where it has a path of its own, the files there."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if self.path:
            delete(self.spark, self.path)

    def admit(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
        """Judge ``docs`` and append their new digests.

        Returns a row for each input row: row_no (``row_col``, or see ``with_row``), doc_id, keep_id, group_size (equal texts in the
        batch), kept, text_sha256. A null text counts as empty, a null id is smaller than any other, an empty table
        gives no rows; other columns are not read.
        """
        numbered, row = (docs, row_col) if row_col else with_row(docs)
        rows = settle(numbered.select(F.col(row).alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256")), "digests")
        top = F.max(F.struct(F.col("doc_id"), F.col("row_no"))).alias("top")
        groups = settle(rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), top), "digest-groups")
        fresh = groups.join(self.spark.table(self.table).select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        self._write(fresh.select("text_sha256", F.col("top.doc_id").alias("keep_id"), F.col("top.row_no").alias("keep_row"), F.lit(batch).alias("batch")))
        self.spark.catalog.refreshTable(self.table)
        known = settle(groups.join(self.spark.table(self.table).hint("merge"), "text_sha256"), "digest-verdicts")
        judged = spread_join(rows, known, ["text_sha256"], "group_size", F.col("row_no"))
        # by this run's numbers: those in the index are of the run that appended, which may have split the files otherwise
        kept = (F.col("batch") == batch) & F.col("top.doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_no") == F.col("top.row_no"))
        return judged.select("row_no", "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def scratch_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index of its own in the shared folder, for a corpus that is deduplicated in itself."""
    name = f"hearthway_digests_{uuid.uuid4().hex}"
    return DigestIndex(spark, name, buckets, f"{shared_dir(spark)}/{name}")


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str = "all", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with their columns.

    A row is known by its text's digest and its id, which hold for every read. Where several rows that are equal in both
    would stay, one of them does. Only rows that a Bloom filter lets through, those that go or are not alone, are shuffled.
    """
    ship(docs.sparkSession)
    own_index = index or scratch_index(docs.sparkSession)
    judged = settle(own_index.admit(docs, batch, id_col, text_col).select("text_sha256", "doc_id", "kept"), "exact-verdicts")
    if index is None:
        own_index.drop()
    sha, own, known_sha, known_id = (unused(docs, x) for x in ("sha", "sha_id", "known_sha", "known_id"))
    each = judged.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("n > 1 or not kept")
    each = settle(each.select(F.col("text_sha256").alias(known_sha), F.col("doc_id").alias(known_id), F.col("kept").alias("_kept")).withColumn("_k", F.xxhash64(known_sha, known_id)), "exact-copies")
    words = docs.sparkSession.sparkContext.broadcast(BlockedBloom.build(each, "_k").words)

    @F.pandas_udf("boolean")
    def judged_so(hashes: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(words.value).passes(hashes.to_numpy()))

    rows = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).withColumn(own, F.col(id_col).cast("long"))
    maybe = judged_so(F.xxhash64(F.xxhash64(sha, own)))
    fits = (F.col(sha) == F.col(known_sha)) & F.col(own).eqNullSafe(F.col(known_id))
    open_ = rows.filter(maybe)
    alone = open_.join(each.select(known_sha, known_id), fits, "left_anti")
    several = open_.join(each.filter("_kept").select(known_sha, known_id), fits, "left_semi").dropDuplicates([sha])
    kept = rows.filter(~maybe).unionByName(alone).unionByName(several)
    return kept.select(*[kept[f"`{c}`"] for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = scratch_index(spark)
    judged = index.admit(docs, "all").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    index.drop()  # the answer is in tables of its own
    return judged


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
