"""Shared pieces: tables in the cluster's shared folder, row identities and joins that stand hot keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bloom import BlockedBloom

#: A key is heavy when it holds more than 1/HEAVY of all rows, so there are fewer than HEAVY such keys.
HEAVY = 1000

#: ASCII white space: the separators of words in every operator here.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset a local session takes a temporary one
    (as tests do), and a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="hearthway-"))
    return f"{root.rstrip('/')}/hearthway-{app}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for held in _collecting:
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame | None) -> None:
    """Delete a table that ``settle`` wrote and that nothing reads any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        delete(df.sparkSession, path)


_collecting: list[list[str]] = []


@contextmanager
def collecting(held: list[str]) -> Iterator[list[str]]:
    """Note in ``held`` the tables that are settled meanwhile, for ``release``."""
    _collecting.append(held)
    try:
        yield held
    finally:
        _collecting.remove(held)


def release(spark: SparkSession, held: list[str]) -> None:
    """Delete the noted tables, which nothing reads any more, and let the JVM's cleaner drop shuffles without a reader."""
    for path in held:
        delete(spark, path)
    held.clear()
    gc.collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row(df: DataFrame) -> tuple[DataFrame, str]:
    """Add a row number that holds for one read only; returns the name of its column.

    Rows that equal each other in every column still get different numbers. Another read may split the files otherwise
    (the splits follow the cores at hand) and then numbers rows otherwise: what is read again needs ``settled_rows``.
    """
    name = unused(df, "row_no")
    return df.withColumn(name, F.monotonically_increasing_id()), name


def settled_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a row number, written once, so that numbers and rows agree in all later reads; and the column's name."""
    numbered, name = with_row(df)
    return settle(numbered, "rows"), name


def drop_rows(numbered: DataFrame, name: str, rows: DataFrame, row: str = "row_no") -> DataFrame:
    """``numbered`` (see ``settled_rows``) without the rows whose number is in ``rows`` (settled), and without ``name``.

    A Bloom filter of the numbers, of bounded size, tells most rows apart where they are read; only rows that it lets
    through are shuffled to an exact anti-join.
    """
    ship(numbered.sparkSession)
    bloom = numbered.sparkSession.sparkContext.broadcast(BlockedBloom.build(rows, row).words)

    @F.pandas_udf("boolean")
    def may_drop(hashes: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(bloom.value).passes(hashes.to_numpy()))

    maybe = may_drop(F.xxhash64(name))
    kept = numbered.filter(~maybe).unionByName(numbered.filter(maybe).join(rows.select(F.col(row).alias(name)), name, "left_anti"))
    return kept.select(*[kept[f"`{c}`"] for c in numbered.columns if c != name])


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, by: Column) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row a key, ``count``: its rows) in which no task gets a whole heavy key.

    Heavy keys are fewer than HEAVY, whatever the data, so their list may be broadcast; each is split over several
    salts by ``by``, and its group row is repeated for each salt. ``groups`` is read twice: settle it first.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    limit = max(1, total // HEAVY)
    heavy = groups.filter(F.col(count) > limit).select(*keys, F.ceil(F.col(count) / F.lit(limit)).cast("int").alias("_splits"))
    salted = (
        rows.join(F.broadcast(heavy), keys, "left")
        .withColumn("_salt", F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("_splits")).cast("int")))
        .drop("_splits")
    )
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.when(F.col(count) > limit, F.ceil(F.col(count) / F.lit(limit)).cast("int") - 1).otherwise(F.lit(0))))))
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")


def uniform(*parts: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of ``parts`` and ``seed``; plain SQL can compute the same."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def numbered_within(df: DataFrame, group: list[str], chunk: Column, counts: DataFrame | None = None, name: str = "slot", order: list | None = None) -> DataFrame:
    """A gapless number from 0 in each group, in which no task sorts a whole group.

    ``chunk`` deals the rows of a group into parts; the parts' sizes are summed first, then rows are numbered in
    their part and moved by the rows of the parts before. ``df`` is read twice: settle it first.
    """
    parted = df.withColumn("_chunk", chunk)
    parts = parted.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    ranked = parted.withColumn("_k", F.row_number().over(W.partitionBy(*group, "_chunk").orderBy(*(order or []))))
    # parts are as many as the chunks; a chunk's own key spreads over tasks even where the group is hot
    return ranked.join(parts, [*group, "_chunk"]).withColumn(name, (F.col("_before") + F.col("_k") - 1).cast("long")).drop("_chunk", "_k", "_before")


def scan(df: DataFrame, key: str, order: list[Column], step: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
    """Walk the rows of each ``key`` in ``order``: ``step(state, row)`` gives the next state and a row to put out or None,
    ``finish(key, state)`` a row at the key's end.

    The state of a key is None at its start. Rows stream past it, so that no key's rows are ever held together.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, now, state = False, None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if not begun or row[key] != now:
                    if begun and finish:
                        out.append(finish(now, state))
                    begun, now, state = True, row[key], None
                state, made = step(state, row)
                out.append(made)
            yield table(out)
        if begun and finish:
            yield table([finish(now, state)])

    def table(made: list[dict | None]) -> pd.DataFrame:
        return pd.DataFrame([[m[n] for n in names] for m in made if m is not None], columns=names)

    ship(df.sparkSession)
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(walk, schema)


def each(df: DataFrame, make: Callable[[dict], dict], schema: str) -> DataFrame:
    """A row made of each row by itself."""
    names = [x.split()[0] for x in schema.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [make(row) for row in batch.to_dict("records")]
            yield pd.DataFrame([[m[n] for n in names] for m in made], columns=names)

    ship(df.sparkSession)
    return df.mapInPandas(walk, schema)


#: Bytes of a batch between the JVM and a Python worker, where the session does not say otherwise.
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

_shipped: set[str] = set()


#: What a Python worker keeps for its later tasks.
_kept: dict[tuple[type, str], object] = {}


def kept(kind: type, path: str):
    """The encoder of this worker for a file; later tasks of the worker find the units of earlier ones."""
    if (kind, path) not in _kept:
        _kept[kind, path] = kind(path)
    return _kept[kind, path]


def let_go() -> None:
    """At the start of a Python task that takes none of them: drop the encoders that this worker keeps from other stages."""
    if _kept:
        _kept.clear()
        tidy()


def tidy() -> None:
    """At the end of a Python task: give memory that is free again back to the system, as workers are used again."""
    import ctypes

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, as --py-files would, and bound Python batches."""
    app = spark.sparkContext.applicationId
    # whole texts vary from nothing to megabytes, so what goes to a Python worker at once is bounded by bytes, not rows
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH)
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    with tempfile.NamedTemporaryFile(prefix="hearthway-", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(out.name)
    _shipped.add(app)
