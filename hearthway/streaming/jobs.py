"""Incremental variants: running flow totals, quarantine by micro-batch, windowed morning volume."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from hearthway.sources.stage import ship, stage_dir


def stream_of(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files at ``path``, a folder or a single file; ``files`` for each micro-batch."""
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def _run(stream: DataFrame, mode: str, each, folder: str) -> None:
    """Run a stream to the end of what has arrived; its checkpoint in ``folder`` lets a later run go on from there."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def _folder(spark: SparkSession, folder: str | None) -> str:
    return folder or f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"


#: Micro-batches after which a log of changed keys is folded into one table.
COMPACT_EVERY = 16


class UpsertLog:
    """The last state of each key in a folder: one base table and the changes of the micro-batches since.

    A micro-batch writes only the keys it changed, over its own folder, so a retry is safe. After every COMPACT_EVERY
    batches base and changes become a new base, which takes its name by a rename once it is whole; then what it holds is
    deleted. So a reader opens one base and at most COMPACT_EVERY folders of changes, however long the job has run, and
    a run that stops anywhere leaves a log that reads the same.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema):
        self.spark, self.folder, self.keys, self.schema = spark, folder, keys, schema
        self.values = [c for c in schema.names if c not in keys]
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        if not self.fs.exists(self.path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(self.folder))]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}="))

    def parts(self) -> tuple[int | None, list[int]]:
        """The last base, and the batches since."""
        bases = self._numbers("base")
        base = bases[-1] if bases else None
        return base, [n for n in self._numbers("batch") if base is None or n > base]

    def add(self, df: DataFrame, batch: int) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        if (batch + 1) % COMPACT_EVERY == 0:
            self.compact(batch)

    def compact(self, upto: int) -> None:
        base, _ = self.parts()
        if base is None or base < upto:
            made = f"{self.folder}/making-{uuid.uuid4().hex}"
            self.read(upto).write.parquet(made)
            if not self.fs.rename(self.path(made), self.path(f"{self.folder}/base={upto}")):
                raise OSError(f"{made} can't take the name of the base")
        for kind, last in (("batch", upto), ("base", upto - 1)):
            for n in self._numbers(kind):
                if n <= last:
                    self.fs.delete(self.path(f"{self.folder}/{kind}={n}"), True)

    def read(self, upto: int | None = None) -> DataFrame:
        """Each key's last state."""
        base, batches = self.parts()
        folders = [(f"base={base}", base)] if base is not None else []
        folders += [(f"batch={n}", n) for n in batches if upto is None or n <= upto]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(self.schema)
        seen = [read.parquet(f"{self.folder}/{f}").withColumn("_batch", F.lit(n).cast("long")) for f, n in folders]
        last = reduce(DataFrame.unionByName, seen).groupBy(*self.keys).agg(F.max_by(F.struct(*self.values), "_batch").alias("_v"))
        return last.select(*self.keys, *[F.col(f"_v.{c}").alias(c) for c in self.values])


def _latest(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Each key's last state after all micro-batches, of this run and earlier ones on the same ``folder``."""
    log = UpsertLog(stream.sparkSession, f"{folder}/out", keys, stream.schema)
    _run(stream, "update", log.add, folder)
    return log.read()


def running_flows(trips: DataFrame, keys: list[str], weight: str, value: str, folder: str | None = None) -> DataFrame:
    """Flow, weighted mean and rows by key after all files that have arrived; equals the batch aggregate.

    With a ``folder`` of its own a job goes on where its last run ended.
    """
    agg = trips.groupBy(*keys).agg(F.sum(weight).alias("flow"), F.sum(F.col(weight) * F.col(value)).alias("_xw"), F.count(F.lit(1)).alias("n_rows"))
    out = _latest(agg, keys, _folder(trips.sparkSession, folder))
    return out.withColumn("mean", F.round(F.col("_xw") / F.col("flow"), 9)).drop("_xw")


def split_stream(rows: DataFrame, dim: DataFrame, key: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid and orphan rows of a stream, split batch by batch against a static dimension."""
    spark, folder = rows.sparkSession, _folder(rows.sparkSession, folder)
    keys = dim.select(key).distinct()

    def each(df: DataFrame, batch: int) -> None:
        df.join(keys, key, "left_semi").write.mode("overwrite").parquet(f"{folder}/valid/batch={batch}")
        df.join(keys, key, "left_anti").write.mode("overwrite").parquet(f"{folder}/orphan/batch={batch}")

    _run(rows, "append", each, folder)
    schema = rows.select(key, *[c for c in rows.columns if c != key]).schema
    return tuple(spark.read.schema(schema).parquet(f"{folder}/{side}").select(*schema.names) for side in ("valid", "orphan"))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
VOLUMES = "hour_ms long, kind string, n long, volume double, ms long, value double"


class HourlyVolume(StatefulProcessor):
    """Count and volume of an hour, held until the watermark passes its end; rows that come after that are put out as late.

    A timer in event time ends the hour and frees its state.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, volume double")

    def handleInputRows(self, key, rows, timerValues):
        (hour,), mark = key, timerValues.getCurrentWatermarkInMs()
        if hour + HOUR_MS <= mark:
            for row in rows:
                yield Row(hour_ms=hour, kind="late", n=None, volume=None, ms=row.ms, value=row.value)
            return
        n, volume = self.totals.get() if self.totals.exists() else (0, 0.0)
        for row in rows:
            n, volume = n + 1, volume + (row.value or 0.0)
        self.totals.update((n, volume))
        self.handle.registerTimer(hour + HOUR_MS)
        yield Row(hour_ms=hour, kind="open", n=n, volume=volume, ms=None, value=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, volume = self.totals.get()
        self.totals.clear()
        yield Row(hour_ms=key[0], kind="final", n=n, volume=volume, ms=None, value=None)

    def close(self) -> None:
        pass


def morning_volume(events: DataFrame, ts: str = "ts", value: str = "value", low: int = 420, high: int = 580, late: str = "1 day", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Hourly count and volume of events between 07:00 and 09:40, and the events that came too late for them.

    Volumes: hour, n, volume, final (the hour has ended). An hour that ends ``late`` before the newest event of earlier
    micro-batches is over: its state is freed, and further events of it go to the second table (ts, value) instead. A
    null value counts as an event without volume, a null time as no event.
    """
    spark, folder = events.sparkSession, _folder(events.sparkSession, folder)
    ship(spark)
    minute = F.hour(ts) * 60 + F.minute(ts)
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).filter(minute.between(low, high)).withWatermark(ts, late)
    # as plain numbers, so that the watermark does not drop late rows before they are seen
    rows = timed.select(F.unix_millis(F.date_trunc("hour", ts)).alias("hour_ms"), F.unix_millis(ts).alias("ms"), F.col(value).cast("double").alias("value"))
    stated = rows.groupBy("hour_ms").transformWithState(HourlyVolume(), VOLUMES, "Update", "EventTime")
    log = UpsertLog(spark, f"{folder}/out", ["hour_ms"], StructType.fromDDL("hour_ms long, kind string, n long, volume double"))

    def each(df: DataFrame, batch: int) -> None:
        df.persist(StorageLevel.DISK_ONLY)
        # an hour may change and end in one micro-batch
        last = df.filter("kind <> 'late'").groupBy("hour_ms").agg(F.max_by(F.struct("kind", "n", "volume"), F.struct(F.col("kind") == "final", "n")).alias("l")).select("hour_ms", "l.*")
        log.add(last, batch)
        df.filter("kind = 'late'").select("ms", "value").write.mode("overwrite").parquet(f"{folder}/late/batch={batch}")
        df.unpersist()

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        _run(stated, "update", each, folder)
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
    volumes = log.read().select(F.timestamp_millis("hour_ms").alias("hour"), "n", "volume", (F.col("kind") == "final").alias("final"))
    at = log.path(f"{folder}/late")
    missed = spark.read.schema("ms long, value double").parquet(f"{folder}/late") if log.fs.exists(at) else spark.createDataFrame([], "ms long, value double")
    return volumes, missed.select(F.timestamp_millis("ms").alias(ts), F.col("value").alias(value))
