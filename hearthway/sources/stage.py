"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def stage_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a local session takes a temporary folder, and a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or _own.setdefault(app, 'file://' + tempfile.mkdtemp(prefix='hearthway-'))).rstrip('/')}/stage-{app}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage of iterations in a way that survives lost executors."""
    path = f"{stage_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that ``settle`` wrote and that nothing reads any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, as --py-files would, where Python runs on them."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    with tempfile.NamedTemporaryFile(prefix="hearthway-", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(out.name)
    _shipped.add(app)
