"""Reading the base tables and cutting lineage through shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One base table; naming columns keeps the parquet scan as narrow as the query."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing and the master is local (tests) a temporary folder is made and
    set once; on a cluster a machine-local folder would lose rows, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if configured:
        if current.isEmpty():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not current.isEmpty():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="webspark-")
    _WRITTEN.append((spark, own))
    context.setCheckpointDir(own)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the files.

    Used where one result feeds several consumers: it cuts lineage, survives the loss of an
    executor, keeps columns prunable, and unlike a cache costs no executor memory. It runs a job at
    once, so an operator that uses it does part of its work while the query is built. The files
    live until ``release`` or the end of the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every intermediate result written so far, on whatever file system it lies. To be
    called once the results of the queries have been written or collected."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:
            # the session is gone: what is local can still be removed
            local = path.removeprefix("file://").removeprefix("file:")
            if local.startswith("/"):
                shutil.rmtree(local, ignore_errors=True)


atexit.register(release)
