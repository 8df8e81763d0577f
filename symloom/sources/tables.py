"""Paths in the folder that driver and executors share, and tables kept by content."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local master (tests) takes a folder under /tmp; any other is refused, because its executors could
    not read what another wrote."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = at or "/tmp/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished jobs go: Spark deletes them when the driver has collected the plans that made them, which it may not do for long."""
    gc.collect()
    spark._jvm.System.gc()


def stored(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that was written under ``key`` (a hash of what it was made from, as of manifests), made and written where there is none."""
    at = f"{root.rstrip('/')}/{key}"
    try:
        return spark.read.parquet(at)
    except AnalysisException as e:
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
    make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def content_key(rows: DataFrame, *columns: str) -> str:
    """A key that changes with the rows' content and not with their order."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("h"), F.coalesce(F.sum(h % 1000003), F.lit(0)).alias("k")).first()
    return f"{got['n']}-{got['h']}-{got['k']}".replace("--", "-m")
