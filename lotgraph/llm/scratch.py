"""Tables that cut lineage: written once to the folder that all executors share, then read back; memory of workers."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local temporary folder only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.gettempdir() + "/lotgraph-scratch"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lotgraph/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder, in so many parts at most, and return the written table."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def cleanup(spark: SparkSession) -> None:
    """Delete what this application wrote; results that are still lazy must have been written before."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        drop_path(spark, path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python by so many rows at most: a batch is held some times over, beside what earlier steps left."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def only(module: str) -> None:
    """A Python worker goes from step to step: it forgets what the operators other than this one have cached."""
    held = 0
    for name, other in list(sys.modules.items()):
        if name.startswith("lotgraph.llm.") and name != module:
            for f in vars(other).values():
                if hasattr(f, "cache_clear") and f.__module__ == name and f.cache_info().currsize:
                    held += 1
                    f.cache_clear()
    if held:
        gc.collect()
