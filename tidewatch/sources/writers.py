"""Sinks: records with a growing schema, aggregates, units of work that can be resumed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder's path where all executors can write: in the checkpoint folder, on this machine only where all runs on it."""
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = set_.get() if set_.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
    return f"{root or tempfile.mkdtemp(prefix='scratch-')}/{uuid.uuid4()}"


def append_records(df: DataFrame, path: str) -> None:
    """Append rows to a compressed Parquet folder whose schema may grow; readers merge schemas."""
    df.write.mode("append").option("compression", "gzip").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_aggregate(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One small file."""
    one = df.coalesce(1).write.mode("overwrite")
    one.option("header", True).csv(path) if kind == "csv" else one.json(path)


def unfinished(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The units of work whose key has no result yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
