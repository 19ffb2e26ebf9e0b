"""A folder that the driver and all executors share, for what is written and read again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below spark.checkpoint.dir; a temporary folder only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="scratch-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to a new place and read from it, so that what made it runs once; kept by the executors where they share no folder."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.master.startswith("local"):
        return df.persist()
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def part_files(path: str) -> list[str]:
    """The files of a folder that Spark has written, in order, on a file system that is mounted."""
    folder = path.removeprefix("file://").removeprefix("file:")
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.startswith("part-"))
