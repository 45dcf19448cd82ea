"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs in a single process.
LOCAL = "/tmp/siftline-shared"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a cluster must name one, as no executor sees another's local folders."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or LOCAL).rstrip("/")


def stored(frame: DataFrame) -> DataFrame:
    """Write a frame below spark.checkpoint.dir and read it back, so that later steps neither recompute it nor carry its plan."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/siftline-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
