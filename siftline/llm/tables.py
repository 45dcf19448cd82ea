"""Reading inputs, shared intermediate tables and size-checked joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many
#: bytes (rows times the given row width); beyond that the join shuffles.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where the setting is missing in a single process (tests), it is below /tmp; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = held.get() if held.isDefined() else "/tmp/spark-siftline"
    return f"{base.rstrip('/')}/siftline-{uuid.uuid4().hex}"


def stored(frame: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage."""
    spark = frame.sparkSession
    path = shared_dir(spark)
    writer = frame.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z only; every other letter stays as it is."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def maybe_broadcast(side: DataFrame, row_bytes: int) -> DataFrame:
    """The side marked for broadcasting if its counted size is small, else as it is.

    ``side`` should be a stored table, as it is counted here.
    """
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


def broadcast_if_small(side: DataFrame) -> DataFrame:
    """The side marked for broadcasting if the bytes of its values, summed over the whole table, are few.

    Its columns are numbers, booleans, strings or bytes; ``side`` should be stored or cheap, as it is read here.
    """
    row = sum(F.coalesce(F.octet_length(c), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(8) for c, kind in side.dtypes)
    total = side.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(side) if total <= BROADCAST_BYTES else side


def crc_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo a number; null ids give null."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def row_key() -> Column:
    """A key of a row of documents: equal for rows with equal doc_id and text only."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
