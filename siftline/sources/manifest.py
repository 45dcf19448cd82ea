"""The record of a run: what went in, with which settings, and what was counted on the way."""

from __future__ import annotations

import json
import platform
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import config_digest, file_digests


def run_id(at: datetime | None = None) -> str:
    """Sortable by time, as ``20260909T184233Z-1a2b3c4d``."""
    return f"{(at or datetime.now(UTC)).strftime('%Y%m%dT%H%M%SZ')}-{uuid.uuid4().hex[:8]}"


def started(spark: SparkSession, sample_id: str, config: dict, backend: str, inputs: list[str], name: str | None = None) -> dict:
    """A manifest at the start of a run; Spark reads and digests the inputs."""
    now = datetime.now(UTC)
    files = sorted(file_digests(spark, inputs).collect()) if inputs else []
    return {
        "run_id": name or run_id(now), "started_at": now.isoformat(), "finished_at": None, "sample_id": sample_id, "spark_version": spark.version,
        "python_version": platform.python_version(), "platform": platform.platform(), "backend": backend, "config_digest": f"sha256:{config_digest(config)}", "config": config,
        "inputs": [{"path": f["path"], "digest": f"sha256:{f['sha256']}", "bytes": f["length"]} for f in files], "counts": {},
    }


def finished(record: dict, *counts: dict[str, int]) -> dict:
    """The manifest with its end and the counts that the run observed; those of later arguments win."""
    merged = {k: int(v) for c in counts for k, v in c.items()}
    return record | {"finished_at": datetime.now(UTC).isoformat(), "counts": merged}


def write_manifest(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON file in a new folder, wherever Spark can write."""
    spark.createDataFrame([(json.dumps(record, indent=2),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, sample_id, started_at, finished_at, backend, counts) of all manifests in the folders below ``path``, newest first."""
    schema = "run_id string, sample_id string, started_at string, finished_at string, backend string, counts map<string, bigint>"
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    read = text.select(F.from_json("value", schema).alias("m")).select("m.*").where("run_id is not null")
    return read.orderBy(F.desc("started_at"), F.desc("run_id"))
