"""Making this package importable in Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def share_package(spark: SparkSession) -> None:
    """Put the folder of this package on the workers' path, wherever the driver was started.

    Workers on other machines need the package installed or sent with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
