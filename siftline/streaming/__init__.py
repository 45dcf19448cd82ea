"""Extension beyond the batch operators: the stateless scoring steps over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import variants


def annotate_stream(spark: SparkSession, path: str, schema: str, thresholds: variants.Thresholds = variants.Thresholds()) -> DataFrame:
    """Variants that arrive as Parquet files, with ccf and drop reason; needs no state."""
    return variants.annotated(spark.readStream.schema(schema).parquet(path), thresholds)
