"""FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, header, seq): one row per record; lines of a sequence are joined, upper-cased; gz is fine."""
    records = spark.read.option("lineSep", ">").text(path).where("length(trim(value)) > 0")
    lines = F.split("value", r"\r?\n", 2)
    seq = F.upper(F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")), r"\s+", ""))
    return records.select(F.regexp_extract(lines[0], r"^(\S+)", 1).alias("name"), F.trim(lines[0]).alias("header"), seq.alias("seq"))


def proteins(records: DataFrame) -> DataFrame:
    """Protein, transcript, gene and symbol of ``key:value`` tokens in each header; versions stripped."""
    token = lambda key: F.nullif(F.regexp_extract("header", rf"(?:^|\s){key}:(\S+)", 1), F.lit(""))
    plain = lambda c: F.split(c, r"\.")[0]
    return records.select(
        plain(F.col("name")).alias("protein"), plain(token("transcript")).alias("transcript"), plain(token("gene")).alias("gene"), token("gene_symbol").alias("symbol"), "seq"
    )
