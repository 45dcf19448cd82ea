"""Coding spans, variants by coding position and reported results, from their text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the lines of text files; (block, at) orders a file's lines, and a block is what one task read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("at", F.monotonically_increasing_id())


def carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null at or above each line, without bringing a file into one task."""
    marked = lines.withColumn("_own", value)
    inner = F.last("_own", ignorenulls=True).over(W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    ends = marked.where("_own is not null").groupBy("file", "block").agg(F.max_by("_own", "at").alias("_end"))
    blocks = lines.select("file", "block").distinct().join(ends, ["file", "block"], "left")
    above = F.last("_end", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.withColumn("_above", above).drop("_end")
    return marked.withColumn("_inner", inner).join(blocks, ["file", "block"]).withColumn(name, F.coalesce("_inner", "_above")).drop("_own", "_inner", "_above")


def attributes(text: Column) -> Column:
    """A map of ``k=v`` items; items without a sign are left out and the first of equal keys counts."""
    pairs = F.filter(F.split(text, ";"), lambda x: x.contains("="))
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda o: o["k"]), e["k"]) == i + 1)
    return F.map_from_entries(first)


def read_cds_spans(spark: SparkSession, path: str) -> DataFrame:
    """(transcript, sequence, start, end, strand) of the CDS lines of GFF3 files.

    ``##transcript-origin n`` shifts the lines below it by n, until the next one.  The
    transcript is the end of Parent after a colon, or the sequence where there is none.
    Lines of fewer than nine fields are left out.
    """
    lines = in_file_order(spark, path)
    origin = F.regexp_extract("value", r"^##transcript-origin.*?(-?\d+)\s*$", 1)
    lines = carried(lines, F.when(F.col("value").startswith("##transcript-origin"), F.try_to_number(origin, F.lit("S999999999999999"))).cast("long"), "origin")
    field = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).where((F.size(field) >= 9) & (field[2] == "CDS"))
    parent = F.coalesce(F.try_element_at(attributes(field[8]), F.lit("Parent")), F.lit(""))
    shift = F.coalesce("origin", F.lit(0))
    return rows.select(
        F.when(parent != "", F.substring_index(parent, ":", -1)).otherwise(field[0]).alias("transcript"), field[0].alias("sequence"),
        (field[3].cast("long") - shift).alias("start"), (field[4].cast("long") - shift).alias("end"), field[6].alias("strand"),
    )


def read_coding_variants(spark: SparkSession, path: str) -> DataFrame:
    """(variant_id, ref, alt, transcript, cds_pos) of VCF lines whose INFO has TRANSCRIPT and CDSPOS; cds_pos counts from 0."""
    field = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#')").withColumn("_info", attributes(field[7]))
    at = F.try_element_at("_info", F.lit("CDSPOS")).cast("long") - 1
    return rows.select(field[2].alias("variant_id"), field[3].alias("ref"), field[4].alias("alt"), F.try_element_at("_info", F.lit("TRANSCRIPT")).alias("transcript"), at.alias("cds_pos"))


def read_reported(spark: SparkSession, path: str) -> DataFrame:
    """(variant_id, downstream_peptide, start_offset) of a CSV with a header; an offset that is no whole number is null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select("variant_id", F.coalesce("downstream_peptide", F.lit("")).alias("downstream_peptide"), F.expr("try_cast(start_offset as long)").alias("start_offset"))
