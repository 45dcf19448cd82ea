"""Leak detection, alias-normalised merges, grading and set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import allele_chains, canonical_allele


def leaked(benchmark: DataFrame, panels: DataFrame, held_out: DataFrame, keys: list[str]) -> DataFrame:
    """Benchmark rows whose normalised key is in a training panel and was not held out."""
    trained = panels.select(*keys).distinct().join(held_out.select(*keys).distinct(), keys, "left_anti")
    return benchmark.join(trained, keys, "left_semi")


def clean(benchmark: DataFrame, leaks: DataFrame, keys: list[str]) -> DataFrame:
    """Benchmark rows that are not leaked."""
    return benchmark.join(leaks.select(*keys).distinct(), keys, "left_anti")


def canonicalised(source: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Adds ``canonical``: the canonical allele of a column; unreadable names get null.

    ``aliases`` has alias (upper-case) and canonical; the first by canonical wins.
    """
    table = aliases.groupBy(F.col("alias").alias("_chain")).agg(F.min("canonical").alias("_alias"))
    # Each distinct name is read once, however many rows have it.
    named = source.select(F.col(column).alias("_name")).where(F.col(column).isNotNull()).distinct()
    chains = named.select("_name", F.explode_outer(F.array_distinct(allele_chains(F.col("_name")))).alias("_chain"))
    entry = F.when(F.col("_alias").isNotNull(), F.struct("_chain", "_alias"))
    known = chains.join(table, "_chain", "left").groupBy("_name").agg(F.map_from_entries(F.collect_list(entry)).alias("_known"))
    read = known.select("_name", canonical_allele(F.col("_name"), F.col("_known")).alias("_canonical"))
    return source.join(read, F.col(column) == F.col("_name"), "left").withColumn("canonical", F.col("_canonical")).drop("_name", "_canonical")


def largest(source: DataFrame, column: str, payload: str) -> DataFrame:
    """The largest payload of each name, as ``merged`` keeps no other; a name that very many rows have is one row."""
    return source.groupBy(column).agg(F.max(payload).alias(payload))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per canonical name the payloads of both sources, and where it occurs: both, only_a or only_b."""
    left = a.where("canonical is not null").groupBy("canonical").agg(F.max("payload").alias("payload_a"))
    right = b.where("canonical is not null").groupBy("canonical").agg(F.max("payload").alias("payload_b"))
    where = F.when(F.col("payload_a").isNull(), F.lit("only_b")).when(F.col("payload_b").isNull(), F.lit("only_a")).otherwise(F.lit("both"))
    return left.join(right, "canonical", "full").withColumn("side", where)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def grade(checks: DataFrame, by: str) -> DataFrame:
    """Per submission: 0 if a gate check fails, else the share of passed checks; and whether gates and required ones pass.

    ``checks`` has passed, gate and required (booleans).
    """
    gates = F.coalesce(F.bool_and(F.when(F.col("gate"), F.col("passed"))), F.lit(True))
    needed = F.coalesce(F.bool_and(F.when(F.col("required"), F.col("passed"))), F.lit(True))
    share = F.avg(F.col("passed").cast("double"))
    return checks.groupBy(by).agg(F.when(gates, share).otherwise(F.lit(0.0)).alias("score"), (gates & needed).alias("passed"), F.count("*").alias("checks"))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def deterministic(results: DataFrame, by: str, payload: str) -> DataFrame:
    """Per key whether all repeats gave one payload."""
    return results.groupBy(by).agg(F.count("*").alias("runs"), (F.count_distinct(payload) == 1).alias("identical"))
