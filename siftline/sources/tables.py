"""Tab-separated and JSON inputs and outputs of the ranking and evaluation steps."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

VARIANT_COLUMNS = ("chrom", "pos", "ref", "alt", "gene", "transcript", "consequence", "protein_position", "amino_acids")


class SchemaError(ValueError):
    """A required column is missing."""


def _blank(c: Column) -> Column:
    return F.when(F.trim(c).isin("", "."), F.lit(None)).otherwise(F.trim(c))


def read_tsv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as text, names lower-cased, blanks and ``.`` as null."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return raw.select(*[_blank(F.col(c)).alias(c) for c in raw.columns])


def number(c: str) -> Column:
    """The first comma part as a double, null if unreadable."""
    return F.expr(f"try_cast(split({c}, ',')[0] as double)")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """The variant table; rows without a readable position are skipped."""
    raw = read_tsv(spark, path, ("chrom", "pos", "ref", "alt", "gene", "consequence", "protein_position"))
    optional = lambda c, kind: (number(c).cast(kind) if c in raw.columns else F.lit(None).cast(kind)).alias(c)
    start = F.regexp_extract("protein_position", r"^(\d+)", 1)
    end = F.regexp_extract("protein_position", r"^\d+-(\d+)", 1)
    text = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ("chrom", "ref", "alt", "gene", "transcript", "consequence", "amino_acids")]
    filters = F.coalesce(F.split("filter", ";"), F.array().cast("array<string>")) if "filter" in raw.columns else F.array().cast("array<string>")
    rows = raw.select(
        *text, F.expr("try_cast(pos as long)").alias("pos"), start.try_cast("int").alias("start"), F.when(end != "", end.try_cast("int")).otherwise(start.try_cast("int")).alias("end"),
        *[optional(c, "double") for c in ("dna_vaf", "rna_vaf", "copy_number", "population_af")], optional("tumor_depth", "int"), filters.alias("filters"),
    )
    return rows.where("start is not null")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Assay labels with key and label (1, 0 or null for indeterminate calls)."""
    raw = read_tsv(spark, path, ("sample_id", "peptide", "call"))
    allele = F.coalesce("allele", F.lit("*")) if "allele" in raw.columns else F.lit("*")
    label = F.when(F.col("call") == "positive", 1).when(F.col("call") == "negative", 0)
    return raw.withColumn("key", F.concat_ws("|", "sample_id", "peptide", allele)).withColumn("label", label)


def read_ranking(spark: SparkSession, path: str, method: str) -> DataFrame:
    """(method, key, score); rows without peptide or score are skipped, of equal keys the last wins."""
    raw = read_tsv(spark, path, ("score",)).withColumn("_line", F.monotonically_increasing_id())
    stated = [c for c in ("mutant_peptide", "peptide") if c in raw.columns]
    if not stated:
        raise SchemaError("missing columns: peptide")
    peptide = F.coalesce(*[F.col(c) for c in stated])
    allele = F.coalesce("allele", F.lit("*")) if "allele" in raw.columns else F.lit("*")
    sample = F.col("sample_id") if "sample_id" in raw.columns else F.lit("")
    rows = raw.select(F.concat_ws("|", sample, peptide, allele).alias("key"), number("score").alias("score"), "_line", peptide.alias("_p")).where("_p is not null and score is not null")
    return rows.groupBy("key").agg(F.max_by("score", "_line").alias("score")).select(F.lit(method).alias("method"), "key", "score")


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Published claims: claim_id (unique within the read), peptide, gene, protein_change, source and downstream.

    Cells are trimmed; rows without a peptide are skipped, a missing source is empty, a missing
    downstream protein null.
    """
    raw = spark.read.csv(path, sep="\t", header=True)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    missing = [c for c in ("peptide", "gene", "protein_change") if c not in raw.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    text = lambda c: F.trim(F.coalesce(F.col(c) if c in raw.columns else F.lit(None).cast("string"), F.lit("")))
    rows = raw.select(F.monotonically_increasing_id().alias("claim_id"), *[text(c).alias(c) for c in ("peptide", "gene", "protein_change", "source")], F.nullif(text("downstream_protein"), F.lit("")).alias("downstream"))
    return rows.where("peptide <> ''")


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """(path, alleles, unreadable): the genotype of each file, a list with ``#`` comments or a table with an allele column.

    A file is a table if its first line has a tab and the word allele.  The files are
    small and many: each is one row.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("lines"))
    header = F.lower(F.get("lines", F.lit(0)))
    at = F.array_position(F.split(header, "\t"), "allele").cast("int") - 1
    cells = F.transform(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda x: F.coalesce(F.get(F.split(x, "\t"), at), F.lit("")))
    stated = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    listed = F.flatten(F.transform(stated, names.genotype_tokens))
    tokens = F.when(header.contains("\t") & header.contains("allele"), cells).otherwise(listed)
    return files.select("path", names.genotype(tokens).alias("g")).select("path", "g.alleles", "g.unreadable")


def read_feature_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(key, features): feature rows of JSON arrays under ``sample|peptide|allele`` and ``sample|peptide|*``.

    Files count in the order given, rows by their place: of rows with the same allele the
    last wins, without one (``*``) the first, unless a row states ``*`` itself.
    """
    read = [spark.read.json(p, multiLine=True).select("sample_id", "peptide", "allele", "features", F.struct(F.lit(i).alias("file"), F.monotonically_increasing_id().alias("at")).alias("at")) for i, p in enumerate(paths)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)
    exact = rows.groupBy(F.concat_ws("|", "sample_id", "peptide", "allele").alias("key")).agg(F.max_by("features", "at").alias("features"))
    any_allele = rows.groupBy(F.concat_ws("|", "sample_id", "peptide", F.lit("*")).alias("key")).agg(F.min_by("features", "at").alias("features"))
    return exact.unionByName(any_allele.join(exact.select("key"), "key", "left_anti"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The feature rows of a JSON array."""
    return spark.read.json(path, multiLine=True)


def write_tsv(frame: DataFrame, path: str, columns: list[str]) -> None:
    """A table with a header and tabs; nulls are empty."""
    frame.select(*columns).write.csv(path, sep="\t", header=True, nullValue="", mode="errorifexists")


def write_features(frame: DataFrame, path: str) -> None:
    """Feature rows as JSON lines; NaN becomes null."""
    doubles = {c for c, kind in frame.dtypes if kind == "double"}
    frame.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in frame.columns]).write.json(path)


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256, length) of input files, read by Spark."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"), "length")


def config_digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
