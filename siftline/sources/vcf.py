"""Annotated VCF files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.variants import consequence_class, novel_tail, protein_span, residue_change


class VCFError(ValueError):
    """The header lacks what the reader needs."""


def header(spark: SparkSession, path: str) -> tuple[list[str], list[str], int | None]:
    """Sample columns, annotation fields and annotation release from the header lines, which are few."""
    lines = [r.value for r in spark.read.text(path).where(F.col("value").startswith("#")).collect()]
    names = next((x for x in lines if x.startswith("#CHROM")), None)
    if names is None:
        raise VCFError("no #CHROM line")
    csq = next((m for x in lines if "ID=CSQ" in x and (m := re.search(r"Format:\s*([^\"']+)", x))), None)
    if csq is None:
        raise VCFError("no annotation format in the header")
    text = "\n".join(lines)
    release = re.search(r"ensembl=(\d+)", text) or re.search(r'##VEP="v(\d+)', text)
    return names.split("\t")[9:], [f.strip() for f in csq[1].split("|")], int(release[1]) if release else None


def last_wins(keys: Column, values: Column) -> Column:
    """A map of two arrays in which the last of equal keys counts."""
    at = F.sequence(F.lit(1), F.size(keys))
    kept = F.filter(at, lambda i: ~F.array_contains(F.slice(keys, i + 1, F.size(keys)), F.element_at(keys, i)))
    return F.map_from_arrays(F.transform(kept, lambda i: F.element_at(keys, i)), F.transform(kept, lambda i: F.element_at(values, i)))


def info_map(info: Column) -> Column:
    """``k=v`` pairs; a flag maps to 'true', and the last of a repeated key counts."""
    parts = F.filter(F.split(info, ";"), lambda x: x != "")
    keys = F.transform(parts, lambda x: F.substring_index(x, "=", 1))
    values = F.transform(parts, lambda x: F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit("true")))
    return F.when(F.size(parts) > 0, last_wins(keys, values)).otherwise(F.create_map().cast("map<string,string>"))


def depths(call: Column) -> Column:
    """The sample's depths by allele; null if there is none or one is no number."""
    read = F.transform(F.split(F.try_element_at(call, F.lit("AD")), ","), lambda x: x.try_cast("int"))
    return F.when(F.forall(read, lambda x: x.isNotNull()), read)


def allele_fraction(call: Column) -> Column:
    """From the sample's fields: the second of at least two depths over their sum, else AF."""
    read = depths(call)
    total = F.aggregate(read, F.lit(0), lambda a, x: a + x)
    share = F.when((F.size(read) >= 2) & (total > 0), F.get(read, 1) / total)
    return F.coalesce(share, F.get(F.split(F.try_element_at(call, F.lit("AF")), ","), 0).try_cast("double"))


def total_depth(call: Column) -> Column:
    """DP, else the sum of at least two depths where it is positive."""
    read = depths(call)
    total = F.aggregate(read, F.lit(0), lambda a, x: a + x)
    return F.coalesce(F.try_element_at(call, F.lit("DP")).try_cast("int"), F.when((F.size(read) >= 2) & (total > 0), total))


def read_vcf(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """One row per line: the picked annotation's fields, filters, allele fraction, depth and population frequency.

    The protein position, the residues and a frameshift's tail are columns too, named as
    ``peptides.mutant_proteins`` reads them.
    Of the annotations that change a protein the canonical one is picked, else a
    protein-coding one, else the first.  Lines without one are left out, and those
    without a readable protein position where the annotation has that field.  ``.gz``
    files are read as one part each.
    """
    samples, fields, release = header(spark, path)
    column = 9 + (samples.index(sample) if sample else max(len(samples) - 1, 0))
    part = F.split("value", "\t")
    keys = F.split(F.coalesce(F.get(part, 8), F.lit("")), ":")  # files without samples have eight columns
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    rows = rows.select(
        F.get(part, 0).alias("chrom"), F.get(part, 1).try_cast("long").alias("pos"), F.get(part, 2).alias("id"), F.get(part, 3).alias("ref"), F.get(part, 4).alias("alt"),
        F.when(F.get(part, 6).isin(".", ""), F.array().cast("array<string>")).otherwise(F.split(F.get(part, 6), ";")).alias("filters"), info_map(F.get(part, 7)).alias("info"),
        last_wins(keys, F.concat(F.split(F.coalesce(F.get(part, column), F.lit("")), ":"), F.array_repeat(F.lit("."), F.size(keys)))).alias("call"),
    )
    entry = lambda e: F.struct(*[F.coalesce(F.try_element_at(F.split(e, r"\|"), F.lit(i + 1)), F.lit("")).alias(f) for i, f in enumerate(fields)])
    entries = F.transform(F.split(F.try_element_at("info", F.lit("CSQ")), ","), entry)
    coding = F.filter(entries, lambda e: consequence_class(e["Consequence"]) != "other")
    order = [F.filter(coding, lambda e: e["CANONICAL"] == "YES")] if "CANONICAL" in fields else []
    order += [F.filter(coding, lambda e: e["BIOTYPE"] == "protein_coding")] if "BIOTYPE" in fields else []
    picked = F.coalesce(*[F.try_element_at(o, F.lit(1)) for o in [*order, coding]])
    population = F.coalesce(*[F.get(F.split(F.try_element_at("info", F.lit(k)), ","), 0).try_cast("double") for k in ("gnomADe_AF", "gnomAD_AF", "AF_popmax", "POPAF")])
    out = rows.withColumn("csq", picked).where("csq is not null")
    of = lambda name: F.col(f"csq.{name}") if name in fields else None
    text = lambda name: F.lit(None).cast("string") if of(name) is None else of(name)
    start, end = protein_span(text("Protein_position"))
    before, after = residue_change(text("Amino_acids"))
    tail, change = novel_tail(of("FrameshiftSequence"), of("DownstreamProtein"), of("ProteinLengthChange"), start)
    gene = F.coalesce(*[F.when(text(c) != "", text(c)) for c in ("SYMBOL", "Gene")], F.lit(""))
    found = out.where(start.isNotNull()) if "Protein_position" in fields else out
    return found.select(
        "chrom", "pos", "id", "ref", "alt", "filters", "csq", consequence_class(F.col("csq.Consequence")).alias("consequence"),
        gene.alias("gene"), text("Feature").alias("transcript"), consequence_class(F.col("csq.Consequence")).alias("variant_class"),
        start.alias("protein_start"), end.alias("protein_end"), before.alias("aa_ref"), after.alias("aa_alt"), tail.alias("downstream"), change.alias("length_change"),
        allele_fraction(F.col("call")).alias("dna_vaf"), total_depth(F.col("call")).alias("tumor_depth"), population.alias("population_af"), F.lit(release).cast("int").alias("release"),
    )
