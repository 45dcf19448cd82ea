"""Filtering and annotating variant tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.residues import clip

# Drop reasons in the order in which they are tried.
REASONS = ("not_pass", "low_depth", "low_vaf", "germline_common", "subclonal", "no_expression_data", "not_expressed", "allele_not_expressed")
# Consequence terms that change a protein, by class.
CODING = {
    "missense_variant": "missense",
    "inframe_insertion": "inframe_insertion",
    "inframe_deletion": "inframe_deletion",
    "frameshift_variant": "frameshift",
}


@dataclass(frozen=True)
class Thresholds:
    require_pass: bool = True
    min_depth: int = 20
    min_vaf: float = 0.05
    max_population_af: float = 1e-4
    min_ccf: float = 0.6
    purity: float = 0.5
    min_tpm: float = 1.0
    min_rna_vaf: float = 0.02
    require_rna: bool = False


def ccf(vaf: Column, copies: Column, purity: float, multiplicity: int = 1) -> Column:
    """Cancer-cell fraction, 0..1; null without a positive allele fraction; missing or bad copy numbers count as 2."""
    cn = F.when(copies > 0, copies).otherwise(F.lit(2.0))
    raw = vaf * (F.lit(purity) * cn + F.lit(2 * (1 - purity))) / F.lit(purity * multiplicity)
    return F.when(vaf > 0, clip(raw))


def drop_reason(t: Thresholds = Thresholds()) -> Column:
    """The first rule a variant breaks, or null.  A missing measure breaks no rule but the one that asks for it.

    Columns: filters (array), depth, dna_vaf, population_af, ccf, tpm, rna_vaf.
    """
    out = F.lit(None).cast("string")
    rules = [
        (F.lit(t.require_pass) & (F.size("filters") > 0) & (F.col("filters") != F.array(F.lit("PASS"))), "not_pass"),
        (F.col("depth") < t.min_depth, "low_depth"),
        (F.col("dna_vaf") < t.min_vaf, "low_vaf"),
        (F.col("population_af") > t.max_population_af, "germline_common"),
        (F.col("ccf") < t.min_ccf, "subclonal"),
        (F.col("tpm").isNull() & F.lit(t.require_rna), "no_expression_data"),
        (F.col("tpm") < t.min_tpm, "not_expressed"),
        (F.col("rna_vaf") < t.min_rna_vaf, "allele_not_expressed"),
    ]
    for broken, reason in reversed(rules):
        out = F.when(broken, F.lit(reason)).otherwise(out)
    return out


def expression_lookup(variants: DataFrame, by_transcript: DataFrame, by_gene: DataFrame) -> DataFrame:
    """Adds tpm: by transcript, else by gene.  The two tables are keyed (transcript, tpm) and (gene, tpm)."""
    t = by_transcript.select(F.col("transcript").alias("_transcript"), F.col("tpm").alias("_by_transcript"))
    g = by_gene.select(F.col("gene").alias("_gene"), F.col("tpm").alias("_by_gene"))
    joined = variants.join(t, F.col("transcript") == F.col("_transcript"), "left").join(g, F.col("gene") == F.col("_gene"), "left")
    return joined.withColumn("tpm", F.coalesce("_by_transcript", "_by_gene")).drop("_transcript", "_by_transcript", "_gene", "_by_gene")


def expression_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (line, transcript, gene, tpm): the last value of each transcript and the largest of each gene."""
    rows = rows.where("tpm is not null")
    by_transcript = rows.where("transcript is not null").groupBy("transcript").agg(F.max_by("tpm", "line").alias("tpm"))
    return by_transcript, rows.where("gene is not null").groupBy("gene").agg(F.max("tpm").alias("tpm"))


def annotated(variants: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Variants with ccf and reason (null: kept)."""
    return variants.withColumn("ccf", ccf(F.col("dna_vaf"), F.col("copies"), t.purity)).withColumn("reason", drop_reason(t))


def reason_counts(frame: DataFrame) -> DataFrame:
    """Variants by drop reason; kept ones count as 'kept'."""
    return frame.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def consequence_class(terms: Column) -> Column:
    """Class of the first term that changes a protein, else 'other'; terms are joined by ``&``."""
    known = F.filter(F.split(terms, "&"), lambda t: t.isin(*CODING))
    classes = F.create_map(*[F.lit(x) for item in CODING.items() for x in item])
    return F.coalesce(F.try_element_at(classes, F.try_element_at(known, F.lit(1))), F.lit("other"))


def failure_counts(frame: DataFrame) -> DataFrame:
    """Variants by every drop reason, also those that none broke."""
    every = F.explode(F.array(*[F.lit(r) for r in REASONS])).alias("reason")
    names = frame.sparkSession.range(1).select(every)
    counted = frame.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return names.join(counted, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def _integer(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("int"))


def protein_span(text: Column) -> tuple[Column, Column]:
    """First and last residue of ``12``, ``12-14`` or ``12-14/300``; null without a readable first one, and the last is never before the first."""
    part = F.split(F.substring_index(text, "/", 1), "-")
    start, end = _integer(part[0]), _integer(F.get(part, 1))
    return start, F.when(start.isNotNull(), F.greatest(start, F.coalesce(end, start)))


def residue_change(text: Column) -> tuple[Column, Column]:
    """Residues before and after of ``R/A``; ``-`` stands for none, and one side alone for both."""
    text = F.coalesce(text, F.lit(""))
    side = lambda s: F.when(s == "-", F.lit("")).otherwise(s)
    before = F.substring_index(text, "/", 1)
    return side(before), F.when(text.contains("/"), side(F.regexp_replace(text, "^[^/]*/", ""))).otherwise(side(text))


def novel_tail(whole: Column | None, tail: Column | None, length_change: Column | None, start: Column) -> tuple[Column, Column]:
    """A frameshift's tail, and the change of length that belongs to it.

    ``whole`` is the whole new protein, of which the tail begins at ``start``; its length
    change is not known.  Without it ``tail`` counts, with ``length_change``.  Empty texts and
    ``-`` are missing; so are columns that an annotation lacks (None).
    """
    stated = lambda c: F.lit(None).cast("string") if c is None else F.when(~F.trim(c).isin("", "-"), F.trim(c))
    own, other = stated(whole), stated(tail)
    cut = F.substring(own, start, F.length(own))
    change = F.lit(None).cast("int") if length_change is None else _integer(length_change)
    return F.when(own.isNotNull(), F.when(cut != "", cut)).otherwise(other), F.when(own.isNull() & other.isNotNull(), change)
