"""Checking published claims of peptides against a proteome, and retired gene symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import protein_change
from ..functions.residues import is_valid
from .matching import with_isoform
from .peptides import mutant_proteins, window_starts


def usable_aliases(aliases: DataFrame, symbols: DataFrame) -> DataFrame:
    """The aliases (old, new) that lead to a known symbol and do not hide one; of several of one name the first new one by name."""
    known = symbols.select("symbol").distinct().hint("merge")
    fits = aliases.join(known, F.col("new") == F.col("symbol"), "left_semi").join(known, F.col("old") == F.col("symbol"), "left_anti")
    return fits.groupBy("old").agg(F.min("new").alias("new"))


def retired_symbols(wanted: DataFrame, table: DataFrame, symbols: DataFrame) -> DataFrame:
    """(old, new): wanted symbols that are unknown now, with the approved known symbol that had them before.

    ``table``: place, symbol, status, prev_symbol and alias_symbol, the last two with
    names between bars.  The row that comes first by place wins, earlier symbols go
    before aliases, then the first in the list.
    """
    known = symbols.select("symbol").distinct()
    unknown = wanted.where("symbol <> ''").select("symbol").distinct().join(known, "symbol", "left_anti").withColumnRenamed("symbol", "old")
    approved = table.withColumn("new", F.trim("symbol")).where("trim(status) = 'Approved'").join(known.withColumnRenamed("symbol", "new"), "new", "left_semi")
    names = lambda c: F.split(F.regexp_replace(F.coalesce(c, F.lit("")), '^"+|"+$', ""), r"\|")
    listed = approved.select("place", "new", F.posexplode(F.concat(names("prev_symbol"), names("alias_symbol"))).alias("at", "name"))
    found = listed.withColumn("old", F.trim("name")).join(unknown, "old", "left_semi")
    return found.groupBy("old").agg(F.min_by("new", F.struct("place", "at")).alias("new"))


def reconcile(claims: DataFrame, isoforms: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(claim_id, transcript, verdict): whether a claimed peptide follows from the claimed change.

    ``claims``: claim_id (unique), gene, protein_change, peptide, downstream (null or
    empty for none).  ``isoforms``: symbol, transcript (unique), seq, primary.
    ``aliases``: old, new.  Verdicts, by the first that applies: unparseable_change,
    tail_required (a frameshift without its tail), gene_not_found,
    no_consistent_isoform, derivable, peptide_not_generated.  A gene that is known by
    an alias only and has no fitting isoform is gene_not_found.  A null gene is not
    found; a null or empty peptide is not generated.
    """
    c = F.col("change")
    # As a generated row the change is parsed once, not again in every expression that uses it.
    # So is the gene, or what its look-up asks for would be filtered far below, apart for each use of the claims.
    parsed = F.inline(F.array(F.struct("gene", protein_change(F.col("protein_change")).alias("change"))))
    early = F.when(c.isNull(), "unparseable_change").when((c["kind"] == "frameshift") & (F.coalesce("downstream", F.lit("")) == ""), "tail_required")
    read = claims.select("claim_id", "peptide", "downstream", parsed).withColumn("_early", early)
    # What is judged by its text alone meets nothing; a claim that is looked up goes along whole.
    told = read.where("_early is not null").select("claim_id", F.lit(None).cast(isoforms.schema["transcript"].dataType).alias("transcript"), F.col("_early").alias("verdict"))
    placed = with_isoform(read.where("_early is null").drop("_early"), isoforms, None if aliases is None else usable_aliases(aliases, isoforms))
    # Residues that a change does not name are those of the isoform.
    stated = F.when(c["ref"] != "", c["ref"]).otherwise(F.substring(F.col("seq"), c["start"], c["end"] - c["start"] + 1))
    shift = c["kind"] == "frameshift"
    variant = placed.withColumns(
        {
            "variant_class": F.when(shift, "frameshift").when(c["kind"] == "missense", "missense").when(c["kind"] == "insertion", "inframe_insertion").otherwise("inframe_deletion"),
            "protein_start": c["start"], "protein_end": c["end"], "aa_ref": stated, "aa_alt": c["alt"], "release": F.lit(None).cast("int"), "length_change": F.lit(None).cast("int"),
        }
    )
    out = mutant_proteins(variant).withColumns({"first": F.col("first").cast("int"), "last": F.col("last").cast("int")})
    size = F.length("peptide")
    starts = window_starts(F.length("mutant"), F.col("first"), F.col("last"), size, F.col("variant_class") == "frameshift")
    made = (size > 0) & is_valid(F.col("peptide")) & F.exists(starts, lambda s: F.substring(F.col("mutant"), s + 1, size) == F.col("peptide"))
    verdict = (
        F.when(F.col("transcript").isNull(), F.when(F.col("known"), "no_consistent_isoform").otherwise("gene_not_found"))
        .when(F.col("mutant").isNull(), "no_consistent_isoform")
        .when(F.coalesce(made, F.lit(False)), "derivable")
        .otherwise("peptide_not_generated")
    )
    return out.select("claim_id", "transcript", verdict.alias("verdict")).unionByName(told)


# Columns of the verdict table, in order.
VERDICT = ("peptide", "gene", "protein_change", "source", "verdict", "transcript", "detail")
DETAILS = {
    "unparseable_change": "the change cannot be read", "tail_required": "a frameshift needs its novel tail", "gene_not_found": "no isoform of this gene",
    "no_consistent_isoform": "no isoform has the stated residues", "derivable": "the peptide covers the change", "peptide_not_generated": "the changed isoform has no such peptide over the change",
}


def verdict_table(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The columns of the verdict table: each claim (claim_id, peptide, gene, protein_change, source) with its verdict from ``reconcile``."""
    detail = F.coalesce(*[F.when(F.col("verdict") == k, F.lit(v)) for k, v in DETAILS.items()])
    return claims.join(verdicts, "claim_id").withColumn("detail", detail).select(*VERDICT)


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """(verdict, n), also of verdicts that no claim has."""
    sums = verdicts.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in DETAILS])
    return sums.select(F.expr(f"stack({len(DETAILS)}, {', '.join(f"'{v}', {v}" for v in DETAILS)}) as (verdict, n)"))
