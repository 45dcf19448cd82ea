"""From positions on a sequence to positions in coding sequences, and what a change does downstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.residues import translate_codons

#: Width of the bins in which positions meet spans.
BIN = 16_384
#: Rows up to which a side of a join is sent to all tasks; it is counted, as the planner's guess leaves out what is made of a row.
MOST_ROWS = 100_000
#: Spans or results that a task sorts, however small they are when compressed.
TASK_ROWS = 250_000


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(F.upper(bases), "ACGT", "TGCA"))


def sized(side: DataFrame) -> DataFrame:
    """A side of a join, sent to all tasks only if its rows are few."""
    return side.hint("broadcast" if side.count() <= MOST_ROWS else "merge")


def tasks(frame: DataFrame) -> int:
    """Tasks of TASK_ROWS rows each, but no fewer than the session's."""
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-frame.count() // TASK_ROWS))


def span_offsets(spans: DataFrame) -> DataFrame:
    """Adds ``before``: the coding bases of a transcript's spans ahead of each, in the direction of its strand.

    ``spans`` has transcript, start, end (both included) and strand (``-`` or else forward).
    """
    ahead = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    order = W.partitionBy("transcript").orderBy(ahead).rowsBetween(W.unboundedPreceding, -1)
    return spans.repartition(tasks(spans), "transcript").withColumn("before", F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(order), F.lit(0)))


def coding_positions(variants: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """Variants in each coding span that holds their whole ``ref``: transcript, strand, cds_pos (from 0), and ref and alt in coding direction.

    ``variants`` has sequence, pos (from 1), ref and alt, ``spans`` sequence and the columns
    of ``span_offsets``.  Both meet in bins of the sequence, so no position is compared
    with a span far away.
    """
    bins = F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))
    binned = spans.where("start <= end").select("sequence", "transcript", "start", "end", "strand", "before", F.explode(bins).alias("_bin"))
    met = variants.withColumn("_bin", F.expr(f"pos div {width}")).join(sized(binned), ["sequence", "_bin"])
    stop = F.col("pos") + F.length("ref") - 1
    inside = met.where((F.col("pos") >= F.col("start")) & (stop <= F.col("end")))
    back = F.col("strand") == "-"
    at = F.col("before") + F.when(back, F.col("end") - stop).otherwise(F.col("pos") - F.col("start"))
    turned = {c: F.when(back, reverse_complement(F.col(c))).otherwise(F.col(c)) for c in ("ref", "alt")}
    return inside.withColumn("cds_pos", at).withColumns(turned).drop("_bin", "start", "end", "before")


def apply_indel(cds: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """The sequence with ``ref`` at ``pos`` (from 0) replaced by ``alt``, whatever stood there."""
    pos = pos.cast("int")
    return F.concat(F.substring(cds, F.lit(1), pos), alt, F.substring(cds, pos + F.length(ref) + 1, F.length(cds)))


def downstream(cds: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """start_offset, the first changed codon, and peptide, all residues from there to the first stop (kept as ``*``)."""
    first = F.floor(pos / 3).cast("int")
    peptide = translate_codons(F.substring(apply_indel(cds, pos, ref, alt), first * 3 + 1, F.length(cds) + F.length(alt)))
    return F.struct(first.cast("long").alias("start_offset"), peptide.alias("peptide"))


def recomputed(variants: DataFrame, transcripts: DataFrame, spans: DataFrame) -> DataFrame:
    """(variant_id, downstream_peptide, start_offset) from variants by coding position.

    ``transcripts`` has transcript and seq; the coding sequence is what follows the
    transcript's first coding base.  Variants of unknown transcripts are left out.
    """
    starts = spans.groupBy("transcript").agg(F.min("start").alias("_start"))
    coding = transcripts.join(starts, "transcript").select("transcript", F.substring(F.col("seq"), F.col("_start").cast("int"), F.length("seq")).alias("_cds"))
    made = variants.join(coding, "transcript").withColumn("_made", downstream(F.col("_cds"), F.col("cds_pos"), F.col("ref"), F.col("alt")))
    return made.select("variant_id", F.col("_made.peptide").alias("downstream_peptide"), F.col("_made.start_offset").alias("start_offset"))


def drift(reported: DataFrame, found: DataFrame) -> DataFrame:
    """Each reported variant with verdict: equal, offset_drift (and by how much), peptide_differs or not_recomputed."""
    own = found.select("variant_id", F.col("downstream_peptide").alias("_peptide"), F.col("start_offset").alias("_offset"))
    joined = reported.join(own, "variant_id", "left").withColumn("drift", F.col("start_offset") - F.col("_offset"))
    verdict = (
        F.when(F.col("_offset").isNull(), "not_recomputed")
        .when(F.coalesce(F.col("drift") != 0, F.lit(True)), "offset_drift")
        .when(F.col("downstream_peptide") != F.col("_peptide"), "peptide_differs")
        .otherwise("equal")
    )
    return joined.withColumn("verdict", verdict).drop("_peptide", "_offset")
