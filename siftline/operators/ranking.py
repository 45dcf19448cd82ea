"""From peptides to a ranked shortlist: predictions, features, gates and caps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.residues import hydropathy, mutation_exposure, substitution_dissimilarity
from ..sources.shared import stored
from . import matching, scoring

#: A predictor: from peptide and allele to columns presentation_score, affinity_nm and affinity_percentile.
Predictor = Callable[[Column, Column], dict[str, Column]]
#: Predictors by name; others can be added.
PREDICTORS: dict[str, Predictor] = {"null": scoring.null_prediction}
#: Best rows that are looked up for self matches first, and most that are held apart for it.
FIRST_BLOCK = 1_000
MOST_BLOCK = 1_100_000
# Columns of the ranked table, in order.
RANKED = (
    "rank", "run_id", "sample_id", "gene", "hgvsp", "transcript", "variant", "variant_class", "mutant_peptide", "wildtype_peptide", "length", "mutation_position",
    "allele", "score", "presentation_score", "affinity_nm", "affinity_percentile", "wt_affinity_nm", "agretopicity", "ccf", "dna_vaf", "tpm", "rna_vaf", "normal_tpm",
    "gate_failures",
)


def distinct_peptides(candidates: DataFrame) -> DataFrame:
    """peptide, n_flank and c_flank of all mutant and wild-type peptides, each once; flanks of a mutant one first, then by text."""
    side = lambda c, kind: candidates.where(f"{c} is not null").select(F.col(c).alias("peptide"), F.struct(F.lit(kind).alias("kind"), "n_flank", "c_flank").alias("at"))
    best = side("peptide", 0).unionByName(side("wildtype", 1)).groupBy("peptide").agg(F.min("at").alias("at"))
    return best.select("peptide", "at.n_flank", "at.c_flank")


def predicted(peptides: DataFrame, alleles: list[str], predict: Predictor | str = "null") -> DataFrame:
    """peptide, allele and the predictor's columns; a sample has a handful of alleles, so they are an array of constants."""
    predict = PREDICTORS[predict] if isinstance(predict, str) else predict
    paired = peptides.select("peptide", F.explode(F.array(*[F.lit(a) for a in dict.fromkeys(alleles)])).alias("allele"))
    return paired.select("peptide", "allele", *[c.alias(name) for name, c in predict(F.col("peptide"), F.col("allele")).items()])


def with_predictions(candidates: DataFrame, calls: DataFrame, usable: Column | None = None) -> DataFrame:
    """Candidates by allele with the call of the mutant peptide, and wt_affinity_nm of the wild type where it has one.

    A candidate without any call is left out, and so is one whose call is not ``usable`` if that is given.
    """
    wild = calls.select(F.col("peptide").alias("wildtype"), "allele", F.col("affinity_nm").alias("wt_affinity_nm"))
    own = calls if usable is None else calls.where(usable)
    return candidates.join(own.hint("merge"), "peptide").join(wild.hint("merge"), ["wildtype", "allele"], "left")


def called(candidates: DataFrame, alleles: list[str], predict: Predictor | str = "null", usable: Column | None = None) -> DataFrame:
    """What ``with_predictions`` makes of the candidates and their ``predicted`` peptides, computed in each row.

    A predictor that is a cheap expression costs less than a peptide's way to its call, and no
    row is shuffled.
    """
    predict = PREDICTORS[predict] if isinstance(predict, str) else predict
    paired = candidates.select("*", F.explode(F.array(*[F.lit(a) for a in dict.fromkeys(alleles)])).alias("allele"))
    calls = predict(F.col("peptide"), F.col("allele"))
    # As a generated row a call is made once; a filter on plain columns would be moved ahead and make it again for each measure.
    paired = paired.withColumns(calls).select(*paired.columns, F.inline(F.array(F.struct(*calls))))
    wild = F.when(F.col("wildtype").isNotNull(), predict(F.col("wildtype"), F.col("allele"))["affinity_nm"])
    return (paired if usable is None else paired.where(usable)).withColumn("wt_affinity_nm", wild)


def presented(max_percentile: float = 2.0, min_presentation: float = 0.0) -> Column:
    """Whether a call fails no gate on its own; missing measures rule nothing out."""
    return F.coalesce(F.col("affinity_percentile") <= max_percentile, F.lit(True)) & F.coalesce(F.col("presentation_score") >= min_presentation, F.lit(True))


def presentable(calls: DataFrame, max_percentile: float = 2.0, min_presentation: float = 0.0) -> DataFrame:
    """(peptide): those that some allele is predicted to present; missing measures rule nothing out."""
    return calls.where(presented(max_percentile, min_presentation)).select("peptide").distinct()


def self_scanned(candidates: DataFrame, calls: DataFrame | None, reference: DataFrame, nearest_by: str | None = None, max_percentile: float = 2.0, min_presentation: float = 0.0) -> DataFrame:
    """Adds is_self, and self_similarity where ``nearest_by`` names the reference's id column (else null).

    Only presentable mutant peptides are looked up (all, without ``calls``); others are not self and have
    no similarity.
    """
    own = candidates.select("peptide").distinct()
    wanted = own if calls is None else own.join(presentable(calls, max_percentile, min_presentation).hint("merge"), "peptide", "left_semi")
    exact = matching.self_matches(wanted, reference).withColumn("_self", F.lit(True))
    out = candidates.join(exact.hint("merge"), "peptide", "left").withColumn("is_self", F.coalesce("_self", F.lit(False))).drop("_self")
    if nearest_by is None:
        return out.withColumn("self_similarity", F.lit(None).cast("double"))
    return out.join(matching.nearest_similarity(wanted, reference, nearest_by).withColumnRenamed("similarity", "self_similarity").hint("merge"), "peptide", "left")


def featured(rows: DataFrame, max_percentile: float = 2.0, min_presentation: float = 0.0, normal_ceiling: float | None = None) -> DataFrame:
    """Adds the nine scored features, agretopicity_raw, wt_dissimilarity_raw, self_match, wildtype_missing, gate_failures and score.

    ``rows`` has a candidate's columns with those of its calls, ccf, tpm, normal_tpm,
    self_similarity and is_self, all of which may be null.  Missing measures give the
    neutral value.
    """
    ratio = scoring.agretopicity(F.col("affinity_nm"), F.col("wt_affinity_nm"))
    apart = substitution_dissimilarity(F.col("peptide"), F.col("wildtype"))
    neutral = F.lit(scoring.NEUTRAL)
    failed = scoring.gates(F.col("affinity_percentile"), F.col("presentation_score"), F.coalesce("is_self", F.lit(False)), F.col("normal_tpm"), max_percentile, min_presentation, normal_ceiling)
    out = rows.withColumns(
        {
            "clonality": F.coalesce("ccf", neutral),
            "expression": scoring.expression_feature(F.col("tpm")),
            "presentation": scoring.presentation_feature(F.col("presentation_score"), F.col("affinity_percentile"), F.col("affinity_nm")),
            "agretopicity": scoring.agretopicity_feature(ratio),
            "tumor_selectivity": scoring.selectivity_feature(F.col("normal_tpm")),
            "mutation_exposure": mutation_exposure(F.col("position"), F.length("peptide")),
            "hydrophobicity": hydropathy(F.col("peptide")),
            "wt_dissimilarity": F.coalesce(apart, neutral),
            "self_dissimilarity": scoring.dissimilarity_feature(F.col("self_similarity")),
            "agretopicity_raw": ratio,
            "wt_dissimilarity_raw": apart,
            "wildtype_missing": (F.col("wildtype").isNull() | ratio.isNull()).cast("double"),
            "gate_failures": failed,
        }
    )
    out = out.withColumn("self_match", F.array_contains("gate_failures", "self_peptide").cast("double"))
    # A feature without weight adds nothing, so what needs the score alone need not make it.
    return out.withColumn("score", scoring.sigmoid(scoring.logit({n: F.col(n) for n, weight in scoring.WEIGHTS.items() if weight})))


def ranked(scored: DataFrame, top_n: int = 20, cap: int = 2, shift_cap: int = 6, include_failed: bool = False) -> DataFrame:
    """The shortlist with its rank: best scores first, at most ``cap`` peptides of a variant, ``shift_cap`` of a frameshift."""
    eligible = scored if include_failed else scored.where(F.size("gate_failures") == 0)
    limit = F.when(F.col("variant_class") == "frameshift", F.lit(shift_cap)).otherwise(F.lit(cap))
    return scoring.shortlist(eligible, "variant", best_first(), top_n, limit)


def best_first() -> list[Column]:
    """The order of the shortlist."""
    return [F.desc("score"), F.asc("variant"), F.asc("transcript"), F.asc("peptide"), F.asc("allele")]


def ranked_unscanned(rows: DataFrame, reference: DataFrame, top_n: int = 20, cap: int = 2, shift_cap: int = 6, first: int = FIRST_BLOCK, most: int = MOST_BLOCK) -> DataFrame:
    """``ranked`` over the ``featured`` and ``self_scanned`` rows, where only the best rows are looked up in the reference.

    A self match fails a row and changes no score, and the caps are taken best first: once
    the best rows, less their self matches, fill the shortlist, no later row can enter it.
    Until they do, or are all rows, larger blocks follow; beyond ``most`` all rows are looked up.
    """
    blank = {"is_self": F.lit(False), "self_similarity": F.lit(None).cast("double")}
    # The order needs the score alone; the other features are made of the few rows that are left.
    scored = featured(rows.withColumns(blank)).where(F.size("gate_failures") == 0).select(*rows.columns, "score")
    size = max(first, top_n)
    while size <= most:
        best = stored(scored.orderBy(*best_first()).limit(size))
        found = stored(ranked(featured(self_scanned(best, None, reference)), top_n, cap, shift_cap))
        if found.count() == top_n or best.count() < size:
            return found
        size *= 32
    return ranked(featured(self_scanned(scored, None, reference)), top_n, cap, shift_cap)


def change_text(gene: Column, kind: Column, start: Column, end: Column, ref: Column, alt: Column) -> Column:
    """Gene and short text of a protein change; ``ref`` and ``alt`` are empty for none."""
    span = F.when(end > start, F.concat_ws("_", start.cast("string"), end.cast("string"))).otherwise(start.cast("string"))
    tail = F.when(kind == "frameshift", F.concat(ref, span, F.lit("fs"))).when(ref == "", F.concat(span, F.lit("ins"), alt)).otherwise(F.concat(ref, span, F.when(alt == "", F.lit("del")).otherwise(alt)))
    return F.concat(gene, F.lit(" p."), tail)


def ranked_table(ranking: DataFrame, sample_id: str, run_id: str = "") -> DataFrame:
    """The 25 columns of the ranked table."""
    renamed = {
        "run_id": F.lit(run_id), "sample_id": F.lit(sample_id), "mutant_peptide": F.col("peptide"), "wildtype_peptide": F.col("wildtype"), "length": F.length("peptide").cast("long"),
        "mutation_position": F.col("position").cast("long"), "score": F.round("score", 6), "agretopicity": F.col("agretopicity_raw"), "gate_failures": F.array_join("gate_failures", ";"),
        "rank": F.col("rank").cast("long"),
    }
    return ranking.select(*[renamed.get(c, F.col(c)).alias(c) for c in RANKED])


def with_gated(shortlist: DataFrame, scored: DataFrame, keys: list[str], order: list[Column], top_n: int) -> DataFrame:
    """The shortlist, then the best ``top_n`` rows that failed a gate and are not in it; these have no rank.

    ``shortlist`` has rank and the columns of ``scored``; both have gate_failures.
    """
    failed = scored.where(F.size("gate_failures") > 0).join(shortlist.select(*keys), keys, "left_anti")
    return shortlist.unionByName(failed.orderBy(*order).limit(top_n).withColumn("rank", F.lit(None).cast("int")), allowMissingColumns=True)


def assay_request(ranking: DataFrame, assay: str = "IFNG_ELISPOT") -> DataFrame:
    """A sheet for the laboratory from ranked rows (sample_id, peptide, allele, rank, score); what it fills in is empty."""
    blank = [F.lit("").alias(c) for c in ("call", "effect_size", "replicate_count", "run_date", "operator", "notes")]
    return ranking.select("sample_id", "peptide", "allele", F.lit(assay).alias("assay"), *blank, F.col("rank").alias("predicted_rank"), F.col("score").alias("predicted_score"))
