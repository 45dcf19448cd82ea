"""Features, the explicit logistic model, gates, baseline rankers and shortlists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.residues import clip

# Weights of the logistic model.
WEIGHTS = {
    "presentation": 2.5, "clonality": 1.5, "expression": 1.2, "agretopicity": 0.5, "tumor_selectivity": 0.4,
    "self_dissimilarity": 0.25, "wt_dissimilarity": 0.15, "mutation_exposure": 0.1, "hydrophobicity": 0.0,
}
BIAS = -3.0
NEUTRAL = 0.5


def expression_feature(tpm: Column) -> Column:
    return F.coalesce(clip(F.log10(F.greatest(tpm, F.lit(0.0)) + 1) / 2.5), F.lit(NEUTRAL))


def selectivity_feature(normal_tpm: Column) -> Column:
    return F.when(normal_tpm.isNull(), F.lit(NEUTRAL)).otherwise(1 - expression_feature(normal_tpm))


def presentation_feature(score: Column, percentile: Column, nanomolar: Column) -> Column:
    """The first of: the score, a transform of the percentile, one of the affinity; 0 without any."""
    by_rank = clip(1 - F.log10(F.greatest(percentile, F.lit(0.01)) + 1) / 2)
    by_affinity = clip(1 - (F.log10(F.greatest(nanomolar, F.lit(1.0))) - 1) / 3)
    return F.when(score.isNotNull(), clip(score)).when(percentile.isNotNull(), by_rank).when(nanomolar.isNotNull(), by_affinity).otherwise(F.lit(0.0))


def agretopicity(mutant_nm: Column, wildtype_nm: Column) -> Column:
    """Wild-type over mutant affinity; null unless both are positive."""
    return F.when((mutant_nm > 0) & (wildtype_nm > 0), wildtype_nm / mutant_nm)


def agretopicity_feature(ratio: Column) -> Column:
    return F.when(ratio.isNull(), F.lit(NEUTRAL)).when(ratio <= 0, F.lit(0.0)).otherwise(clip(F.log10(ratio) / 2 + 0.5))


def dissimilarity_feature(similarity: Column) -> Column:
    return F.coalesce(clip(1 - similarity), F.lit(NEUTRAL))


def logit(features: dict[str, Column], weights: dict[str, float] | None = None, bias: float = BIAS) -> Column:
    out = F.lit(bias)
    for name, weight in (WEIGHTS if weights is None else weights).items():
        if name in features:
            out = out + features[name] * F.lit(weight)
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def contributions(scored: DataFrame, id_column: str, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per row and feature column: id, feature, value, contribution."""
    weights = WEIGHTS if weights is None else weights
    names = [n for n in weights if n in scored.columns]
    pairs = ", ".join(f"'{n}', {n}, {weights[n]!r}D" for n in names)
    long = scored.select(id_column, F.expr(f"stack({len(names)}, {pairs}) as (feature, value, weight)"))
    return long.select(id_column, "feature", "value", (F.col("value") * F.col("weight")).alias("contribution"))


def gates(percentile: Column, score: Column, is_self: Column, normal_tpm: Column, max_percentile: float = 2.0, min_score: float = 0.0, ceiling: float | None = None) -> Column:
    """Failed gates in order.  The self match counts only where no earlier gate failed."""
    early = F.array_compact(F.array(F.when(percentile > max_percentile, F.lit("weak_binder")), F.when(score < min_score, F.lit("low_presentation"))))
    late = F.array_compact(
        F.array(
            F.when((F.size(early) == 0) & is_self, F.lit("self_peptide")),
            F.when(F.lit(ceiling is not None) & (normal_tpm > F.lit(ceiling or 0.0)), F.lit("normal_tissue_expressed")),
        )
    )
    return F.concat(early, late)


def hash_unit(key: Column) -> Column:
    """A number in 0..1 from the first eight bytes of a SHA-256 digest."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def null_prediction(peptide: Column, allele: Column) -> dict[str, Column]:
    """A deterministic stand-in for a presentation predictor."""
    u = hash_unit(F.concat(peptide, F.lit("|"), allele))
    return {"presentation_score": u, "affinity_nm": F.pow(F.lit(10.0), 1 + 4 * (1 - u)), "affinity_percentile": 100 * (1 - u) * (1 - u)}


#: Baseline rankers by name: from the columns percentile, nanomolar, presentation, expression and id to a score.
RANKERS: dict[str, Callable[[], Column]] = {
    "binding_only": lambda: F.coalesce(-F.col("percentile"), -F.col("nanomolar"), F.lit(float("-inf"))),
    "presentation_only": lambda: F.coalesce("presentation", F.lit(0.0)),
    "expression_only": lambda: F.coalesce("expression", F.lit(0.0)),
    "arbitrary": lambda: hash_unit(F.concat(F.lit("siftline:"), F.col("id"))),
}

def shortlist(scored: DataFrame, key: str, order: list[Column], top_n: int, cap: Column) -> DataFrame:
    """The best rows with at most ``cap`` of each key, top_n in all, with their rank.

    ``cap`` may differ between rows of one key: they share one counter, and a row
    that is skipped does not count.  Rows of one key with the same cap are settled
    by their place in the key; a key is never larger than its cap after that, so
    the final order sorts few rows.
    """
    capped = scored.withColumn("_cap", cap)
    place = F.row_number().over(W.partitionBy(key, "_cap").orderBy(*order))
    near = capped.withColumn("_place", place).where(F.col("_place") <= F.col("_cap"))
    # What is left of a key is at most the sum of its caps; now the shared counter decides.
    mixed = near.groupBy(key).agg(F.count_distinct("_cap").alias("_caps"), F.min("_cap").alias("_least"))
    joined = near.join(mixed, key)
    ahead = F.row_number().over(W.partitionBy(key).orderBy(*order))
    kept = _shared_caps(joined.withColumn("_ahead", ahead), key, order)
    return kept.orderBy(*order).limit(top_n).withColumn("rank", F.row_number().over(W.orderBy(*order))).drop("_cap", "_place", "_caps", "_least", "_ahead", "_members", "_taken")


def _shared_caps(near: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Apply the shared counter to keys that mix caps, over their few rows in order."""
    caps = F.array_sort(F.collect_list(F.struct("_ahead", "_cap")).over(W.partitionBy(key)))
    step = lambda acc, m: F.when(F.size(acc) < m["_cap"], F.concat(acc, F.array(m["_ahead"]))).otherwise(acc)
    taken = F.aggregate("_members", F.array().cast("array<int>"), step)
    return near.withColumn("_members", caps).withColumn("_taken", taken).where(F.array_contains("_taken", F.col("_ahead")))


def acquisition(score: Column, exploration: Column, exploitation: float = 0.6) -> Column:
    return exploitation * score + (1 - exploitation) * exploration


def outcome_uncertainty(score: Column) -> Column:
    return 1 - 2 * F.abs(score - 0.5)
