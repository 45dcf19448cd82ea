"""Whole runs: variants to a ranked table, rankings to an evaluation and its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, peptides, permutation, ranking, statistics, variants
from ..sources.shared import stored


@dataclass(frozen=True)
class Ranked:
    """The ranked table, all scored candidates, and every variant with its drop reason (null: kept)."""

    table: DataFrame
    scored: DataFrame
    judged: DataFrame


def _expression(rows: DataFrame, tables: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    return rows.withColumn("tpm", F.lit(None).cast("double")) if tables is None else variants.expression_lookup(rows, *tables)


def rank(
    changes: DataFrame, proteins: DataFrame, alleles: list[str], *, expression: tuple[DataFrame, DataFrame] | None = None, normal: tuple[DataFrame, DataFrame] | None = None,
    predict: ranking.Predictor | str = "null", thresholds: variants.Thresholds = variants.Thresholds(), lengths: tuple[int, ...] = peptides.LENGTHS, max_percentile: float = 2.0,
    min_presentation: float = 0.0, normal_ceiling: float | None = None, nearest: bool = False, top_n: int = 20, cap: int = 2, shift_cap: int = 6, include_failed: bool = False, sample_id: str = "", run_id: str = "",
) -> Ranked:
    """From annotated variants to the shortlist.

    ``changes``: the columns of ``vcf.read_vcf``; rna_vaf and copy_number may be missing.  ``proteins``:
    protein, transcript, symbol and seq; they are the reference of the self matches as well.  ``expression`` and
    ``normal`` are the two tables of ``variants.expression_tables``.  Variants that break a rule make no
    peptides; exact self matches are looked up for presentable peptides only, ``nearest`` also asks for the most
    similar ones.
    """
    missing = [F.lit(None).cast("double").alias(c) for c in ("rna_vaf", "copy_number") if c not in changes.columns]
    named = changes.select("*", *missing).withColumns({"depth": F.col("tumor_depth"), "copies": F.col("copy_number"), "variant": F.concat_ws(":", "chrom", "pos", "ref", "alt", "transcript")})
    judged = stored(variants.annotated(_expression(named, expression), thresholds))
    built = peptides.mutant_proteins(peptides.with_protein(judged.where("reason is null"), proteins))
    told = built.withColumn("hgvsp", ranking.change_text(F.col("gene"), F.col("variant_class"), F.col("protein_start"), F.col("protein_end"), F.col("aa_ref"), F.col("aa_alt")))
    found = stored(peptides.peptides(told, "variant", lengths))
    calls = ranking.predicted(ranking.distinct_peptides(found), alleles, predict)
    scanned = ranking.self_scanned(found, calls, proteins, "protein" if nearest else None, max_percentile, min_presentation)
    rows = ranking.with_predictions(scanned, calls)
    base = rows.withColumnRenamed("tpm", "_tpm")
    rows = _expression(base, normal).withColumnRenamed("tpm", "normal_tpm").withColumnRenamed("_tpm", "tpm")
    scored = stored(ranking.featured(rows, max_percentile, min_presentation, normal_ceiling))
    return Ranked(ranking.ranked_table(ranking.ranked(scored, top_n, cap, shift_cap, include_failed), sample_id, run_id), scored, judged)


def evaluate(labels: DataFrame, rankings: DataFrame, k: int = 20, rounds: int = 1000, baseline: str | None = None) -> dict[str, DataFrame]:
    """How well each method finds the positives, by name of the result; each is one row a method.

    ``labels``: key (unique), label (1, 0 or null) and stratum.  ``rankings``: method, key, score.  Results:
    coverage, retrieval (recall and precision), significance (exact tail at k, ties against the method), ordering
    (AUC with its permutation p, AUC within strata with its interval), and paired against ``baseline`` if it is named.
    """
    usable = labels.where("label is not null").select("key", "label", "stratum")
    pool = stored(evaluation.labelled(rankings.where("score is not null").select("method", "key", "score"), usable))
    ranks = evaluation.ranks(pool, ["method"])
    hits = lambda n: F.sum(F.when(F.col("rank") <= n, F.col("label")).otherwise(0)).cast("long")
    retrieval = ranks.groupBy("method").agg(
        F.sum("label").cast("long").alias("positives"), hits(10).alias("hits_10"), hits(20).alias("hits_20"), F.try_divide(hits(10), F.sum("label")).alias("recall_10"), F.try_divide(hits(20), F.sum("label")).alias("recall_20"),
        F.try_divide(hits(10), F.count_if(F.col("rank") <= 10)).alias("precision_10"), F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("best_rank"),
    )
    at = evaluation.at_k(pool.withColumn("_tie", F.struct("label", "key")), k, F.col("_tie").asc())
    significance = at.select("method", "hits", (F.col("depth") * F.col("positives") / F.col("pool")).alias("expected"), statistics.hypergeometric_tail("hits", "depth", "positives", "pool").alias("p"))
    ordering = permutation.permutation_p(pool, ["method"], rounds)
    strata = evaluation.stratified_auc(pool).withColumnRenamed("auc", "stratified_auc")
    intervals = permutation.bootstrap_interval(pool, ["method"]).select("method", "low", "high")
    out = {
        "coverage": evaluation.method_coverage(labels, rankings), "retrieval": retrieval, "significance": significance,
        "ordering": ordering.join(strata, "method", "left").join(intervals, "method", "left"),
    }
    if baseline is not None:
        base = pool.where(F.col("method") == baseline).select("key", F.col("score").alias("score_b"))
        both = pool.where(F.col("method") != baseline).select("method", "key", F.col("score").alias("score_a"), "label").join(base, "key")
        out["paired"] = permutation.paired_comparison(both, ["method"], k, rounds)
    return out


def benchmark(runs: dict[str, Ranked], labels: DataFrame, k: int = 20, rounds: int = 1000, baseline: str | None = None) -> dict[str, DataFrame]:
    """``evaluate`` of the candidates of several runs (by method), all of them ranked by score; keys are ``peptide|allele``, each with its best score."""
    long = None
    for method, run in runs.items():
        rows = run.scored.groupBy(F.concat_ws("|", "peptide", "allele").alias("key")).agg(F.max("score").alias("score")).withColumn("method", F.lit(method))
        long = rows if long is None else long.unionByName(rows)
    return evaluate(labels, long, k, rounds, baseline)


# Titles of the report's parts.
TITLES = {"coverage": "Labels", "retrieval": "Retrieval", "significance": "Against chance", "ordering": "Ordering quality", "paired": "Paired against the baseline"}


def _cell(value: object) -> str:
    return "n/a" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value).replace("|", "\\|")


def report(results: dict[str, DataFrame], inputs: list[dict] = ()) -> str:
    """A markdown report of ``evaluate``: one table a result, with a row a method; ``inputs`` are those of a manifest."""
    lines = ["# Ranking evaluation", ""]
    if inputs:
        lines += ["## Inputs", "", "| path | digest |", "| --- | --- |", *[f"| `{_cell(i['path'])}` | `{i['digest']}` |" for i in inputs], ""]
    for name, frame in results.items():
        columns = frame.columns
        rows = sorted(tuple(r) for r in frame.collect())
        lines += [f"## {TITLES[name]}", "", f"| {' | '.join(columns)} |", "|" + " --- |" * len(columns), *[f"| {' | '.join(map(_cell, r))} |" for r in rows], ""]
    return "\n".join(lines)
