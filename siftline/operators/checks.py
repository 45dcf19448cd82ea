"""Rules that rows must keep, counted in the pass that uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.residues import ALPHABET

Rules = dict[str, Column]


def variant_rules() -> Rules:
    """Of variants with protein_start and protein_end: the span does not run backwards."""
    return {"span_backwards": F.col("protein_end") < F.col("protein_start")}


def candidate_rules(shortest: int = 8, longest: int = 15) -> Rules:
    """Of peptides with peptide, wildtype (or null), position and flanks: sizes, letters and a consistent register."""
    size = F.length("peptide")
    odd = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(f"^[{ALPHABET}]*$")
    return {
        "length_outside": (size < shortest) | (size > longest),
        "unknown_residue": odd("peptide") | odd("wildtype") | odd("n_flank") | odd("c_flank"),
        "position_outside": (F.col("position") < 1) | (F.col("position") > size),
        "register_differs": F.length("wildtype") != size,
        "wildtype_identical": F.col("wildtype") == F.col("peptide"),
    }


def broken(rules: Rules) -> Column:
    """The names of the rules that a row breaks, in the order of the rules; what is missing breaks none."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())


def observed(frame: DataFrame, rules: Rules, label: str = "checks") -> tuple[DataFrame, Observation]:
    """The rows with ``broken``, and counts of all rows and of each rule, taken while the rows are next used.

    ``Observation.get`` has them after one action on the returned frame; no second pass is made.
    """
    seen = Observation(label)
    counted = [F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()]
    return frame.observe(seen, F.count(F.lit(1)).alias("rows"), *counted).withColumn("broken", broken(rules)), seen


def rule_counts(frame: DataFrame, rules: Rules) -> DataFrame:
    """(rule, n) of every rule, also of those that no row breaks."""
    sums = frame.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    pairs = ", ".join(f"'{name}', {name}" for name in rules)
    return sums.select(F.expr(f"stack({len(rules)}, {pairs}) as (rule, n)"))
