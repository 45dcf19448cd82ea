"""Exact tails, tests, multiple-testing correction and power."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .evaluation import running_before


def upper_tail(hits: int, drawn: int, positives: int, pool: int) -> float:
    """P(at least so many hits) when drawing without replacement, in whole numbers."""
    ways = sum(math.comb(positives, h) * math.comb(pool - positives, drawn - h) for h in range(max(hits, 0), min(drawn, positives) + 1) if drawn - h <= pool - positives)
    return ways / math.comb(pool, drawn)


@F.pandas_udf(T.DoubleType())
def hypergeometric_tail(hits: pd.Series, drawn: pd.Series, positives: pd.Series, pool: pd.Series) -> pd.Series:
    return pd.Series([upper_tail(*map(int, row)) for row in zip(hits, drawn, positives, pool, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


def design_capacity(designs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(drawn, positives, pool) with hits_needed: the fewest hits that reach ``alpha``; null if none does."""
    tries = designs.select("drawn", "positives", "pool", F.explode(F.sequence(F.lit(1), F.greatest(F.least("drawn", "positives"), F.lit(1)))).alias("hits"))
    tails = tries.withColumn("p", hypergeometric_tail("hits", "drawn", "positives", "pool"))
    return tails.groupBy("drawn", "positives", "pool").agg(F.min(F.when((F.col("p") <= alpha) & (F.col("hits") <= F.least("drawn", "positives")), F.col("hits"))).alias("hits_needed"), (F.first("drawn") * F.first("positives") / F.first("pool")).alias("expected_hits"))


def z_test(measurements: DataFrame) -> DataFrame:
    """Per feature the two-sided test of equal means of groups A and B with unit variance."""
    mean = lambda g: F.avg(F.when(F.col("group") == g, F.col("value")))
    count = lambda g: F.count(F.when(F.col("group") == g, F.col("value")))
    rows = measurements.groupBy("feature").agg(mean("A").alias("mean_a"), mean("B").alias("mean_b"), count("A").alias("n_a"), count("B").alias("n_b")).where("n_a > 0 and n_b > 0")
    z = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b"))
    return rows.withColumn("z", z).withColumn("p", erfc(F.abs("z") / math.sqrt(2)))


def corrected(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds rank, adjusted (step-up), and whether each test passes step-up, Bonferroni and uncorrected.

    ``tests`` has feature and p.  Ranks come from running sums over ranges of p.
    Tests with equal p share the last rank of their p, which changes no set.
    """
    m = tests.count()
    sizes = tests.groupBy("p").agg(F.count("*").alias("n"))
    ranked = running_before(sizes, "p", "n", []) if m else sizes.withColumn("before", F.lit(0))
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("n")).cast("long")).withColumn("raw", F.col("p") * m / F.col("rank"))
    adjusted = _smallest_from_here(ranked)
    joined = tests.join(adjusted.select("p", "rank", F.least("low", F.lit(1.0)).alias("adjusted")), "p")
    cut = ranked.where(F.col("raw") <= alpha).agg(F.max("p").alias("cut"))
    passes = joined.join(F.broadcast(cut))
    return passes.select("feature", "p", "rank", "adjusted", F.coalesce(F.col("p") <= F.col("cut"), F.lit(False)).alias("step_up"), (F.col("p") <= alpha / max(m, 1)).alias("bonferroni"), (F.col("p") < alpha).alias("uncorrected"))


def _smallest_from_here(ranked: DataFrame) -> DataFrame:
    """Adds ``low``: the smallest raw value at this p or a larger one, by ranges of p."""
    cuts = ranked.agg(F.percentile_approx("p", [i / 32 for i in range(1, 32)], 1000)).first()[0] or []
    bucket = F.lit(0)
    for cut in sorted(set(cuts)):
        bucket = bucket + F.when(F.col("p") > cut, 1).otherwise(0)
    dealt = ranked.withColumn("_range", bucket)
    inner = F.min("raw").over(W.partitionBy("_range").orderBy(F.desc("p")))
    lows = dealt.groupBy("_range").agg(F.min("raw").alias("_low"))
    later = lows.withColumn("_later", F.min("_low").over(W.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1))).drop("_low")
    return dealt.withColumn("_inner", inner).join(F.broadcast(later), "_range").withColumn("low", F.least("_inner", "_later")).drop("_range", "_inner", "_later")


def _law(n: int, population: int, successes: int, log_odds: float) -> tuple[np.ndarray, np.ndarray]:
    """Hits in a sample of n and their chances; neighbours' ratios are summed, so no table of the population is held."""
    k = np.arange(max(0, n - (population - successes)), min(n, successes) + 1)
    up = k[1:].astype(float)
    steps = np.log((successes - up + 1) * (n - up + 1)) - np.log(up * (population - successes - n + up)) + log_odds
    w = np.r_[0.0, np.cumsum(steps)]
    w = np.exp(w - w.max())
    return k, w / w.sum()


def power_curve(spark: SparkSession, population: int, successes: int, odds: float, alpha: float = 0.05, first: int = 1, last: int | None = None) -> DataFrame:
    """(n, critical, power) for sample sizes ``first`` to ``last`` (all, if null), under Fisher's noncentral hypergeometric law."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for n in batch["id"].tolist():
                k, null = _law(n, population, successes, 0.0)
                tail = np.cumsum(null[::-1])[::-1]
                ok = np.flatnonzero(tail <= alpha)
                _, shifted = _law(n, population, successes, math.log(odds))
                rows.append((n, int(k[ok[0]]) if len(ok) else None, float(shifted[ok[0] :].sum()) if len(ok) else 0.0))
            yield pd.DataFrame(rows, columns=["n", "critical", "power"]).astype({"critical": "Int64"})

    return spark.range(first, (last or population) + 1).mapInPandas(run, "n long, critical long, power double")


def least_sample(spark: SparkSession, population: int, successes: int, odds: float, target: float, alpha: float = 0.05) -> int | None:
    """The smallest n that reaches the target power, or null.

    Sizes are tried in blocks that double; the first block with one that reaches it holds
    the smallest, so large samples of a large population are not computed.
    """
    first, size = 1, 512
    while first <= population:
        last = min(population, first + size - 1)
        found = smallest_sample(power_curve(spark, population, successes, odds, alpha, first, last), target).first().min_n
        if found is not None:
            return found
        first, size = last + 1, 2 * size
    return None


def smallest_sample(curve: DataFrame, target: float) -> DataFrame:
    """The smallest n that reaches the target power; power is not monotone, so all are looked at."""
    return curve.where(F.col("power") >= target).agg(F.min("n").alias("min_n"))


def population_overlap(sample: DataFrame, population: DataFrame) -> DataFrame:
    """Sizes of population, group, sample and of the sample's part in the group."""
    distinct = population.groupBy("item").agg(F.max("in_group").alias("in_group"))
    joined = distinct.join(sample.select("item").distinct().withColumn("drawn", F.lit(1)), "item", "left")
    both = F.col("drawn").isNotNull()
    return joined.agg(F.count("*").alias("population"), F.count_if(F.col("in_group")).alias("grouped"), F.count_if(both).alias("sampled"), F.count_if(both & F.col("in_group")).alias("overlap"))




def screened(values: DataFrame, sheet: DataFrame) -> DataFrame:
    """The rows of ``values`` (feature) that the sample sheet (feature, role) lists with the role screen: spike-ins and unlisted ones go."""
    return values.join(sheet.where("trim(role) = 'screen'").select("feature"), "feature", "left_semi")
