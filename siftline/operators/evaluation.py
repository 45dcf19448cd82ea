"""Evaluating rankings over labelled pools.

Rankings are long tables (method, key, score), labels (key, label, stratum).  Ranks
and running sums over a whole pool never sort it in one task: rows go to ranges of
the score, each range is summed alone, and the ranges' totals give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RANGES = 32


def running_before(frame: DataFrame, order: str, value: str, groups: list[str]) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over rows of the group with a smaller ``order``.

    ``order`` must be unique within a group.
    """
    cuts = frame.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []
    bucket = F.lit(0)
    for cut in sorted(set(cuts)):
        bucket = bucket + F.when(F.col(order) > cut, 1).otherwise(0)
    dealt = frame.withColumn("_range", bucket)
    inner = F.sum(value).over(W.partitionBy(*groups, "_range").orderBy(order)) - F.col(value)
    totals = dealt.groupBy(*groups, "_range").agg(F.sum(value).alias("_total"))
    offset = F.coalesce(F.sum("_total").over(W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.withColumn("_offset", offset).drop("_total")
    return dealt.withColumn("_inner", inner).join(offsets, [*groups, "_range"]).withColumn("before", F.col("_inner") + F.col("_offset")).drop("_range", "_inner", "_offset")


def labelled(rankings: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranked rows with a label; rows without one are neither positive nor negative."""
    return rankings.join(labels.where("label is not null"), "key")


def shared_pool(rankings: DataFrame, methods: int) -> DataFrame:
    """Rankings restricted to the keys that every method ranks."""
    everywhere = rankings.groupBy("key").agg(F.count_distinct("method").alias("m")).where(F.col("m") == methods).select("key")
    return rankings.join(everywhere, "key", "left_semi")


def at_k(pool: DataFrame, k: int, ties: Column | None = None) -> DataFrame:
    """Per method: pool size, positives, hits among the k best and their rate.

    Equal scores go by ``ties``, by default the key ascending.  Each task finds its
    own k best of a method first, so a method's pool is not sorted as one.
    """
    order = [F.desc("score"), F.col("key") if ties is None else ties]
    spread = F.pmod(F.xxhash64("key"), F.lit(64))
    first = F.row_number().over(W.partitionBy("method", spread).orderBy(*order))
    near = pool.withColumn("_first", first).where(F.col("_first") <= k)
    top = near.withColumn("_place", F.row_number().over(W.partitionBy("method").orderBy(*order))).where(F.col("_place") <= k)
    hits = top.groupBy("method").agg(F.sum("label").alias("hits"), F.count("*").alias("depth"), F.min(F.when(F.col("label") == 1, F.col("_place"))).alias("best_rank_in_k"))
    sizes = pool.groupBy("method").agg(F.count("*").alias("pool"), F.sum("label").alias("positives"))
    return sizes.join(hits, "method").select("method", "pool", "positives", "depth", "hits", (F.col("hits") / F.col("depth")).alias("rate"), "best_rank_in_k")


def compare(pool: DataFrame, k: int, baseline: str) -> DataFrame:
    """at_k with the baseline's rate and the lift over it (null if that rate is 0)."""
    rows = at_k(pool, k)
    base = rows.where(F.col("method") == baseline).select(F.col("rate").alias("baseline_rate"))
    joined = rows.join(F.broadcast(base), how="left")
    return joined.withColumn("lift", F.try_divide("rate", "baseline_rate"))


def by_score(pool: DataFrame, groups: list[str]) -> DataFrame:
    """Positives and negatives at each score."""
    return pool.groupBy(*groups, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def rank_auc(pool: DataFrame, groups: list[str]) -> DataFrame:
    """Per group the chance that a positive outranks a negative, ties half; null if a class is empty."""
    counted = running_before(by_score(pool, groups), "score", "neg", groups)
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return counted.groupBy(*groups).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.when(pairs > 0, wins / pairs).alias("auc"), wins.alias("wins"))


def stratified_auc(pool: DataFrame) -> DataFrame:
    """Per method the wins and pairs summed within strata; strata of one class drop out."""
    each = rank_auc(pool, ["method", "stratum"]).where("auc is not null")
    return each.groupBy("method").agg(F.count("*").alias("strata"), (F.sum("wins") / F.sum(F.col("positives") * F.col("negatives"))).alias("auc"))


def enrichment(features: DataFrame) -> DataFrame:
    """Per feature the mean over positives and over negatives, and their counts."""
    mean = lambda y: F.avg(F.when(F.col("label") == y, F.col("value")))
    count = lambda y: F.count(F.when(F.col("label") == y, F.col("value")))
    return features.groupBy("feature").agg(mean(1).alias("mean_positive"), mean(0).alias("mean_negative"), count(1).alias("n_positive"), count(0).alias("n_negative"))


def ranks(pool: DataFrame, groups: list[str]) -> DataFrame:
    """Adds ``rank``: place by descending score, equal scores by key, without sorting a group in one task."""
    sizes = pool.groupBy(*groups, "score").agg(F.count("*").alias("n")).withColumn("_down", -F.col("score"))
    ahead = running_before(sizes, "_down", "n", groups).select(*groups, "score", F.col("before").alias("_ahead"))
    tie = F.row_number().over(W.partitionBy(*groups, "score").orderBy("key"))
    return pool.withColumn("_tie", tie).join(ahead, [*groups, "score"]).withColumn("rank", (F.col("_ahead") + F.col("_tie")).cast("long")).drop("_ahead", "_tie")


def recall_curve(pool: DataFrame) -> DataFrame:
    """Per method and depth at which the score changes: positives found, and those expected by chance."""
    steps = by_score(pool, ["method"]).withColumn("n", F.col("pos") + F.col("neg")).withColumn("_down", -F.col("score"))
    found = running_before(steps, "_down", "pos", ["method"]).withColumnRenamed("before", "_found")
    deep = running_before(found, "_down", "n", ["method"])
    totals = pool.groupBy("method").agg(F.sum("label").alias("_p"), F.count("*").alias("_n"))
    depth = F.col("before") + F.col("n")
    return deep.join(F.broadcast(totals), "method").select("method", depth.cast("long").alias("depth"), (F.col("_found") + F.col("pos")).cast("long").alias("found"), (F.col("_p") * depth / F.col("_n")).alias("chance"))


def coverage(labelled: DataFrame, ranking: DataFrame, by: str) -> DataFrame:
    """Per group: usable labels, those that the ranking scores and leaves out, and positives; ``labelled`` has key and label."""
    scored = ranking.where("score is not null").select("key", F.lit(1).alias("_scored")).distinct()
    usable = labelled.where("label is not null").join(scored, "key", "left")
    counts = usable.groupBy(by).agg(F.count("*").alias("usable"), F.count("_scored").alias("scored"), F.sum("label").cast("long").alias("positives"))
    return counts.select(by, "usable", "scored", (F.col("usable") - F.col("scored")).alias("unscored"), "positives")


def facets(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column and distinct value of it, with its number of rows."""
    pairs = ", ".join(f"'{c}', cast({c} as string)" for c in columns)
    long = frame.select(F.expr(f"stack({len(columns)}, {pairs}) as (facet, value)"))
    return long.where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def key_overlap(assayed: DataFrame, rankings: DataFrame) -> DataFrame:
    """(method, keys, shared): distinct keys of each ranking (method, key), and how many were assayed (key).

    A ranking that shares none would give an empty figure; ``shared`` tells before one is drawn.
    Null keys are left out.
    """
    known = assayed.select("key").where("key is not null").distinct().withColumn("_known", F.lit(True))
    own = rankings.select("method", "key").where("key is not null").distinct()
    return own.join(known, "key", "left").groupBy("method").agg(F.count("*").alias("keys"), F.count("_known").alias("shared"))


def method_coverage(labels: DataFrame, rankings: DataFrame) -> DataFrame:
    """Per method: labels in the file, usable ones, those that it scores and leaves out, positives and positives scored.

    ``labels`` has key (unique) and label (null: not usable), ``rankings`` method, key and score.
    """
    totals = labels.agg(F.count("*").alias("labels"), F.count("label").alias("usable"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("positives"))
    own = rankings.where("score is not null").select("method", "key").distinct()
    met = own.join(labels.where("label is not null"), "key", "left").groupBy("method").agg(F.count("label").alias("scored"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("positives_scored"))
    return met.join(F.broadcast(totals), how="left").select("method", "labels", "usable", "scored", (F.col("usable") - F.col("scored")).alias("unscored"), "positives", "positives_scored")
