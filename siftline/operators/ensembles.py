"""Logistic models fitted to many weighted copies of one table, all in the same passes.

A copy is a column of multiplicities: a row counts as often as its entry in the
array ``times``.  Bootstrap resamples and the training sides of cross-validation
are both such copies.  Each Newton pass reads the rows once, and every task sums
gradients and Hessians of all copies; only those sums, whose size depends on the
number of copies and features, come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .evaluation import rank_auc

BUCKETS = 64
#: Copies of one fit, at most, and numbers (rows x copies) that a task holds at a time.
MOST_COPIES = 2_000
HELD = 1_000_000
#: Significant digits of the class counts by which groups are dealt to folds.
DIGITS = 2


def numbered(items: DataFrame, within: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Adds a gapless number from 0 within ``within``, by a hash of ``order``, whose values are unique there.

    A key's rows are spread over buckets, so no key is numbered in one task.
    """
    dealt = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    inner = F.row_number().over(W.partitionBy(*within, "_bucket").orderBy(F.xxhash64(*order, F.lit(1)), *order))
    sizes = dealt.groupBy(*within, "_bucket").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(W.partitionBy(*within).orderBy("_bucket")) - F.col("_size")
    starts = sizes.withColumn("_start", before).drop("_size")
    out = dealt.withColumn("_inner", inner).join(starts, [*within, "_bucket"])
    return out.withColumn(name, (F.col("_start") + F.col("_inner") - 1).cast("long")).drop("_bucket", "_inner", "_start")


def multiplicities(groups: DataFrame, group: str, rounds: int, seed: int = 0) -> DataFrame:
    """(group, times): how often each distinct group is drawn in each of ``rounds`` resamples with replacement.

    Every resample draws as many groups as there are.  Draws come from a hash of the
    seed and their number, so they do not depend on tasks.
    """
    known = numbered(groups.select(group).distinct().withColumn("_all", F.lit(0)), ["_all"], [group]).drop("_all")
    n = known.count()
    drawn = groups.sparkSession.range(rounds * n).select(F.expr(f"id div {max(n, 1)}").alias("round"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("number"))
    counts = drawn.groupBy("number", "round").agg(F.count("*").cast("int").alias("n"))
    maps = counts.groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("round", "n"))).alias("drawn"))  # one entry a round at most
    every = F.sequence(F.lit(0), F.lit(rounds - 1)) if rounds else F.array().cast("array<int>")
    times = F.transform(every, lambda i: F.coalesce(F.try_element_at("drawn", i.cast("long")), F.lit(0)))
    return known.join(maps, "number", "left").select(group, times.alias("times"))


def _summed(rows: DataFrame, per_batch: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], copies: int) -> np.ndarray:
    """Sums over all rows of ``per_batch(x, y, times)``, an array with one row for each copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        step = max(1, HELD // copies)
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            x, times = (np.reshape(batch.column(i).flatten().to_numpy(zero_copy_only=False), (batch.num_rows, -1)) for i in (0, 2))
            part = per_batch(np.c_[x, np.ones(len(x))], batch.column(1).to_numpy().astype(float), times.astype(float))
            total = part if total is None else total + part
        if total is not None:
            at = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "value"])

    sums = rows.select("x", "y", "times").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(sums))
    for row in sums:
        out[row["at"]] = row["value"]
    return out.reshape(copies, -1)


def fit_copies(rows: DataFrame, names: list[str], copies: int, c: float = 0.3, passes: int = 50, tolerance: float = 1e-9) -> list[np.ndarray | None]:
    """Weights, then the bias, of an L2 logistic model with balanced classes for each copy; null for one that lacks a class.

    ``rows`` has label (0 or 1), the columns ``names`` and times, an array of ``copies``
    counts.  The bias is not shrunk; ``c`` is the weight of the losses against the
    squared weights.
    """
    if copies > MOST_COPIES:
        raise ValueError(f"{copies} copies are too many for one fit; at most {MOST_COPIES}")
    data = rows.select(F.array(*[F.col(n).cast("double") for n in names]).alias("x"), F.col("label").cast("int").alias("y"), "times").persist()
    try:
        counts = _summed(data, lambda x, y, times: np.stack([times.T @ (1 - y), times.T @ y], 1), copies)
        if not counts.size:
            return [None] * copies
        usable = (counts > 0).all(1)
        safe = np.where(counts > 0, counts, 1)
        balance = counts.sum(1)[:, None] / (2 * safe)
        k = len(names) + 1
        penalty = np.r_[np.ones(k - 1), 0.0]
        weights, last, step, best = np.zeros((copies, k)), None, np.zeros((copies, k)), np.full(copies, np.inf)
        for _ in range(passes):

            def sums(x: np.ndarray, y: np.ndarray, times: np.ndarray, weights: np.ndarray = weights) -> np.ndarray:
                eta = x @ weights.T
                p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                w = times * np.where(y[:, None] == 1, balance[:, 1], balance[:, 0])
                loss = (w * (np.logaddexp(0, eta) - y[:, None] * eta)).sum(0)
                pairs = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                return np.c_[loss, (w * (p - y[:, None])).T @ x, (w * p * (1 - p)).T @ pairs]

            total = _summed(data, sums, copies)
            value = c * total[:, 0] + (penalty * weights**2).sum(1) / 2
            worse = value > best + 1e-9 * np.abs(best) if last is not None else np.zeros(copies, bool)
            gradient = c * total[:, 1 : k + 1] + penalty * weights
            hessian = c * total[:, k + 1 :].reshape(copies, k, k) + np.diag(penalty) + 1e-12 * np.eye(k)
            newton = np.zeros((copies, k))
            newton[usable] = np.linalg.solve(hessian[usable], gradient[usable][:, :, None])[:, :, 0]
            step = np.where(worse[:, None], step / 2, newton)
            last = np.where(worse[:, None], last if last is not None else weights, weights)
            best = np.where(worse, best, value)
            weights = last - step
            if np.abs(step[usable]).max(initial=0.0) < tolerance:
                break
        return [w if ok else None for w, ok in zip(weights, usable, strict=True)]
    finally:
        data.unpersist()


def bootstrap_ensemble(rows: DataFrame, names: list[str], group: str, key: str, rounds: int = 200, c: float = 0.3, seed: int = 0) -> DataFrame:
    """(member, name, weight): models of resamples of whole groups, ``bias`` among the names.

    With a single group its rows are resampled instead, by their unique ``key``; the
    spread then describes that group alone.  Resamples that lack a class are left out, so
    fewer than ``rounds`` members may come back.
    """
    unit = group if rows.select(group).distinct().limit(2).count() > 1 else key
    drawn = rows.join(multiplicities(rows, unit, rounds, seed), unit)
    fitted = fit_copies(drawn, names, rounds, c)
    flat = [(i, n, float(w)) for i, found in enumerate(fitted) if found is not None for n, w in zip([*names, "bias"], found, strict=True)]
    return rows.sparkSession.createDataFrame(flat, "member int, name string, weight double")


def member_scores(ensemble: DataFrame, names: list[str]) -> Column:
    """The scores of a row under each member, an array; ``ensemble`` is one of ``bootstrap_ensemble``, whose size is bounded."""
    members: dict[int, dict[str, float]] = {}
    for row in ensemble.collect():
        members.setdefault(row["member"], {})[row["name"]] = row["weight"]
    logits = [sum((F.col(n) * F.lit(m[n]) for n in names), F.lit(m["bias"])) for _, m in sorted(members.items())]
    return F.transform(F.array(*logits) if logits else F.array().cast("array<double>"), lambda z: 1 / (1 + F.exp(-z)))


def weight_uncertainty(scores: Column) -> Column:
    """min(1, sample deviation / 0.5) of an array of scores; 0 with fewer than two."""

    def spread(own: Column, mean: Column) -> Column:
        squares = F.aggregate(own, F.lit(0.0), lambda a, s: a + (s - mean) * (s - mean))
        return F.when(F.size(own) < 2, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.sqrt(squares / (F.size(own) - 1)) / 0.5))

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), use)[0]

    # A lambda's argument is computed once, where a column would be computed again for each score.
    return once(scores, lambda own: once(F.aggregate(own, F.lit(0.0), lambda a, s: a + s) / F.size(own), lambda mean: spread(own, mean)))


def _deal(profiles: list[tuple[int, float, float]], folds: int) -> list[list[int]]:
    """For each profile (groups, positives and negatives of one) the folds in the order in which they take its groups.

    Full turns give every fold the same; the groups left over go one by one to the
    fold that leaves the class counts of all folds closest to each other.
    """
    load = np.zeros((folds, 2))
    totals = np.maximum(np.array([[n * p, n * q] for n, p, q in profiles]).sum(0), 1) if profiles else np.ones(2)
    out = []
    for n, positive, negative in profiles:
        each = np.array([positive, negative]) / totals
        load += (n // folds) * each
        order: list[int] = []
        for _ in range(n % folds):
            tries = []
            for f in (f for f in range(folds) if f not in order):
                load[f] += each
                tries.append((round(float(load.std(0).sum()), 12), round(float(load[f].sum()), 12), f))
                load[f] -= each
            chosen = min(tries)[2]
            load[chosen] += each
            order.append(chosen)
        out.append(order + [f for f in range(folds) if f not in order])
    return out


def balanced_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Adds ``fold``: whole groups go to folds so that both classes are spread evenly.

    Groups with about the same numbers of positives and negatives (two significant
    digits, so the profiles are few whatever the number of groups) are dealt in turn,
    the most uneven profiles first; the rest of each goes to the folds with the least.
    Null groups are a group.
    """
    own = F.coalesce(F.col(group).cast("string"), F.lit("\0"))
    labelled = rows.withColumn("_group", own)
    sizes = labelled.groupBy("_group").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum(1 - F.col("label").cast("long")).alias("q"))
    rounded = lambda c: F.when(F.col(c) == 0, 0).otherwise(F.round(F.col(c) / F.pow(10.0, F.floor(F.log10(F.col(c))) - DIGITS + 1)) * F.pow(10.0, F.floor(F.log10(F.col(c))) - DIGITS + 1)).cast("long")
    sizes = sizes.withColumns({"_p": rounded("p"), "_q": rounded("q")})
    found = sizes.groupBy("_p", "_q").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("q").alias("q")).collect()
    found.sort(key=lambda r: (-abs(r["p"] - r["q"]), -(r["p"] + r["q"]), r["_p"], r["_q"]))
    orders = _deal([(r["n"], r["p"], r["q"]) for r in found], folds)
    spark = rows.sparkSession
    plan = spark.createDataFrame([(r["_p"], r["_q"], o) for r, o in zip(found, orders, strict=True)], "_p long, _q long, _order array<int>")
    placed = numbered(sizes, ["_p", "_q"], ["_group"], "_number").join(F.broadcast(plan), ["_p", "_q"])
    fold = F.get("_order", F.pmod(F.col("_number"), F.lit(folds)))
    return labelled.join(placed.select("_group", fold.alias("fold")), "_group").drop("_group")


def cross_validated(rows: DataFrame, names: list[str], group: str, c: float = 0.3, folds: int = 5, least_groups: int = 3) -> DataFrame:
    """(fold, auc) of models that saw none of the fold's groups; no row with fewer groups than ``least_groups``.

    All folds are fitted in the same passes.  A fold lacking a class on either side has
    no row.  ``rows`` has label and the columns ``names``.
    """
    spark = rows.sparkSession
    many = rows.select(group).distinct().limit(max(folds, least_groups)).count()
    folds = min(folds, many)
    if many < least_groups:
        return spark.createDataFrame([], "fold int, auc double")
    dealt = balanced_folds(rows, group, folds).persist()
    times = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: (f != F.col("fold")).cast("int"))
    fitted = fit_copies(dealt.withColumn("times", times), names, folds, c)
    score = F.lit(None).cast("double")
    for f, w in enumerate(fitted):
        if w is not None:
            score = F.when(F.col("fold") == f, sum((F.col(n) * float(v) for n, v in zip(names, w[:-1], strict=True)), F.lit(float(w[-1])))).otherwise(score)
    held = dealt.select("fold", score.alias("score"), "label").where("score is not null")
    return rank_auc(held, ["fold"]).where("auc is not null").select("fold", "auc")


def cross_validation_report(rows: DataFrame, names: list[str], group: str, c: float = 0.3, folds: int = 5, least_groups: int = 3) -> DataFrame:
    """One row: the mean held-out auc (null if no fold has one), the folds it is over, the number of groups and the scheme."""
    tested = cross_validated(rows, names, group, c, folds, least_groups).agg(F.avg("auc").alias("auc"), F.count("*").alias("folds"))
    groups = rows.select(F.count_distinct(group).alias("groups"))
    scheme = F.when(F.col("folds") == 0, "none").otherwise(F.format_string("grouped %d-fold", "folds"))
    return tested.join(F.broadcast(groups)).withColumn("scheme", scheme)
