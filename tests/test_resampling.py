"""Ensembles, folds, permutation tests and intervals against numpy and enumeration."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import ensembles, evaluation, learning, permutation


def newton(x, y, times, c):
    """The same model by plain Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    n, k = times.sum(), np.array([(times * (y == 0)).sum(), (times * (y == 1)).sum()])
    w, mask = np.zeros(x.shape[1]), np.r_[np.ones(x.shape[1] - 1), 0]
    each = times * (n / (2 * k))[y]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        h = c * (x.T * (each * p * (1 - p))) @ x + np.diag(mask)
        w -= np.linalg.solve(h, c * x.T @ (each * (p - y)) + mask * w)
    return w


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2))
    y = (x[:, 0] + rng.normal(size=240) > 0.4).astype(int)
    rows = [(i, i % 12, float(a), float(b), int(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "key int, g int, a double, b double, label int").cache(), x, y


def test_copies_equal_numpy(table):
    rows, x, y = table
    times = F.array(F.lit(1), F.col("key") % 3, F.when(F.col("label") == 1, 0).otherwise(1), (F.col("g") < 4).cast("int") * 2)
    got = ensembles.fit_copies(rows.withColumn("times", times), ["a", "b"], 4)
    keys, groups = np.arange(240), np.arange(240) % 12
    for found, counts in ((got[0], np.ones(240)), (got[1], keys % 3), (got[3], (groups < 4) * 2)):
        assert found == pytest.approx(newton(x, y, counts, 0.3), abs=1e-6)
    assert got[2] is None  # one class only
    fitted = learning.refit(rows, ["a", "b"])
    assert [fitted["a"], fitted["b"], fitted["bias"]] == pytest.approx(got[0].tolist(), abs=1e-3)


def test_separable_classes_converge(spark):
    rows = spark.createDataFrame([(float(i), int(i > 20), [1]) for i in range(40)], "x double, label int, times array<int>")
    assert np.isfinite(ensembles.fit_copies(rows, ["x"], 1)[0]).all()
    assert ensembles.fit_copies(rows.where("x < 0"), ["x"], 1) == [None]
    with pytest.raises(ValueError, match="too many"):
        ensembles.fit_copies(rows, ["x"], ensembles.MOST_COPIES + 1)


def test_resamples_draw_whole_groups(spark):
    groups = spark.range(50).select(F.concat(F.lit("g"), F.col("id") % 7).alias("g"))
    drawn = {r.g: r.times for r in ensembles.multiplicities(groups, "g", 30, 1).collect()}
    assert len(drawn) == 7 and all(sum(t[i] for t in drawn.values()) == 7 for i in range(30))
    assert len({tuple(t[i] for t in drawn.values()) for i in range(30)}) > 20
    assert drawn == {r.g: r.times for r in ensembles.multiplicities(groups.repartition(5), "g", 30, 1).collect()}


def test_ensemble_disagrees_and_feeds_the_spread(spark, table):
    rows, _, _ = table
    members = ensembles.bootstrap_ensemble(rows, ["a", "b"], "g", "key", 25).cache()
    assert members.count() == 75 and members.where("name = 'a'").select(F.round("weight", 6)).distinct().count() > 20
    scored = rows.select("key", ensembles.member_scores(members, ["a", "b"]).alias("scores"))
    spread = {r.key: r.spread for r in scored.select("key", ensembles.weight_uncertainty(F.col("scores")).alias("spread")).collect()}
    long = {r.key: r.spread for r in learning.ensemble_spread(scored.select("key", F.explode("scores").alias("score")), "key").collect()}
    assert spread == pytest.approx(long, abs=1e-12) and max(spread.values()) > 0
    alone = ensembles.bootstrap_ensemble(rows.withColumn("g", F.lit(1)), ["a", "b"], "g", "key", 10)
    assert alone.where("name = 'a'").select(F.round("weight", 6)).distinct().count() > 5  # rows are drawn instead
    one = spark.range(1).select(ensembles.weight_uncertainty(F.array(F.lit(0.3))).alias("a"), ensembles.weight_uncertainty(F.array(F.lit(0.0), F.lit(1.0))).alias("b")).first()
    assert (one.a, one.b) == (0.0, 1.0)


def test_numbers_have_no_gaps(spark):
    frame = spark.range(1000).selectExpr("id", "if(id < 900, 0, id % 3) as k")
    got = ensembles.numbered(frame, ["k"], ["id"]).groupBy("k").agg(F.collect_list("number").alias("n")).collect()
    assert all(sorted(r.n) == list(range(len(r.n))) for r in got)


def test_folds_are_balanced(spark):
    pure = spark.createDataFrame([(g, float(g % 2) + i / 40, g % 2) for g in range(12) for i in range(20)], "g int, x double, label int")
    tested = ensembles.cross_validated(pure, ["x"], "g").collect()
    assert sorted(r.fold for r in tested) == [0, 1, 2, 3, 4]
    rng = random.Random(1)
    rows = [(g, 0.0, int(rng.random() < g % 5 / 5)) for g in range(300) for _ in range(rng.choice([1, 2, 30]))]
    dealt = ensembles.balanced_folds(spark.createDataFrame([*rows, (None, 0.0, 1)], "g int, x double, label int"), "g", 5).collect()
    assert len(dealt) == len(rows) + 1
    folds = Counter((r.fold, r.label) for r in dealt)
    for label in (0, 1):
        sizes = [folds[f, label] for f in range(5)]
        assert max(sizes) - min(sizes) <= 30
    by_group = {}
    assert all(by_group.setdefault(r.g, r.fold) == r.fold for r in dealt)


def test_one_huge_group_stays_whole(spark):
    rows = spark.createDataFrame([(g, float(i % 5), i % 2) for g, n in ((0, 400), (1, 20), (2, 20), (3, 20)) for i in range(n)], "g int, x double, label int")
    dealt = ensembles.balanced_folds(rows, "g", 4).groupBy("fold").agg(F.collect_set("g").alias("g")).collect()
    assert sorted(len(r.g) for r in dealt) == [1, 1, 1, 1]


def test_cross_validation_report(spark):
    rows = spark.createDataFrame([(i % 9, float(i % 2) * 3 + i % 4, i % 2) for i in range(180)], "g int, x double, label int")
    got = ensembles.cross_validation_report(rows, ["x"], "g").first()
    each = [r.auc for r in ensembles.cross_validated(rows, ["x"], "g").collect()]
    assert got.auc == pytest.approx(np.mean(each)) and (got.folds, got.groups, got.scheme) == (5, 9, "grouped 5-fold")
    few = ensembles.cross_validation_report(rows.where("g < 2"), ["x"], "g").first()
    assert (few.auc, few.folds, few.scheme) == (None, 0, "none")


def auc(scores, labels):
    wins = [(p > n) + (p == n) / 2 for p, x in zip(scores, labels, strict=True) if x for n, y in zip(scores, labels, strict=True) if not y]
    return sum(wins) / len(wins)


def hits(scores, labels, k):
    return sum(y for _, y in sorted(zip(scores, labels, strict=True), key=lambda r: (-r[0], r[1]))[:k])


def arrangements(labels):
    n, k = len(labels), sum(labels)
    for chosen in itertools.combinations(range(n), k):
        yield [int(i in chosen) for i in range(n)]


@pytest.fixture(scope="module")
def tiny():
    rng = random.Random(8)
    out = {}
    for g in range(6):
        n = rng.randint(5, 11)
        out[g] = [(rng.randint(0, 6) / 2, rng.randint(0, 4) / 4, int(i < 3)) for i in range(n)]
    return out


def frame(spark, pools):
    return spark.createDataFrame([(g, *r) for g, rows in pools.items() for r in rows], "g int, score_a double, score_b double, label int")


def exact(rows, k=3):
    a, b, y = zip(*rows, strict=True)
    gap, hit = auc(a, y) - auc(b, y), hits(a, y, k) - hits(b, y, k)
    every = list(arrangements(y))
    far = sum(abs(auc(a, z) - auc(b, z)) >= abs(gap) - 1e-12 for z in every), sum(abs(hits(a, z, k) - hits(b, z, k)) >= abs(hit) for z in every)
    return auc(a, y), auc(b, y), far[0] / len(every), hits(a, y, k), hits(b, y, k), far[1] / len(every)


def test_paired_comparison_is_exact_on_small_pools(spark, tiny):
    for r in permutation.paired_comparison(frame(spark, tiny), ["g"], 3).collect():
        assert (r.auc_a, r.auc_b, r.auc_p, r.hits_a, r.hits_b, r.hits_p) == pytest.approx(exact(tiny[r.g]))
        assert (r.pool, r.positives, r.depth) == (len(tiny[r.g]), 3, 3)


def test_drawn_permutations_agree_with_enumeration(spark, tiny, monkeypatch):
    """Every pool is drawn, its cells in several blocks."""
    monkeypatch.setattr(permutation, "EXACT_ROWS", 0)
    monkeypatch.setattr(permutation, "BLOCK_CELLS", 3)
    for r in permutation.paired_comparison(frame(spark, tiny), ["g"], 3, 4000, 5).collect():
        want = exact(tiny[r.g])
        assert (r.auc_p, r.hits_p) == pytest.approx((want[2], want[5]), abs=0.04)
    single = frame(spark, tiny).select("g", F.col("score_a").alias("score"), "label")
    for r in permutation.permutation_p(single, ["g"], 4000, 5).collect():
        a, _, y = zip(*tiny[r.g], strict=True)
        every = list(arrangements(y))
        assert (r.auc, r.p) == pytest.approx((auc(a, y), sum(auc(a, z) >= auc(a, y) - 1e-12 for z in every) / len(every)), abs=0.04)


def test_identical_rankings_and_odd_pools(spark):
    rows = [(1, float(i), float(i), i % 2) for i in range(40)] + [(2, 1.0, 2.0, 1), (2, 2.0, 1.0, 1), (3, 1.0, None, 1), (3, 2.0, 1.0, None), (4, 5.0, 5.0, 0)]
    got = {r.g: r for r in permutation.paired_comparison(spark.createDataFrame(rows, "g int, score_a double, score_b double, label int"), ["g"], 10, 99).collect()}
    assert (got[1].auc_p, got[1].hits_p) == (1.0, 1.0) and sorted(got) == [1, 2, 4]
    assert (got[2].auc_a, got[2].auc_p, got[2].depth, got[2].hits_a) == (None, None, 2, 2)
    assert (got[4].positives, got[4].hits_a, got[4].auc_b) == (0, 0, None)


def test_permutation_p_finds_signal(spark):
    rows = spark.range(3000).selectExpr("'m' as method", "cast(id as double) as score", "cast(id % 7 = 0 or id > 2900 as int) as label")
    got = permutation.permutation_p(rows, ["method"], 200).first()
    assert got.auc == pytest.approx(evaluation.rank_auc(rows, ["method"]).first().auc) and got.p == pytest.approx(1 / 201)


@pytest.mark.parametrize("cells", [10_000, 7])
def test_bootstrap_interval(spark, monkeypatch, cells):
    monkeypatch.setattr(permutation, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(2)
    pools = {s: (rng.normal(size=60).round(1), (rng.random(60) < 0.4).astype(int)) for s in range(8)}
    pools = {s: (x + y * 0.8, y) for s, (x, y) in pools.items()}
    rows = [("m", s, float(x), int(y)) for s, (xs, ys) in pools.items() for x, y in zip(xs, ys, strict=True)] + [("m", 99, 1.0, 1), ("lone", 1, 1.0, 1), ("lone", 1, 0.0, 0)]
    got = {r.method: r for r in permutation.bootstrap_interval(spark.createDataFrame(rows, "method string, stratum int, score double, label int"), ["method"], 400, 3).collect()}
    values = []
    for _ in range(1500):
        wins = pairs = 0.0
        for s in rng.integers(0, 8, 8):
            at = rng.integers(0, 60, 60)
            x, y = pools[s][0][at], pools[s][1][at]
            d = x[y == 1][:, None] - x[y == 0][None, :]
            wins, pairs = wins + (d > 0).sum() + (d == 0).sum() / 2, pairs + d.size
        values.append(wins / pairs)
    assert (got["m"].low, got["m"].high) == pytest.approx(np.percentile(values, [2.5, 97.5]), abs=0.02)
    assert got["m"].draws == 400 and got["lone"].low is None
