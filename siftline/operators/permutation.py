"""Permutation tests and bootstrap intervals of rankings, without a pool on the driver or in one task.

Permuting labels moves them between rows whose scores stay.  Midranks do not depend
on labels, so an AUC, or the gap between two, is a sum over the positives of a whole
number that each row keeps.  Rows with the same number are one cell, and the
positives of a permutation are a multivariate hypergeometric draw from the cells:
first over blocks of cells, by a generator that all tasks seed alike, then in each
block alone; the blocks' sums are added.  Small pools are enumerated instead: each is
one list, and a task enumerates pools of equal size and positives side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..sources.shared import stored
from .ensembles import multiplicities
from .evaluation import running_before

#: Rows up to which a pool's label arrangements are enumerated: 12,870 at most.
EXACT_ROWS = 16
#: Cells of a block.
BLOCK_CELLS = 10_000
#: Large pools up to which their keys are sent to all tasks.
MOST_KEYS = 100_000
#: Sums of arrangements that a task holds at once.
SUMS = 1 << 20

Arrays = list[np.ndarray]


def placed(cells: DataFrame, groups: list[str], score: str) -> DataFrame:
    """(groups, score, rank, below, tied): twice the midrank of each score (1 for the lowest row), the rows below it and at it.

    ``cells`` has n, its rows.
    """
    sizes = cells.groupBy(*groups, score).agg(F.sum("n").alias("tied"))
    return running_before(sizes, score, "tied", groups).select(*groups, score, (2 * F.col("before") + F.col("tied") + 1).cast("long").alias("rank"), F.col("before").alias("below"), "tied")


def zone(pool: Column, below: Column, tied: Column, k: int) -> Column:
    """place (2 above the k-th best score, 1 tied with it, 0 below) and spare: the tied rows beyond the k best."""
    above, end = pool - below - tied, pool - below
    place = F.when(end <= k, 2).when(above >= k, 0).otherwise(1)
    return F.struct(place.alias("place"), F.when(place == 1, end - k).otherwise(0).cast("long").alias("spare"))


def _by_size(rows: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of pools of up to EXACT_ROWS rows and those of larger ones (None without any); rows that lack a group are left out."""
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    large = stored(rows.groupBy(*groups).agg(F.count("*").alias("_n")).where(F.col("_n") > EXACT_ROWS).select(*groups))
    n = large.count()
    if n == 0:
        return rows, None
    large = F.broadcast(large) if n <= MOST_KEYS else large.hint("merge")
    return rows.join(large, groups, "left_anti"), rows.join(large, groups, "left_semi")


@lru_cache(maxsize=None)
def _arrangements(n: int, positives: int) -> np.ndarray:
    """All arrangements of the positives among n rows, a column each."""
    chosen = np.array(list(combinations(range(n), positives)), np.int64)
    out = np.zeros((len(chosen), n), np.float32)
    np.put_along_axis(out, chosen, 1, 1)
    return out.T


def _as_far(parts: Arrays, spares: Arrays, value: Callable[[Arrays, Arrays], np.ndarray], labels: np.ndarray, two_sided: bool) -> tuple[np.ndarray, np.ndarray]:
    """The value of each pool, and the share of its arrangements whose value is as far.

    ``value`` takes the sums over the positives of each of ``parts`` (pools by rows) and the ``spares`` (one a pool).
    Single precision is exact for sums this small.
    """
    every = _arrangements(labels.shape[1], int(labels[0].sum()))
    seen = value([(p * labels).sum(1, keepdims=True) for p in parts], spares)
    share, step = np.empty(len(labels)), max(1, SUMS // every.shape[1])
    for at in range(0, len(labels), step):
        some = slice(at, at + step)
        made, own = value([p[some].astype(np.float32) @ every for p in parts], [x[some] for x in spares]), seen[some]
        share[some] = ((np.abs(made) >= np.abs(own)) if two_sided else (made >= own)).sum(1) / every.shape[1]
    return seen[:, 0], share


def _below_tied(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of its pool stand below each row, and at it."""
    return (codes[:, None, :] < codes[:, :, None]).sum(2), (codes[:, None, :] == codes[:, :, None]).sum(2)


def _one_ranking(scores: Arrays, labels: np.ndarray) -> Arrays:
    """observed and p of pools of equal size and positives, given as pools by rows."""
    below, tied = _below_tied(scores[0])
    return list(_as_far([2 * below + tied + 1], [], lambda sums, _: sums[0], labels, False))


def _two_rankings(scores: Arrays, labels: np.ndarray, k: int) -> Arrays:
    """ra, rb, hits_a, hits_b, hits_p and auc_p of pools of equal size and positives, given as pools by rows."""
    ranks, places, spares = [], [], []
    for codes in scores:
        below, tied = _below_tied(codes)
        ranks.append(2 * below + tied + 1)
        end = codes.shape[1] - below  # as in ``zone``
        edge = (end > k) & (end - tied < k)
        places += [end <= k, edge]
        spares.append(np.where(edge, end - k, 0).max(1, keepdims=True))

    def hits(sums: Arrays, spares: Arrays) -> Arrays:
        return [top + np.maximum(0, edge - spare) for top, edge, spare in zip(sums[::2], sums[1::2], spares, strict=True)]

    def gap(sums: Arrays, spares: Arrays) -> np.ndarray:
        a, b = hits(sums, spares)
        return a - b

    seen = hits([(p * labels).sum(1, keepdims=True) for p in places], spares)
    _, hits_p = _as_far(places, spares, gap, labels, True)
    _, auc_p = _as_far([ranks[0] - ranks[1]], [], lambda sums, _: sums[0], labels, True)
    return [*[(r * labels).sum(1) for r in ranks], *[h[:, 0] for h in seen], hits_p, auc_p]


def _enumerated(rows: DataFrame, groups: list[str], scores: list[str], made: dict[str, T.DataType], of: Callable[[Arrays, np.ndarray], Arrays]) -> DataFrame:
    """(groups, pool, positives, ``made``) of pools of up to EXACT_ROWS rows; ``of`` makes the last of pools of equal size and positives."""
    packed = rows.groupBy(*groups).agg(F.collect_list(F.struct(*scores, F.col("label").cast("long").alias("label"))).alias("_rows"))
    columns = {"pool": T.LongType(), "positives": T.LongType(), **made}
    schema = T.StructType([*(rows.schema[g] for g in groups), *(T.StructField(c, t) for c, t in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(groups))
            *values, labels = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            codes = [np.unique(v, return_inverse=True)[1] for v in values]  # ranks take the order of scores only
            pool = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(pool):
                continue
            first = np.cumsum(pool) - pool
            out = {"pool": pool, "positives": np.add.reduceat(labels, first)} | {c: np.zeros(len(pool), np.float64 if t == T.DoubleType() else np.int64) for c, t in made.items()}
            for size, positives in np.unique(np.stack([pool, out["positives"]], 1), axis=0):
                alike = np.flatnonzero((pool == size) & (out["positives"] == positives))
                at = first[alike, None] + np.arange(size)
                for c, found in zip(made, of([v[at] for v in codes], labels[at]), strict=True):
                    out[c][alike] = found
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(groups)], *map(pa.array, out.values())], schema.fieldNames())

    return packed.select(*groups, "_rows").mapInArrow(run, schema)


def drawn_sums(cells: DataFrame, groups: list[str], rounds: int, seed: int) -> DataFrame:
    """(groups, round, total): the sum of ``value`` over the positives of each permutation.

    ``cells`` has value, n (its rows) and k (the positives among them).  Up to 10**9 rows a group.
    """
    counts = cells.groupBy(*groups).agg(F.count("*").alias("_cells"), F.sum("k").alias("_positives"))
    blocks = F.ceil(F.col("_cells") / BLOCK_CELLS)
    dealt = cells.join(counts.withColumn("_blocks", blocks), groups).withColumn("_block", F.pmod(F.xxhash64("value"), F.col("_blocks")).cast("int"))
    packed = dealt.groupBy(*groups, "_block").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("cells"), F.sum("n").alias("size"), F.first("_positives").alias("positives"))
    sizes = packed.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_block", "size"))).alias("sizes"))
    rows = packed.join(sizes, groups).withColumn("_key", F.xxhash64(*groups) if groups else F.lit(0).cast("long"))
    schema = T.StructType([*(rows.schema[g] for g in groups), T.StructField("round", T.IntegerType()), T.StructField("total", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                key = [seed, row["_key"] & 0xFFFFFFFF, row["_key"] >> 32 & 0xFFFFFFFF]
                ids, sizes = np.array([s["_block"] for s in row["sizes"]]), np.array([s["size"] for s in row["sizes"]])
                given = np.random.default_rng(key).multivariate_hypergeometric(sizes, int(row["positives"]), size=rounds, method="marginals")[:, ids == row["_block"]].ravel()
                values, n = (np.array([c[f] for c in row["cells"]], np.int64) for f in ("value", "n"))
                own = np.random.default_rng([*key, row["_block"]])
                totals = [int(own.multivariate_hypergeometric(n, g, method="marginals") @ values) for g in given.tolist()]
                yield pd.DataFrame({g: [row[g]] * rounds for g in groups} | {"round": np.arange(rounds, dtype=np.int32), "total": totals})

    sums = rows.repartition(*groups, "_block").mapInPandas(run, schema)
    return sums.groupBy(*groups, "round").agg(F.sum("total").alias("total"))


def _p_values(cells: DataFrame, groups: list[str], rounds: int, seed: int, two_sided: bool) -> DataFrame:
    """(groups, observed, p) of the sum of ``value`` over the positives, drawn; ``cells`` has value, n and k and is stored."""
    cells = cells.groupBy(*groups, "value").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = cells.groupBy(*groups).agg(F.sum(F.col("value") * F.col("k")).alias("observed"))
    drawn = drawn_sums(cells, groups, rounds, seed).join(whole, groups)
    far = (F.abs("total") >= F.abs("observed")) if two_sided else (F.col("total") >= F.col("observed"))
    return drawn.groupBy(*groups).agg(F.first("observed").alias("observed"), ((1 + F.count_if(far)) / F.lit(rounds + 1)).alias("p"))


def permutation_p(pool: DataFrame, groups: list[str], rounds: int = 1000, seed: int = 0) -> DataFrame:
    """(groups, auc, p): the rank AUC of each pool and the chance of one as large when labels are permuted.

    ``pool`` has score and label (0 or 1; rows lacking either take no part) and at least one
    column of ``groups``.  Pools of up to EXACT_ROWS rows are enumerated, others drawn ``rounds``
    times, the observed labels included.  Pools of one class have neither value.
    """
    small, large = _by_size(pool.where("score is not null and label is not null"), groups)
    tested = _enumerated(small, groups, ["score"], {"observed": T.LongType(), "p": T.DoubleType()}, _one_ranking)
    if large is not None:
        cells = stored(large.groupBy(*groups, "score").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("k")))
        valued = stored(cells.join(placed(cells, groups, "score"), [*groups, "score"]).select(*groups, F.col("rank").alias("value"), "n", "k"))
        counts = cells.groupBy(*groups).agg(F.sum("n").alias("pool"), F.sum("k").alias("positives"))
        tested = tested.unionByName(counts.join(_p_values(valued, groups, rounds, seed, False), groups))
    k, m = F.col("positives"), F.col("pool") - F.col("positives")
    both = (k > 0) & (m > 0)
    return tested.select(*groups, F.when(both, (F.col("observed") - k * (k + 1)) / (2 * k * m)).alias("auc"), F.when(both, F.col("p")).alias("p"))


def _hit_gaps(cells: pd.Series, spare_a: pd.Series, spare_b: pd.Series, keys: pd.Series, rounds: int, seed: int) -> pd.DataFrame:
    """hits under a and b and the drawn p-value of their gap, from the rows and positives of nine zones a pool."""
    out = []
    for zone, sa, sb, key in zip(cells, spare_a, spare_b, keys, strict=True):
        a, b, n, k = (np.array([int(c[f]) for c in zone]) for f in ("a", "b", "n", "k"))
        sa, sb, positives = int(sa), int(sb), int(k.sum())

        def hits(of: np.ndarray, place: np.ndarray, spare: int):
            return (of * (place == 2)).sum(-1) + np.maximum(0, (of * (place == 1)).sum(-1) - spare)

        seen = int(hits(k, a, sa)), int(hits(k, b, sb))
        gap = seen[0] - seen[1]
        rng = np.random.default_rng([seed, int(key) & 0xFFFFFFFF, int(key) >> 32 & 0xFFFFFFFF, 7])
        drawn = rng.multivariate_hypergeometric(n, positives, size=rounds, method="marginals")
        p = (1 + int((np.abs(hits(drawn, a, sa) - hits(drawn, b, sb)) >= abs(gap)).sum())) / (rounds + 1)
        out.append((*seen, p))
    return pd.DataFrame(out, columns=["hits_a", "hits_b", "p"])


def paired_comparison(pool: DataFrame, groups: list[str], k: int, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """One ranking against another over the same labelled rows, for each pool.

    ``pool`` has score_a, score_b, label (0 or 1) and at least one column of ``groups``; rows lacking one of these
    three take no part.  Per pool: pool, positives, depth (k, or the pool's size), hits_a and
    hits_b among the best of each, hits_p, auc_a, auc_b and auc_p.  Scores that tie count
    negatives first.  Both p-values are two-sided over permuted labels, exact for pools
    of up to EXACT_ROWS rows.  Pools of one class have no auc.
    """
    small, large = _by_size(pool.where("score_a is not null and score_b is not null and label is not null"), groups)
    made = dict.fromkeys(("ra", "rb", "hits_a", "hits_b"), T.LongType()) | dict.fromkeys(("hits_p", "_auc_p"), T.DoubleType())
    tested = _enumerated(small, groups, ["score_a", "score_b"], made, lambda scores, labels: _two_rankings(scores, labels, k))
    if large is not None:
        tested = tested.unionByName(_drawn_comparison(large, groups, k, rounds, seed))
    positives, negatives = F.col("positives"), F.col("pool") - F.col("positives")
    both = (positives > 0) & (negatives > 0)
    of = lambda c: F.when(both, (F.col(c) - positives * (positives + 1)) / (2 * positives * negatives))
    return tested.select(
        *groups, "pool", "positives", F.least(F.lit(k), "pool").cast("int").alias("depth"), "hits_a", "hits_b", "hits_p",
        of("ra").alias("auc_a"), of("rb").alias("auc_b"), F.when(both, F.col("_auc_p")).alias("auc_p"),
    )


def _drawn_comparison(rows: DataFrame, groups: list[str], k: int, rounds: int, seed: int) -> DataFrame:
    """(groups, pool, positives, ra, rb, hits_a, hits_b, hits_p, _auc_p) of pools that are drawn; ra and rb are the positives' sums of ranks."""
    cells = stored(rows.groupBy(*groups, "score_a", "score_b").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("k")))
    found = cells.join(cells.groupBy(*groups).agg(F.sum("n").alias("_pool")), groups)
    for side in ("a", "b"):
        own = placed(cells, groups, f"score_{side}").withColumnsRenamed({"rank": f"_r{side}", "below": "_below", "tied": "_tied"})
        found = found.join(own, [*groups, f"score_{side}"]).withColumn(f"_z{side}", zone(F.col("_pool"), F.col("_below"), F.col("_tied"), k)).drop("_below", "_tied")
    found = stored(found.withColumn("value", F.col("_ra") - F.col("_rb")))
    zones = found.groupBy(*groups, F.col("_za.place").alias("a"), F.col("_zb.place").alias("b")).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("_za.spare").alias("sa"), F.max("_zb.spare").alias("sb"),
        F.sum(F.col("_ra") * F.col("k")).alias("ra"), F.sum(F.col("_rb") * F.col("k")).alias("rb"),
    )
    whole = zones.groupBy(*groups).agg(
        F.sum("n").alias("pool"), F.sum("k").alias("positives"), F.max("sa").alias("sa"), F.max("sb").alias("sb"), F.sum("ra").alias("ra"), F.sum("rb").alias("rb"),
        F.array_sort(F.collect_list(F.struct("a", "b", "n", "k"))).alias("cells"),  # nine at most, in one order for the draws
    )

    @F.pandas_udf("hits_a long, hits_b long, p double")
    def tested(cells: pd.Series, spare_a: pd.Series, spare_b: pd.Series, keys: pd.Series) -> pd.DataFrame:
        return _hit_gaps(cells, spare_a, spare_b, keys, rounds, seed)

    whole = whole.withColumn("hits", tested("cells", "sa", "sb", F.xxhash64(*groups)))
    auc = _p_values(found, groups, rounds, seed, True).select(*groups, F.col("p").alias("_auc_p"))
    return whole.join(auc, groups).select(*groups, "pool", "positives", "ra", "rb", "hits.hits_a", "hits.hits_b", F.col("hits.p").alias("hits_p"), "_auc_p")


def _resample(row: dict, seed: int) -> Iterator[tuple[int, int, int, int, float]]:
    """(draw, copy, positives, negatives, wins) of one block of a stratum, for every time it is drawn."""
    key = [seed, row["_key"] & 0xFFFFFFFF, row["_key"] >> 32 & 0xFFFFFFFF]
    shares = np.array([s["n"] for s in row["sizes"]], float)
    at = [s["_block"] for s in row["sizes"]].index(row["_block"])
    cells = np.array([(c["pos"], c["neg"]) for c in row["cells"]], np.int64)
    odds = cells.ravel() / cells.sum()
    common, own = np.random.default_rng(key), np.random.default_rng([*key, row["_block"]])
    for draw, times in enumerate(row["times"]):
        for copy in range(times):
            given = common.multinomial(int(shares.sum()), shares / shares.sum())[at]
            pos, neg = own.multinomial(given, odds).reshape(-1, 2).T
            below = np.cumsum(neg) - neg
            yield draw, copy, int(pos.sum()), int(neg.sum()), float(pos @ (below + neg / 2))


def bootstrap_interval(pool: DataFrame, groups: list[str], draws: int = 500, seed: int = 0) -> DataFrame:
    """(groups, low, high, draws): 95 % interval of the AUC within strata; strata are drawn, then rows within each.

    ``pool`` has stratum, score, label and at least one column of ``groups``.  Strata of one class take no part; with fewer than two others
    there is no interval (null), and resamples without a pair are left out.  A stratum is cut
    into blocks by score, so that none is resampled in one task.
    """
    strata = [*groups, "stratum"]
    rows = pool.where("score is not null and label is not null")
    cells = stored(rows.groupBy(*strata, "score").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg")))
    usable = cells.groupBy(*strata).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"), F.count("*").alias("_cells")).where("_p > 0 and _q > 0")
    ordered = running_before(cells.join(usable, strata).withColumn("_one", F.lit(1)), "score", "_one", strata)
    dealt = ordered.withColumn("_block", F.expr(f"cast(before div {BLOCK_CELLS} as int)"))
    packed = stored(dealt.groupBy(*strata, "_block").agg(F.array_sort(F.collect_list(F.struct("score", "pos", "neg"))).alias("cells"), F.sum(F.col("pos") + F.col("neg")).alias("n")))
    sizes = packed.groupBy(*strata).agg(F.array_sort(F.collect_list(F.struct("_block", "n"))).alias("sizes"))
    names = usable.select(*strata)
    few = names.groupBy(*groups).agg(F.count("*").alias("_strata"))
    drawn = _drawn_strata(names, groups, draws, seed)
    rows = packed.join(sizes, strata).join(drawn, strata).withColumn("_key", F.xxhash64(*strata))
    schema = T.StructType([*(rows.schema[g] for g in strata), T.StructField("_block", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("draw", "copy", "pos", "neg")), T.StructField("wins", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                found = pd.DataFrame(list(_resample(row, seed)), columns=["draw", "copy", "pos", "neg", "wins"])
                yield found.assign(**{g: row[g] for g in strata}, _block=row["_block"])[schema.fieldNames()]

    parts = rows.repartition(*strata, "_block").mapInPandas(run, schema)
    earlier = W.partitionBy(*strata, "draw", "copy").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(earlier), F.lit(0))
    copies = parts.withColumn("wins", F.col("wins") + F.col("pos") * below).groupBy(*strata, "draw", "copy").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum("wins").alias("w"))
    values = copies.groupBy(*groups, "draw").agg(F.sum(F.col("p") * F.col("q")).alias("pairs"), F.sum("w").alias("w")).where("pairs > 0").withColumn("value", F.col("w") / F.col("pairs"))
    ends = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    found = values.groupBy(*groups).agg(ends[0].alias("low"), ends[1].alias("high"), F.count("*").alias("draws")).join(few, groups)
    enough: Column = F.col("_strata") > 1
    return found.select(*groups, F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), "draws")


def _drawn_strata(names: DataFrame, groups: list[str], draws: int, seed: int) -> DataFrame:
    """(groups, stratum, times): how often each resample of a pool draws each of its strata."""
    found = None
    for row in names.select(*groups).distinct().collect():  # the compared methods
        own = names
        for g in groups:
            own = own.where(F.col(g).eqNullSafe(F.lit(row[g])))
        part = own.join(multiplicities(own, "stratum", draws, seed), "stratum").select(*groups, "stratum", "times")
        found = part if found is None else found.union(part)
    return found if found is not None else names.select(*groups, "stratum").withColumn("times", F.array().cast("array<int>"))
