"""Training sets, refits and batch selection."""

from __future__ import annotations

from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import stored


def training_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features (sample, peptide, allele, ...) with labels (sample, peptide, allele or '*', label).

    An exact allele goes before the wildcard; rows without a label drop out.
    """
    known = labels.where("label is not null").groupBy("sample", "peptide", "allele").agg(F.max("label").alias("label"))
    exact = known.where("allele <> '*'").withColumnRenamed("label", "_exact")
    wild = known.where("allele = '*'").drop("allele").withColumnRenamed("label", "_wild")
    joined = features.join(exact, ["sample", "peptide", "allele"], "left").join(wild, ["sample", "peptide"], "left")
    return joined.withColumn("label", F.coalesce("_exact", "_wild")).where("label is not null").drop("_exact", "_wild")


def refit(rows: DataFrame, names: list[str], c: float = 0.3, least_rows: int = 40, least_class: int = 8) -> dict[str, float] | None:
    """Weights and bias of an L2 logistic model with balanced classes; null if there is too little to learn from."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n, p, q = sum(counts.values()), counts.get(1, 0), counts.get(0, 0)
    if n < least_rows or min(p, q) < least_class:
        return None
    weighted = rows.withColumn("_w", F.when(F.col("label") == 1, n / (2.0 * p)).otherwise(n / (2.0 * q)))
    data = VectorAssembler(inputCols=names, outputCol="_x").transform(weighted.withColumn("label", F.col("label").cast("double")))
    model = LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(data)
    return dict(zip(names, map(float, model.coefficients), strict=True)) | {"bias": float(model.intercept)}


def weight_changes(prior: dict[str, float], fitted: dict[str, float], spark: SparkSession) -> DataFrame:
    """(name, prior, fitted, change, text) of each weight of the prior, by name."""
    rows = spark.createDataFrame([(n, float(prior[n]), float(fitted.get(n, 0.0))) for n in sorted(prior)], "name string, prior double, fitted double")
    out = rows.withColumn("change", F.col("fitted") - F.col("prior"))
    return out.withColumn("text", F.format_string("%-18s %+.3f -> %+.3f  (%+.3f)", "name", "prior", "fitted", "change"))


def ensemble_spread(scores: DataFrame, key: str) -> DataFrame:
    """Per key min(1, sample deviation / 0.5) of the ensemble's scores; 0 for a single one."""
    spread = F.least(F.lit(1.0), F.coalesce(F.stddev_samp("score"), F.lit(0.0)) / 0.5)
    return scores.groupBy(key).agg(spread.alias("spread"))


def _spent(column: str, values: list) -> Column:
    """Whether a key is one of those whose cap is reached; null is a key like any other."""
    found = F.coalesce(F.col(column).isin([v for v in values if v is not None]), F.lit(False))
    return found | F.col(column).isNull() if None in values else found


def active_batch(items: DataFrame, order: list[Column], batch_size: int, per_variant: int, per_allele: int) -> DataFrame:
    """Greedy pick in order under two caps (0: none), at most ``batch_size`` rows, with their rank.

    Each (variant, allele) pair keeps only as many of its best rows as either cap
    allows.  Under both caps a pick depends on all before it: the driver looks at the
    best few rows whose keys still have room, takes what the caps allow and asks for
    the next.  A row that it leaves has a key without room, so no row is looked at twice,
    and the driver holds no more than the batch and one such block.
    """
    limit = min([c for c in (per_variant, per_allele) if c] or [batch_size])
    near = items.withColumn("_n", F.row_number().over(W.partitionBy("variant", "allele").orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
    if not (per_variant and per_allele):
        for key, cap in (("variant", per_variant), ("allele", per_allele)):
            if cap:
                near = near.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")
        return near.orderBy(*order).limit(batch_size).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    rows = stored(near.withColumn("_row", F.monotonically_increasing_id()))
    variants, alleles, taken = Counter(), Counter(), []
    while len(taken) < batch_size:
        full = lambda counts, cap: [k for k, n in counts.items() if n >= cap]
        open_ = rows.where(~_spent("variant", full(variants, per_variant)) & ~_spent("allele", full(alleles, per_allele)) & ~F.col("_row").isin(taken))
        block = open_.orderBy(*order, "_row").limit(4 * batch_size).select("_row", "variant", "allele").collect()
        for r in block:
            if len(taken) < batch_size and variants[r.variant] < per_variant and alleles[r.allele] < per_allele:
                variants[r.variant] += 1
                alleles[r.allele] += 1
                taken.append(r["_row"])
        if len(block) < 4 * batch_size:
            break
    places = rows.sparkSession.createDataFrame([(r, i) for i, r in enumerate(taken, 1)], "_row long, rank int")
    return rows.where(F.col("_row").isin(taken)).join(places, "_row").drop("_row")
