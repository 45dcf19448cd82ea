"""K-d tree sharding with DataFrame functions only.

The tree splits at weighted medians along the widest metadata dimension until each
leaf holds the target bytes.  A median is found by narrowing: rows are summed into
BINS bins of each node's range, the bin that holds the median becomes the range,
and so on until that bin weighs next to nothing; only one row per node and bin
leaves a task.  Where one value holds too much, ties split by a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .tables import maybe_broadcast, stored

BINS = 1024
#: A split may miss its share by this part of the node.
TOLERANCE = 5e-4
#: Rows numbered by one task.
ROWS_A_BUCKET = 100_000

SHARDS = 8


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions d0 (id), d1 (log size), d2 (source), d3 (language) of each row."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    spread = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")).cast("double"), F.lit(-1.0))
    return docs.select(
        F.col("doc_id").cast("long"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("d0"), F.log2(size.cast("double")).alias("d1"),
        spread("source").alias("d2"), spread("lang").alias("d3"),
    )


DIMENSIONS = ("d0", "d1", "d2", "d3")


def _pick(index: Column, columns: list[Column]) -> Column:
    out = columns[-1]
    for i in range(len(columns) - 2, -1, -1):
        out = F.when(index == i, columns[i]).otherwise(out)
    return out


def _pick_first(values: list[Column], wanted: Column) -> Column:
    """The index of the first value that equals the wanted one."""
    out = F.lit(len(values) - 1)
    for i in range(len(values) - 2, -1, -1):
        out = F.when(values[i] == wanted, F.lit(i)).otherwise(out)
    return out


def _narrowed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One narrowing step: for each open node the bin of its range that holds the wanted weight.

    ``rows`` has node, v and size; ``state`` node, lo, hi, below and want.  Returns
    node with the new lo, hi, below and the weight inside.
    """
    inside = rows.join(F.broadcast(state), "node").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    step = (F.col("hi") - F.col("lo")) / BINS
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(BINS - 1))).otherwise(F.lit(0))
    bins = inside.groupBy("node", place.alias("bin")).agg(
        F.sum("size").alias("w"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi"), F.first("below").alias("below"), F.first("want").alias("want")
    )
    upto = F.col("below") + F.sum("w").over(W.partitionBy("node").orderBy("bin"))
    cum = bins.withColumn("upto", upto).where("upto >= want")
    best = cum.groupBy("node").agg(F.min_by(F.struct(F.col("bin_lo").alias("lo"), F.col("bin_hi").alias("hi"), (F.col("upto") - F.col("w")).alias("below"), "w"), "bin").alias("b"))
    return best.select("node", "b.*")


def _cuts(rows: DataFrame, wants: dict[int, float], weights: dict[int, float]) -> dict[int, tuple[float, float, float]]:
    """Per node: the range [lo, hi] that holds its weighted quantile, and the weight below it.

    The range is one value, or weighs next to nothing.
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("node", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("lo", "hi", "below", "want")])
    start = rows.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    open_ = {r.node: (r.lo, r.hi, 0.0) for r in start if r.node in wants}
    out: dict[int, tuple[float, float, float]] = {n: s for n, s in open_.items() if s[0] == s[1]}
    open_ = {n: s for n, s in open_.items() if n not in out}
    while open_:
        state = spark.createDataFrame([(n, lo, hi, below, wants[n]) for n, (lo, hi, below) in open_.items()], schema)
        for r in _narrowed(rows, state).collect():
            got = (r.lo, r.hi, float(r.below))
            if r.lo == r.hi or r.w <= TOLERANCE * weights[r.node]:
                out[r.node] = got
                del open_[r.node]
            else:
                open_[r.node] = got
    return out


def kd_leaves(rows: DataFrame, dimensions: tuple[str, ...], shards: int) -> DataFrame:
    """The rows with ``shard`` (0 .. shards-1), from a stored table with size and the dimensions.

    A node for k shards splits off floor(k/2)/k of its weight along its widest
    dimension (range over the whole table's range; ties: the first).  What the
    driver holds is a few numbers per node of the tree.
    """
    whole = rows.agg(*[F.min(d).alias(f"lo_{d}") for d in dimensions], *[F.max(d).alias(f"hi_{d}") for d in dimensions]).first()
    spans = [max((whole[f"hi_{d}"] or 0.0) - (whole[f"lo_{d}"] or 0.0), 1e-12) for d in dimensions]
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.lit(1 << 40)).cast("double")
    spark, rows = rows.sparkSession, rows.withColumn("node", F.lit(0).cast("long"))
    parts = {0: (0, shards)}  # node -> first shard, shards
    while any(k > 1 for _, k in parts.values()):
        wide = [(F.max(d) - F.min(d)) / F.lit(s) for d, s in zip(dimensions, spans, strict=True)]
        most = F.greatest(*wide) if len(wide) > 1 else wide[0]
        which = _pick_first(wide, most)
        facts = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), which.alias("dim")).collect() if parts[r.node][1] > 1}
        weights = {n: float(r.w) for n, r in facts.items()}
        wants = {n: weights[n] * (parts[n][1] // 2) / parts[n][1] for n in facts}
        axes = spark.createDataFrame([(n, int(r.dim)) for n, r in facts.items()], "node long, dim int")
        at = rows.join(F.broadcast(axes), "node").withColumn("v", _pick(F.col("dim"), [F.col(d) for d in dimensions])).select("node", "v", "size", tie.alias("tie"))
        cuts = _cuts(at, wants, weights)
        # Inside a cut's own range, rows go by their hash.
        ranges = spark.createDataFrame([(n, int(facts[n].dim), lo, hi) for n, (lo, hi, _) in cuts.items()], "node long, dim int, lo double, hi double")
        ties = at.join(F.broadcast(ranges.drop("dim")), "node").where("v >= lo and v <= hi").select("node", F.col("tie").alias("v"), "size")
        tie_cuts = _cuts(ties, {n: wants[n] - cuts[n][2] for n in cuts}, weights)
        rules = spark.createDataFrame([(n, int(facts[n].dim), lo, hi, tie_cuts[n][1]) for n, (lo, hi, _) in cuts.items()], "node long, dim int, lo double, hi double, most double")
        v = _pick(F.col("dim"), [F.col(d) for d in dimensions])
        left = (v < F.col("lo")) | ((v <= F.col("hi")) & (tie <= F.col("most")))
        child = F.when(F.col("dim").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 1).otherwise(2))
        rows = stored(rows.join(F.broadcast(rules), "node", "left").withColumn("node", child).select(*rows.columns))
        deeper = {n: p for n, p in parts.items() if p[1] == 1}
        for n, (first, k) in parts.items():
            if k > 1:
                deeper |= {2 * n + 1: (first, k // 2), 2 * n + 2: (first + k // 2, k - k // 2)}
        parts = deeper
        if not facts:  # no rows
            break
    leaves = spark.createDataFrame([(n, first) for n, (first, _) in parts.items()], "node long, shard int")
    return rows.join(F.broadcast(leaves), "node").drop("node")


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard, without bringing a shard into one task.

    Rows are numbered within buckets of a shard; the buckets' sizes give the offsets.
    """
    buckets = max(1, -(-rows.count() // ROWS_A_BUCKET))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(buckets)))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(sizes.select("shard", "bucket", before.alias("offset")))
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return dealt.withColumn("place", place).join(maybe_broadcast(offsets, 24), ["shard", "bucket"]).withColumn("slot", (F.col("offset") + F.col("place")).cast("long")).drop("bucket", "place", "offset")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row of ``docs``.

    The law is ``bytes``: shards have nearly equal sizes.  Copies may lie in
    different shards, as a group may be larger than a shard.  Null texts have size
    1; null ids, sources and languages are values of their own.  Identical rows are
    ties that nothing can tell apart and stay together.  An empty table gives no
    rows.
    """
    rows = stored(metadata(docs))
    out = with_slots(kd_leaves(rows, DIMENSIONS, shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shards_for(total_bytes: int, target_bytes: int) -> int:
    """Leaves needed so that each reaches the target."""
    return max(1, -(-total_bytes // target_bytes))
