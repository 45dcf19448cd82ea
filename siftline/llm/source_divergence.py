"""How far the sources of a language differ in the words they use.

Terms are counted by language and source; a language keeps those of enough of its
documents.  The kept terms are numbered in chunks of a bounded size, and each
group's counts in a chunk become one packed vector.  Pairs of groups are computed
in two-dimensional tiles: groups form blocks, and a block's vectors are sent to
the tasks of all block pairs it belongs to, ordered by chunk.  A task holds one
chunk of two blocks at a time and adds its absolute differences to its pair
submatrix.  Long runs of chunks are cut into stripes, whose submatrices are summed.

No vector is ever whole in one place, and no task's memory depends on the number
of terms or groups.  Counts are summed in each task before they are shuffled, so a
source with a third of all rows is as many rows as it has different terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .tables import broadcast_if_small, stored

#: Kept terms of a chunk (about), groups of a block, chunks of a stripe.
CHUNK_TERMS = 8192
BLOCK_GROUPS = 32
STRIPE_CHUNKS = 64
#: Counts that a task holds before it hands them on, bytes of a text that are split at a time.
HELD_COUNTS = 300_000
PIECE = 1 << 20
SCALE = 1_000_000_000

#: Letters stay, A-Z become a-z, bytes above ASCII stay, all others become blanks.
_TERM_BYTES = bytes(i if i >= 128 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def terms_in_pieces(raw: memoryview) -> Iterator[list[bytes]]:
    """The terms of a text, of any length, some at a time."""
    rest = b""
    for at in range(0, len(raw), PIECE):
        piece = rest + bytes(raw[at : at + PIECE]).translate(_TERM_BYTES)
        cut = piece.rfind(b" ") + 1 if at + PIECE < len(raw) else len(piece)
        rest = piece[cut:]
        yield piece[:cut].split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = A.utf8(batch.column(2))
            for i, group in enumerate(zip(langs, sources, strict=True)):
                own: Counter = Counter()
                for terms in terms_in_pieces(data[offsets[i] : offsets[i + 1]].data):
                    own.update(terms)
                seen, within = held.setdefault(group, (Counter(), Counter()))
                before = len(seen)
                seen.update(own)
                within.update(own.keys())
                size += len(seen) - before
                if size > HELD_COUNTS:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (seen, within) in held.items():
            n = len(seen)
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(seen), pa.binary()).cast(pa.string())]
            columns += [pa.array(list(seen.values()), pa.int64()), pa.array([within[t] for t in seen], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / whole) in whole numbers, for count + 5 <= whole < 9 * 10**15."""
    rest, out = count + 5, F.lit(0).cast("long")
    for factor in (1, 1000, 1000, 1000):
        rest = rest * factor
        out = out * factor + F.call_function("div", rest, whole)
        rest = rest % whole
    return out + 1


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``share`` for arrays."""
    rest = counts.astype(np.int64) + 5
    out = np.zeros(np.broadcast_shapes(rest.shape, whole.shape), np.int64)
    for factor in (1, 1000, 1000, 1000):
        part, rest = np.divmod(rest * factor, whole)
        out = out * factor + part
    return out + 1


def _tile_sums(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) of each tile and stripe; rows are sorted by tile, stripe, chunk and group."""
    tile: tuple | None = None
    matrix = ids = None
    chunk, rows = None, []

    def close_chunk() -> None:
        nonlocal matrix, ids
        if not rows:
            return
        now = np.array([r[0] for r in rows])
        if matrix is None:
            ids, matrix = now, np.zeros((len(now), len(now)), np.int64)
        dense = np.zeros((len(rows), rows[0][1]), np.int64)
        for i, (_, _, _, slots, counts) in enumerate(rows):
            dense[i, slots] = counts
        p = shares(dense, np.array([r[2] for r in rows])[:, None])
        for i in range(len(p) - 1):
            matrix[i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(1)
        rows.clear()

    def close_tile() -> Iterator[pa.RecordBatch]:
        nonlocal matrix, chunk
        close_chunk()
        if matrix is not None:
            lang, low, high, _ = tile
            i, j = np.triu_indices(len(ids), 1)
            if low != high:  # pairs within one block belong to its own tile
                apart = ids[i] // block != ids[j] // block
                i, j = i[apart], j[apart]
            columns = [pa.array([lang] * len(i), pa.string()), pa.array(ids[i], pa.int32()), pa.array(ids[j], pa.int32()), pa.array(matrix[i, j])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])
        matrix, chunk = None, None

    for batch in batches:
        langs, lows, highs, stripes, chunks, groups, widths, wholes = (batch.column(i).to_pylist() for i in range(8))
        slots, counts = batch.column(8), batch.column(9)
        for i in range(batch.num_rows):
            now = (langs[i], lows[i], highs[i], stripes[i])
            if now != tile:
                if tile is not None:
                    yield from close_tile()
                tile = now
            if chunks[i] != chunk:
                close_chunk()
                chunk = chunks[i]
            rows.append((groups[i], widths[i], max(wholes[i], 1), slots[i].values.to_numpy(), counts[i].values.to_numpy()))
    if tile is not None:
        yield from close_tile()
    A.release()


def group_pairs(groups: DataFrame, chunks: DataFrame, weighted: DataFrame) -> DataFrame:
    """(lang, a, b, value): the summed difference of each two groups of a language, a < b.

    ``groups`` has lang, gid (from 0), whole; ``chunks`` lang, chunk, width; ``weighted``
    lang, gid, chunk, slot, n.
    """
    packed = weighted.groupBy("lang", "gid", "chunk").agg(F.collect_list(F.struct("slot", "n")).alias("cells"))  # about CHUNK_TERMS cells at most
    none = F.array().cast("array<struct<slot:int,n:long>>")
    whole = groups.join(chunks, "lang", "left").fillna(0, ["chunk", "width"]).join(packed, ["lang", "gid", "chunk"], "left").withColumn("cells", F.coalesce("cells", none))
    blocks = groups.groupBy("lang").agg(F.floor(F.max("gid") / BLOCK_GROUPS).cast("int").alias("last"))
    block = F.floor(F.col("gid") / BLOCK_GROUPS).cast("int")
    sent = whole.join(broadcast_if_small(blocks), "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("block", block)
    keys = ["lang", "low", "high", "stripe"]
    tiles = sent.select(
        "lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.floor(F.col("chunk") / STRIPE_CHUNKS).cast("int").alias("stripe"),
        "chunk", "gid", "width", "whole", F.col("cells.slot").alias("slots"), F.col("cells.n").alias("counts"),
    )
    sums = tiles.repartition(*keys).sortWithinPartitions(*keys, "chunk", "gid").mapInArrow(partial(_tile_sums, block=BLOCK_GROUPS), "lang string, a int, b int, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources of a language, and each source's own terms.

    ``docs`` needs text, lang and source, of which nulls count as empty; other columns
    are ignored.  A term's share in a group is 1 + floor(10**9 * (count + 5) / (N + 5 V))
    over the V terms that at least ``min_docs`` documents of the language hold.  Part
    ``pair`` sums the absolute differences of shares between two sources, for each
    ordered pair (0 without kept terms).  Part ``term`` has the ``top`` terms of a source
    that are more frequent there than in the language.  Repeated rows count each.  Ties
    are ranked by item in UTF-8 order.  An empty table gives no rows.
    """
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = stored(term_counts(clean))
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("docs").alias("held"), F.sum("n").alias("total")).where(F.col("held") >= min_docs).drop("held"))
    langs = stored(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n")))
    placed = kept.join(broadcast_if_small(langs), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / CHUNK_TERMS)).cast("int"))
    by_chunk = Window.partitionBy("lang", "chunk")
    placed = stored(placed.withColumns({"slot": F.row_number().over(by_chunk.orderBy("term")) - 1, "width": F.count("*").over(by_chunk)}))
    chunks = placed.groupBy("lang", "chunk").agg(F.max("width").alias("width"))
    used = stored(counts.drop("docs").join(placed.drop("width"), ["lang", "term"]))

    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = clean.select("lang", "source").distinct().join(broadcast_if_small(langs), "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0, ["v", "source_n"])
    groups = groups.select("lang", "source", (F.col("source_n") + 5 * F.col("v")).alias("whole"))
    groups = stored(groups.withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    small = broadcast_if_small(groups)

    named = used.join(small, ["lang", "source"])
    pairs = group_pairs(groups.drop("source"), chunks, named.select("lang", "gid", "chunk", "slot", "n"))
    for side in ("a", "b"):
        pairs = pairs.join(broadcast_if_small(groups).select("lang", F.col("gid").alias(side), F.col("source").alias(f"source_{side}")), ["lang", side])
    both = pairs.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value")
    both = both.union(pairs.select("lang", "source_b", "source_a", "value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = both.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked))

    above = share(F.col("n"), F.col("whole")) - share(F.col("total"), F.col("lang_n") + 5 * F.col("v"))
    own = named.withColumn("value", above).where("n > 0 and value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    term_part = own.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair_part.select(*columns).union(term_part.select(*columns))
