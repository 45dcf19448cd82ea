"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark items form a hash table that each task holds.  A
window is filed under its longest word, as long words are rare: the scan over the
training texts looks every word up, and compares the whole window around the few
that are found.  Larger benchmarks are scanned in blocks, each of a size that may
be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import ascii_lower, maybe_broadcast, row_key, stored

WINDOW = 10
#: Windows that one block of the benchmark holds; each takes about 300 bytes.
BLOCK_ROWS = 100_000

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word with what separates it from the next, in text that is not lower-cased.
_PIECE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: Column) -> Column:
    """Runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z; null gives none."""
    return F.array_remove(F.coalesce(F.split(ascii_lower(text), _GAP), F.array().cast("array<string>")), "")


def windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """anchor, offset, window (words), items (ids as text): all distinct windows of the items.

    An item of fewer words than ``length``, but not none, is one window.  Null ids are left out.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("window"))
    longest = F.array_max(F.transform("window", lambda w: F.length(w)))
    offset = F.array_position(F.transform("window", lambda w: F.length(w)), longest).cast("int") - 1
    merged = cut.groupBy("window").agg(F.collect_set("item").alias("items"))
    return merged.select(F.element_at("window", offset + 1).alias("anchor"), offset.alias("offset"), "window", "items")


def hits(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """key, spans (start, end word, ascending) and items of the rows of ``docs`` in which a window occurs."""
    table = stored(windows(benchmark, length).withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(1 << 20))))
    blocks = max(1, -(-table.count() // BLOCK_ROWS))
    # The words are made below the generator and kept in one stage with the look-up.
    words = docs.select(row_key().alias("key"), words_of(F.col("text")).alias("words"))
    each = words.select("key", "words", F.posexplode("words").alias("pos", "word"))
    found = []
    for b in range(blocks):
        side = F.broadcast(table.where(F.col("block") % blocks == b).drop("block"))
        same = (F.col("word") == F.col("anchor")) & (F.col("pos") >= F.col("offset"))
        same = same & (F.slice("words", F.greatest(F.col("pos") - F.col("offset"), F.lit(0)) + 1, F.size("window")) == F.col("window"))
        start = F.col("pos") - F.col("offset")
        found.append(each.join(side, same).select("key", F.struct(start.alias("start"), (start + F.size("window")).alias("end")).alias("span"), "items"))
    spans = reduce(DataFrame.unionByName, found)
    return spans.groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans: Column) -> Column:
    """Words that lie in any of the ascending spans."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).cast("long").alias("n")
    )
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of ``docs``.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns
    are ignored.  Null and wordless texts have no words and no hits; wordless items
    have no windows.  Repeated rows each come back.  Empty tables are fine.
    """
    side = maybe_broadcast(stored(hits(docs, benchmark, length)), 400)
    base = docs.select("doc_id", row_key().alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = base.join(side, "key", "left")
    items = F.coalesce("items", F.array().cast(T.ArrayType(T.StringType())))
    hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns."""
    keys = stored(hits(docs, benchmark, length).select(F.col("key").alias("_siftline_key")))
    return docs.join(maybe_broadcast(keys, 16), row_key() == F.col("_siftline_key"), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """All rows of ``docs``; hit words leave the text together with the separators that follow them."""
    side = maybe_broadcast(stored(hits(docs, benchmark, length).select(F.col("key").alias("_siftline_key"), F.col("spans").alias("_siftline_spans"))), 300)
    joined = docs.join(side, row_key() == F.col("_siftline_key"), "left")
    pieces = F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(pieces, lambda _, i: ~F.exists("_siftline_spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    cleaned = F.when(F.col("_siftline_key").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(kept, "")))
    return joined.withColumn("text", cleaned).select(*docs.columns)
