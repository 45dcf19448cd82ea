"""Line deduplication over levelled sorted runs, with DataFrame functions only.

Batches of documents go by descending doc_id.  A batch's line hashes, sorted and
counted, are merge-anti-joined with the runs of all earlier batches: a line they
lack is new, and its keeper is the batch's largest doc_id that holds it; a known
line only adds to its count.  The batch then becomes a run of its own.  FANOUT runs
of a level are compacted to one sorted run of the next, so a line meets few runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ascii_lower, maybe_broadcast, row_key, stored

LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5
BATCHES, FANOUT = 4, 2
_BLANK = " \t\n\x0b\f\r"


def key_of(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(_BLANK)))


class Runs:
    """Levels of sorted runs (h, n_docs, keeper); a run is a table in the shared folder."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def split(self, lines: DataFrame) -> DataFrame:
        """Lines (h, n_docs, keeper) with the keeper nulled where a run holds the line already."""
        fresh = reduce(lambda left, run: left.join(run, "h", "left_anti"), self.all(), lines)
        if fresh is lines:
            return lines
        return lines.select("h", "n_docs").join(fresh.select("h", "keeper"), "h", "left")

    def add(self, lines: DataFrame) -> None:
        """Store a batch as a run and compact levels that are full."""
        run, level = self._sorted(self.split(lines)), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FANOUT:
                return
            run = self._sorted(self.merged(self.levels[level]))
            self.levels[level] = []
            level += 1

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """Runs added up: counts sum, and the one batch that found a line new names the keeper."""
        return reduce(DataFrame.unionByName, runs).groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    @staticmethod
    def _sorted(lines: DataFrame) -> DataFrame:
        return stored(lines.select("h", "n_docs", "keeper").sortWithinPartitions("h"))


def repeated_lines(lines: DataFrame, batches: int = BATCHES, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(h, keeper): lines of at least so many documents, from lines (h, doc_id)."""
    cuts = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + F.when(F.col("doc_id") > cut, 1).otherwise(0)
    runs = Runs()
    for b in reversed(range(batches)):
        mine = lines.where(batch == b).select("h", "doc_id").distinct()
        runs.add(mine.groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")))
    return Runs.merged(runs.all()).where(F.col("n_docs") >= least_documents).select("h", "keeper")


def dropped_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """(_siftline_key, _siftline_drop): the positions of the lines that each row of ``docs`` loses."""
    line = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    exploded = docs.where("text is not null").select("doc_id", row_key().alias("key"), line)
    keyed = exploded.withColumn("line", F.btrim("line", F.lit(_BLANK))).where(F.length("line") >= least_length)
    lines = stored(keyed.select(F.xxhash64(ascii_lower("line")).alias("h"), "doc_id", "key", "pos"))
    hot = repeated_lines(lines, batches, least_documents)
    gone = lines.join(hot, "h").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return stored(gone.groupBy(F.col("key").alias("_siftline_key")).agg(F.collect_set("pos").alias("_siftline_drop")))


def _joined(docs: DataFrame, **limits: int) -> tuple[DataFrame, Column]:
    side = maybe_broadcast(dropped_lines(docs, **limits), 160)
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("_siftline_drop", i)), "\n")
    return docs.join(side, row_key() == F.col("_siftline_key"), "left"), F.when(F.col("_siftline_key").isNull(), F.col("text")).otherwise(kept)


def report(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256; one row per row of ``docs``.

    ``docs`` needs doc_id and text.  A null or empty text is one empty line.  Rows
    of one doc_id count as one document and keep a line together; a null doc_id
    counts as a document and keeps a line only if no other row holds it.  Repeated
    rows each come back; an empty table gives no rows.
    """
    joined, kept = _joined(docs.select("doc_id", "text"), **limits)
    text = F.coalesce("text", F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.when(F.col("_siftline_key").isNull(), F.lit(0)).otherwise(F.size("_siftline_drop"))
    return joined.select("doc_id", n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))


def remove_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """All rows and columns of ``docs``; the text loses its dropped lines."""
    joined, kept = _joined(docs, **limits)
    return joined.withColumn("text", kept).select(*docs.columns)
