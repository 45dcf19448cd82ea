"""Quality rules with thresholds learned per language and source.

Features of every whole text come from one pass over the table.  A logarithmic
histogram per (language, source, feature) is the quantile sketch: its bins hold
counts, so sketches merge by adding and are the same however the rows are dealt;
a quantile comes back within ``ACCURACY`` of its value.  Each group's fences follow
from its sketch, shrunk towards those of its language where it is small.  Features
then join the fences of their group; no fence has a fixed part, and a count must
exceed its fence by more than counts vary by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import arrays as A
from .tables import maybe_broadcast, stored

#: Relative accuracy of the quantile sketches.
ACCURACY = 0.01
#: A fence stands REACH times as far from the median as the outer tenth of the group on that side.
REACH = 3.0
#: Documents' worth of the language's fence that a group's own fence is mixed with.
PRIOR_ROWS = 50
#: Deviations by which a count must exceed what its fence explains: one count in a hundred does by chance.
DEVIATIONS = 2.326
#: The judged features: their expression over the base counts and, for shares, the count, what it is a share of, and how many make one event
#: (two runs of three words are the least that repeats).
FEATURES: dict[str, tuple[str, tuple[str, str, int] | None]] = {
    "mean_word_chars": ("word_chars / n_words", None),
    "symbol_share": ("n_symbols / (word_chars + 1)", ("n_symbols", "word_chars + 1", 1)),
    "repeat_share": ("n_repeat_words / n_words", ("n_repeat_words", "n_words", 6)),
    "dup_line_share": ("n_dup_lines / n_lines", ("n_dup_lines", "n_lines", 1)),
}

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False


def _repeats(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which items occur at least twice within their owner."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    same = np.zeros(len(o) + 1, bool)
    same[1:-1] = (o[1:] == o[:-1]) & (h[1:] == h[:-1])
    out = np.zeros(len(o), bool)
    out[order] = same[1:] | same[:-1]
    return out


def counts_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of each row."""
    rows = len(offsets) - 1
    starts, ends, n_words = A.words(data, offsets)
    owner = np.repeat(np.arange(rows), n_words)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = np.bincount(owner, lead[ends] - lead[starts], rows)
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOLS[data], out=marks[1:])
    symbols = marks[offsets[1:]] - marks[offsets[:-1]]

    hashes = A.word_hashes(data, starts, ends)
    keep = A.inside(n_words, 3)
    covered = np.zeros(len(hashes), bool)
    if len(keep):
        at = np.flatnonzero(keep)
        at = at[_repeats(owner[at], A.window_hashes(hashes, 3)[at])]
        for k in range(3):
            covered[at + k] = True
    repeat_words = np.bincount(owner[covered], minlength=rows)

    # Lines with a word: spans between newlines, compared whole; empty ones have none.
    lines, line_ends, n_lines = A.words(data, offsets, ~_NEWLINE)
    worded = np.searchsorted(starts, lines, "left") < np.searchsorted(starts, line_ends, "left")
    line_owner = np.repeat(np.arange(rows), n_lines)[worded]
    line_hash = A.word_hashes(data, lines[worded], line_ends[worded])
    order = np.lexsort((line_hash, line_owner))
    o, h = line_owner[order], line_hash[order]
    later = np.flatnonzero((o[1:] == o[:-1]) & (h[1:] == h[:-1]))
    dup_lines = np.bincount(o[later], minlength=rows)
    return [x.astype(np.int64) for x in (n_words, chars, symbols, dup_lines, repeat_words, np.bincount(line_owner, minlength=rows))]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and n_lines, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, most=2 << 20):
                columns = counts_of(*A.utf8(part.column(3)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, columns)], names=["doc_id", "lang", "source", *BASE, "n_lines"])

    kept = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    return kept.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in [*BASE, "n_lines"]))


_GAMMA = math.log((1 + ACCURACY) / (1 - ACCURACY))
_LEAST = 1e-4


def bin_of(value: Column) -> Column:
    """The sketch's bin of a value of zero or more; all below _LEAST share the first."""
    return F.greatest(F.ceil(F.log(F.greatest(value, F.lit(_LEAST))) / _GAMMA), F.lit(math.ceil(math.log(_LEAST) / _GAMMA)))


def value_of(bin_: Column) -> Column:
    """The middle of a bin; the first stands for zero."""
    return F.when(bin_ <= math.ceil(math.log(_LEAST) / _GAMMA), F.lit(0.0)).otherwise(F.exp(bin_ * _GAMMA) * (1 - ACCURACY))


def sketches(features: DataFrame, by: list[str]) -> DataFrame:
    """One row per group, feature and bin with its count: the mergeable sketch."""
    names = list(FEATURES)
    long = features.select(*by, F.expr("stack({}, {}) as (feature, value)".format(len(names), ", ".join(f"'{n}', {n}" for n in names))))
    return long.where("value is not null").groupBy(*by, "feature", bin_of(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """rows, q10, q25, q50, q75 and q90 of each group and feature from its sketch."""
    group = [*by, "feature"]
    running = sketch.withColumn("upto", F.sum("n").over(W.partitionBy(*group).orderBy("bin"))).withColumn("rows", F.sum("n").over(W.partitionBy(*group)))
    at = lambda q: value_of(F.min(F.when(F.col("upto") >= F.col("rows") * q, F.col("bin"))))
    return running.groupBy(*group).agg(F.max("rows").alias("rows"), *[at(q / 100).alias(f"q{q:02}") for q in (10, 25, 50, 75, 90)])


def fences(features: DataFrame) -> DataFrame:
    """lang, source and, for each feature, its lower and upper fence, from the sketches of group and language."""
    sketch = stored(sketches(features, ["lang", "source"]))
    own = quartiles(sketch, ["lang", "source"])
    wide = sketch.groupBy("lang", "feature", "bin").agg(F.sum("n").alias("n"))  # sketches merge by adding
    used = ("q10", "q50", "q90")
    whole = quartiles(wide, ["lang"]).select(F.col("lang").alias("l"), F.col("feature").alias("f"), *[F.col(q).alias(f"w{q}") for q in used])
    both = own.join(whole, F.col("lang").eqNullSafe(F.col("l")) & (F.col("feature") == F.col("f")))
    trust = F.col("rows") / (F.col("rows") + PRIOR_ROWS)
    mixed = {q: F.col(q) * trust + F.col(f"w{q}") * (1 - trust) for q in used}
    error = ACCURACY * mixed["q50"]  # what the sketch may have taken off the spread
    bounds = both.select(
        "lang", "source", "feature",
        (mixed["q50"] - REACH * (mixed["q50"] - mixed["q10"] + error)).alias("low"),
        (mixed["q50"] + REACH * (mixed["q90"] - mixed["q50"] + error)).alias("high"),
    )
    pick = lambda n, side: F.max(F.when(F.col("feature") == n, F.col(side))).alias(f"{n}_{side}")
    return bounds.groupBy("lang", "source").agg(*[pick(n, s) for n in FEATURES for s in ("low", "high")])


def outside(name: str) -> Column:
    """Whether a row's feature lies outside its fences, in columns ``name``, ``name``_low and ``name``_high.

    A share is a count over a size.  Above its fence it is only outside if the count
    exceeds what the fence explains at that size by DEVIATIONS, as counts vary (square
    roots of counts have a deviation of one half): one doubled line of four is no
    outlier even where nine tenths of a group have none, a third of a long text is.
    """
    value, counted = F.col(name), FEATURES[name][1]
    high = value > F.col(f"{name}_high")
    if counted is not None:
        count, size, event = F.expr(counted[0]) / counted[2], F.expr(counted[1]), counted[2]
        explained = F.greatest(F.col(f"{name}_high"), F.lit(0.0)) * size / event
        high &= 2 * (F.sqrt(count + 0.375) - F.sqrt(explained + 0.375)) > DEVIATIONS
    return high | (value < F.col(f"{name}_low"))


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed, the features outside their group's fences, and kept; one row per row.

    ``docs`` needs doc_id, text, lang and source.  Null text counts as no words and
    fails the base rule; null lang or source form groups of their own.  Features
    are null, and judge nothing, without words.  An empty table gives no rows.
    """
    base = base_counts(docs)
    ratio = {n: F.when(F.col("n_words") > 0, F.expr(e)) for n, (e, _) in FEATURES.items()}
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(base.withColumns(ratio).withColumn("base_failed", failed))
    # The groups' usual values come from documents that pass the base rules.
    bounds = stored(fences(rows.where("not base_failed")))
    side = maybe_broadcast(bounds.withColumnsRenamed({"lang": "l", "source": "s"}), 120)
    joined = rows.join(side, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    outliers = [F.when(outside(n), F.lit(n)) for n in FEATURES]
    return joined.select(
        "doc_id", *BASE, "base_failed", F.array_compact(F.array(*outliers)).alias("outliers")
    ).withColumn("kept", ~F.col("base_failed") & (F.size("outliers") == 0))
