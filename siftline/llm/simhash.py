"""Near copies by SimHash fingerprints, with pigeonring filtering of candidates.

The 64 bits of a fingerprint are cut into m segments on a ring.  If two
fingerprints differ in at most t bits, then by the cycle lemma some segment
starts a chain whose first l segments differ in at most l * t / m bits, for every
l from 1 to m.  While l * t / m is below one, these segments are equal: they are
the key under which fingerprints meet (with five segments and two bits: any two
neighbours, 26 bits).  Candidates that meet under a key must keep the budgets of
all longer chains before their whole distance is looked at.

Equal fingerprints are one class.  A key with many classes is deepened: its chain
may differ in few bits in the next segments, so one of them is equal as well and
joins the key.  Keys that are still long are cut into blocks, each pair of blocks
a task's group of bounded size.  A group returns a spanning forest of its links, not
the links, so groups of near copies are never expanded to all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .tables import broadcast_if_small, stored

U = np.uint64
SEGMENTS = 5
#: Classes of a key that are compared in one place; it grows so that at most LONG_KEYS keys have more.
KEY_ROWS = 4096
LONG_KEYS = 500_000
#: Rows dealt to one group of tasks, pairs and shingles held at a time, bytes of a text that are split at a time.
GROUP_ROWS = 100_000
HELD_PAIRS = 1_000_000
HELD_SHINGLES = 100_000
PIECE = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"


def word_lists(raw: memoryview) -> Iterator[list[bytes]]:
    """The lower-cased (A-Z) words of a text, of any length, some at a time."""
    rest = b""
    for at in range(0, len(raw), PIECE):
        piece = rest + bytes(raw[at : at + PIECE]).lower()
        cut = max(piece.rfind(bytes([c])) for c in SPACES) + 1 if at + PIECE < len(raw) else len(piece)
        rest = piece[cut:]
        yield piece[:cut].split()


def shingle_hashes(raw: memoryview, words_each: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles of a text, repeats included; the whole sequence if it has fewer words."""
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    tail: list[bytes] = []
    many = False
    for words in word_lists(raw):
        words = tail + words
        if len(words) >= words_each:
            many = True
            grams = map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False))
            yield np.fromiter(map(digest, grams), U)
            words = words[len(words) - words_each + 1 :]
        tail = words
    if tail and not many:
        yield np.array([digest(b" ".join(tail))], U)


def fingerprints(docs: DataFrame, words_each: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per row; a bit is set if it is in over half of the shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.utf8(batch.column(1))
            ones, sizes = np.zeros((batch.num_rows, 64), np.int64), np.zeros(batch.num_rows, np.int64)
            held, owner, size = [], [], 0
            for i in range(batch.num_rows):
                for hashes in shingle_hashes(data[offsets[i] : offsets[i + 1]].data, words_each, seed):
                    held.append(hashes)
                    owner.append(i)
                    size += len(hashes)
                    if size > HELD_SHINGLES:
                        add(held, owner, ones, sizes)
                        held, owner, size = [], [], 0
            add(held, owner, ones, sizes)
            found = np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").reshape(-1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])
        A.release()

    def add(held: list[np.ndarray], owner: list[int], ones: np.ndarray, sizes: np.ndarray) -> None:
        if held:
            lengths = np.array([len(h) for h in held])
            bits = np.unpackbits(np.concatenate(held).astype(">u8").view(np.uint8)).reshape(-1, 64)
            np.add.at(ones, owner, np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0, dtype=np.int64))
            np.add.at(sizes, owner, lengths)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class Ring:
    """Segments of the 64 bits on a ring, and the budgets of their chains."""

    def __init__(self, most: int, segments: int = SEGMENTS) -> None:
        cuts = [64 * i // segments for i in range(segments + 1)]
        self.most, self.m = most, segments
        self.masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        self.budgets = [length * most // segments for length in range(segments + 1)]
        self.equal = max(length for length in range(segments + 1) if self.budgets[length] == 0)
        if not self.equal:
            raise ValueError("more segments than bits of difference are needed")

    def mask(self, start: int, first: int, end: int) -> int:
        """Bits of the segments first .. end - 1 after ``start``."""
        return sum(self.masks[(start + i) % self.m] for i in range(first, end))

    def deeper(self) -> list[int]:
        """Segments after the equal ones, of which one is equal as well: one more than the budget that they share."""
        length = self.equal
        while length < self.m and length - self.equal <= self.budgets[length]:
            length += 1
        return list(range(self.equal, length)) if length - self.equal > self.budgets[length] else []


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masked(mask: int) -> Column:
    return F.col("fp").bitwiseAND(F.lit(_signed(mask)))


def _long_keys(posted: DataFrame, rows: int) -> DataFrame:
    return posted.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > rows)


def postings(classes: DataFrame, ring: Ring, key_rows: int) -> DataFrame:
    """(start, ring, key, block, pair, fp): fingerprints under the keys of their chains; ``pair`` numbers a key's pairs of blocks.

    ``start`` names the segments of the key, ``ring`` the chain's first segment.
    """
    keys = F.array(*(F.struct(F.lit(i).alias("start"), _masked(ring.mask(i, 0, ring.equal)).alias("key")) for i in range(ring.m)))
    posted = classes.select("fp", F.inline(keys)).withColumn("ring", F.col("start"))
    limit = max(key_rows, ring.m * classes.count() // LONG_KEYS)
    long = stored(_long_keys(posted, limit))
    split = posted.join(F.broadcast(long), ["start", "key"], "left")  # at most LONG_KEYS rows
    short = split.where("n is null").drop("n")
    more = ring.deeper()
    found = split.where("n is not null").drop("n")
    if more and not long.isEmpty():
        deep = [
            F.when(F.col("ring") == i, F.array(*(F.struct(F.lit(ring.m * (d + 1) + i).alias("start"), _masked(ring.mask(i, 0, ring.equal) | ring.mask(i, d, d + 1)).alias("key")) for d in more)))
            for i in range(ring.m)
        ]
        found = found.select("fp", "ring", F.inline(F.coalesce(*deep)))
        long = stored(_long_keys(found, limit))
    split = found.join(F.broadcast(long), ["start", "key"], "left")
    blocks = F.coalesce(F.ceil(F.col("n") / limit), F.lit(1)).cast("int")
    split = split.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumn("pair", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    columns = ["start", "ring", "key", "block", "pair", "fp"]
    return short.withColumns({"block": F.lit(0), "pair": F.lit(0)}).select(*columns).union(split.select(*columns))


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position that links reach, for each of n."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def chained(difference: np.ndarray, start: np.ndarray, ring: Ring) -> np.ndarray:
    """Which differences keep the budgets of the chains from their starts on."""
    ok = np.ones(len(difference), bool)
    for length in range(ring.equal + 1, ring.m + 1):
        masks = np.array([ring.mask(i, 0, length) for i in range(ring.m)], U)
        ok[ok] = np.bitwise_count(difference[ok] & masks[start[ok]]) <= ring.budgets[length]
    return ok


def linked(posted: DataFrame, groups: int, ring: Ring) -> DataFrame:
    """(a, b): enough links between classes to connect all that link."""

    def run(table: pa.Table) -> pa.Table:
        A.release()
        start, rings, key, block, pair = (table[c].to_numpy() for c in ("start", "ring", "key", "block", "pair"))
        values, fp = np.unique(table["fp"].to_numpy().view(U), return_inverse=True)
        order = np.lexsort((fp, pair, key, start))
        start, rings, key, block, pair, fp = (x[order] for x in (start, rings, key, block, pair, fp))
        n = len(fp)
        new = np.r_[True, (start[1:] != start[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])] if n else np.zeros(0, bool)
        ends = np.r_[np.flatnonzero(new)[1:], n] if n else np.zeros(0, np.int64)
        end = np.repeat(ends, np.diff(np.r_[np.flatnonzero(new), n])) if n else ends
        mixed = np.zeros(n, bool)  # rows of lists of two blocks: only pairs across them are new
        if n:
            blocks = np.maximum.reduceat(block, np.flatnonzero(new)) != np.minimum.reduceat(block, np.flatnonzero(new))
            mixed = np.repeat(blocks, np.diff(np.r_[np.flatnonzero(new), n]))
        root, left, right, held = np.arange(len(values)), [], [], 0
        at, step = np.arange(n), 1
        while True:
            at = at[at + step < end[at]]
            if not len(at):
                break
            for lo in range(0, len(at), HELD_PAIRS):
                i = at[lo : lo + HELD_PAIRS]
                j = i + step
                ok = (root[fp[i]] != root[fp[j]]) & ~(mixed[i] & (block[i] == block[j]))
                i, j = i[ok], j[ok]
                ok = chained(values[fp[i]] ^ values[fp[j]], rings[i], ring)
                left.append(fp[i[ok]])
                right.append(fp[j[ok]])
                held += int(ok.sum())
                if held > HELD_PAIRS:
                    root = _joined(root, left, right)
                    left, right, held = [], [], 0
            step += 1
        root = _joined(root, left, right)
        apart = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"a": values[root[apart]].view(np.int64), "b": values[apart].view(np.int64)})

    dealt = posted.withColumn("part", F.pmod(F.xxhash64("start", "key", "pair"), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(run, "a long, b long")


def _joined(root: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """``root`` with more links."""
    known = np.flatnonzero(root != np.arange(len(root)))
    return _forest(len(root), np.concatenate([known, *left]).astype(np.int64), np.concatenate([root[known], *right]).astype(np.int64))


def near_duplicates(docs: DataFrame, most: int = 2, words_each: int = 3, seed: int = 42, key_rows: int = KEY_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``, which needs doc_id and text.

    Words are cut at ASCII white space and lower-cased (A-Z), shingles have ``words_each``
    words and count as often as they occur; a text of fewer words is one shingle, one
    without words (or null) has fingerprint zero, which links like any other.
    Fingerprints link at ``most`` or fewer differing bits; component_id is the
    smallest doc_id that links reach.  Repeated rows each come back; null doc_ids are
    kept and win no minimum.  An empty table gives no rows.
    """
    ring = Ring(most)
    rows = stored(fingerprints(docs, words_each, seed))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    posted = stored(postings(classes.select("fp"), ring, key_rows))
    edges = linked(posted, max(1, -(-posted.count() // GROUP_ROWS)), ring)
    roots = components(edges).withColumnRenamed("v", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = stored(rooted.join(lows, "root").select("fp", "component_id"))
    joined = rows.join(broadcast_if_small(ids), "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
