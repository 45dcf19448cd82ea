"""Near-duplicate documents by an n-gram Jaccard join with several token orders.

Documents are sets of word shingles, 64-bit hashes.  Equal sets form a class and
are compared once.  Shingles of a single class can match nothing, so only the
shared ones matter: one shuffle by shingle finds them with their class counts,
one shuffle by class brings them together.  A class with too few shared shingles
can reach no partner and leaves.

For a threshold t two sets of n shingles can link only if they share a shingle of
their first ``n - ceil(t n) + 1`` under any global order.  Here each order puts
rare shingles first (by the octave of their class count) and breaks ties by its
own hash, so the orders differ.  Candidates must share prefix shingles under
every order; what is left is verified exactly on the whole sets.

Large groups of near copies are never expanded to all pairs.  In a few rounds each
class meets one hub under each order, the class of another component that leads most
of its posting lists; what links is joined into components.  The complete pass then
only pairs classes that are not yet connected, and whose parity bitmaps do not
already rule a link out.  Connected components need no more, and no link is lost.

No shingle's classes have to fit in one task.  Shingles that are frequent within
slices of the input are counted over all slices; those beyond a bound are known to
be shared and bypass the count.  Long posting lists are cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .tables import maybe_broadcast, stored

U = np.uint64
#: Shingles dealt to one group of the shuffle by shingle, classes to one of that by class, postings to one that pairs them.
TOKENS_A_PART = 1_500_000
CLASSES_A_PART = 10_000
POSTINGS_A_PART = 50_000
#: Independent token orders, and rounds in which classes meet hubs.
ORDERS = 2
ROUNDS = 3
#: Classes of a posting list that are compared in one place.
LIST_ROWS = 20_000
#: Classes from which a shingle bypasses the count; it grows so that at most HOT_SHINGLES do.
HOT_CLASSES = 1_000_000
HOT_SHINGLES = 1_000_000


def shingle_sets(batch: pa.RecordBatch, words_each: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a batch: the slice, row numbers and shingle hashes (distinct, by row), and set sizes."""
    for part in A.slices(batch):
        data, offsets = A.utf8(part.column(part.schema.get_field_index("text")))
        data = A.LOWER[data]
        starts, ends, counts = A.words(data, offsets)
        hashes = A.word_hashes(data, starts, ends)
        rows = np.repeat(np.arange(len(counts)), counts)
        keep = A.inside(counts, words_each)
        grams, owner = A.window_hashes(hashes, words_each)[keep], rows[: len(keep)][keep]
        short = np.flatnonzero((counts > 0) & (counts < words_each))
        if len(short):
            firsts = (np.cumsum(counts) - counts)[short]
            grams = np.concatenate([grams, A.span_hashes(hashes, firsts, firsts + counts[short])])
            owner = np.concatenate([owner, short])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        if len(grams):
            new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]
            grams, owner = grams[new], owner[new]
        yield part, owner, grams, np.bincount(owner, minlength=part.num_rows)


def set_keys(owner: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key of each set that does not depend on order; empty sets get 0."""
    total = np.zeros(len(grams) + 1, U)
    np.cumsum(A.mix(grams ^ U(0x5851F42D4C957F2D)), out=total[1:])
    ends = np.cumsum(sizes)
    keys = A.mix(total[ends] - total[ends - sizes] + sizes.astype(U))
    return np.where(sizes > 0, keys | U(1), U(0))


def document_classes(docs: DataFrame, words_each: int = 5) -> DataFrame:
    """(doc_id, n_shingles, cls, often): the size and the class of each document's set, one row per row.

    The first row of a slice has in ``often`` the shingles that several of the
    slice's classes hold, and their numbers of classes; all others have null.
    """
    schema = "doc_id long, n_shingles long, cls long, often binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, owner, grams, sizes in shingle_sets(batch, words_each):
                keys = set_keys(owner, grams, sizes)
                values, counts = np.unique(grams[_once(keys)[owner]], return_counts=True)
                often = np.concatenate([values[counts > 1], counts[counts > 1].astype(U)]).tobytes()
                columns = [part.column(0), pa.array(sizes.astype(np.int64)), pa.array(keys.view(np.int64)), pa.array([often or None] + [None] * (part.num_rows - 1), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "cls", "often"])
        A.release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _once(keys: np.ndarray) -> np.ndarray:
    """The first of equal values."""
    _, firsts = np.unique(keys, return_index=True)
    once = np.zeros(len(keys), bool)
    once[firsts] = True
    return once


def hot_shingles(rows: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that slices with several of their classes count ``least`` times together, and octaves of their counts.

    A count holds the class of copies in several slices once for each, so there
    are at most (shingles of all rows) / ``least`` of them.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for often in batch.column(0):
                both = np.frombuffer(often.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[: len(both) // 2]), pa.array(both[len(both) // 2 :])], names=["token", "n"])

    counted = rows.where("often is not null").select("often").mapInArrow(unpack, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= least).toPandas().sort_values("token", key=lambda t: t.astype(np.uint64))
    return found["token"].to_numpy(np.int64).view(U), np.log2(np.maximum(found["n"].to_numpy(np.int64), 1)).astype(np.uint8)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def _blobs(part: np.ndarray, cls: np.ndarray, size: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """Cut rows sorted by (part, cls) into one row per part: heads (class, size, count) and the rows' values."""
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        starts, counts = _runs(cls[lo:hi])
        head = np.concatenate([cls[lo:hi][starts], (size[lo:hi][starts].astype(U) << U(32)) | counts.astype(U)])
        yield int(part[lo]), head.tobytes(), *(v[lo:hi] for v in values)


def _heads(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Class and size of every row that a head describes."""
    head = np.frombuffer(blob, U)
    cls, packed = head[: len(head) // 2], head[len(head) // 2 :]
    counts = (packed & U(0xFFFFFFFF)).astype(np.int64)
    return np.repeat(cls, counts), np.repeat((packed >> U(32)).astype(np.int64), counts)


def known_at(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a sorted array, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def shared_shingles(docs: DataFrame, n_tokens: int, n_classes: int, threshold: Fraction, words_each: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(cls, n, tokens, levels) of the classes that may have a partner.

    ``tokens`` are the shared shingles (uint64, ascending), ``levels`` the octaves
    of their class counts; n is the size of the whole set.  ``hot`` are shingles
    that are known to be shared, and their levels: their rows are dealt by class.
    """
    parts = max(1, -(-n_tokens // TOKENS_A_PART))
    known = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOT_SHINGLES
    class_parts = max(1, -(-n_classes // CLASSES_A_PART))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, owner, grams, sizes in shingle_sets(batch, words_each):
                keys = set_keys(owner, grams, sizes)
                once = _once(keys)  # copies within a slice count once
                grams, owner = grams[once[owner]], owner[once[owner]]
                if not len(grams):
                    continue
                part = (((grams >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
                is_hot, _ = known_at(known.value[0], grams)
                part[is_hot] = -1 - ((keys[owner[is_hot]] >> U(32)) % U(parts)).astype(np.int64)
                order = np.lexsort((owner, part))
                part, grams, owner = part[order], grams[order], owner[order]
                rows = [(p, h, g.tobytes()) for p, h, g in _blobs(part, keys[owner], sizes[owner], grams)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], names=["part", "head", "body"])
        A.release()

    def by_token(key: tuple, table: pa.Table) -> pa.Table:
        A.release()
        heads = [_heads(x.as_py()) for x in table["head"]]
        cls, size = np.concatenate([h[0] for h in heads]), np.concatenate([h[1] for h in heads])
        token = np.concatenate([np.frombuffer(x.as_buffer(), U) for x in table["body"]])
        order = np.lexsort((cls, token))
        token, cls, size = token[order], cls[order], size[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]
        token, cls, size = token[new], cls[new], size[new]
        if key[0].as_py() < 0:
            level = known.value[1][known_at(known.value[0], token)[1]]
        else:
            starts, counts = _runs(token)
            counts = np.repeat(counts, counts)
            many = counts > 1
            token, cls, size, level = token[many], cls[many], size[many], np.log2(counts[many]).astype(np.uint8)
        part = (A.mix(cls) >> U(40)) % U(class_parts)
        order = np.lexsort((cls, part))
        rows = [(p, h, t.tobytes(), v.tobytes()) for p, h, t, v in _blobs(part[order], cls[order], size[order], token[order], level[order])]
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "head", "tokens", "levels"])

    def by_class(table: pa.Table) -> pa.Table:
        A.release()
        heads = [_heads(x.as_py()) for x in table["head"]]
        cls, size = np.concatenate([h[0] for h in heads]), np.concatenate([h[1] for h in heads])
        token = np.concatenate([np.frombuffer(x.as_py(), U) for x in table["tokens"]])
        level = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table["levels"]])
        order = np.lexsort((token, cls))
        cls, size, token, level = cls[order], size[order], token[order], level[order]
        out = []
        for lo, count in zip(*(x.tolist() for x in _runs(cls)), strict=True):
            n = int(size[lo])
            if count * threshold.denominator >= threshold.numerator * n:
                out.append((int(cls[lo].view(np.int64)), n, token[lo : lo + count].tobytes(), level[lo : lo + count].tobytes()))
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["cls", "n", "tokens", "levels"])

    dealt = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(deal, "part long, head binary, body binary")
    shared = dealt.groupBy("part").applyInArrow(by_token, "part long, head binary, tokens binary, levels binary")
    return shared.groupBy("part").applyInArrow(by_class, "cls long, n long, tokens binary, levels binary")


def ordered(token: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """Positions of the shingles under one global order: rare first, ties by that order's own hash."""
    return np.lexsort((A.mix(token ^ U(0x9E37 + 0x1000193 * order)), level))


def postings(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(ord, token, cls, n, own): the shared shingles in each class's prefix under every order; own: its unshared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for cls, n, tokens, levels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                token, level = np.frombuffer(tokens, U), np.frombuffer(levels, np.uint8)
                own = n - len(token)
                need = -(-n * threshold.numerator // threshold.denominator)
                length = n - need + 1 - own  # unshared shingles stand first under every order
                for k in range(ORDERS):
                    head = token[ordered(token, level, k)[:length]]
                    for out, value in zip(cols, (k, None, cls, n, own), strict=True):
                        out.append(head.view(np.int64) if value is None else np.full(len(head), value, np.int64))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["ord", "token", "cls", "n", "own"])

    return sets.mapInArrow(run, "ord long, token long, cls long, n long, own long")


def _distinct_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def hub_pairs(near: DataFrame, first: bool, threshold: Fraction) -> DataFrame:
    """(a, b): under each order, each class with the hub that most of its posting lists name, one row at most.

    ``near`` has ord, token, cls, n, own and comp.  A list's hub for a class is the
    list's leading class of another component: the least edited in the first round,
    in later ones any by a hash, as the least edited was tried.
    """
    lead = F.struct(F.col("own") if first else F.xxhash64("cls", F.lit("hub")), "cls", "n", "comp")
    one = near.groupBy("ord", "token").agg(F.min(lead).alias("one"))
    led = near.join(one, ["ord", "token"])
    two = led.where("comp <> one.comp").groupBy("ord", "token").agg(F.min(lead).alias("two"))
    met = led.join(two, ["ord", "token"], "left").withColumn("hub", F.when(F.expr("comp <> one.comp"), F.col("one")).otherwise(F.col("two")))
    num, den = threshold.numerator, threshold.denominator
    met = met.where(f"hub is not null and hub.n * {den} >= {num} * n and n * {den} >= {num} * hub.n").select("ord", "cls", F.col("hub.cls").alias("hub"))
    votes = met.groupBy("ord", "cls", "hub").count()
    best = votes.groupBy("ord", "cls").agg(F.max(F.struct("count", "hub")).alias("best"))
    return best.select(F.least("cls", "best.hub").alias("a"), F.greatest("cls", "best.hub").alias("b")).distinct()


def mixed(posted: DataFrame, roots: DataFrame) -> DataFrame:
    """The posting lists that hold classes of several components, with comp."""
    near = posted.join(maybe_broadcast(roots.withColumnRenamed("v", "cls"), 16), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    lists = near.groupBy("ord", "token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("ord", "token")
    return near.join(lists, ["ord", "token"])


def bitmaps(sets: DataFrame) -> DataFrame:
    """(cls, bits): the parity of each class's shared shingles per bit, about four bits a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tokens in batch.column(1):
                token = A.mix(np.frombuffer(tokens.as_buffer(), U))
                width = max(128, 1 << (4 * len(token) - 1).bit_length())
                flips = np.bincount((token & U(width - 1)).astype(np.int64), minlength=width) & 1
                out.append(np.packbits(flips.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["cls", "bits"])

    return sets.select("cls", "tokens").mapInArrow(run, "cls long, bits binary")


def _unconnected(cls: np.ndarray, n: np.ndarray, own: np.ndarray, comp: np.ndarray, bits: list, few: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group from different components that sizes and bitmaps allow to link.

    A member of ``first`` that is one of ``few`` meets those of ``second``; where both are
    the whole group, each pair is looked at once.  Two sets differ in at least their
    unshared shingles and the bits in which their parities differ.  Bitmaps of
    neighbouring widths meet at the narrower one.
    """
    num, den = threshold.numerator, threshold.denominator
    widths = np.array([len(b) for b in bits])
    for width in np.unique(widths):
        same, wider = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
        index = np.concatenate([same, wider])
        rows = np.zeros((len(index), width // 8), U)
        for at, i in enumerate(index.tolist()):
            raw = np.frombuffer(bits[i], U)
            rows[at] = raw if at < len(same) else raw[: width // 8] ^ raw[width // 8 :]
        c, m, o, p, to = cls[index], n[index], own[index], comp[index], second[index]
        narrow = np.arange(len(index)) < len(same)
        done = np.zeros(len(index), bool)
        for i in np.flatnonzero((few & first)[index]).tolist():
            j = np.flatnonzero((p != p[i]) & to & ~done & (narrow | narrow[i]))
            done[i] = True
            j = j[(m[j] * den >= num * m[i]) & (m[i] * den >= num * m[j])]
            apart = np.bitwise_count(rows[j] ^ rows[i]).sum(1, dtype=np.int64) + o[j] + o[i]
            j = j[apart * (den + num) <= (den - num) * (m[j] + m[i])]
            if len(j):
                yield np.full(len(j), c[i]), c[j]


def in_blocks(near: DataFrame, list_rows: int) -> tuple[DataFrame, int]:
    """``near`` with few, cell, lo and hi, and its number of rows: each pair of a list's members from different components is in one group.

    A list of up to ``list_rows`` members is one group.  The members of a longer one are
    dealt to cells of half that size, and every two cells make a group (lo, hi), as does each
    alone.  If one component fills more than a cell, its members have cells of their own,
    which only meet those of the others.  ``few`` is 1 for members that look for
    partners, -1 where a group holds its whole list and finds that out itself.
    Long lists are at most one for each ``list_rows`` postings.
    """
    half = f"{list_rows} / 2"
    lists = near.groupBy("ord", "token", "comp").count().groupBy("ord", "token").agg(F.max(F.struct("count", "comp")).alias("big"), F.sum("count").alias("total")).where(F.col("total") > list_rows)
    split = lists.select("ord", "token", "total", "big.*").withColumn("apart", F.expr(f"count > {half}")).withColumn("others", F.expr("total - if(apart, count, 0)"))
    split = split.withColumns({"fewer": F.expr(f"cast(greatest(1, ceil(others / ({half}))) as int)"), "mains": F.expr(f"cast(if(apart, ceil(count / ({half})), 0) as int)")})
    long = stored(split.select("ord", "token", F.when(F.col("apart"), F.col("comp")).alias("main"), "total", "others", "fewer", "mains"))
    extra = long.agg(F.coalesce(F.sum(F.expr("others * (fewer + mains) + (total - others) * fewer - total")), F.lit(0))).first()[0]
    joined = near.join(maybe_broadcast(long.drop("total", "others"), 64), ["ord", "token"], "left")
    main = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    place = F.xxhash64("cls")
    cell = F.when(F.col("fewer").isNull(), 0).when(main, F.col("fewer") + F.pmod(place, "mains")).otherwise(F.pmod(place, "fewer")).cast("int")
    last = F.when(F.col("fewer").isNull(), 0).when(main, F.col("fewer") - 1).otherwise(F.col("fewer") + F.col("mains") - 1)
    dealt = joined.withColumns({"few": F.when(F.col("fewer").isNull(), -1).otherwise((~main).cast("int")), "cell": cell, "_other": F.explode(F.sequence(F.lit(0), last))})
    dealt = dealt.withColumns({"lo": F.least("cell", "_other"), "hi": F.greatest("cell", "_other")})
    return dealt.drop("main", "fewer", "mains", "_other"), near.count() + extra


def remaining_pairs(near: DataFrame, groups: int, threshold: Fraction) -> DataFrame:
    """(ord, a, b): all candidate pairs by order that are not yet connected.

    ``near`` has ord, token, cls, n, own, comp, bits, few, cell, lo and hi.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        A.release()
        token, cls, n, own, comp, few, cell, low, high = (table[c].to_numpy() for c in ("token", "cls", "n", "own", "comp", "few", "cell", "lo", "hi"))
        bits = table["bits"].combine_chunks()
        left, right, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        order = np.lexsort((cls, high, low, token))
        lists = np.stack([token[order], low[order], high[order]], 1)
        cuts = np.flatnonzero(np.r_[True, (lists[1:] != lists[:-1]).any(1), True]) if len(lists) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = order[lo:hi]
            looking = few[at] == 1
            if few[at[0]] < 0:  # the whole list: its largest component need not look for the others
                names, counts = np.unique(comp[at], return_counts=True)
                looking = comp[at] != names[np.argmax(counts)]
            first, second = cell[at] == low[at], cell[at] == high[at]
            for a, b in _unconnected(cls[at], n[at], own[at], comp[at], [bits[i].as_buffer() for i in at.tolist()], looking, first, second, threshold):
                left.append(a)
                right.append(b)
                held += len(a)
            if held > 1_000_000:
                a, b = _distinct_pairs(left, right)
                left, right, held = [a], [b], 0
        a, b = _distinct_pairs(left, right)
        return pa.table({"ord": np.full(len(a), key[0].as_py(), np.int64), "a": a, "b": b})

    dealt = near.withColumn("part", F.pmod(F.xxhash64("token", "lo", "hi"), F.lit(groups)))
    return dealt.groupBy("ord", "part").applyInArrow(run, "ord long, a long, b long")


def candidates(near: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): pairs of different components that share a prefix shingle under every order; ``near`` has ord, token, cls, n, own and comp."""
    dealt, rows = in_blocks(near, LIST_ROWS)
    pairs = remaining_pairs(dealt.join(bitmaps(sets), "cls"), max(1, -(-rows // POSTINGS_A_PART)), threshold)
    return pairs.groupBy("a", "b").agg(F.count_distinct("ord").alias("orders")).where(F.col("orders") == ORDERS).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): the pairs whose whole sets reach the threshold.  Unshared shingles lie in no intersection."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ta, tb = (batch.column(i) for i in range(6))
            sizes = na.to_numpy() + nb.to_numpy()
            common = np.fromiter(
                (len(np.intersect1d(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), assume_unique=True)) for x, y in zip(ta, tb, strict=True)), np.int64, len(sizes)
            )
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(common * den >= num * (sizes - common)))
        A.release()

    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long")


def linked_classes(docs: DataFrame, rows: DataFrame, classes: DataFrame, limit: Fraction, words_each: int) -> DataFrame:
    """(v, root): the classes with a link, and one of each component."""
    n_classes, n_tokens = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    hot = hot_shingles(rows, max(HOT_CLASSES, total // HOT_SHINGLES))
    sets = stored(shared_shingles(docs, n_tokens, n_classes, limit, words_each, hot))
    posted = stored(postings(sets, limit))
    near, roots, links = posted.withColumn("comp", F.col("cls")), None, docs.sparkSession.createDataFrame([], "a long, b long")
    for turn in range(ROUNDS):
        met = stored(verified(hub_pairs(near, turn == 0, limit), sets, limit))
        found = met.count()
        if found:
            links = links.union(met)
            roots = components(links)
            near = stored(mixed(posted, roots))
        if found * 50 < n_classes:  # few links are left to find
            break
    more = stored(verified(candidates(near, sets, limit), sets, limit))
    return components(links.union(more)) if roots is None or not more.isEmpty() else roots


def linked_pairs(docs: DataFrame, threshold: str = "3/4", words_each: int = 5) -> DataFrame:
    """(a, b): all pairs of classes that link, a below b; ``document_classes`` has the classes' members.

    The whole join, between different sets: a group of near copies with m different
    sets gives up to m * m / 2 rows.
    """
    limit = Fraction(threshold)
    rows = stored(document_classes(docs, words_each))
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(F.max("n_shingles").alias("n"))
    n_classes, n_tokens = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = hot_shingles(rows, max(HOT_CLASSES, n_tokens // HOT_SHINGLES))
    sets = stored(shared_shingles(docs, n_tokens, n_classes, limit, words_each, hot))
    near = stored(postings(sets, limit)).withColumn("comp", F.col("cls"))
    return verified(candidates(near, sets, limit), sets, limit)


def jaccard_components(docs: DataFrame, threshold: str = "3/4", words_each: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    ``docs`` needs doc_id and text; other columns are ignored.  Texts are
    lower-cased (A-Z) and cut at ASCII white space; a text of fewer than
    ``words_each`` words is one shingle.  Null and empty texts have no shingles and
    link with nothing.  Two documents link when their Jaccard similarity is at
    least ``threshold``; component_id is the smallest doc_id that links reach.
    Repeated rows each come back; null doc_ids are kept and win no minimum.
    Shingles and classes are told apart by 64-bit hashes.  An empty table gives no rows.
    """
    rows = stored(document_classes(docs, words_each))
    classes = stored(rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.max("n_shingles").alias("n")))
    ids = classes
    if not classes.isEmpty():
        roots = linked_classes(docs, rows, classes, Fraction(threshold), words_each)
        rooted = classes.join(roots.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
        lows = rooted.groupBy("root").agg(F.min("low").alias("low"))
        ids = rooted.drop("low").join(lows, "root")
    ids = stored(ids.select("cls", F.col("low").alias("component_id")))
    return rows.join(maybe_broadcast(ids, 24), "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame, threshold: str = "3/4", words_each: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the smallest doc_id.

    All columns stay.  Of repeated rows (equal doc_id and text) one stays.  Rows
    with a null doc_id cannot be named by others and stay.
    """
    found = stored(jaccard_components(docs, threshold, words_each))
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_siftline_id")).distinct())
    kept = docs.join(maybe_broadcast(gone, 16), F.col("doc_id") == F.col("_siftline_id"), "left_anti")
    rows, ids = found.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    return kept.dropDuplicates(["doc_id", "text"]) if rows > ids else kept
