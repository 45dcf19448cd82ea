"""Language-model scoring by context-tree weighting over bytes.

Training counts every (DEPTH + 1)-gram of the normalised training bytes, all of
them.  A byte is eight binary decisions, so a context of d bytes holds a small tree
of binary nodes; each node has a Krichevsky-Trofimov estimate from its zeros and
ones, and its weighted probability is half that estimate and half the product of
the weighted probabilities one byte deeper.  Scoring mixes the estimates of all
depths along the path of each byte's context, from the deepest node that training
saw.

No table of all nodes is ever held in one place.  Documents are dealt to chunks, and
a chunk asks for each distinct gram and word of its texts once, with its count in
training texts.  The asked keys are summed over all chunks by a hash of the whole
key, so that what is frequent is a row for each chunk at most.  The distinct grams
are then dealt by their two most recent context bytes, so that whole subtrees lie in
one part.  A first pass over these parts adds up what contexts of one and no byte
need, at most 255 * 257 nodes; a second weights each part's subtrees again and gives
every gram its probability, and the answers join the chunks that asked and their
texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .tables import row_key, stored

U = np.uint64
DEPTH = 5
#: Text whose distinct grams and words are asked for together, and text for each part of them.
CHUNK_BYTES = 16 << 20
PART_BYTES = 8 << 20
#: Grams whose subtrees are weighted at once, unless one pair of context bytes has more.
BLOCK_GRAMS = 100_000
_LN10 = math.log(10.0)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Lower-case bytes with runs of white space as one space, trimmed, and a zero byte at each end; new offsets; words."""
    data = A.LOWER[data]
    starts, ends, counts = A.words(data, offsets)
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), counts)
    lengths = ends - starts + 1  # each word and one byte after it
    sizes = np.bincount(owner, lengths, rows).astype(np.int64)
    sizes[counts == 0] = 1
    out_offsets = np.r_[0, np.cumsum(sizes)]
    out = np.full(out_offsets[-1], 32, np.uint8)
    if len(starts):
        before = np.cumsum(lengths) - lengths
        first = np.repeat(np.cumsum(counts) - counts, counts)
        at = out_offsets[:-1][owner] + before - before[first]
        solid = ends - starts
        step = np.arange(int(solid.sum())) - np.repeat(np.cumsum(solid) - solid, solid)
        out[np.repeat(at, solid) + step] = data[np.repeat(starts, solid) + step]
    out[out_offsets[1:] - 1] = 0
    return out, out_offsets, (A.word_hashes(data, starts, ends), owner, counts)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the DEPTH bytes before it (zeros before a row) and itself, packed; the byte is lowest."""
    out = data.astype(U)
    n = len(data)
    since = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, DEPTH + 1):
        prior = np.zeros(n, U)
        prior[back:] = data[: max(0, n - back)]
        prior[since < back] = 0
        out |= prior << U(8 * back)
    return out


def _near(gram: np.ndarray) -> np.ndarray:
    """The two most recent context bytes."""
    return (gram >> U(8)) & U(65535)


#: Kinds of asked keys, and the bytes of one.
GRAM, WORD = 0, 1
WIDTH = {GRAM: DEPTH + 1, WORD: 8}


def _pack(key: np.ndarray, kind: int) -> bytes:
    return np.ascontiguousarray(key.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : WIDTH[kind]].tobytes()


def _unpack(column: pa.ChunkedArray, kind: int) -> np.ndarray:
    """The keys of all rows' blobs, one after the other."""
    raw = b"".join(x.as_py() for x in column)
    out = np.zeros((len(raw) // WIDTH[kind], 8), np.uint8)
    out[:, : WIDTH[kind]] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH[kind])
    return out.view("<u8").reshape(-1)


def _numbers(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    keys, inverse = np.unique(key, return_inverse=True)
    return keys, np.bincount(inverse, n, len(keys)).astype(np.int64)


def _groups(group: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """Each group and its values, in the order of groups."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(group[lo]), *(v[order[lo:hi]] for v in values)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((A.mix(key) >> U(32)) * U(parts)) >> U(32)


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})


def asked_keys(texts: DataFrame, parts: int) -> DataFrame:
    """(kind, part, chunk, keys, n): the distinct grams and words of each chunk's texts by part, packed, and their counts in training texts.

    ``texts`` has chunk, held_out and text.
    """

    def run(table: pa.Table) -> pa.Table:
        A.release()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], WORD: []}

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate([h[i] for h in held[kind]]) for i in range(2)))

        for batch in table.select(["held_out", "text"]).to_batches():
            for part in A.slices(batch, most=1 << 20):
                data, offsets, (words, owner, _) = normalised(*A.utf8(part.column(1)))
                learns = ~part.column(0).to_numpy(zero_copy_only=False).astype(bool)
                for kind, keys, row in ((GRAM, grams(data, offsets), np.repeat(np.arange(len(learns)), np.diff(offsets))), (WORD, words, owner)):
                    held[kind].append(_summed(keys, learns[row].astype(np.int64)))
                    if sum(len(h[0]) for h in held[kind]) > 2_000_000:
                        held[kind] = [merged(kind)]
        chunk, out = table["chunk"][0].as_py(), []
        for kind in (GRAM, WORD):
            key, n = merged(kind)
            out += [(kind, part, chunk, _pack(k, kind), m.astype("<u4").tobytes()) for part, k, m in _groups(_part(key, parts), key, n)]
        return _table(out, kind=pa.int64(), part=pa.int64(), chunk=pa.int64(), keys=pa.binary(), n=pa.binary())

    return texts.groupBy("chunk").applyInArrow(run, "kind long, part long, chunk long, keys binary, n binary")


def counted_keys(asked: DataFrame, parts: int) -> DataFrame:
    """(kind, part, keys, n, total, seen): all distinct keys with their counts in training texts, grams dealt by their two latest
    context bytes; the sum of the row's counts, and how many are not 0."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        A.release()
        kind = key[0].as_py()
        keys, n = _summed(_unpack(table["keys"], kind), _numbers(table["n"], "<u4"))
        part = _part(_near(keys), parts) if kind == GRAM else np.full(len(keys), key[1].as_py())
        rows = [(kind, p, _pack(k, kind), m.astype("<i8").tobytes(), int(m.sum()), int((m > 0).sum())) for p, k, m in _groups(part, keys, n)]
        return _table(rows, kind=pa.int64(), part=pa.int64(), keys=pa.binary(), n=pa.binary(), total=pa.int64(), seen=pa.int64())

    return asked.select("kind", "part", "keys", "n").groupBy("kind", "part").applyInArrow(run, "kind long, part long, keys binary, n binary, total long, seen long")


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log-gamma for arguments of 1/2 and more: Stirling's series after shifting small ones up."""
    x = x.astype(float)
    shift = np.zeros_like(x)
    small = x < 8
    while small.any():
        shift[small] += np.log(x[small])
        x = np.where(small, x + 1, x)
        small = x < 8
    inv = 1 / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + inv / 12 - inv**3 / 360 + inv**5 / 1260 - shift


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    half = 2 * math.lgamma(0.5)
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - half - _lgamma(zeros + ones + 1)


def nodes_of(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary nodes (context << 8 | prefix with a leading one), ascending, and their zeros and ones."""
    keys, bits = [], []
    for depth in range(8):
        prefix = (U(1) << U(depth)) | (byte >> U(8 - depth))
        keys.append((context << U(8)) | prefix)
        bits.append((byte >> U(7 - depth)) & U(1))
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.tile(n, 8).astype(float)
    bit = np.concatenate(bits).astype(bool)
    ones = np.bincount(inverse, weight * bit, len(key))
    return key, np.bincount(inverse, weight, len(key)) - ones, ones


def _weighted(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of each node, and the log odds of its own estimate against the deeper ones."""
    own = kt(zeros, ones)
    if below is None:  # the deepest contexts have their estimate only
        return own, np.full(len(own), np.inf)
    top = np.maximum(own, below)
    return top + np.log(np.exp(own - top) + np.exp(below - top)) - math.log(2), own - below


def _parents(key: np.ndarray, depth: int) -> np.ndarray:
    """The nodes one byte of context shallower: the oldest byte of a context of ``depth`` bytes goes."""
    mask = (U(1) << U(8 * depth)) - U(1)
    return key & mask


Nodes = tuple[np.ndarray, np.ndarray, np.ndarray]


def subtrees(gram: np.ndarray, n: np.ndarray) -> tuple[list[Nodes], np.ndarray, np.ndarray]:
    """Of all training grams of some pairs of context bytes: by depth from DEPTH to 2 the nodes, their estimates of a one and
    log odds; and the nodes one byte shallower with the sums of the weights under them."""
    byte, out, below, sums = gram & U(255), [], None, None
    for depth in range(DEPTH, 1, -1):
        context = (gram >> U(8)) & ((U(1) << U(8 * depth)) - U(1))
        key, zeros, ones = nodes_of(context, byte, n)
        if sums is not None:
            below = sums[1][np.searchsorted(sums[0], key)]
        weight, odds = _weighted(key, zeros, ones, below)
        out.append((key, (ones + 0.5) / (zeros + ones + 1), odds))
        parent, inverse = np.unique(_parents(key, depth), return_inverse=True)
        sums = parent, np.bincount(inverse, weight, len(parent))
    return out, *sums


def _blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A part's distinct grams, ascending, and their training counts, in blocks of whole pairs of context bytes."""
    gram, n = _unpack(table["keys"], GRAM), _numbers(table["n"], "<i8")
    order = np.lexsort((gram, _near(gram)))
    near = _near(gram[order])
    cuts = [*np.flatnonzero(np.r_[True, near[1:] != near[:-1]]).tolist(), len(near)]
    start = 0
    for cut, after in zip(cuts[1:], [*cuts[2:], None], strict=True):
        if after is None or after - start > BLOCK_GRAMS:
            yield gram[order[start:cut]], n[order[start:cut]]
            start = cut


def shallow(counted: DataFrame) -> list[Nodes]:
    """Nodes of one and no context byte, at most 255 * 257, from sums of the rest."""

    def run(table: pa.Table) -> pa.Table:
        A.release()
        pairs, nodes = [], []
        for gram, n in _blocks(table):
            seen = n > 0
            if seen.any():
                pairs.append(_summed(gram[seen] & U(65535), n[seen]))
                nodes.append(subtrees(gram[seen], n[seen])[1:])
        columns = [np.concatenate([x[i] for x in rows]) if rows else np.zeros(0, kind) for rows in (pairs, nodes) for i, kind in enumerate((U, float))]
        kind = np.repeat([0, 1], [len(columns[0]), len(columns[2])])
        return pa.table({"kind": kind.astype(np.int64), "node": np.concatenate([columns[0], columns[2]]).astype(np.int64), "value": np.concatenate([columns[1], columns[3]]).astype(float)})

    rows = counted.where(F.col("kind") == GRAM).select("part", "keys", "n").groupBy("part").applyInArrow(run, "kind long, node long, value double")
    both = rows.groupBy("kind", "node").agg(F.sum("value").alias("value")).orderBy("kind", "node").toPandas()
    (gram, n), sums = ((x["node"].to_numpy(np.int64).view(U), x["value"].to_numpy()) for x in (both[both["kind"] == k] for k in (0, 1)))
    out = []
    for depth in (1, 0):
        context = (gram >> U(8)) & ((U(1) << U(8 * depth)) - U(1))
        key, zeros, ones = nodes_of(context, gram & U(255), n)
        weight, odds = _weighted(key, zeros, ones, sums[1][np.searchsorted(sums[0], key)])
        out.append((key, (ones + 0.5) / (zeros + ones + 1), odds))
        up, inverse = np.unique(_parents(key, depth), return_inverse=True)
        sums = up, np.bincount(inverse, weight, len(up))
    return out


def log10_probs(gram: np.ndarray, tables: list[Nodes]) -> np.ndarray:
    """Log10 probability of each gram's last byte after the bytes before it, from the nodes of all depths, deepest first."""
    byte, out = gram & U(255), np.zeros(len(gram))
    for at in range(8):
        prefix = (U(1) << U(at)) | (byte >> U(8 - at))
        one = ((byte >> U(7 - at)) & U(1)).astype(bool)
        p, deeper = np.full(len(gram), 0.5), np.zeros(len(gram), bool)
        for depth, (key, own, odds) in zip(range(DEPTH, -1, -1), tables, strict=True):
            if not len(key):
                continue
            node = (((gram >> U(8)) & ((U(1) << U(8 * depth)) - U(1))) << U(8)) | prefix
            slot = np.minimum(np.searchsorted(key, node), len(key) - 1)
            known = key[slot] == node
            # A share of own / (own + deeper); all of it where nothing deeper was seen.
            share = np.where(deeper, 1 / (1 + np.exp(-np.clip(odds[slot], -500, 500))), 1.0)
            p = np.where(known, share * own[slot] + (1 - share) * p, p)
            deeper |= known
        out += np.log10(np.where(one, p, 1 - p))
    return out


def answers(asked: DataFrame, counted: DataFrame, parts: int) -> DataFrame:
    """(kind, chunk, keys, values): what each chunk asked for, grams with their log10 probabilities and words with their counts."""
    shared = asked.sparkSession.sparkContext.broadcast(shallow(counted))  # at most 255 * 257 nodes
    schema = "kind long, part long, keys binary, values binary"
    kinds = {"kind": pa.int64(), "part": pa.int64(), "keys": pa.binary(), "values": pa.binary()}

    def weigh(key: tuple, table: pa.Table) -> pa.Table:
        A.release()
        if key[0].as_py() == WORD:
            return pa.table([table["kind"], table["part"], table["keys"], pa.array([x.as_py() for x in table["n"]], pa.binary())], names=list(kinds))
        rows = []
        for gram, n in _blocks(table):
            seen = n > 0
            logs = log10_probs(gram, [*subtrees(gram[seen], n[seen])[0], *shared.value]).astype("<f4")
            rows += [(GRAM, p, _pack(g, GRAM), x.tobytes()) for p, g, x in _groups(_part(gram, parts), gram, logs)]
        return _table(rows, **kinds)

    def look_up(key: tuple, asking: pa.Table, known: pa.Table) -> pa.Table:
        A.release()
        kind = key[0].as_py()
        keys, values = _unpack(known["keys"], kind), _numbers(known["values"], "<f4" if kind == GRAM else "<i8")
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        out = [values[np.searchsorted(keys, _unpack(asking["keys"].slice(i, 1), kind))].tobytes() for i in range(len(asking))]
        return pa.table({"kind": asking["kind"], "chunk": asking["chunk"], "keys": asking["keys"], "values": pa.array(out, pa.binary())})

    valued = counted.select("kind", "part", "keys", "n").groupBy("kind", "part").applyInArrow(weigh, schema)
    by = asked.select("kind", "part", "chunk", "keys").groupBy("kind", "part")
    return by.cogroup(valued.groupBy("kind", "part")).applyInArrow(look_up, "kind long, chunk long, keys binary, values binary")


def code_lengths(docs: DataFrame, answered: DataFrame) -> DataFrame:
    """doc_id, held_out, n_words, n_bytes, known, logs, score: of each row the words seen in training, the sum of
    log10(count + 1) of its words, and the log10 probability of its normalised bytes and end."""
    names = ["doc_id", "held_out", "n_words", "n_bytes", "known", "logs", "score"]

    def run(table: pa.Table, texts: pa.Table) -> pa.Table:
        A.release()
        known = {}
        for kind, number in ((GRAM, "<f4"), (WORD, "<i8")):
            mine = table.filter(pc.equal(table["kind"], kind))
            keys, values = _unpack(mine["keys"], kind), _numbers(mine["values"], number)
            order = np.argsort(keys)
            known[kind] = keys[order], values[order]
        find = lambda kind, key: known[kind][1][np.searchsorted(known[kind][0], key)].astype(float)
        out = []
        for batch in texts.select(["doc_id", "held_out", "text"]).to_batches():
            for part in A.slices(batch, most=1 << 20):
                data, offsets, (words, owner, counts) = normalised(*A.utf8(part.column(2)))
                sizes, rows = np.diff(offsets), part.num_rows
                score = np.bincount(np.repeat(np.arange(rows), sizes), find(GRAM, grams(data, offsets)), rows)
                c = find(WORD, words)
                seen, logs = np.bincount(owner, c > 0, rows).astype(np.int64), np.bincount(owner, np.log10(c + 1), rows).astype(float)
                out.append(pa.RecordBatch.from_arrays([*part.columns[:2], *map(pa.array, (counts.astype(np.int64), sizes.astype(np.int64), seen, logs, score))], names=names))
        return pa.Table.from_batches(out)

    by = docs.select("doc_id", "held_out", "text", "chunk").groupBy("chunk")
    return answered.groupBy("chunk").cogroup(by).applyInArrow(run, "doc_id long, held_out boolean, n_words long, n_bytes long, known long, logs double, score double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; one row per row.

    ``docs`` needs doc_id, text and held_out; rows with held_out false are learned
    from, those with null count as held out.  A null or empty text is its end token
    alone.  Repeated rows count each in training and get equal results; those with
    equal doc_id and text share a chunk.  Without training rows all words are unknown
    and the model is uniform.  An empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("held_out", F.lit(True)).alias("held_out"), row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = keyed.withColumn("chunk", F.pmod("key", F.lit(1 + size // CHUNK_BYTES)))
    parts = 1 + size // PART_BYTES
    asked = stored(asked_keys(dealt.select("chunk", "held_out", "text"), parts))
    counted = stored(counted_keys(asked, parts))
    lengths = stored(code_lengths(dealt, answers(asked, counted, parts)))
    ends = lengths.where("not held_out").count()
    words = counted.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen")).first()
    n, v = words.total + ends, words.seen + (1 if ends else 0)
    tokens = F.col("n_words") + 1
    return lengths.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + (1 if ends else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(ends + 1) - tokens * math.log10(n + v + 1)).alias("base_score"), "score",
        (-F.col("score") * (_LN10 / math.log(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
