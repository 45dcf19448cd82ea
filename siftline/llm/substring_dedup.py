"""Substring deduplication by seed and extend over winnowed anchors.

Seeds: of every 16 consecutive runs of SEED words, those with the smallest hash are
anchors.  A window of WINDOW = SEED + 15 words holds 16 such runs and chooses its
anchors from its own words alone, so equal windows anywhere share an anchor at the
same place.  One shuffle by anchor finds those that occur at least twice.

Extension: a shared anchor can belong to a repeat only through windows that contain
it, so each of its occurrences is extended to both sides, 15 words at most, and the
windows over the extension are matched by hash, again in one shuffle.  The windows
of one document that match elsewhere, put together, are its maximal repeats.

Anchors are told apart by 64 bits, as a false one only costs windows that then match
nothing.  Windows are told apart by 128: two hashes over words hashed by separately drawn
codes, so n windows hold a false pair with a chance of about n * n / 2**129.

No pairs of occurrences are formed, and two occurrences settle a window: a slice of
texts sends each of its windows once, however many of its documents share it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .tables import broadcast_if_small, row_key, stored

U = np.uint64
WINDOW, SEED = 35, 20
#: Hashes that one group of a shuffle holds.
HASHES_A_PART = 1_000_000

_HITS = "part long, head binary, body binary, check binary, pos binary"


def _twice(hashes: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair (hash, check) that occurs twice or more: all places, and the first place alone."""
    order = np.argsort(hashes, kind="stable") if checks is None else np.lexsort((checks, hashes))
    same = np.zeros(len(order) + 1, bool)
    h = hashes[order]
    same[1:-1] = h[1:] == h[:-1]
    if checks is not None:
        c = checks[order]
        same[1:-1] &= c[1:] == c[:-1]
    return order[same[1:] | same[:-1]], order[same[1:] & ~same[:-1]]


def _deal(part_count: int, keys: np.ndarray, owner: np.ndarray, hashes: np.ndarray, checks: np.ndarray | None, pos: np.ndarray) -> pa.RecordBatch:
    """Pack (row, hash, check, position) by the group of the hash: heads (key, count), hashes, checks and positions.

    Two occurrences settle a hash.  Those of a hash that this slice holds twice go, without
    hashes, to one more group that only hands them on; one of them stands for the slice in
    the group of the hash.  So a hash that many documents share costs its group a row a slice.
    """
    part = (((hashes >> U(44)) * U(part_count)) >> U(20)).astype(np.int64)
    settled, first = _twice(hashes, checks)
    alone = np.ones(len(hashes), bool)
    alone[settled] = False
    alone[first] = True
    asked = np.flatnonzero(alone)
    asked = asked[np.argsort(part[asked], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, part[asked[1:]] != part[asked[:-1]], True]) if len(asked) else np.zeros(1, int)
    rows = []

    def add(group: int, at: np.ndarray, answered: bool) -> None:
        who = owner[at]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        head = np.concatenate([keys[who[starts]], np.diff(np.r_[starts, len(at)]).astype(U)])
        body, check = (b"", b"") if answered else (hashes[at].tobytes(), b"" if checks is None else checks[at].tobytes())
        rows.append((group, head.tobytes(), body, check, pos[at].astype(np.uint32).tobytes()))

    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        add(int(part[asked[lo]]), asked[lo:hi], False)
    if len(settled):
        settled.sort()
        add(part_count + int(keys[owner[settled[0]]] % U(part_count)), settled, True)
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "head", "body", "check", "pos"])


def _repeated(dealt: DataFrame) -> DataFrame:
    """(key, pos) of all hashes that occur at least twice, in whichever rows; a place may come back twice."""

    def run(table: pa.Table) -> pa.Table:
        A.release()
        keys = []
        for blob in table["head"]:
            head = np.frombuffer(blob.as_py(), U)
            keys.append(np.repeat(head[: len(head) // 2], head[len(head) // 2 :].astype(np.int64)))
        key = np.concatenate(keys)
        whole = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[name]])
        hashes, checks, pos = whole("body", U), whole("check", U), whole("pos", np.uint32)
        twice = _twice(hashes, checks if len(checks) else None)[0] if len(hashes) else np.arange(len(pos))  # a group without hashes is settled
        twice = twice[np.lexsort((pos[twice], key[twice]))]
        return pa.table({"key": key[twice].view(np.int64), "pos": pos[twice].astype(np.int32)})

    return dealt.groupBy("part").applyInArrow(run, "key long, pos int")


def _intervals(hits: DataFrame, before: int, after: int) -> DataFrame:
    """(key, spans): the union of pos - before .. pos + after per row, as packed ascending (start, end) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for held in batch.column(1):
                pos = np.unique(held.values.to_numpy()).astype(np.int64)
                starts, ends = np.maximum(pos - before, 0), pos + after
                new = np.r_[True, starts[1:] > ends[:-1]]
                out.append(np.stack([starts[new], np.r_[ends[:-1][new[1:]], ends[-1]]], 1).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["span_key", "spans"])

    return hits.groupBy("key").agg(F.collect_list("pos").alias("pos")).mapInArrow(run, "span_key long, spans binary")


def _covered(size: int, blob: bytes | None) -> np.ndarray:
    """Which of ``size`` places packed spans cover."""
    step = np.zeros(size + 1, np.int32)
    if blob:
        spans = np.minimum(np.frombuffer(blob, np.uint32).reshape(-1, 2).astype(np.int64), size)
        np.add.at(step, spans[:, 0], 1)
        np.add.at(step, spans[:, 1], -1)
    return np.cumsum(step[:size]) > 0


def _hashed(part: pa.RecordBatch, checked: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Row keys, word counts, word hashes, each word's place in its row, and second hashes if asked, from columns key and text."""
    data, offsets = A.utf8(part.column(part.schema.get_field_index("text")))
    starts, ends, counts = A.words(data, offsets)
    place = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    return part.column(0).to_numpy().view(U), counts, A.word_hashes(data, starts, ends), place, A.word_hashes(data, starts, ends, A.CHECK_CODES) if checked else None


def winnowed(hashes: np.ndarray, counts: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors, and the hashes of all runs of ``seed`` words."""
    runs = A.window_hashes(hashes, seed)
    valid = A.inside(counts, window)
    many = window - seed + 1
    low = np.full(len(valid), U(0xFFFFFFFFFFFFFFFF))
    for k in range(many):
        np.minimum(low, runs[k : k + len(valid)], out=low)
    chosen = np.zeros(len(runs), bool)
    for k in range(many):
        chosen[k : k + len(valid)] |= valid & (low == runs[k : k + len(valid)])
    return np.flatnonzero(chosen), runs


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(span_key, spans): for each row that has any, its words inside repeated windows, as packed spans."""
    keyed = docs.select(row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    volume = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-volume // (6 * HASHES_A_PART)))  # about six bytes a word; anchors are an eighth of the words

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, most=2 << 20):
                keys, counts, hashes, place, _ = _hashed(part)
                at, runs = winnowed(hashes, counts, window, seed)
                owner = np.repeat(np.arange(len(counts)), counts)
                yield _deal(max(1, parts // 4), keys, owner[at], runs[at], None, place[at])
        A.release()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, most=2 << 20):
                keys, counts, hashes, place, second = _hashed(part, checked=True)
                starts = np.cumsum(counts) - counts
                near = np.zeros(len(hashes), bool)
                for i, blob in enumerate(part.column(2)):
                    near[starts[i] : starts[i] + counts[i]] = _covered(int(counts[i]), blob.as_py())
                valid = A.inside(counts, window)
                at = np.flatnonzero(valid & near[: len(valid)])
                owner = np.repeat(np.arange(len(counts)), counts)
                yield _deal(parts, keys, owner[at], A.window_hashes(hashes, window)[at], A.window_hashes(second, window)[at], place[at])
        A.release()

    anchors = _repeated(keyed.mapInArrow(seeds, _HITS))
    shared = stored(_intervals(anchors, window - seed, 1))  # starts of the windows that contain an anchor
    near = keyed.join(broadcast_if_small(shared), F.col("key") == F.col("span_key")).select("key", "text", "spans")
    windows = _repeated(near.mapInArrow(extend, _HITS))
    return stored(_intervals(windows, 0, window))


def _removed(docs: DataFrame, window: int, seed: int, schema: str, finish) -> DataFrame:
    spans = broadcast_if_small(repeats(docs, window, seed))
    keyed = docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("key"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, blob in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if blob.is_valid:
                    gone = _covered(len(words), blob.as_py())
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                rows.append((len(words), len(words) - len(kept), finish(b" ".join(kept))))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return keyed.join(spans, F.col("key") == F.col("span_key"), "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def report(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; one row per row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts anywhere
    else, in the same text or another; all occurrences go.  Words are runs without
    ASCII white space, unchanged.  Null texts have no words; texts shorter than a
    window keep all.  Repeated rows are repeats of each other.  An empty table gives
    no rows.
    """
    sha = lambda kept: hashlib.sha256(kept).hexdigest()
    return _removed(docs, window, seed, "doc_id long, n_words long, n_removed long, kept_sha256 string", sha)


def cleaned(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by one space."""
    return _removed(docs, window, seed, "doc_id long, n_words long, n_removed long, kept string", lambda kept: kept.decode("utf-8", "replace"))
