"""The conversation trie, the source audit and SimHash against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import conversation_trie, queries, scans, simhash, source_divergence

from ..conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
TURNS = "conv_id long, turn long, role string, text string, depth int, node string, fp string, place int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
DOCS = "doc_id long, text string, lang string, source string, fp string, term string, block int, n long"


def trie_rows(rebuilt):
    """The nodes of {conversation: turns} from all prefixes."""
    members = collections.defaultdict(list)
    for conv, turns in rebuilt.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for path, convs in members.items():
        words = (len(convs) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        for depth in range(len(path) + 1):
            saved[path[:depth]] += words
            leaves[path[:depth]] += not children[path]
    ends = {p: ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p)))) for p, m in members.items()}
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()
    )


def in_order(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), x.decode()) for _, _, r, x in sorted(v)] for c, v in turns.items()}


def rebuilt_rows(rows):
    turns = in_order(rows)
    shares = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    return trie_rows({c: turns.get(c - c % 20, [])[:h] + turns[c][h:] for c, h in shares.items()})


def op11(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], TURNS)
    opened = conversation_trie.with_shared_openings(frame)
    return sorted(tuple(r) for r in conversation_trie.report(conversation_trie.prefix_trie(opened, frame.select("conv_id"))).select(COLUMNS).collect())


def talks(seed=5):
    """Shared openings, copies, ties, nulls, a conversation over many partitions and one that rebuilding leaves empty."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hello there", "a  b\tc", "", None, "same words again", "日本 語"])) for c in range(45) for t in range(rng.randint(1, 6))]
    rows += [(60, None, "user", "null turn"), (60, None, "user", "another"), (60, 0, "user", "zero"), (60, 0, "a", "zero"), (60, 0, "a", "zero")]
    rows += [(c, t, "user", f"long {t % 50}") for c in (100, 101, 120) for t in range(500)]
    rows += [(c, 0, "u", "alone") for c in range(201, 220)]
    return [*rows, (None, 0, "user", "no conversation"), (7, 99, "user", "x" * 300_000)]


def test_conversation_trie(spark):
    rows = talks()
    want = rebuilt_rows(rows)
    assert op11(spark, rows) == want
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)  # some conversation has no turn left


def test_conversation_trie_splits_collisions(spark, monkeypatch):
    """With a hash that depends on nothing but the length, groups are told apart by their texts."""
    rows = [r for r in talks(6) if r[0] is not None and r[0] < 60]
    monkeypatch.setattr(conversation_trie, "turn_hash", lambda: F.length("text").cast("long") % 2)
    assert op11(spark, rows) == rebuilt_rows(rows)


def test_conversation_trie_with_many_children(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "HUB_CHILDREN", 3)
    rows = [(c, t, "user", f"{c % 7} {t}") for c in range(1, 120) for t in range(4)]
    assert op11(spark, rows) == rebuilt_rows(rows)


def test_conversation_trie_without_rows(spark):
    assert op11(spark, []) == []
    only = conversation_trie.prefix_trie(spark.createDataFrame([], TURNS), spark.createDataFrame([(3,), (4,)], "conv_id long"))
    assert [tuple(r) for r in conversation_trie.report(only).select(COLUMNS).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())]


def test_scan_over_partitions(spark):
    """A key of nearly all rows is summed over all partitions."""
    frame = spark.range(5000).selectExpr("if(id < 4900, 1L, id) as k", "id as t", "id * 7 % 13 as v", "id * 31 % 1009 as g")
    order = [F.col("k"), F.col("t")]
    got = scans.running(frame.repartition(3), "k", order, order, sums=("v",), roll="g").toPandas().sort_values(["k", "t"])
    one = got[got.k == 1]
    assert one.place.tolist() == list(range(1, 4901)) and (one.run_v == one.v.cumsum()).all()
    roll, power, want = 0, 1, []
    for g in one.g.tolist():
        roll, power = (roll + g * power) % scans.WRAP, power * scans.BASE % scans.WRAP
        want.append(roll)
    assert [x % scans.WRAP for x in one.fp.tolist()] == want
    assert [x % scans.WRAP for x in one.before.tolist()] == [0, *want[:-1]]
    assert (got[got.k > 1].place == 1).all()


def audit_rows(docs, least, top):
    counts, held, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in docs:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = [g for g in groups if g[0] == lang]
        total = sum((counts[g] for g in own), collections.Counter())

        def shares(count, kept=kept):
            whole = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // whole for t in kept}

        p, q = {g: shares(counts[g]) for g in own}, shares(total)
        for g in own:
            pairs = sorted((-sum(abs(p[g][t] - p[o][t]) for t in kept), o[1].encode()) for o in own if o != g)
            terms = sorted((q[t] - p[g][t], t.encode()) for t in kept if counts[g][t] > 0 and p[g][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, g[1], part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def op12(spark, docs, least, top):
    frame = spark.createDataFrame([(i, *d, "x", "y", 1, 2) for i, d in enumerate(docs)], DOCS)
    return sorted(map(tuple, source_divergence.audit(frame, least, top).collect()))


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK_GROUPS", 3)
    monkeypatch.setattr(source_divergence, "CHUNK_TERMS", 16)
    monkeypatch.setattr(source_divergence, "STRIPE_CHUNKS", 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_source_divergence(spark, small_tiles, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "ABCDEFGHIJ"] + ["été", "日本語", "x"]
    docs = [
        (" ".join(rng.choices(words, k=rng.randint(0, 40))) + "-9!" + rng.choice(words), rng.choice(["en", "de", None]), rng.choice([None, *(f"s{i}" for i in range(8 * seed))]))
        for _ in range(150)
    ]
    docs += [(None, "en", "s0"), (None, None, None), ("", "empty", "a"), (None, "empty", "b"), ("rare words only", "few", "a"), ("other", "few", "b"), ("x" * 300_000 + " aA", "en", "s1")]
    docs += [docs[0]] * 20
    assert op12(spark, docs, 4, 5) == audit_rows(docs, 4, 5)


def test_source_divergence_of_nothing(spark):
    assert op12(spark, [], 30, 50) == []
    assert op12(spark, [("a b", "en", "s")], 1, 50) == audit_rows([("a b", "en", "s")], 1, 50)


def test_terms_of_long_texts(monkeypatch):
    text = ("Word9" * 3 + " ÄÖ-x ") * 50
    monkeypatch.setattr(source_divergence, "PIECE", 7)
    got = [t.decode() for piece in source_divergence.terms_in_pieces(memoryview(text.encode())) for t in piece]
    assert got == [t.translate(LOWER) for t in TERM.findall(text)]


def test_shares_are_exact(spark):
    cases = [(0, 10**15), (10**15 - 5, 10**15), (123456789012, 8 * 10**15 + 7), (1, 7), (0, 5), (2, 3 * 10**9 + 1)]
    want = [1 + 10**9 * (c + 5) // w for c, w in cases]
    assert source_divergence.shares(np.array([c for c, _ in cases]), np.array([w for _, w in cases])).tolist() == want
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c long, w long")
    assert [r.p for r in frame.select("i", source_divergence.share(F.col("c"), F.col("w")).alias("p")).orderBy("i").collect()] == want


def fingerprint(text):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(ids, prints, most=2):
    values = np.array(prints, np.uint64)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= most):
            root[find(i)] = find(i + 1 + int(j))
    low = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [(d, f"{p:016x}", low.get(find(i))) for i, (d, p) in enumerate(zip(ids, prints, strict=True))]


def key(row):
    return [(v is None, str(v)) for v in row]


def texts(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(80)]
    base = rng.choices(words, k=400)
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(400), rng.randint(0, 6)):
            copy[at] = rng.choice(words)
        out.append(" ".join(copy))
    return [*out, None, "", " \n", "one", "ONE", "one two", "Été trois\x0bquatre cinq", out[0], out[0], "ab " * 120_000, "z" * 200_000]


@pytest.mark.parametrize("key_rows", [simhash.KEY_ROWS, 4])
def test_simhash(spark, monkeypatch, key_rows):
    monkeypatch.setattr(simhash, "HELD_SHINGLES", 500)
    monkeypatch.setattr(simhash, "HELD_PAIRS", 100)
    monkeypatch.setattr(simhash, "GROUP_ROWS", 200)
    rows = texts()
    ids = [None if i in (3, 90) else i for i in range(len(rows))]
    frame = spark.createDataFrame([(i, t, None, None, "x", "y", 1, 2) for i, t in zip(ids, rows, strict=True)], DOCS)
    got = [tuple(r) for r in simhash.near_duplicates(frame, key_rows=key_rows).collect()]
    assert sorted(got, key=key) == sorted(near(ids, [fingerprint(t) for t in rows]), key=key)


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_pigeonring_loses_no_link(spark, monkeypatch, most):
    """Dense and random fingerprints, short and long keys, for several thresholds."""
    rng = random.Random(most)
    centre = rng.getrandbits(64)
    prints = [rng.getrandbits(64) for _ in range(150)]
    prints += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), most)) for p in prints[:60]]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    for rows in (4096, 5):
        got = sorted(tuple(r) for r in simhash.near_duplicates(frame, most=most, key_rows=rows).collect())
        assert got == sorted(near(range(len(prints)), prints, most))


def test_ring_budgets():
    ring = simhash.Ring(2, 5)
    assert ring.budgets == [0, 0, 0, 1, 1, 2] and ring.equal == 2 and ring.deeper() == [2, 3]
    assert sum(ring.masks) == (1 << 64) - 1
    with pytest.raises(ValueError, match="segments"):
        simhash.Ring(5, 5)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 5)
    raw = memoryview("Some words, Été and\tmore of them   at\x0blast".encode())
    got = np.concatenate(list(simhash.shingle_hashes(raw, 3, 42)))
    words = [w.translate(LOWER) for w in WORD.findall(bytes(raw).decode())]
    assert got.tolist() == [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]


def test_simhash_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op13_simhash(spark, SF).collect())
    assert got == sorted(near([r.doc_id for r in rows], [fingerprint(r.text) for r in rows]))


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
