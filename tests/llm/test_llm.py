"""The operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import bpe, decontamination, jaccard_join, language_id, line_dedup, queries, quality_rules, sharding, substring_dedup, tree_weighting, url_reputation
from siftline.llm.components import components

from ..compare import connect, same
from ..conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, spans string, _part int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, texts, ids=None):
    """Documents with null languages and extra columns whose names could clash."""
    rows = [(i, t, None, None, None, "x", "y", 1) for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=3):
    """Small texts: random, exact and near copies, empty, null and repeated lines."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)]
    base = rng.choices(words, k=100)
    for _ in range(25):
        copy = list(base)
        for at in rng.sample(range(100), rng.randint(0, 4)):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    line = "A line of boilerplate that stands in many of these documents"
    texts += [f"{line}\n{rng.choice(words)} tail {i}\n  {line.upper()} " for i in range(7)]
    return [*texts, texts[0], texts[0], "", None, " \n\t", "one two", "One TWO", "日本語 の テキスト " * 20]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    held = none.withColumn("held_out", F.lit(False))
    frames = [
        sharding.shard_documents(none), jaccard_join.jaccard_components(none), language_id.identify(none, language_id.fit(none)), url_reputation.judge(pages), decontamination.report(none, bench),
        tree_weighting.score(held), line_dedup.report(none), quality_rules.judge(none), bpe.encode_documents(none, VOCABULARY), substring_dedup.report(none),
    ]
    assert [f.count() for f in frames] == [0] * 10


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1)], "a long, b long")
    got = {r.v: r.root for r in components(edges).collect()}
    assert got[1] == got[2] == got[3]
    assert got[8] == got[9] != got[1]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert components(chain).select("root").distinct().count() == 1


def test_sharding(spark, docs):
    got = sharding.shard_documents(docs, 8).toPandas()
    assert len(got) == docs.count()
    by = got.groupby("shard")
    assert set(by.groups) == set(range(8))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in by)
    sizes = by["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(corpus())}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples(name="R", index=False) for r in [type("R", (), {"doc_id": r[0], "size": r[1], "text_crc32": r[2]})]} == want
    assert sharding.shard_documents(frame(spark, [None, None], [None, None]), 4).count() == 2
    assert sharding.shards_for(101, 10) == 11


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, d in enumerate(ids):
        low[find(i)].append(d)
    return {d: (len(sets[i]), min(low[find(i)])) for i, d in enumerate(ids)}


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_components(spark, seed):
    texts = corpus(seed)
    got = jaccard_join.jaccard_components(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, range(len(texts)))


def edited(count, most, size=150, seed=9):
    """Chains of near copies of which few pairs link."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    texts = []
    for _ in range(count):
        copy = list(base)
        for at in rng.sample(range(size), rng.randint(1, most)):
            copy[at] = f"x{rng.randint(0, 3)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("rounds", "list_rows", "hot"), [(1, 20_000, 10**6), (0, 4, 3), (3, 7, 5)])
def test_jaccard_hard_groups(spark, monkeypatch, rounds, list_rows, hot):
    """Over many small groups of the shuffles, with lists in blocks, hot shingles and few or no meetings with hubs."""
    monkeypatch.setattr(jaccard_join, "TOKENS_A_PART", 500)
    monkeypatch.setattr(jaccard_join, "CLASSES_A_PART", 10)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", list_rows)
    monkeypatch.setattr(jaccard_join, "HOT_CLASSES", hot)
    texts = edited(70, 8) + ["b1 b2", "b1 b2 b3 b4 b5", None, ""]
    got = jaccard_join.jaccard_components(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, range(len(texts)))


@pytest.mark.parametrize(("sizes", "list_rows"), [([1] * 400, 20), ([300] + [1] * 5, 20), ([300, 90] + [2] * 30, 40), ([12, 7], 20), ([60], 20)])
def test_long_lists_are_split(spark, sizes, list_rows):
    """Every two members of different components share one group, and no group is large."""
    comps = [c for c, n in enumerate(sizes) for _ in range(n)]
    near = spark.createDataFrame([(o, t, i, c) for o, t in ((0, 5), (1, 5)) for i, c in enumerate(comps)], "ord int, token long, cls long, comp long")
    dealt, rows = jaccard_join.in_blocks(near, list_rows)
    groups = defaultdict(list)
    for r in dealt.collect():
        groups[r.ord, r.lo, r.hi].append(r)
    assert sum(map(len, groups.values())) == rows and max(map(len, groups.values())) <= 2 * list_rows
    met = Counter()
    for (o, lo, hi), own in groups.items():
        first = [r for r in own if r.cell == lo and r.few != 0]
        second = [r for r in own if r.cell == hi]
        met.update((o, *p) for p in {tuple(sorted((a.cls, b.cls))) for a in first for b in second if a.comp != b.comp})
    want = {(o, i, j) for o in (0, 1) for i in range(len(comps)) for j in range(i + 1, len(comps)) if comps[i] != comps[j]}
    assert set(met) == want and set(met.values()) <= {1}


def test_linked_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 9)
    texts = sorted(set(edited(60, 8, seed=12))) * 2
    docs = frame(spark, texts)
    members = {r.doc_id: r.cls for r in jaccard_join.document_classes(docs).collect()}
    got = [(r.a, r.b) for r in jaccard_join.linked_pairs(docs).collect()]
    assert len(set(got)) == len(got)
    sets = {members[i]: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in enumerate(texts)}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert set(got) == want


def test_representatives(spark, docs):
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    want = {low for _, low in brute_components(corpus(), range(docs.count())).values()}
    assert {r.doc_id for r in kept.collect()} == want
    twice = frame(spark, ["a b c d e f", "a b c d e f", None], [1, 1, None])
    assert sorted(str(r.doc_id) for r in jaccard_join.representatives(twice).collect()) == ["1", "None"]


def test_language_id(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op3_language_id(spark, SF).join(table, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    assert got["score"].between(0, 1).all()
    assert dict(zip(got["doc_id"], got["held_out"], strict=True)) == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]}
    model = language_id.fit(table.select(F.col("doc_id").alias("key"), "text", "lang"))
    odd = language_id.identify(frame(spark, ["", None, "123 !?", "the and of"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd] == ["und", "und", "und", "en"]
    assert [r.rejected for r in odd][:3] == [True] * 3
    foreign = language_id.identify(frame(spark, ["ԱԲԳ дежзик лмноп " * 50]), model).first()
    assert foreign.rejected
    assert language_id.accepted(table, model).columns == table.columns


def test_language_model_sums_to_one():
    model = language_id.train(["abab abba baab", "aabb ba"])
    for context in ("a", "ab", " b", "bab"):
        alphabet = "ab "
        texts = [context + c for c in alphabet]
        total = 0.0
        for t in texts:
            codes = language_id.np.array([ord(c) for c in " " * language_id.ORDER + t], language_id.np.uint32)
            rows = language_id.np.zeros(len(codes), int)
            keys = language_id.grams(codes, rows)
            total += math.exp(language_id.log_probs(model, keys, language_id.contexts(keys, rows))[-1])
        assert total + model["floor"][0] >= 0.97
        assert total <= 1.0001


URLS = ["https://A.example.NET/en/x?q", "http://example.net/de", "ftp://example.com/de/#x", "http://x.example.com/de", "org://a.org/fr/", "http://notexample.net/en/", "nothing", None, "a://b://c/d", "x://", "http://net?/en/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>fine text</p>") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_reputation.judge(pages).collect()}
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for i, u in enumerate(URLS):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (max(fits)[1] if fits else None)
        assert got[i].verdict == (max(fits)[2] if fits else "allow")


def test_url_reputation_shrinks(spark):
    rows = [("bad.example.com", True)] * 80 + [("new.example.com", True)] + [(f"h{i}.other.io", False) for i in range(200)] + [("bad.other.io", None)]
    got = {r.host: r for r in url_reputation.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["bad.example.com"].bound > 0.5
    assert got["new.example.com"].bound < got["bad.example.com"].bound
    assert got["bad.other.io"].rows == 0
    assert got["bad.other.io"].mean < 0.1


def beta_below(a, b, x, steps=20_000):
    """P(Beta(a, b) < x) by the midpoint rule over the logit."""
    grid = np.linspace(-40, math.log(x / (1 - x)), steps + 1)
    mid = (grid[1:] + grid[:-1]) / 2
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return float(np.exp(a * -np.log1p(np.exp(-mid)) + b * -np.log1p(np.exp(mid)) - log_beta).sum() * (grid[1] - grid[0]))


def test_beta_quantile():
    a, b = np.array([1.5, 40.0, 0.8, 3000.0, 7.0, 15_000.0]), np.array([3.0, 2.0, 9.0, 1000.0, 7.0, 6000.0])
    got = url_reputation._lower_quantile(a, b, 0.05)
    assert [beta_below(x, y, q) for x, y, q in zip(a, b, got, strict=True)] == pytest.approx([0.05] * 6, rel=0.02)


def plain_reputations(rows):
    """host: (rows, mean, bound over 0.5), from (host, bad), one level after the other."""
    counts = defaultdict(lambda: [0, 0])
    for host, bad in rows:
        counts[host][0] += bad is not None
        counts[host][1] += bool(bad)

    def place(host):
        name = re.sub(r":\d*$", "", host.split("@")[-1]).rstrip(".")
        if re.fullmatch("[0-9.]+", name):
            return ("", name, host)
        parts = name.split(".")
        long = 2 if ".".join(parts[-2:]) in url_reputation.LONG_SUFFIXES else 1
        return (".".join(parts[-long:]), ".".join(parts[-long - 1 :]), host)

    mean = {(): (sum(k for _, k in counts.values()) + 0.5) / (sum(n for n, _ in counts.values()) + 1)}
    for depth in (1, 2, 3):
        level = defaultdict(lambda: [0, 0])
        for host, (n, k) in counts.items():
            level[place(host)[:depth]][0] += n
            level[place(host)[:depth]][1] += k
        over = pairs = 0.0
        for key, (n, k) in level.items():
            m = mean[key[:-1]]
            over += (k - n * m) ** 2 - n * m * (1 - m)
            pairs += n * (n - 1) * m * (1 - m)
        weight = 1000.0 if not pairs or over <= 0 else min(1000.0, max(1.0, pairs / over - 1))
        mean |= {key: (k + mean[key[:-1]] * weight) / (n + weight) for key, (n, k) in level.items()}
    out = {}
    for host, (n, _) in counts.items():
        m = mean[place(host)]
        out[host] = n, m, beta_below(m * (n + weight), (1 - m) * (n + weight), 0.5) < 0.05
    return out


def test_url_verdicts_on_all_pages(spark):
    """The method blocks and keeps, row by row as a plain version does."""
    larger = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{larger}/pages.parquet")
    got = queries.op4_url_reputation(spark, larger).join(pages, "page_id").collect()
    noise = lambda t: sum(t.count(c) for c in "#*$%&|!") / len(t) >= url_reputation.NOISE if t else False
    visible = lambda h: re.sub(r"\s", "", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", h or ""))
    words = re.compile(r"(?:^|[^a-z0-9])(?:" + "|".join(url_reputation.SPAM_WORDS) + ")(?:[^a-z0-9]|$)")
    bad = [(r.host, bool(words.search(r.host + r.path.translate(LOWER))) or noise(visible(r.html))) for r in got]
    plain = plain_reputations(bad)
    assert len(got) == pages.count()
    for r in got:
        assert r.bad_mean == pytest.approx(plain[r.host][1], rel=1e-6)
        if r.rule is None:
            assert r.verdict == ("block" if plain[r.host][2] else "allow"), r.host
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_url_edges(spark):
    odd = ["http://user@Casino-win.co.uk:80/x", "http://a.b.co.uk./", "http://10.0.0.1:8080/", "http://10.0.0.1/", None, "nothing", "http:///p", "://x y/", "http://" + "long." * 5000 + "com/"]
    rows = [(None if i % 3 == 0 else i, u, None if i % 2 else "<p>text</p>", "k", "h") for i, u in enumerate(odd * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = url_reputation.judge(pages).collect()
    assert len(got) == len(rows)
    plain = plain_reputations([(r.host, "casino" in r.host) for r in got])
    for r in got:
        assert r.bad_mean == pytest.approx(plain[r.host][1], rel=1e-6), r.host
    assert url_reputation.judge(pages.limit(0)).count() == 0


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "One two, three"), (10, " ".join(f"k{i}" for i in range(12))), (2, "!!"), (None, "zz"), (3, None)], "item_id long, text string")
    texts = ["x ONE-two three y one two three", " ".join(f"K{i}" for i in range(11)), " ".join(f"k{i}" for i in range(9)), None, "", "one two"]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in decontamination.report(docs, bench).collect()}
    assert [got[i].n_hit for i in range(6)] == [6, 11, 0, 0, 0, 0]
    assert (got[0].items_sha256, got[1].items_sha256, got[2].items_sha256) == (sha("1"), sha("10"), sha(""))
    assert {r.doc_id for r in decontamination.remove_documents(docs, bench).collect()} == {2, 3, 4, 5}
    spans = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert (spans[0], spans[1], spans[5]) == ("x y ", "", "one two")


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ROWS", 50)
    table, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    blocks = {r.doc_id: r.n_hit for r in decontamination.report(table, bench).collect()}
    monkeypatch.undo()
    assert blocks == {r.doc_id: r.n_hit for r in decontamination.report(table, bench).collect()}
    assert any(blocks.values())


def plain_kneser_ney(texts, order=language_id.ORDER):
    """P(character | up to three before) of interpolated Kneser-Ney, from dictionaries."""
    rows = [re.sub("[^a-z]+", " ", f" {t.lower()} ") for t in texts]
    counts = {order: Counter((" " * order + r)[i + 1 : i + 1 + order] for r in rows for i in range(len(r)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    size = len(counts[1]) + 1
    total, kinds, discount = {}, {}, {}
    for n in range(1, order + 1):
        total[n], kinds[n] = Counter(), Counter()
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        discount[n] = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / size
        under, all_ = p(gram[1:]), total[n].get(gram[:-1], 0)
        if not all_:
            return under
        return max(counts[n].get(gram, 0) - discount[n], 0) / all_ + discount[n] * kinds[n][gram[:-1]] / all_ * under

    return p


def test_language_model_is_kneser_ney():
    rng = random.Random(3)
    learn = [" ".join(rng.choice(["the", "then", "hen", "a", "other", "sheen"]) for _ in range(30)) for _ in range(20)]
    model, p = language_id.train(learn), plain_kneser_ney(learn)
    for text in ("the then", "zebra the", "q", "othering hens, a sheet!"):
        codes, rows = language_id.characters([text])
        keys = language_id.grams(codes, rows)
        got = language_id.log_probs(model, keys, language_id.contexts(keys, rows))
        low = re.sub("[^a-z]+", " ", f" {text} ")
        want = [math.log(p((" " * language_id.ORDER + low)[i + 1 : i + 1 + language_id.ORDER])) for i in range(len(low))]
        assert got.tolist() == pytest.approx(want, rel=1e-9)


def test_language_id_rejects_foreign_text_despite_wrong_labels(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 100").select("doc_id", "text", "lang")
    wrong = table.withColumn("lang", F.when(F.col("doc_id") % 25 == 0, F.lit("de")).otherwise(F.col("lang"))).withColumnRenamed("doc_id", "key")
    greek = ["αβγδ εζηθ ικλμ νξοπ ρστυ " * 8, "хорошо говорить по русски " * 8, "qzxv jkwq xzzq vvkj " * 10]
    few = frame(spark, ["ulla mopo tikki sun " * 20] * 3).select(F.col("doc_id").alias("key"), "text", F.lit("xx").alias("lang"))
    model = language_id.fit(wrong.unionByName(few))
    assert set(model.languages) >= {"de", "en", "xx"}
    assert all(r.rejected for r in language_id.identify(frame(spark, greek), model).collect())
    kept = language_id.accepted(table, model).count()
    assert kept >= 0.99 * table.count()
    assert {r.lang_pred for r in language_id.identify(frame(spark, ["tikki sun ulla mopo " * 9]), model).collect()} == {"xx"}


def test_language_id_models_every_language(spark, monkeypatch):
    rng = random.Random(4)
    words = {f"l{i:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)] for i in range(40)}
    rows = [(i, " ".join(rng.choices(w, k=60)), name) for i, (name, w) in enumerate((n, w) for n, w in words.items() for _ in range(12))]
    table = spark.createDataFrame(rows, "key long, text string, lang string")
    answers = []
    for shared in (1 << 25, 10):  # with the shared array, and each language looked up alone
        monkeypatch.setattr(language_id, "SHARED", shared)
        model = language_id.fit(table)
        answers.append([(r.lang_pred, round(r.score, 6)) for r in language_id.identify(table, model, ["key"]).orderBy("key").collect()])
    assert answers[0] == answers[1]
    assert [a[0] for a in answers[0]] == [r[2] for r in rows]
    assert language_id.sampled(table.withColumn("text", F.expr("repeat(text, 10)")), size=40 * 9000).groupBy("lang").count().agg(F.max("count")).first()[0] <= 3


def test_tree_weighting(spark, docs):
    texts = corpus()
    held = {i: i % 5 == 2 for i in range(len(texts))}
    got = {r.doc_id: r for r in tree_weighting.score(docs.withColumn("held_out", F.col("doc_id") % 5 == 2)).collect()}
    words = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    counts = Counter(w for i, ws in enumerate(words) if not held[i] for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    depth = tree_weighting.DEPTH
    grams = Counter()
    for i, ws in enumerate(words):
        if not held[i]:
            b = bytes(depth) + " ".join(ws).encode() + b"\0"
            grams.update(b[j - depth : j + 1] for j in range(depth, len(b)))
    nodes = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    for g, times in grams.items():
        for d in range(depth + 1):
            for k in range(8):
                nodes[d][g[depth - d : depth], 1 << k | g[depth] >> 8 - k][g[depth] >> 7 - k & 1] += times
    lg = math.lgamma
    odds, sums = [{} for _ in range(depth + 1)], {}
    for d in range(depth, -1, -1):
        up = defaultdict(float)
        for key, (a, b) in nodes[d].items():
            own = lg(a + 0.5) + lg(b + 0.5) - 2 * lg(0.5) - lg(a + b + 1)
            weight = own
            if d < depth:
                odds[d][key], top = own - sums[key], max(own, sums[key])
                weight = top + math.log(math.exp(own - top) + math.exp(sums[key] - top)) - math.log(2)
            up[key[0][1:], key[1]] += weight
        sums = up
    for i, ws in enumerate(words):
        tokens = [*ws, None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)
        b, total = bytes(depth) + " ".join(ws).encode() + b"\0", 0.0
        for j in range(depth, len(b)):
            for k in range(8):
                p = None
                for d in range(depth, -1, -1):
                    key = b[j - d : j], 1 << k | b[j] >> 8 - k
                    if key in nodes[d]:
                        a, c = nodes[d][key]
                        own = (c + 0.5) / (a + c + 1)
                        share = 1.0 if p is None else 1 / (1 + math.exp(-max(-500, min(500, odds[d][key]))))
                        p = own if p is None else share * own + (1 - share) * p
                p = 0.5 if p is None else p
                total += math.log10(p if b[j] >> 7 - k & 1 else 1 - p)
        assert got[i].score == pytest.approx(total, rel=0.02)


def exact_tree_scores(texts, held):
    """Log10 scores by an exact tree of all nodes."""
    depth, lg = tree_weighting.DEPTH, math.lgamma
    padded = [bytes(depth) + " ".join(WORD.findall((t or "").translate(LOWER))).encode() + b"\0" for t in texts]
    grams = Counter(b[j - depth : j + 1] for b, h in zip(padded, held, strict=True) if not h for j in range(depth, len(b)))
    nodes = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    for g, times in grams.items():
        for d in range(depth + 1):
            for k in range(8):
                nodes[d][g[depth - d : depth], 1 << k | g[depth] >> 8 - k][g[depth] >> 7 - k & 1] += times
    odds, sums = [{} for _ in range(depth + 1)], {}
    for d in range(depth, -1, -1):
        up = defaultdict(float)
        for key, (a, b) in nodes[d].items():
            own = weight = lg(a + 0.5) + lg(b + 0.5) - 2 * lg(0.5) - lg(a + b + 1)
            if d < depth:
                odds[d][key], top = own - sums[key], max(own, sums[key])
                weight = top + math.log(math.exp(own - top) + math.exp(sums[key] - top)) - math.log(2)
            up[key[0][1:], key[1]] += weight
        sums = up
    scores = []
    for b in padded:
        total = 0.0
        for j in range(depth, len(b)):
            for k in range(8):
                p = None
                for d in range(depth, -1, -1):
                    key = b[j - d : j], 1 << k | b[j] >> 8 - k
                    if key in nodes[d]:
                        a, c = nodes[d][key]
                        share = 1.0 if p is None else 1 / (1 + math.exp(-max(-500, min(500, odds[d][key]))))
                        p = share * (c + 0.5) / (a + c + 1) + (1 - share) * (p or 0)
                p = 0.5 if p is None else p
                total += math.log10(p if b[j] >> 7 - k & 1 else 1 - p)
        scores.append(total)
    return scores


def test_tree_keeps_every_node(spark, monkeypatch):
    """Scores are those of the exact tree, over many chunks, parts and blocks, however many nodes there are."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzäéß", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 150))) for _ in range(60)] + ["", None]
    texts += [t[: len(t) // 2] for t in texts[:8]]
    for name, value in (("CHUNK_BYTES", 6000), ("PART_BYTES", 9000), ("BLOCK_GRAMS", 300)):
        monkeypatch.setattr(tree_weighting, name, value, raising=False)
    for kind in (5, 1):  # with training rows, and without any
        held = [i % kind == 0 for i in range(len(texts))]
        got = {r.doc_id: r.score for r in tree_weighting.score(frame(spark, texts).withColumn("held_out", F.col("doc_id") % kind == 0)).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(exact_tree_scores(texts, held), rel=1e-6)


def test_tree_on_short_texts(spark):
    """Texts of 0 to 6 bytes, each a partition of its own, and a null held_out, which is not learned from."""
    texts = ["", "a", "ab", "a b", "abc", "a  bc", "abcdef", None]
    table = frame(spark, texts).repartition(len(texts), "doc_id").withColumn("held_out", F.when(F.col("doc_id") != 4, F.col("doc_id") == 2))
    for one in [table] + [table.where(F.col("doc_id") == i) for i in (0, 3, 7)]:
        rows = one.orderBy("doc_id").collect()
        got = {r.doc_id: r for r in tree_weighting.score(one).collect()}
        want = exact_tree_scores([texts[r.doc_id] for r in rows], [r.held_out is not False for r in rows])
        assert [got[r.doc_id].score for r in rows] == pytest.approx(want, rel=1e-6)
        words = Counter(w for r in rows if r.held_out is False for w in (texts[r.doc_id] or "").split())
        for r in rows:
            assert got[r.doc_id].n_known == sum(w in words for w in (texts[r.doc_id] or "").split()) + any(r.held_out is False for r in rows)
            assert got[r.doc_id].train_tokens == sum(words.values()) + sum(r.held_out is False for r in rows)


def test_line_dedup_edges(spark):
    line = "x" * 40
    texts = [f"{line}\nonly {i}" for i in range(4)] + [f" {line.upper()}\t\n{line}"] + ["x" * 39] * 6 + ["", None]
    got = {r.doc_id: r for r in line_dedup.report(frame(spark, texts)).collect()}
    assert [got[i].n_dropped for i in range(5)] == [1, 1, 1, 1, 0]
    assert got[0].kept_sha256 == sha("only 0")
    assert (got[11].n_lines, got[12].n_lines, got[12].kept_sha256) == (1, 1, sha(""))
    assert not any(got[i].n_dropped for i in range(5, 13))
    repeated = frame(spark, [line] * 6, [1, 1, 1, 1, 2, None])
    assert not any(r.n_dropped for r in line_dedup.report(repeated).collect())


def test_line_runs_do_not_depend_on_batches(spark, docs):
    results = []
    for batches in (1, 3, 7):
        results.append({r.doc_id: r.kept_sha256 for r in line_dedup.report(docs, batches=batches).collect()})
    assert results[0] == results[1] == results[2]


def test_quality_counts(spark, docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(corpus()):
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_outliers(spark):
    rng = random.Random(1)
    clean = [" ".join(f"word{rng.randint(0, 500)}" for _ in range(80)) for _ in range(60)]
    noisy = [" ".join(f"word{rng.randint(0, 500)}###" for _ in range(80))]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, clean + noisy)).collect()}
    assert all(got[i].kept for i in range(60))
    assert "symbol_share" in got[60].outliers


def test_every_quality_fence_comes_from_its_group(spark):
    """Each feature's fence differs between groups and removes a planted outlier that the base rules pass."""
    rng = random.Random(2)

    def text(chars, symbols, repeats, doubled, n=200):
        words = ["".join(rng.choices("abcdefghij", k=max(2, round(rng.gauss(chars, 1))))) for _ in range(n)]
        for at in rng.sample(range(n), symbols):
            words[at] += "#"
        for k in range(repeats):
            words[100 + 4 * k : 103 + 4 * k] = ["again", "and", "again"]
        lines = [" ".join(words[i : i + 10]) for i in range(0, n, 10)]
        return "\n".join(lines + lines[:1] * doubled)

    usual = {"a": lambda: text(6, rng.randint(0, 4), rng.choice([0, 2, 3]), 0), "b": lambda: text(9, rng.randint(10, 30), rng.choice([0, 4, 6]), rng.randint(0, 2))}
    rows = [(1000 * k + i, make(), "xx", g) for k, (g, make) in enumerate(usual.items()) for i in range(300)]
    odd = {"mean_word_chars": text(7.8, 2, 0, 0), "symbol_share": text(6, 40, 0, 0), "repeat_share": text(6, 2, 24, 0), "dup_line_share": text(6, 2, 0, 6)}
    rows += [(5000 + i, t, "xx", "a") for i, t in enumerate(odd.values())]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(table).collect()}
    for i, name in enumerate(odd):
        assert not got[5000 + i].base_failed
        assert name in got[5000 + i].outliers
    assert sum(got[r[0]].kept for r in rows[:600]) >= 590
    features = quality_rules.base_counts(table).withColumns({n: F.expr(e) for n, (e, _) in quality_rules.FEATURES.items()})
    a, b = quality_rules.fences(features).orderBy("source").collect()
    for name in odd:
        assert abs(a[f"{name}_high"] - b[f"{name}_high"]) > 0.1 * a[f"{name}_high"], name


def test_quality_verdicts_follow_exact_quantiles(spark):
    """Over a whole table, outliers are those of fences from sorted values, but for values next to a fence."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    base = quality_rules.base_counts(docs).withColumns({n: F.when(F.col("n_words") > 0, F.expr(e)) for n, (e, _) in quality_rules.FEATURES.items()})
    base = base.toPandas().fillna({"lang": "", "source": ""})
    passed = base[[not got[i].base_failed for i in base.doc_id]]
    near = kept = 0
    for n, (_, counted) in quality_rules.FEATURES.items():
        at = lambda values: [sorted(values)[max(0, math.ceil(len(values) * q) - 1)] for q in (0.1, 0.5, 0.9)]
        wide = {k: at(list(v)) for k, v in passed.groupby("lang")[n]}
        fences = {}
        for (lang, source), v in passed.groupby(["lang", "source"])[n]:
            trust = len(v) / (len(v) + 50)
            q10, q50, q90 = (x * trust + y * (1 - trust) for x, y in zip(at(list(v)), wide[lang], strict=True))
            fences[lang, source] = q50 - 3 * (q50 - q10 + 0.01 * q50), q50 + 3 * (q90 - q50 + 0.01 * q50)
        for r in base.to_dict("records"):
            if r["n_words"] == 0 or (r["lang"], r["source"]) not in fences:
                continue
            low, high = fences[r["lang"], r["source"]]
            verdicts = set()
            for slack in (0.9, 1, 1.1):
                over = r[n] > high * slack
                if counted:
                    count, size, event = r[counted[0]], r["word_chars"] + 1 if "char" in counted[1] else r[counted[1]], counted[2]
                    over = over and 2 * (math.sqrt(count / event + 0.375) - math.sqrt(max(high * slack, 0) * size / event + 0.375)) > 2.326
                verdicts.add(over or r[n] < low / slack)
            if len(verdicts) > 1:
                near += 1
            else:
                kept += 1
                assert (n in got[r["doc_id"]].outliers) == verdicts.pop(), (n, r)
    assert near < 0.05 * kept


def test_quality_counts_need_evidence(spark):
    """Where a group has no doubled lines, one in a short text is kept and five in a longer one are not."""
    rng = random.Random(9)
    lines = lambda n: [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(10)) for _ in range(n)]
    texts = ["\n".join(lines(rng.randint(6, 20))) for _ in range(200)]
    short, long = ["a short line here", *lines(6)], lines(20)
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, [*texts, "\n".join([*short, short[0]]), "\n".join([*long, *long[:5]])])).collect()}
    assert not [r for i, r in got.items() if i < 201 and set(r.outliers) - {"mean_word_chars"}]
    assert "dup_line_share" not in got[200].outliers
    assert "dup_line_share" in got[201].outliers


def test_quantile_sketch_merges(spark):
    values = spark.createDataFrame([(i % 3, float(i)) for i in range(1, 1000)], "g int, value double")
    bins = values.select("g", F.lit("f").alias("feature"), quality_rules.bin_of(F.col("value")).alias("bin")).groupBy("g", "feature", "bin").agg(F.count("*").alias("n"))
    whole = quality_rules.quartiles(bins.groupBy("feature", "bin").agg(F.sum("n").alias("n")).withColumn("all", F.lit(1)), ["all"]).first()
    assert whole.q50 == pytest.approx(500, rel=0.02)
    assert whole.q75 == pytest.approx(750, rel=0.02)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_spec(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_bpe_equals_library(spark, docs, library):
    got = {r.doc_id: r for r in bpe.encode_documents(docs, VOCABULARY, with_ids=True).collect()}
    for i, t in enumerate(corpus()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids) == (len(ids), ids)
        assert got[i].ids_sha256 == sha(" ".join(map(str, ids)))
        assert got[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def encoded(encoder, texts):
    """Rows of ids of the given texts."""
    return [r[3].tolist() for r in encoder.texts(pa.array(texts, pa.string()), hold=True)]


def test_bpe_on_random_text(encoder, library):
    rng = random.Random(5)
    pools = ["abcdefghijklmnopqrstuvwxyz", "aeinrst", "!?-_'.", "0123", "éàüßñÅΣσς İ日本", "   \n\t\x85\x1c'sS", ["<|endoftext|>"], ["'ll", "'S", "''"]]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, (n, ids, decoded, _) in zip(texts, encoder.texts(pa.array(texts)), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), sha(" ".join(map(str, want))), sha(library.decode(want, skip_special_tokens=False))), repr(text)


def test_bpe_has_the_librarys_characters(encoder, library):
    texts = [f"a{c}a !{c}! {c}1" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    texts = [" ".join(texts[i : i + 500]) for i in range(0, len(texts), 500)]
    assert encoded(encoder, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_window_is_bounded(library):
    encoder = bpe.Encoder(bpe.read_spec(VOCABULARY))
    rng = random.Random(6)
    texts = ["".join(rng.choice(letters) for _ in range(size)) for size in (65, 200, 3000) for letters in ("a", "ab", "the", "abcdefghijklmnopqrstuvwxyz")]
    texts += ["a" * 5000, "thequickbrownfox" * 100, "ab" * 700 + "!" * 900, "é" * 300]
    assert encoded(encoder, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.transducer.widest == 4 * encoder.merges.lookahead + 1


def test_bpe_tokens_come_from_the_transducer(encoder, library, monkeypatch):
    made = []
    together = encoder.transducer._together

    def watched(data, starts, sizes):
        for lane, place, ids in together(data, starts, sizes):
            made.append(len(ids))
            yield lane, place, ids

    monkeypatch.setattr(encoder.transducer, "_together", watched)
    text = "A quick test of alpharetical wordlings, 12 times"  # no pre-token twice
    assert encoded(encoder, [text]) == [library.encode(text, add_special_tokens=False).ids]
    assert sum(made) == len(encoded(encoder, [text])[0])


def test_bpe_cuts_long_texts(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 64)
    texts = ["Some words, été " * 30, None, "", "x" * 200 + " y", "ok"]
    rows = encoder.texts(pa.array(texts), hold=True)
    for text, (n, ids, decoded, held) in zip(texts, rows, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert held.tolist() == want
        assert (n, ids, decoded) == (len(want), sha(" ".join(map(str, want))), sha(library.decode(want, skip_special_tokens=False)))


def test_decoding_in_pieces(encoder, library):
    text = "été à 日本 , x <|endoftext|> 3"
    ids = np.array(encoded(encoder, [text])[0])
    for table, want in ((bpe.Table.readable(encoder.merges), None), (encoder.names, library.decode(ids.tolist(), skip_special_tokens=False))):
        for step in (1, 2, 5):
            decoder = bpe.Decoder(table)
            got = "".join(decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + decoder.finish()
            assert got.split() == text.split() if want is None else got == want
    assert bpe.Decoder(encoder.names).feed(np.array([10**6, -1])) == ""


def test_substring_dedup(spark, docs):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(50)]
    texts = [t or None for t in corpus()]
    for _ in range(12):
        cut = passage[rng.randint(0, 10) :][: rng.randint(33, 40)]
        texts.append(" ".join([*(f"q{rng.randint(0, 9999)}" for _ in range(20)), *cut, *(f"q{rng.randint(0, 9999)}" for _ in range(20))]))
    texts += ["la " * 90, "la la " * 10]
    got = {r.doc_id: r for r in substring_dedup.report(frame(spark, texts)).collect()}
    words = [(t or "").split() if t is None or t.isascii() else WORD.findall(t) for t in texts]
    counts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    for i, w in enumerate(words):
        gone = {j + k for j in range(len(w) - 34) if counts[tuple(w[j : j + 35])] > 1 for k in range(35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), sha(kept)), i
    twice = frame(spark, ["a " * 5 + " ".join(passage)] * 2, [7, 7])
    assert {r.n_removed for r in substring_dedup.report(twice).collect()} == {55}


def test_windows_are_told_apart_by_two_hashes():
    """With a first hash that hardly tells windows apart, the second one does; a shared one is sent once a slice."""
    rng = np.random.default_rng(4)
    hashes, checks = rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(62), rng.integers(0, 400, 500).astype(np.uint64)
    count = Counter(zip(hashes.tolist(), checks.tolist(), strict=True))
    places, first = substring_dedup._twice(hashes, checks)
    assert sorted(places.tolist()) == [i for i, x in enumerate(zip(hashes.tolist(), checks.tolist(), strict=True)) if count[x] > 1]
    assert len(first) == sum(n > 1 for n in count.values())
    owner, keys = np.repeat(np.arange(50), 10), np.arange(50).astype(np.uint64)
    dealt = substring_dedup._deal(4, keys, owner, hashes, checks, np.tile(np.arange(10), 50)).to_pylist()
    assert sum(len(r["body"]) // 8 for r in dealt) == len(count)
    assert [len(r["pos"]) // 4 for r in dealt if not r["body"]] == [len(places)]


def test_a_passage_of_very_many_copies(spark):
    """Copies within a slice and across slices, and one that stands alone in its slice, all go."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"a{i} b{i} {passage} c{i}" for i in range(400)] + [" ".join(f"x{i}" for i in range(400_000)) + " " + passage]
    got = {r.doc_id: r for r in substring_dedup.report(frame(spark, texts).repartition(5)).collect()}
    assert {r.n_removed for r in got.values()} == {60}
    assert got[400].kept_sha256 == sha(" ".join(f"x{i}" for i in range(400_000)))


def test_shuffled_sides_give_the_same(spark, docs, monkeypatch):
    """Beyond the broadcast bound every join shuffles."""
    from siftline.llm import tables

    before = [substring_dedup.report(docs), line_dedup.report(docs), jaccard_join.jaccard_components(docs), quality_rules.judge(docs)]
    before = [sorted(map(str, f.collect())) for f in before]
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    after = [substring_dedup.report(docs), line_dedup.report(docs), jaccard_join.jaccard_components(docs), quality_rules.judge(docs)]
    assert before == [sorted(map(str, f.collect())) for f in after]


def test_pipeline(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    docs = table
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == table.columns, name
        seen.append(docs.toPandas())
    language, lines, near, clean = seen
    assert set(language["doc_id"]) == set(table.toPandas()["doc_id"])
    keys = defaultdict(set)
    strip = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    for d, t in zip(language["doc_id"], language["text"], strict=True):
        for x in t.split("\n"):
            if len(strip(x)) >= 40:
                keys[strip(x)].add(d)
    want = {d: "\n".join(x for x in t.split("\n") if not (len(keys.get(strip(x), ())) >= 5 and d != max(keys[strip(x)]))) for d, t in zip(language["doc_id"], language["text"], strict=True)}
    assert dict(zip(lines["doc_id"], lines["text"], strict=True)) == want
    assert (lines["n_chars"] == lines["text"].str.len()).all()
    found = brute_components(list(lines["text"]), list(lines["doc_id"]))
    assert set(near["doc_id"]) == {low for _, low in found.values()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in bench["text"]:
        w = word.findall(t.translate(LOWER))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(w) for w in windows}
    dirty = lambda t: (lambda w: any(tuple(w[i : i + k]) in windows for k in lengths for i in range(len(w) - k + 1)))(word.findall(t.translate(LOWER)))
    assert set(clean["doc_id"]) == {d for d, t in zip(near["doc_id"], near["text"], strict=True) if not dirty(t)}
    final = corpus_pipeline.run(spark, SF).toPandas()
    assert set(final["doc_id"]) == set(clean["doc_id"])


def test_null_ids_and_values(spark):
    rows = [(None, None, None, None, None, None, None, None), (1, "some words here", "en", "s", 3, None, None, None), (None, "some words here", None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    frames = [
        sharding.shard_documents(table), jaccard_join.jaccard_components(table), language_id.identify(table, language_id.fit(table.withColumn("key", F.col("doc_id")))), decontamination.report(table, bench),
        tree_weighting.score(table.withColumn("held_out", F.lit(False))), line_dedup.report(table), quality_rules.judge(table), bpe.encode_documents(table, VOCABULARY), substring_dedup.report(table),
    ]
    assert [f.count() for f in frames] == [3] * 9
    assert pd.isna(frames[1].toPandas()["component_id"]).sum() == 1
