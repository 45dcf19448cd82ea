"""Language identification with interpolated Kneser-Ney character models.

One model per language, for every language, is trained on a bounded sample of
labelled documents: at most ``SAMPLE`` whole documents a language and
``ALL_SAMPLE`` of all, dealt by a hash of the id, with at most ``SAMPLE_BYTES`` of
text in all (but one document of each language at least).  N-grams live
in sorted arrays of 64-bit hashes next to their interpolated probabilities and
back-off weights.  A text goes to the language with the lowest cross-entropy per
character.  A slice of the sample that trained nothing calibrates two things: how
sure a lead in cross-entropy is, and which cross-entropy is too high for any known
language, which is a rejection.  Only documents that the models find right calibrate a
rejection, so that a wrong label does not.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import arrays as A
from .tables import maybe_broadcast, stored

U = np.uint64
ORDER = 4
#: Documents sampled for each language, a fifth of them for calibration; of all languages together; bytes of their texts.
SAMPLE = 500
ALL_SAMPLE = 16_000
SAMPLE_BYTES = 64 << 20
#: Entries of the shared array of longest n-grams, by language; with more each language is looked up alone, to the same result.
SHARED = 1 << 25
UNKNOWN = "und"
#: Text that a task judges at once.
SLICE_BYTES = 1 << 18
#: Rejection: standard deviations above the usual cross-entropy, at least; so many times the quantile of right documents.
LEAST_Z, OVER, QUANTILE = 12.0, 1.5, 0.995
#: Right calibration documents from which a language's own deviation and limit count; with fewer those of all languages do.
ENOUGH = 20

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters (Unicode category L)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-case, every other run a space, and each one's row.

    A row with letters starts and ends with a space.
    """
    low = [" " + (t or "").lower() + " " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    rows = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = letters()[codes]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    keep = letter | first
    keep[1:] |= letter[:-1]
    has = np.bincount(rows[letter], minlength=len(low)) > 0
    keep &= has[rows]
    return np.where(letter, codes, 32)[keep], rows[keep]


def grams(codes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """keys[n] (n = 0..ORDER): the hash of the n characters that end at each place; what lies before a row is spaces."""
    code = A.mix(codes.astype(U) + U(0x51ED270B))
    blank = A.mix(np.array([32], U) + U(0x51ED270B))[0]
    total = np.zeros(len(code), U)
    keys = [np.full(len(code), U(0x1234567))]
    factor = np.ones(1, U)
    for back in range(ORDER):
        shifted = np.full(len(code), blank)
        if back < len(code):
            shifted[back:] = code[: len(code) - back]
            same = rows[back:] == rows[: len(rows) - back]
            shifted[back:][~same] = blank
        total = total + shifted * factor
        factor = np.multiply(factor, U(A._GEN), dtype=U)
        keys.append(A.mix(total + U(back + 1)))
    return keys


def contexts(keys: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    """before[n]: the hash of the n characters before each place; at a row's start those of a lone space."""
    start = grams(np.array([32]), np.array([0]))
    out = []
    for n, key in enumerate(keys[:-1]):
        prior = np.full(len(key), start[n][0])
        if len(key):
            same = np.r_[False, rows[1:] == rows[:-1]]
            prior[1:] = key[:-1]
            prior[~same] = start[n][0]
        out.append(prior)
    return out


def _pieces(texts: list[str], most: int = 300_000) -> Iterator[list[str]]:
    """Texts in runs of about so many characters, so that the arrays of one run stay small."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def longest_grams(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """All distinct n-grams of the highest order: the hashes of their ends and contexts by length, and their counts."""
    held: list[np.ndarray] = []
    for piece in _pieces(texts):
        codes, rows = characters(piece)
        keys = grams(codes, rows)
        _, at, count = np.unique(keys[ORDER], return_index=True, return_counts=True)
        held.append(np.stack([*(k[at] for k in keys), *(b[at] for b in contexts(keys, rows)), count.astype(U)]))
    whole = np.concatenate(held, 1) if held else np.zeros((2 * ORDER + 2, 0), U)
    _, at, inverse = np.unique(whole[ORDER], return_index=True, return_inverse=True)
    count = np.bincount(inverse, whole[-1].astype(np.int64), len(at)).astype(np.int64)
    return list(whole[: ORDER + 1, at]), list(whole[ORDER + 1 : -1, at]), count


def train(texts: list[str]) -> dict[str, np.ndarray]:
    """Sorted hash arrays of one language: key{n}/p{n} for n-grams, ctx{n}/gamma{n} for contexts of n characters."""
    keys, before, count = longest_grams(texts)
    tables: dict[int, tuple] = {}
    at = np.arange(len(count))
    for n in range(ORDER, 0, -1):
        if n < ORDER:  # continuation counts: of how many longer n-grams it is the end
            _, first, count = np.unique(keys[n][at], return_index=True, return_counts=True)
            at = at[first]
        tables[n] = (keys[n][at], at, count)
    out: dict[str, np.ndarray] = {}
    size = len(tables[1][0]) + 1
    out["floor"] = np.array([1 / size])
    lower = None
    for n in range(1, ORDER + 1):
        key, at, count = tables[n]
        ones, twos = int((count == 1).sum()), int((count == 2).sum())
        discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        ctx, owner = np.unique(before[n - 1][at], return_inverse=True)
        total = np.bincount(owner, count, len(ctx))
        gamma = discount * np.bincount(owner, minlength=len(ctx)) / np.maximum(total, 1)
        under = np.full(len(key), 1 / size) if n == 1 else lower[np.searchsorted(out[f"key{n - 1}"], keys[n - 1][at])]
        lower = np.maximum(count - discount, 0) / np.maximum(total, 1)[owner] + gamma[owner] * under
        out |= {f"key{n}": key, f"p{n}": lower, f"ctx{n - 1}": ctx, f"gamma{n - 1}": gamma}
    return out


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def log_probs(model: dict[str, np.ndarray], keys: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each place's character in one language, by backing off from the longest known n-gram."""
    n_all = len(keys[0])
    out, weight, open_ = np.zeros(n_all), np.ones(n_all), np.ones(n_all, bool)
    for n in range(ORDER, 0, -1):
        todo = np.flatnonzero(open_)
        at, hit = found(model[f"key{n}"], keys[n][todo])
        out[todo[hit]] = weight[todo[hit]] * model[f"p{n}"][at[hit]]
        open_[todo[hit]] = False
        rest = todo[~hit]
        at, hit = found(model[f"ctx{n - 1}"], before[n - 1][rest])
        weight[rest[hit]] *= model[f"gamma{n - 1}"][at[hit]]
    out[open_] = weight[open_] * model["floor"][0]
    return np.log(np.maximum(out, 1e-12))


class Identifier:
    """All languages' models; the longest n-grams of any language share one sorted array with a column each."""

    def __init__(self, models: dict[str, dict[str, np.ndarray]]):
        self.languages = sorted(models)
        self.models = models
        self.keys = np.zeros(0, U)
        self.table = np.zeros((0, len(models)), np.float32)
        self.usual = np.tile([0.0, 1.0, 1.0], (len(models), 1))
        self.sharpness, self.limit = 20.0, np.full(len(models), np.inf)

    def share(self, texts: list[str]) -> None:
        """Fill the shared array with the longest n-grams of the given (training) texts."""
        keys, before, _ = longest_grams(texts)
        if len(keys[ORDER]) * len(self.languages) > SHARED:
            return
        self.keys = keys[ORDER]
        self.table = np.stack([log_probs(self.models[x], keys, before) for x in self.languages], 1).astype(np.float32) if self.languages else self.table

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text (rows) and language (columns), texts' characters, second moments."""
        codes, rows = characters(texts)
        keys = grams(codes, rows)
        before = contexts(keys, rows)
        at, hit = found(self.keys, keys[ORDER])
        miss = np.flatnonzero(~hit)
        part, prior = [k[miss] for k in keys], [b[miss] for b in before]
        counts = np.bincount(rows, minlength=len(texts))
        out = np.zeros((len(texts), len(self.languages)))
        square = np.zeros_like(out)
        for j, name in enumerate(self.languages):
            logs = self.table[at, j].astype(float) if len(self.keys) else np.zeros(len(at))
            logs[miss] = log_probs(self.models[name], part, prior)
            out[:, j] = -np.bincount(rows, logs, len(texts)) / np.maximum(counts, 1)
            square[:, j] = np.bincount(rows, logs * logs, len(texts)) / np.maximum(counts, 1)
        return out, counts, square

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        """Learn the usual cross-entropies, the rejection limit and the sharpness from labelled texts."""
        parts = [self.entropies(piece) for piece in _pieces(texts)]
        entropy, counts, square = (np.concatenate([p[i] for p in parts]) for i in range(3))
        column = np.array([self.languages.index(t) for t in truth], int)
        ok = counts > 0
        right = ok & (entropy.argmin(1) == column)
        mine = [right & (column == j) for j in range(len(self.languages))]
        spread = np.sqrt(np.maximum(square - entropy**2, 1e-6))
        if not right.any():
            return
        away = np.concatenate([entropy[m, j] - entropy[m, j].mean() for j, m in enumerate(mine) if m.any()])
        at = np.flatnonzero(right), column[right]
        for j, m in enumerate(mine):  # a language without right documents has the figures of all
            values = (entropy[m, j], spread[m, j]) if m.any() else (entropy[at], spread[at])
            deviation = entropy[m, j].std() if m.sum() >= ENOUGH else away.std() if m.any() else entropy[at].std()
            self.usual[j] = values[0].mean(), deviation, values[1].mean()
        z = self._z(entropy[right], counts[right], column[right])
        for j, m in enumerate(mine):
            known = z[column[right] == j] if m.sum() >= ENOUGH else z
            self.limit[j] = max(LEAST_Z, OVER * float(np.quantile(known, QUANTILE)))
        lead = entropy[ok].min(1, keepdims=True) - entropy[ok]
        scores = []
        for sharp in (5.0, 10.0, 20.0, 40.0):
            p = np.exp(sharp * lead)
            p /= p.sum(1, keepdims=True)
            scores.append((np.log(np.maximum(p[np.arange(len(p)), column[ok]], 1e-9)).mean(), sharp))
        self.sharpness = max(scores)[1]

    def _z(self, entropy: np.ndarray, counts: np.ndarray, column: np.ndarray) -> np.ndarray:
        usual, deviation, spread = self.usual[column].T
        return (entropy[np.arange(len(column)), column] - usual) / np.sqrt(np.maximum(deviation**2 + spread**2 / np.maximum(counts, 1), 1e-6))

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text; no letters: 'und', 0 and rejected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, counts, _ = self.entropies(texts)
        best = entropy.argmin(1)
        weights = np.exp(-self.sharpness * (entropy - entropy.min(1, keepdims=True)))
        score = weights.max(1) / weights.sum(1)
        none = counts == 0
        rejected = none | (self._z(entropy, counts, best) > self.limit[best])
        return [UNKNOWN if n else self.languages[b] for n, b in zip(none.tolist(), best.tolist(), strict=True)], np.where(none, 0.0, score), rejected


def sampled(labelled: DataFrame, sample: int = SAMPLE, total: int = ALL_SAMPLE, size: int = SAMPLE_BYTES) -> DataFrame:
    """lang, text and calibrates of the documents to learn from.

    The order within a language is by a hash of ``key``; texts beyond the language's
    share of ``size`` come last.  Rows with a null are left out.
    """
    usable = labelled.where("lang is not null and text is not null and key is not null")
    deal = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30))
    sizes = stored(usable.groupBy("lang").count())
    many = max(1, sizes.count())
    each, room = max(10, min(sample, total // many)), size // many
    share = F.least(F.lit(1.0), F.lit(1.3 * each + 60) / F.col("count")) * (1 << 30)
    near = usable.join(maybe_broadcast(sizes, 100), "lang").withColumn("deal", deal).where(F.col("deal") < share)
    order = W.partitionBy("lang").orderBy(F.octet_length("text") > room, "deal", "key", "text")
    near = near.select("lang", "text", F.row_number().over(order).alias("place"), F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("bytes"))
    return near.where((F.col("place") <= each) & ((F.col("bytes") <= room) | (F.col("place") == 1))).select("lang", "text", (F.col("place") % 5 == 0).alias("calibrates"))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Identifier:
    """Train on rows (key, text, lang); ``key`` is any id that deals the sample, nulls are left out."""
    chosen = sampled(labelled, sample).toPandas()
    models, rest = {}, chosen[chosen["calibrates"]]
    learn = chosen[~chosen["calibrates"]]
    for lang, texts in learn.groupby("lang")["text"]:
        models[lang] = train(list(texts))
    out = Identifier(models)
    out.share(list(learn["text"]))
    rest = rest[rest["lang"].isin(models)]
    if len(rest):
        out.calibrate(list(rest["text"]), list(rest["lang"]))
    return out


def _judged(docs: DataFrame, model: Identifier, keep: list[str]) -> DataFrame:
    """kept_0, kept_1, ... (the columns ``keep``), lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    frame = docs.select("text", *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    schema = "".join(f"kept_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    names = [f"kept_{i}" for i in range(len(keep))] + ["lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in A.slices(batch, most=SLICE_BYTES):
                lang, score, rejected = model.judge(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=names)
        A.release()

    return frame.mapInArrow(run, schema + "lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, model: Identifier, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id), then lang_pred, score and rejected; one row per row.

    Reads the column text only.  A null text or one without letters is 'und', with
    score 0, rejected.  Repeated rows each come back; an empty table gives none.
    """
    keep = keep or ["doc_id"]
    return _judged(docs, model, keep).select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Identifier) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    kept = _judged(docs, model, docs.columns).where("not rejected")
    return kept.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)])
