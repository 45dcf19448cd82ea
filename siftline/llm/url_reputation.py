"""URL filtering: explicit rules first, then empirical-Bayes host reputation.

Labelled outcomes (bad or not) of pages are counted per host.  The bad shares of the
children of a node (suffixes under the whole, registered domains under a suffix, hosts
under a domain) follow a beta distribution around the node's own share; how tight it
is, is fitted at each level by moments, net of the binomial noise of the counts.  Each
posterior mean is the prior mean of the level below.  A page is blocked if even the
lower quantile of its host's posterior lies above the tolerated share.  Only counts per
host are shuffled and aggregated; texts never are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ascii_lower, maybe_broadcast, stored

#: A rule: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A host is blocked when its bad share exceeds TOLERATED with a posterior probability of 1 - DOUBT.
TOLERATED, DOUBT = 0.5, 0.05
#: Suffixes of more than one label under which names are registered; pass a longer list to ``judge`` as needed.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "co.za")
#: Bounds of a fitted prior's weight, in pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
#: Words that make a url bad where they stand alone between marks.
SPAM_WORDS = ("ads", "adult", "bet", "betting", "bonus", "casino", "escort", "gambling", "jackpot", "nude", "pills", "poker", "porn", "sex", "slots", "viagra", "xxx")
#: A page's visible text counts as bad from this share of noise characters on.
NOISE = 0.08


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path, as text) and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def name_of(host: Column) -> Column:
    """A host without user part, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "(:[0-9]*)?\\.*(:[0-9]*)?$", "")


def is_address(name: Column) -> Column:
    """Whether a name is a numeric address, which has no domain."""
    return name.rlike("^[0-9.]+$|^\\[")


def domain_of(host: Column, suffixes: tuple = LONG_SUFFIXES) -> Column:
    """The registered domain: one label before the public suffix; the name itself if it has no more or is an address."""
    name = name_of(host)
    long = F.substring_index(name, ".", -2).isin(*suffixes)
    return F.when(is_address(name), name).when(long, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix_of(host: Column, suffixes: tuple = LONG_SUFFIXES) -> Column:
    """The public suffix of a host; empty for an address."""
    name = name_of(host)
    last_two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), F.lit("")).when(last_two.isin(*suffixes), last_two).otherwise(F.substring_index(name, ".", -1))


def noisy(html: Column) -> Column:
    """Whether a page's visible text is mostly noise characters; null for a page without text."""
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>", " "), "\\s+", "")
    noise = F.length(text) - F.length(F.translate(text, "#*$%&|!", ""))
    return F.when(F.length(text) > 0, noise / F.length(text) >= NOISE)


def spammy(url: Column) -> Column:
    """Whether one of SPAM_WORDS stands in a url's host or path, between any marks; false for null."""
    return F.coalesce(F.concat(host_of(url), ascii_lower(path_of(url))).rlike(f"(^|[^a-z0-9])({'|'.join(SPAM_WORDS)})([^a-z0-9]|$)"), F.lit(False))


def _lower_quantile(a: np.ndarray, b: np.ndarray, q: float) -> np.ndarray:
    """The q-quantile of beta distributions, by halving; from a + b = 20,000 on from mean and deviation."""
    mean = a / (a + b)
    out = mean - 1.6448536269514722 * np.sqrt(mean * (1 - mean) / (a + b + 1)) if q == 0.05 else mean.copy()
    small = np.flatnonzero((a + b < 20_000) | (q != 0.05))
    lo, hi = np.zeros(len(small)), np.ones(len(small))
    for _ in range(50):
        mid = (lo + hi) / 2
        below = beta_cdf(mid, a[small], b[small]) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    out[small] = (lo + hi) / 2
    return np.clip(out, 0.0, 1.0)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction evaluated from the front."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    log_beta = np.array([math.lgamma(p) + math.lgamma(r) - math.lgamma(p + r) for p, r in zip(a.tolist(), b.tolist(), strict=True)])
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            value *= d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    out = front * value
    return np.where(flip, 1 - out, out)


def prior_weight(children: DataFrame) -> float:
    """The weight, in pages, of the prior of all ``children``, which have rows, bad and prior_mean.

    The squared distance of a child's bad count from its expectation exceeds the
    binomial variance by n - 1 times the correlation of two of its pages, and the
    weight is one over that correlation, less one.
    """
    n, m = F.col("rows").cast("double"), F.col("prior_mean")
    noise = m * (1 - m)
    sums = children.agg(F.sum((F.col("bad") - n * m) ** 2 - n * noise).alias("over"), F.sum(n * (n - 1) * noise).alias("pairs")).first()
    if not sums.pairs:
        return MOST_WEIGHT
    share = sums.over / sums.pairs
    return MOST_WEIGHT if share <= 0 else min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / share - 1))


def reputations(outcomes: DataFrame, suffixes: tuple = LONG_SUFFIXES) -> DataFrame:
    """host, rows, mean and bound: posterior mean and lower quantile of each host's bad share.

    ``outcomes`` has host and bad (boolean; nulls are no outcome).
    """
    counted = outcomes.groupBy("host").agg(F.count("bad").alias("rows"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    hosts = stored(counted.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    whole = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("rows"), F.lit(0)) + 1)).alias("mean")).first()
    parents, keys = None, []
    for key in ("suffix", "domain", "host"):
        keys = [*keys, key]
        level = hosts.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))
        level = level.withColumn("prior_mean", F.lit(float(whole["mean"]))) if parents is None else level.join(parents.select(*keys[:-1], F.col("mean").alias("prior_mean")), keys[:-1])
        weight = prior_weight(level)
        parents = level.withColumns({"weight": F.lit(weight), "mean": (F.col("bad") + F.col("prior_mean") * weight) / (F.col("rows") + weight)})

    @F.pandas_udf("double")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_lower_quantile(a.to_numpy(float), b.to_numpy(float), DOUBT))

    total = F.col("rows") + F.col("weight")
    return parents.select("host", "rows", "mean", bound(F.col("mean") * total, (1 - F.col("mean")) * total).alias("bound"))


def judge(pages: DataFrame, outcome: Column | None = None, rules: tuple = RULES, suffixes: tuple = LONG_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior mean and bound; one row per row.

    ``outcome`` is a boolean column of labelled page outcomes; by default a page is
    bad if its url holds a spam word or its own text is mostly noise.  A null url has empty host and path and is judged by the
    reputation of the empty host.  A host with no outcome has the mean of its
    domain.  Repeated rows count and come back each; an empty table gives no rows.
    """
    url = F.col("url")
    seen = stored(
        pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), (spammy(url) | F.coalesce(noisy(F.col("html")), F.lit(False)) if outcome is None else outcome).alias("bad"))
    )
    known = stored(reputations(seen, suffixes))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = seen.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    joined = named.join(maybe_broadcast(known, 120), "host", "left")
    method = F.when(F.col("bound") > TOLERATED, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.col("mean").alias("bad_mean"), F.col("bound").alias("bad_bound"))
