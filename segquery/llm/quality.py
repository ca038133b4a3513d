"""Quality by hierarchical empirical Bayes: a document's own evidence, its host's and its path's.

A logistic classifier on surface statistics of the whole text, fitted on a bounded sample of
labelled rows, gives each document log odds. Their probabilities, summed over all documents of a
host and of a path, are pseudo counts of Beta posteriors: the global share is the prior of a
host, a host's posterior the prior of its paths; strengths come from the spread between hosts
and between paths (method of moments). A document's own pseudo count is left out of the
posteriors that it meets.

Defined results: null text is empty text; a null host or path is the site ``''``; repeated rows
count as rows, but an id is one row to the classifier (the least vector where its texts differ) and
of low quality where its labels differ; without labelled rows of both classes every document scores the prior 0.5 and is
kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

#: Most labelled rows of a class that the classifier is fitted on.
SAMPLE = 8_000
#: Weight of the site's evidence, in log odds: sites are correlated evidence, so they count half.
SITE_WEIGHT = 0.5

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER, _DIGIT, _SPACE = bytes(range(65, 91)), bytes(range(48, 58)), bytes((9, 10, 11, 12, 13, 32))
_STOPS = bytes(b".,;:?'\"()-")
FEATURES = ("bias", "log_words", "mean_word", "spread_word", "upper", "digit", "stops", "symbols", "pipes", "bangs", "new_words", "same_lines", "line_words", "long_words", "symbol_ends", "stop_ends")


def features_of(text: str) -> list[float]:
    """Surface statistics of the whole text, each within about [0, 10]."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    letters = size - len(raw.translate(None, _LETTERS))
    upper = size - len(raw.translate(None, _UPPER))
    digits = size - len(raw.translate(None, _DIGIT))
    stops = size - len(raw.translate(None, _STOPS))
    spaces = size - len(raw.translate(None, _SPACE))
    symbols = size - letters - digits - stops - spaces
    lens = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    alpha = ((ends | 32) >= 97) & ((ends | 32) <= 122) | (ends >= 128)
    stop_end = (ends == 46) | (ends == 44)
    return [
        1.0, float(np.log1p(n)), float(min(lens.mean(), 40) / 5), float(min(lens.std(), 40) / 5), upper / max(1, letters), 10 * min(1.0, digits / size * 3), 10 * stops / size, 10 * symbols / size,
        raw.count(b"|") / n, raw.count(b"!") / n, len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))), float((lens > 20).mean()), float((~alpha & ~stop_end).mean()), float(stop_end.mean()),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights for raw features: Newton steps on standardised ones."""
    mean, std = x.mean(0), x.std(0)
    mean[0], std[0] = 0.0, 1.0
    std[std < 1e-9] = 1.0
    z = (x - mean) / std
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + keep * w
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = w / std
    raw[0] = w[0] - float((w[1:] * mean[1:] / std[1:]).sum())
    return raw


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, host, path, doc_score, host_posterior, path_posterior, quality_score, keep), one row a document.

    ``host`` and ``path`` name a document's site and part of the site; documents of the corpus
    have their source as host and source and language as path.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def stats(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, h, p in it:
            yield doc_id, h, p, features_of(text)

    seen = stored(map_rows(rows, stats, "doc_id long, host string, path string, x array<double>", 2048))
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    given = []
    for q in (0, 1):
        chosen = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        given.append([r.x for r in seen.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("x").collect()])
    if not given[0] or not given[1]:
        weights = [0.0] * len(FEATURES)
        logit = F.lit(0.0)
    else:
        n_of = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
        x, y = np.array(given[0] + given[1]), np.r_[np.zeros(len(given[0])), np.ones(len(given[1]))]
        weights = fit_logistic(x, y)
        # the sample may hold the classes in other shares than the labels do
        weights[0] += np.log(n_of[1] / n_of[0]) - np.log(len(given[1]) / len(given[0]))
        logit = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))
    scored = stored(seen.select("doc_id", "host", "path", bounded.alias("z")).withColumn("p", 1 / (1 + F.exp(-F.col("z")))))
    paths = stored(scored.groupBy("host", "path").agg(F.sum("p").alias("a"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("a").alias("ha"), F.sum("n").alias("hn"))
    total = hosts.agg(F.sum("ha").alias("a"), F.sum("hn").alias("n")).first()
    mu = min(1 - 1e-4, max(1e-4, (total.a or 0.5) / (total.n or 1)))
    k_host = _strength(hosts, "ha", "hn", F.lit(mu))
    host_mean = (F.col("ha") + F.lit(k_host * mu)) / (F.col("hn") + F.lit(k_host))
    both = paths.join(hosts, "host")
    k_path = _strength(both, "a", "n", host_mean)
    out = scored.join(both, ["host", "path"])
    own_host = (F.col("ha") - F.col("p") + F.lit(k_host * mu)) / (F.col("hn") - 1 + F.lit(k_host))
    out = out.withColumn("host_posterior", own_host)
    out = out.withColumn("path_posterior", (F.col("a") - F.col("p") + F.lit(k_path) * F.col("host_posterior")) / (F.col("n") - 1 + F.lit(k_path)))
    site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_posterior")))
    z = F.col("z") + F.lit(SITE_WEIGHT) * (F.log(site / (1 - site)) - F.lit(float(np.log(mu / (1 - mu)))))
    out = out.withColumn("quality_score", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", "host", "path", F.col("p").alias("doc_score"), "host_posterior", "path_posterior", "quality_score", (F.col("quality_score") >= 0.5).alias("keep"))


def _strength(groups: DataFrame, a: str, n: str, mean: Column) -> float:
    """Pseudo count of the Beta prior: from the spread of group shares beyond the binomial one, within [2, 10000]."""
    share, m = F.col(a) / F.col(n), mean
    r = groups.agg(
        F.sum(F.col(n) * (share - m) * (share - m)).alias("between"), F.sum(m * (1 - m)).alias("within"), F.sum(m * (1 - m) * F.col(n)).alias("scale"), F.count("*").alias("g")
    ).first()
    if not r.g or not r.scale:
        return 10.0
    rho = max(0.0, (r.between or 0.0) - r.within) / r.scale  # variance of group shares over m(1 - m)
    return float(min(10_000.0, max(2.0, 1 / rho - 1 if rho > 0 else 10_000.0)))
