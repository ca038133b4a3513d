"""Packing into optimal length buckets.

The exact histogram of lengths over all rows decides, by dynamic programming, which bucket
boundaries minimise the padding; inside a bucket, batches hold as many rows as the token budget
allows at the bucket's boundary.

Defined results: a null or empty text has length 1 (its end token); repeated rows are packed as
rows of their own; null ids are packed like others; an empty table gives an empty table; a text
longer than the budget stands alone in its batch. Nothing is cut or dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 16
BUDGET = 65_536
SHARD_ROWS = 50_000


def word_length(text: str = "text") -> Column:
    """Words between ASCII white space and one end token."""
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def optimal_boundaries(lengths: list[int], counts: list[int], k: int) -> tuple[list[int], int]:
    """At most ``k`` boundaries that minimise the sum of (boundary - length), and this sum.

    With sorted lengths L, running counts N and running sums S, the cost of a bucket (i, j] is
    L[j] (N[j] - N[i]) - (S[j] - S[i]); for fixed j that is a line in L[j] for each i, so each
    layer of the programme is a lower envelope of lines: O(k * distinct lengths), exact integers.
    """
    order = np.argsort(lengths, kind="stable")
    ls = [int(lengths[i]) for i in order]
    n, s = [0], [0]
    for i in order:
        n.append(n[-1] + int(counts[i]))
        s.append(s[-1] + int(counts[i]) * int(lengths[i]))
    d = len(ls)
    if not d:
        return [], 0
    inf = None
    best: list[int | None] = [0] + [inf] * d
    back: list[list[int]] = []
    totals: list[int] = []
    for _ in range(min(k, d)):
        new: list[int | None] = [inf] * (d + 1)
        frm = [0] * (d + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i); slopes fall, queries rise
        head = 0
        for j in range(1, d + 1):
            if best[j - 1] is not None:
                m, c = -n[j - 1], best[j - 1] + s[j - 1]
                while len(hull) - head >= 2 and (c - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, c, j - 1))
            if head >= len(hull):
                continue
            x = ls[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            m, c, i = hull[head]
            new[j], frm[j] = m * x + c + x * n[j] - s[j], i
        best = new
        back.append(frm)
        totals.append(best[d])
    layer = min(range(len(totals)), key=lambda t: totals[t])
    out, j = [], d
    for t in range(layer, -1, -1):
        out.append(ls[j - 1])
        j = back[t][j]
    return out[::-1], totals[layer]


def packed(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, length, boundary, padding, batch_id, slot), one row for each row of ``docs``.

    Rows of a bucket are dealt by hash to shards of about ``SHARD_ROWS`` and batched there, so no
    task holds a bucket; every shard's last batch may be part full. The driver sees the counts of
    the distinct lengths, of which there are at most the root of twice the sum of all lengths.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), (length if length is not None else word_length()).alias("length"))
    # equal rows are numbered, so the batches do not depend on how the rows lie in partitions
    alike = given.groupBy("doc_id", "length").agg(F.count("*").alias("n"))
    most = 1 << 16
    alike = alike.select("doc_id", "length", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("part"))
    last = F.least(F.lit(most - 1).cast("long"), F.col("n") - 1 - F.col("part") * most)
    alike = alike.select("doc_id", "length", "part", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("copy"))
    rows = stored(alike.select("doc_id", "length", F.xxhash64("doc_id", "part", "copy").alias("deal")))
    hist = rows.groupBy(F.col("length").alias("b")).agg(F.count("*").alias("n")).collect()
    bounds, _ = optimal_boundaries([r.b for r in hist], [r.n for r in hist], buckets)
    if not bounds:
        return rows.select("doc_id", "length", F.lit(0).cast("long").alias("boundary"), F.lit(0).cast("long").alias("padding"), F.lit("").alias("batch_id"), F.lit(0).alias("slot"))
    inside = [sum(r.n for r in hist if (bounds[i - 1] if i else -1) < r.b <= b) for i, b in enumerate(bounds)]

    def of_bucket(values: list[int]) -> Column:
        c = None
        for b, v in zip(bounds, values, strict=True):
            c = F.when(F.col("length") <= b, F.lit(v).cast("long")) if c is None else c.when(F.col("length") <= b, F.lit(v).cast("long"))
        return c

    fits = [max(1, budget // b) for b in bounds]
    shards = [max(1, round(n / SHARD_ROWS)) for n in inside]
    placed = rows.select("doc_id", "length", "deal", of_bucket(bounds).alias("boundary"), of_bucket(fits).alias("fits"), F.pmod("deal", of_bucket(shards)).alias("shard"))
    at = F.row_number().over(Window.partitionBy("boundary", "shard").orderBy("length", "doc_id", "deal")) - 1
    out = placed.withColumn("at", at)
    return out.select(
        "doc_id", "length", "boundary", (F.col("boundary") - F.col("length")).alias("padding"),
        F.concat_ws("-", "boundary", "shard", F.floor(F.col("at") / F.col("fits"))).alias("batch_id"), (F.col("at") % F.col("fits")).cast("int").alias("slot"),
    )
