import itertools
import random

import pytest
from pyspark.sql import functions as F

from segquery.llm import packing


def cost(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_optimal_against_brute_force():
    r = random.Random(0)
    for _ in range(200):
        n = r.randrange(1, 9)
        ls = r.sample(range(1, 60), n)
        cs = [r.randrange(1, 30) for _ in ls]
        k = r.randrange(1, 6)
        bounds, total = packing.optimal_boundaries(ls, cs, k)
        best = min(cost(ls, cs, (*b, max(ls))) for m in range(min(k, n)) for b in itertools.combinations(sorted(ls)[:-1], m))
        assert total == best == cost(ls, cs, bounds) and len(bounds) <= k and max(bounds) == max(ls)


@pytest.mark.parametrize("budget", [10, 500, 65_536])
def test_batches(odd, odd_rows, budget):
    rows = packing.packed(odd, buckets=3, budget=budget).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == sorted((str(i), len((t or "").encode().split()) + 1) for i, t, *_ in odd_rows)
    assert all(r.padding == r.boundary - r.length >= 0 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.batch_id, []).append(r)
    for b in by.values():
        assert len({r.boundary for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].boundary <= budget


def test_one_very_long_row_changes_no_boundary(spark):
    """Lengths far apart: padding stays minimal for all rows."""
    lengths = [x for x in range(2, 90) for _ in range(1 + x % 7)] + [6_500_000]
    d = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    rows = packing.packed(d, F.col("n"), buckets=6).collect()
    hist = {x: lengths.count(x) for x in lengths}
    bounds, least = packing.optimal_boundaries(list(hist), list(hist.values()), 6)
    assert sum(r.padding for r in rows) == least and {r.boundary for r in rows} == set(bounds) and max(bounds) == 6_500_000


def test_shards_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    d = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    rows = packing.packed(d, budget=40).collect()
    assert len(rows) == 1000 and len({r.batch_id.split("-")[1] for r in rows}) == 20 and len({(r.batch_id, r.slot) for r in rows}) == 1000


def test_partitions_do_not_matter(odd):
    of = lambda d: sorted(map(str, packing.packed(d, budget=500).collect()))
    assert of(odd.repartition(1)) == of(odd.repartition(7)) == of(odd.unionAll(odd.limit(0)))


def test_very_many_equal_rows(spark):
    d = spark.range(150_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    rows = packing.packed(d, budget=30)
    assert rows.count() == 150_000 == rows.select("batch_id", "slot").distinct().count()


def test_empty(empty):
    assert packing.packed(empty).count() == 0
