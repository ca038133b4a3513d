import collections
import hashlib
import random

import pytest

from segquery.llm import suffix_dedup


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    c = collections.Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if c[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        n = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), n, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_substrings(df, **kw).collect()], key=str)


def test_odd_rows(odd, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert got(odd) == got(odd, hot=1) == brute(rows, 400)


@pytest.mark.parametrize("hot", [1, 3, 4000])
def test_random(spark, hot):
    r = random.Random(0)
    pieces = ["".join(r.choice("ab") for _ in range(n)) for n in (40, 60, 75, 90)]
    rows = [(i, "".join(r.choice(pieces) if r.random() < 0.5 else "".join(r.choice("abcdefgh") for _ in range(r.randrange(5, 60))) for _ in range(r.randrange(0, 9)))) for i in range(120)]
    rows += [(1000, "ab" * 90), (1001, "a" * 39), (1002, "a" * 40), (1003, "a" * 41), (1004, None)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=40, hot=hot) == brute(rows, 40)


def passages(spark):
    """One passage in every text, cut at various places, and runs of one letter."""
    r = random.Random(1)
    shared = "".join(r.choice("abcdefgh") for _ in range(300))
    rows = [(i, "".join(r.choice("abcdefgh") for _ in range(50)) + shared[k : k + 150] + str(i)) for i, k in enumerate([0, 20, 60, 100, 150] * 6)]
    rows += [(100 + k, "q" * (39 + k) + shared[k : k + 45]) for k in range(9)] + [(200, shared), (201, shared[:41]), (202, shared[-41:]), (203, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("hot", [1, 5, 20])
def test_one_passage_in_many_texts(spark, hot):
    rows, df = passages(spark)
    assert got(df, length=40, hot=hot) == brute(rows, 40)


def test_chunks_do_not_matter(spark):
    """Buckets that are refined one at a time give what buckets refined together do."""
    rows, df = passages(spark)
    for size in (1, 100, 10**9):
        assert got(df, length=40, chunk=size) == brute(rows, 40)


def test_empty(empty):
    assert got(empty) == []
