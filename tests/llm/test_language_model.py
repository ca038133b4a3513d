import collections
import math
import zlib

import pytest

from segquery.llm import katz


def brute(rows, k=5):
    """Katz scores by plain dictionaries."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [(i, (t or "").encode().lower().split() + ["END"]) for i, t in rows]
    c, b, ch = collections.Counter(), collections.Counter(), collections.Counter()
    for i, ws in toks:
        if not held(i):
            prev = "START"
            for w in ws:
                c[w] += 1
                b[prev, w] += 1
                ch[prev] += 1
                prev = w
    n, v = sum(c.values()), len(c)
    of = lambda cnt: katz.discounts([collections.Counter(cnt.values())[r] for r in range(1, k + 2)])
    d1, d2 = of(c), of(b)
    p_uni = {w: d1[min(x, k + 1)] * x / n for w, x in c.items()}
    unknown = 1 - math.fsum(p_uni.values())
    if unknown < 1e-12:
        p_uni, unknown = {w: d1[min(x, k + 1)] * x / (n + 1) for w, x in c.items()}, 1 / (n + 1)
    seen = collections.defaultdict(list)
    for (h, w), x in b.items():
        seen[h].append((w, d2[min(x, k + 1)] * x))
    den, alpha = {}, {}
    for h, followers in seen.items():
        s = math.fsum(x for _, x in followers)
        den[h] = ch[h] + (ch[h] - s < 1e-9)
        alpha[h] = (1 - s / den[h]) / (1 - math.fsum(p_uni[w] for w, _ in followers))
        whole = s / den[h] + alpha[h] * (1 - math.fsum(p_uni[w] for w, _ in followers))
        assert whole == pytest.approx(1, abs=1e-12)  # exactly normalised
    out = []
    for i, ws in toks:
        prev, score, base = "START", 0.0, 0.0
        for w in ws:
            x = b[prev, w]
            score += math.log10(d2[min(x, k + 1)] * x / den[prev] if x else alpha.get(prev, 1.0) * p_uni.get(w, unknown))
            base += math.log10((c[w] + 1) / (n + v + 1))
            prev = w
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.katz_scores(df, **kw).collect()], key=str)


def test_odd_rows(odd, odd_rows):
    assert got(odd) == brute([r[:2] for r in odd_rows])


def test_corpus(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(d) == brute([(r.doc_id, r.text) for r in d.collect()])


def test_small_batches_give_equal_scores(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    whole = got(d)
    assert got(d.repartition(5)) == whole
    assert got(d, batch=2_000) == whole


def test_empty(empty):
    assert got(empty) == []


def test_no_training_rows(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert {r[-1] for r in got(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string"))} == {0.0}


def test_tables_hold_the_counts(spark):
    d = spark.createDataFrame([(i, t) for i, t in zip([k for k in range(20) if zlib.crc32(str(k).encode()) % 7 != 2], ["a b a b", "a b"], strict=False)], "doc_id long, text string")
    tables, const = katz.katz_model(d)
    rows = katz.ngram_rows(tables)
    assert const.n == 8 and const.v == 3
    assert sorted(r["count"] for r in rows.where("history is null").collect()) == [2, 2, 3, 3]  # a, b, end, start
    assert sorted(r["count"] for r in rows.where("history is not null").collect()) == [1, 2, 2, 3]
