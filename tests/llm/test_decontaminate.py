import random
import re

from segquery.llm import decontaminate as D

from .conftest import prose


def toks(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(docs, items):
    """Best stretch over all alignments, without seeds."""
    out = set()
    for i, t in docs:
        w = toks(t)
        for b, bt in items:
            g = toks(bt)
            if len(g) < 8 or i is None:
                continue
            for s in range(-len(g) + 1, len(w)):
                now = best = 0
                for j in range(max(0, -s), min(len(g), len(w) - s)):
                    now = max(0, now + (1 if g[j] == w[s + j] else -1))
                    best = max(best, now)
                if best >= min(10, len(g)):
                    out.add((i, b, best))
    best = {}
    for i, b, s in out:
        best[i, b] = max(best.get((i, b), 0), s)
    return best


def test_against_brute_force(spark):
    r = random.Random(0)
    items = [(k, prose(1000 + k, n)) for k, n in enumerate([9, 12, 15, 25, 40, 7, 3])] + [(50, None), (51, ""), (None, "x " * 20)]
    docs = [(k, prose(k, r.randrange(0, 120))) for k in range(30)]
    for k in range(100, 150):
        g = toks(r.choice(items[:5])[1])
        for _ in range(r.randrange(0, 1 + len(g) // 8)):
            g[r.randrange(len(g))] = "sub"
        docs.append((k, prose(k, 30) + " " + r.choice([" ".join(g), ", ".join(g).upper(), " ".join(g[:10])]) + " " + prose(k + 500, 20)))
    docs += [(200, None), (201, ""), (None, items[3][1]), (202, items[3][1]), (202, items[3][1])]
    got = {(x.doc_id, x.item_id): x.score for x in D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, [i for i in items if i[0] is not None])
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.97 * len(want) and len(want) > 30  # seeds may miss what substitutions cut to pieces


def test_one_row_a_document(odd, odd_rows, empty, spark):
    bench = spark.createDataFrame([(0, " ".join(odd_rows[0][1].split()[40:70]))], "item_id long, text string")
    rows = D.contaminated(odd, bench).collect()
    assert len(rows) == 15 and {r.doc_id for r in rows if r.contaminated} == {0, 1, 2, 11}
    assert D.contaminated(empty, bench).count() == 0
    assert not any(r.contaminated for r in D.contaminated(odd, bench.limit(0)).collect())


def test_shuffled_form_agrees(odd, odd_rows, spark, monkeypatch):
    bench = spark.createDataFrame([(0, " ".join(odd_rows[0][1].split()[40:70]))], "item_id long, text string")
    a = sorted(map(tuple, D.contamination(odd, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert a == sorted(map(tuple, D.contamination(odd, bench).collect())) and a


def test_planted_benchmark_passages(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [toks(r.text) for r in bench.collect()]
    holds = {r.doc_id for r in docs.collect() if any(" " + " ".join(g) + " " in " " + " ".join(toks(r.text)) + " " for g in items)}
    found = {r.doc_id for r in D.contaminated(docs, bench).collect() if r.contaminated}
    assert holds <= found and len(found - holds) <= 1


def test_plan_is_native(spark, sf):
    plan = D.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
