import random

import pytest
import xxhash
from pyspark.sql import functions as F

from segquery.llm import common, graph, simhash


def fp_brute(text, size=3):
    ws = (text or "").encode().lower().split()
    sh = [b" ".join(ws[k : k + size]) for k in range(len(ws) - size + 1)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def component_brute(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_odd_rows_and_random(spark, odd_rows):
    r = random.Random(0)
    rows = [x[:2] for x in odd_rows]
    for i in range(100, 160):
        words = rows[0][1].split()
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = str(r.random())
        rows.append((i, " ".join(words[: r.choice([40, 300])])))
    fps = [fp_brute(t) for _, t in rows]
    comp = component_brute(set(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    want = sorted(((i, f"{f:016x}", least.get(comp[f])) for (i, _), f in zip(rows, fps, strict=True)), key=str)
    got = sorted(map(tuple, simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == want
    assert len(set(comp.values())) < len(comp)


def test_engine_hash_agrees(spark):
    s = spark.createDataFrame([("a b c",), ("é ü ß " * 20,)], "t string").select("t", F.xxhash64("t").alias("h"))
    assert all(r.h & (2**64 - 1) == xxhash.xxh64_intdigest(r.t.encode(), 42) for r in s.collect())


def test_ball_links_connect_all_pairs(spark):
    r = random.Random(1)
    base = [r.getrandbits(16) for _ in range(40)]
    vals = sorted({b ^ sum(1 << k for k in r.sample(range(16), r.randrange(3))) for b in base for _ in range(6)})
    with pytest.raises(ValueError):
        simhash.ball_links(spark.createDataFrame([(0,)], "fp long"), 16, 3)
    for radius in (2, 4):
        links = [(x.a, x.b) for x in simhash.ball_links(spark.createDataFrame([(v,) for v in vals], "fp long"), 16, radius).collect()]
        near = lambda a, b, radius=radius: (a ^ b).bit_count() <= radius
        assert all(near(a, b) for a, b in links)
        a, b = component_brute(vals, near), component_brute(vals, lambda x, y, s=set(links): (x, y) in s or (y, x) in s)
        assert len(set(a.values())) == len(set(b.values()))


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3), (900, 901), (901, 900)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 201 + 60 + 2 and len(set(got.values())) == 3
    assert len({got[k] for k in range(201)}) == 1 and len({got[k] for k in range(500, 560)}) == 1
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b, size=5):
    sh = lambda t: {tuple(t.lower().split()[k : k + size]) for k in range(max(1, len(t.split()) - size + 1))}
    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y)


def test_components_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    edges = spark.createDataFrame([(k, k + 1) for k in range(2000) if k % 50], "a long, b long")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in graph.components(edges).collect()}
        files = [len(list(t.glob("part-*"))) for t in tmp_path.glob("segquery/*")]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got.keys() == {k for k in range(1, 2001)} and len(files) > 3
    assert all((got[k] == got[k + 1]) == (k % 50 > 0) for k in range(1, 2000))
    assert sorted(files)[-2] <= 2  # all but the edges as they come


def test_similar_components(spark):
    """Near copies of similarity 0.8 and more are found, others are left alone."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, groups = [], []
    for g in range(60):
        words = [word() for _ in range(r.choice([60, 150, 400]))]
        rows.append((10 * g, " ".join(words)))
        for k in range(1, 1 + g % 3):
            w = list(words)
            for _ in range(r.randrange(1, max(2, len(w) // 55))):
                w[r.randrange(len(w))] = word()
            rows.append((10 * g + k, " ".join(w)))
            groups.append((10 * g, 10 * g + k, jaccard(rows[-1][1], " ".join(words))))
    rows += [(9001, rows[0][1].upper()), (9002, None), (9003, ""), (9004, None)]
    got = {x.doc_id: x.component_id for x in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [(a, b) for a, b, j in groups if j >= 0.8]
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near) and len(near) > 30
    assert all(got[i] // 10 == i // 10 for i in got if i < 9000)
    assert got[9001] == 0 and got[9002] == got[9003] == got[9004] == 9002


def test_similar_whatever_the_repeats(spark):
    """Near copies that differ in how often a line is repeated are found."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(30):
        text, line = " ".join(word() for _ in range(200)), " ".join(word() for _ in range(6))
        rows += [(2 * g, text), (2 * g + 1, f"{text} " + " ".join([line] * (20 + 4 * g)))]
    assert all(jaccard(rows[i][1], rows[i + 1][1]) >= 0.9 for i in range(0, len(rows), 2))
    got = {x.doc_id: x.component_id for x in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i // 2 * 2 for i in range(len(rows)))


def test_similar_with_the_tables_of_a_large_input(spark, monkeypatch):
    """The sketches and tables that 3,000,000 texts get number their values beyond 32 bits."""
    sized = simhash.tables_for
    bits, tables = sized(3_000_000, 0.8)
    assert (tables - 1) << bits > 1 << 31
    monkeypatch.setattr(simhash, "tables_for", lambda n, *args: sized(3_000_000, *args))
    r = random.Random(5)
    rows = []
    for g in range(30):
        words = [f"w{r.randrange(10**6)}" for _ in range(100)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:-1], "last"]))]
    got = {x.doc_id: x.component_id for x in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_similar_in_a_crowd(spark):
    """In a large family with shared boilerplate all near copies are found, as by brute force."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(160)]
    rows = []
    for g in range(400):
        own = [word() for _ in range(26)]
        rows.append((2 * g, " ".join(shared + own)))
        if g % 2:
            own[r.randrange(2, 24)] = word()
            rows.append((2 * g + 1, " ".join(shared[:-1] + [word()] + own)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = component_brute(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    groups = lambda of: {frozenset(k for k in of if of[k] == c) for c in set(of.values())}
    got = {x.doc_id: x.component_id for x in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) == 400 and groups(got) == groups(want)


def test_empty(empty):
    assert simhash.simhash_components(empty).count() == 0 and simhash.similar_components(empty).count() == 0


def test_odd_rows_similar(odd):
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.similar_components(odd).collect())
    assert len(got) == 15
    at = dict(got)
    assert at["0"] == at["1"] == at["2"] == 0 and at["3"] == at["4"] == at["5"] == 3 and at["8"] == 8
