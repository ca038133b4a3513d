"""Interval joins by bins, score states, ranks by counting, block search, numbering: each against the plain version."""

import itertools

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from segquery.functions import sql
from segquery.operators import analysis as A
from segquery.operators import block_search as B
from segquery.operators import evaluation as E
from segquery.operators import intervals as I
from segquery.operators import localize as L
from segquery.operators import losses
from segquery.operators import numbering as N
from segquery.operators import retrieval as R
from segquery.operators import score_states as K
from segquery.operators import stats as S
from segquery.operators import vectors as V

# ---------------------------------------------------------------- intervals


def segments(spark, rng, n, role, items=3, hot=0.6):
    rows = []
    for k in range(n):
        v = "hot" if rng.random() < hot else f"v{rng.integers(items)}"
        ts = float(rng.integers(0, 400)) / 2
        rows.append((v, f"{role}{k}", ts, ts + float(rng.choice([0, 0.5, 1, 3, 10, 200])), float(rng.integers(0, 5)) / 4))
    cols = "gt_id" if role == "g" else "pred_id"
    return rows, spark.createDataFrame(rows, f"video_id string, {cols} string, ts double, te double, conf double")


def tiou(a, b):
    inter = max(0.0, min(a[3], b[3]) - max(a[2], b[2]))
    return inter / ((a[3] - a[2]) + (b[3] - b[2]) - inter) if inter else 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    gs, g = segments(spark, rng, 120, "g")
    ps, p = segments(spark, rng, 150, "p")
    want = {(a[1], b[1]): round(tiou(a, b), 9) for a in gs for b in ps if a[0] == b[0] and tiou(a, b) > 0}
    rows = I.pairs(g, p).collect()
    assert {(r.gt_id, r.pred_id): round(r.tiou, 9) for r in rows} == want and len(rows) == len(want)
    best = {a[1]: max([(tiou(a, b), -b[2], b[1]) for b in ps if a[0] == b[0]], default=None, key=lambda x: (x[0], x[1])) for a in gs}
    got = {r.gt_id: r for r in I.best_match(g, p).collect()}
    for a in gs:
        own = [b for b in ps if b[0] == a[0]]
        if not own:
            assert got[a[1]].pred_id is None and got[a[1]].tiou is None
            continue
        first = min(own, key=lambda b: (-round(tiou(a, b), 12), b[2], b[1]))
        assert (got[a[1]].pred_id, round(got[a[1]].tiou, 9)) == (first[1], round(tiou(a, first), 9))
    assert all(round(r.best, 9) == round(best[r.gt_id][0] if best[r.gt_id] else 0.0, 9) for r in I.best_tiou(g, p).collect())


def test_hot_item_is_linear(spark):
    """20,000 short segments and one long one of an item: entries stay below three a segment, and pairs without overlap are not made."""
    n = 20_000
    a = spark.range(n).select(F.lit("hot").alias("video_id"), F.col("id").alias("gt_id"), F.col("id").cast("double").alias("ts"), (F.col("id") + 0.9).alias("te"))
    b = a.select("video_id", F.col("gt_id").alias("pred_id"), (F.col("ts") + 0.5).alias("ts"), (F.col("te") + 0.5).alias("te"), F.lit(1.0).alias("conf"))
    long = spark.createDataFrame([("hot", -1, 0.0, float(n), 1.0)], b.schema)
    assert I.pairs(a, b.unionByName(long)).count() == n + (n - 1) + n
    assert I.pairs(a, b.limit(0)).count() == 0 == I.pairs(a.limit(0), b).count()


def test_null_and_empty_times(spark):
    a = spark.createDataFrame([("v", 0, None, 1.0), ("v", 1, 0.0, None), ("v", 2, 1.0, 1.0), ("v", 3, 2.0, 1.0), ("v", 4, 0.0, 2.0), (None, 5, 0.0, 2.0)], "video_id string, gt_id long, ts double, te double")
    b = spark.createDataFrame([("v", 0, 0.0, 2.0, None), (None, 1, 0.0, 2.0, 0.5)], "video_id string, pred_id long, ts double, te double, conf double")
    assert [(r.gt_id, r.pred_id) for r in I.pairs(a, b).collect()] == [(4, 0)]


def test_islands_match_as_items_do(spark):
    rng = np.random.default_rng(5)
    gs, g = segments(spark, rng, 60, "g", items=2, hot=0.5)
    ps, p = segments(spark, rng, 60, "p", items=2, hot=0.5)
    for t in (0.2, 0.5):
        rows = L.hungarian(g, p, t).collect()
        assert len({r.gt_id for r in rows}) == len({r.pred_id for r in rows}) == len(rows)
        total, n = 0.0, 0
        for v in ("hot", "v0", "v1"):
            a, b = [x for x in gs if x[0] == v], [x for x in ps if x[0] == v]
            w = np.array([[tiou(x, y) for y in b] for x in a]).reshape(len(a), len(b))
            got = L.assign(np.where(w >= t, w + min(w.shape), 0.0))
            total, n = total + sum(w[i, j] for i, j in got), n + len(got)
        assert len(rows) == n and sum(r.tiou for r in rows) == pytest.approx(total)
    served, taken = {}, set()
    for b in sorted(ps, key=lambda b: (-b[4], b[1])):
        free = [(-tiou(a, b), a[1]) for a in gs if a[0] == b[0] and tiou(a, b) >= 0.2 and a[1] not in taken]
        if free:
            served[b[1]] = min(free)[1]
            taken.add(min(free)[1])
    assert {r.pred_id: r.gt_id for r in L.greedy_match(g, p, 0.2).collect()} == served
    with pytest.raises(ValueError, match="above 0"):
        L.hungarian(g, p, 0.0)


def plain_merge(segs, threshold):
    """The whole table of tIoU again after every merge."""
    segs = [dict(s) for s in segs]
    while len(segs) > 1:
        box = np.array([[s["ts"], s["te"]] for s in segs], float)
        t = np.triu(L._tiou(box, box), 1)
        i, j = divmod(int(t.argmax()), len(segs))
        if t[i, j] <= threshold:
            break
        a, b = segs[i], segs[j]
        new = (a if a["conf"] >= b["conf"] else b) | {"ts": min(a["ts"], b["ts"]), "te": max(a["te"], b["te"]), "conf": max(a["conf"], b["conf"]), "merged": a["merged"] + b["merged"]}
        segs = [*(s for k, s in enumerate(segs) if k not in (i, j)), new]
    return segs


def test_merging_by_heap(spark):
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 5, 40):
        for _ in range(15):
            segs = [{"ts": float(a), "te": float(a + d), "conf": float(c), "merged": 1} for a, d, c in zip(rng.integers(0, 30, n), rng.integers(1, 9, n), rng.integers(0, 3, n), strict=True)]
            assert L.merged_rows(segs, 0.3) == plain_merge(segs, 0.3)
    ps, p = segments(spark, rng, 80, "p")
    got = sorted((r.video_id, r.ts, r.te, r.conf, r.merged) for r in L.merge_overlaps(p, 0.4).collect())
    want = []
    for v in {b[0] for b in ps}:
        own = [{"video_id": v, "pred_id": b[1], "ts": b[2], "te": b[3], "conf": b[4], "merged": 1} for b in sorted((b for b in ps if b[0] == v), key=lambda b: (b[2], b[3], b[1]))]
        want += [(v, s["ts"], s["te"], s["conf"], s["merged"]) for s in plain_merge(own, 0.4)]
    assert got == sorted(want)


def test_suppression_by_island(spark):
    rng = np.random.default_rng(9)
    ps, p = segments(spark, rng, 90, "p")
    want = []
    for v in {b[0] for b in ps}:
        kept = []
        for b in sorted((b for b in ps if b[0] == v and b[4] >= 0.25), key=lambda b: (-b[4], b[1])):
            if len(kept) < 6 and all(tiou(b, k) <= 0.3 for k in kept):
                kept.append(b)
        want += [b[1] for b in kept]
    assert sorted(r.pred_id for r in L.greedy_nms(p, 0.25, 0.3, 6).collect()) == sorted(want)


def test_predictions_without_confidence_come_last(spark):
    g = spark.createDataFrame([("v", k, 100.0 * k, 100.0 * k + 10) for k in range(3)], "video_id string, gt_id long, ts double, te double")
    right = [("v", k, 100.0 * k, 100.0 * k + 10, 0.9 - k / 10) for k in range(3)]
    p = spark.createDataFrame([*right, *(("v", 10 + k, 5000.0, 5001.0, None) for k in range(5))], "video_id string, pred_id long, ts double, te double, conf double")
    assert L.average_precision(g, p, 0.5).first().ap == 1.0


# ---------------------------------------------------------------- score states


def gallery(spark, n=400, items=7, dim=8, seed=3, hot=0.5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n + 20, dim)).round(3)
    x[5] = x[6] = x[7]  # copies
    video = np.where(rng.random(n) < hot, 0, rng.integers(0, items, n))
    g = [(int(k), int(video[k]), float(rng.integers(0, 50)), 60.0, x[k].tolist(), float(rng.random())) for k in range(n)]
    q = [(int(k), int(rng.integers(0, items)), x[n + k].tolist()) for k in range(19)] + [(19, 0, x[5].tolist())]
    segs = spark.createDataFrame(g, "seg_row long, video_id long, ts double, te double, emb array<double>, bias double").repartition(6)
    return g, q, segs, spark.createDataFrame(q, "query_id long, positive long, q_emb array<double>")


@pytest.fixture
def small(monkeypatch):
    """Kernels that hold few scores at once, so states of many batches merge."""
    monkeypatch.setattr(K, "CELLS", 1)


def scores_of(g, q, bias=0.0):
    return {(b[0], a[0]): float(np.dot(a[4], b[2])) + bias * a[5] for a in g for b in q}


def test_item_states(spark, small):
    g, q, segs, qs = gallery(spark)
    s = scores_of(g, q)
    by = {}
    for a in g:
        for b in q:
            by.setdefault((b[0], a[1]), []).append((-round(s[b[0], a[0]], 9), a[2], a[0]))
    best = {(r.query_id, r.video_id): (round(r.score, 9), r.ts, r.seg_row) for r in V.maxsim(V.item_pairs(qs, segs)).collect()}
    assert best == {k: (-min(v)[0], *min(v)[1:]) for k, v in by.items()}
    top = {(r.query_id, r.video_id): r.score for r in V.topk_mean(V.item_pairs(qs, segs, 3), 3).collect()}
    assert top == {k: pytest.approx(-np.mean([x[0] for x in sorted(v)[:3]])) for k, v in by.items()}
    lse = {(r.query_id, r.video_id): r.score for r in V.lse(V.item_sums(qs, segs, 0.2), 0.2).collect()}
    assert lse == {k: pytest.approx(0.2 * np.log(np.mean(np.exp(np.array([-x[0] for x in v]) / 0.2)))) for k, v in by.items()}
    assert V.item_pairs(qs, segs).count() < len(g) * len(q) / 2  # and not a row for each pair


def test_query_states_counts_and_moments(spark, small):
    g, q, segs, qs = gallery(spark)
    s = scores_of(g, q)
    for k in (1, 4):
        got = {}
        for r in V.event_topk(V.query_pairs(qs, segs, k), k).collect():
            got.setdefault(r.query_id, {})[r.place] = (round(r.score, 9), r.seg_row)
        for b in q:
            want = sorted((-round(s[b[0], a[0]], 9), a[0]) for a in g)[:k]
            assert got[b[0]] == {i + 1: (-x, row) for i, (x, row) in enumerate(want)}
    near = {(r.query_id, r.video_id): r.n for r in V.counts(qs, segs, 1.0).groupBy("query_id", "video_id").agg(F.sum("n").alias("n")).collect()}
    assert near == {(b[0], v): sum(s[b[0], a[0]] >= 1.0 for a in g if a[1] == v) for b in q for v in {a[1] for a in g}}
    m, x = V.score_stats(qs, segs).first(), np.array(list(s.values()))
    assert (m.n, m["mean"], m["std"], m.least, m.most) == (x.size, pytest.approx(x.mean()), pytest.approx(x.std()), pytest.approx(x.min()), pytest.approx(x.max()))


def test_variants_share_a_pass(spark, small, monkeypatch):
    g, q, segs, qs = gallery(spark)
    ways = [{"emb": 1.0}, {"emb": 0.5, "bias": 2.0, "": -1.0}, {"bias": 1.0}]
    options = {"variants": ways, "same": ("positive", 0.25)}
    want = {}
    for k, w in enumerate(ways):
        for a, b in itertools.product(g, q):
            x = w.get("emb", 0) * float(np.dot(a[4], b[2])) + w.get("bias", 0) * a[5] + w.get("", 0) + 0.25 * (a[1] == b[1])
            want[k, b[0], a[1]] = max(x, want.get((k, b[0], a[1]), -np.inf))
    for limit in (K.BLOCK_BYTES, 0):  # beside the tasks, and as a join
        monkeypatch.setattr(K, "BLOCK_BYTES", limit)
        got = V.item_pairs(qs, segs, **options).groupBy("variant", "query_id", "video_id").agg(F.max("score").alias("s")).collect()
        assert {(r.variant, r.query_id, r.video_id): r.s for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    with pytest.raises(ValueError, match="all weights"):
        V.zscored([("emb", 0.0, 0.0, 1.0)])


def test_nulls_and_nothing(spark):
    _, _, segs, qs = gallery(spark, 30)
    holes = segs.withColumn("emb", F.when(F.col("seg_row") % 3 > 0, F.col("emb"))).withColumn("video_id", F.when(F.col("seg_row") % 5 > 0, F.col("video_id")))
    some = qs.withColumn("q_emb", F.when(F.col("query_id") % 2 == 0, F.col("q_emb")))
    got = V.maxsim(V.item_pairs(some, holes)).collect()
    assert {r.query_id for r in got} == set(range(0, 20, 2)) and None in {r.video_id for r in got}
    assert V.item_pairs(qs.limit(0), segs).count() == V.item_pairs(qs, segs.limit(0)).count() == V.query_pairs(qs.limit(0), segs, 3).count() == 0


def test_ranks_by_counting(spark, small):
    g, q, segs, qs = gallery(spark, items=9)
    best = V.max_scores(V.item_pairs(qs, segs))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)))
    ranked = {(r.query_id, r.video_id): r.rank for r in best.withColumn("rank", F.rank().over(w)).collect()}
    size = len({a[1] for a in g})
    truth = qs.select("query_id", F.when(F.col("query_id") == 3, 99).otherwise(F.col("positive")).alias("positive"))
    got = {r.query_id: r.rank for r in R.strict_ranks(best, truth, size).collect()}
    assert got == {b[0]: ranked.get((b[0], 99 if b[0] == 3 else b[1]), size + 1) for b in q}
    own = {b[0]: [a[0] for a in g if a[1] == b[1]][-1] for b in q} | {19: 6}  # a copy of two others
    told = spark.createDataFrame([(b[0], own[b[0]], b[1], 0.0, 1.0) for b in q], "query_id long, own_row long, positive long, gt_ts double, gt_te double")
    s = scores_of(g, q)
    rows = {r.query_id: r for r in R.event_eval(qs, segs, told, 4).collect()}
    assert {k: r["rank"] for k, r in rows.items()} == {b[0]: 1 + sum(round(s[b[0], a[0]], 9) > round(s[b[0], own[b[0]]], 9) for a in g) for b in q}
    for b in q:
        first = [a[1] for a in sorted(g, key=lambda a: (-round(s[b[0], a[0]], 9), a[0]))[:4]]
        assert (rows[b[0]].video1, rows[b[0]].video4) == (first[0] == b[1], b[1] in first)


def test_near_duplicates_leave_out_the_query(spark):
    _, _, segs, _ = gallery(spark, 60)
    rows = {r.seg_row: r for r in segs.collect()}
    qs = segs.where("seg_row < 10").select(F.col("seg_row").alias("query_id"), F.col("emb").alias("q_emb"), F.col("video_id").alias("query_video"))
    got = {r.query_id: (r.n_dup, r.n_dup_other) for r in A.near_duplicates(qs, segs, 2.0).collect()}
    for k in range(10):
        near = [r for i, r in rows.items() if i != k and np.dot(rows[k].emb, r.emb) >= 2.0]
        assert got[k] == (len(near), sum(r.video_id != rows[k].video_id for r in near))


# ---------------------------------------------------------------- block search


def clustered(spark, n=3000, dim=6, centres=12, copies=500):
    rng = np.random.default_rng(4)
    at = rng.standard_normal((centres, dim)) * 6
    x = at[rng.integers(0, centres, n)] + 0.3 * rng.standard_normal((n, dim))
    x[:copies] = x[0]  # a hot vector
    g = spark.createDataFrame([(k, k % 11, 0.0, 1.0, x[k].tolist()) for k in range(n)], "seg_row long, video_id long, ts double, te double, emb array<double>").repartition(5)
    q = np.concatenate([x[[0, n // 4, n // 2]], rng.standard_normal((4, dim))])
    return x, q, g, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "query_id long, q_emb array<double>")


def test_block_search_is_exact_and_skips(spark, tmp_path):
    x, q, g, qs = clustered(spark)
    blocks = B.vector_blocks(g, rows=50).persist()
    parts = blocks.collect()
    assert sum(r.n for r in parts) == len(x) and max(r.n for r in parts) <= 50 and len({r.block for r in parts}) == len(parts)
    for k in (1, 10, 70):
        got = {}
        for r in B.block_topk(qs, blocks, k).collect():
            got.setdefault(r.query_id, []).append((r.place, round(r.score, 7)))
        for i, v in enumerate(q):
            assert [s for _, s in sorted(got[i])] == [round(s, 7) for s in sorted(x @ v, reverse=True)[:k]]
    told = B.block_report(qs, blocks, 10).first()
    assert told.pairs_scored < 0.6 * told.pairs and told.vectors == len(x)
    B.write_blocks(blocks, str(tmp_path / "index"))
    again = spark.read.parquet(str(tmp_path / "index"))
    assert B.block_topk(qs, again, 10).count() == 10 * len(q)


def test_block_search_edges(spark):
    _, _, g, qs = clustered(spark, 40, copies=2)
    few = B.vector_blocks(g.limit(3), rows=2).persist()
    assert B.block_topk(qs, few, 10).count() == 3 * 7
    assert B.block_topk(qs.limit(0), few, 10).count() == 0 == B.block_topk(qs, B.vector_blocks(g.limit(0)), 10).count()


# ---------------------------------------------------------------- numbering


def test_numbering(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(k), None if k % 50 == 0 else float(rng.integers(0, 4)), f"s{k % 7}") for k in rng.permutation(900)]
    df = spark.createDataFrame(rows, "k long, x double, s string").repartition(7)
    for sample in (4096, 60):  # all keys, and a few
        monkeypatch.setattr(N, "SAMPLE", sample)
        got = {r.k: r.place for r in N.numbered(df, "x", "s", "k").collect()}
        order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[2], r[0]))
        assert got == {r[0]: i for i, r in enumerate(order)}
    total = N.numbered(df, "k", total="n").agg(F.max("place").alias("p"), F.max("n").alias("n")).first()
    assert (total.p, total.n) == (899, 900)
    assert N.numbered(df.limit(0), "k").count() == 0
    h = {r.place: r.k for r in N.hash_numbered(df, "k", "seed").collect()}
    from segquery.functions import exprs as X

    want = [r.k for r in df.orderBy(X.hash_uniform("seed", "k"), "k").select("k").collect()]
    assert [h[i] for i in range(900)] == want


def test_tiles_and_derangement(spark):
    for n in (1, 2, 7, 30):
        df = spark.range(n).withColumnRenamed("id", "k")
        tiles = spark.range(n).select(N.tile(F.col("id"), F.lit(n).cast("long"), 4).alias("a"), (F.ntile(4).over(Window.orderBy("id")) - 1).alias("b")).collect()
        assert all(r.a == r.b for r in tiles)
        d = {r.k: r.partner for r in losses.derangement(df, "k", "x").collect()}
        assert set(d) == set(d.values()) == set(range(n)) and (n == 1 or all(a != b for a, b in d.items()))


def test_poisson_bootstrap(spark):
    """Near the interval that theory gives; a difference of nothing has no width."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, 2000)
    units = spark.createDataFrame([(k, int(v), 0, 1) for k, v in enumerate(x)], "unit long, x long, y long, n long")
    r = S.poisson_bootstrap(units, 300, "p").first()
    half = 196 * x.std() / len(x) ** 0.5
    assert r["diff"] == pytest.approx(100 * x.mean()) and r.ci_low == pytest.approx(r["diff"] - half, abs=0.8) and r.ci_high == pytest.approx(r["diff"] + half, abs=0.8) and r.p == 0
    same = S.poisson_bootstrap(units.withColumn("y", F.col("x")), 50, "p").first()
    assert (same["diff"], same.ci_low, same.ci_high, same.p) == (0.0, 0.0, 0.0, 1.0)


# ---------------------------------------------------------------- split evaluation and SQL functions


def test_split_evaluation(spark):
    rng = np.random.default_rng(6)
    _, g = segments(spark, rng, 60, "g")
    _, raw = segments(spark, rng, 90, "p")
    g, raw = g.where("te > ts").drop("conf").persist(), raw.where("te > ts").persist()
    final = raw.where("conf >= 0.5")
    items = g.select("video_id").distinct()
    splits = items.withColumn("split", F.when(F.col("video_id") == "hot", "val").otherwise("dev"))
    durations = items.withColumn("dur", F.lit(500.0))
    got = E.split_evaluation(g, raw, final, {"strong": raw.where("conf >= 0.75")}, durations, splits, (0.5,), (0.5,))
    blocks = {(r.split, r.method): r for r in got["blocks"].collect()}
    assert set(blocks) == {(s, m) for s in ("val", "dev", "all") for m in ("final", "strong", "uniform_pred", "uniform_gt")}
    aps = {(r.split, r.method, r.threshold): r.ap for r in got["ap"].collect()}
    tops = {(r.split, r.n): r for r in got["recall"].collect()}
    for split, own, t in (("val", splits.where("split = 'val'"), 0.5),):
        part = g.join(own, "video_id", "left_semi")
        one, r = E.loc_block(part, final, (0.5,)).first(), blocks[split, "final"]
        assert all(r[c] == pytest.approx(one[c]) for c in one.asDict())
        assert aps[split, "final", t] == pytest.approx(L.average_precision(part, final, t).first().ap)
        assert tops[split, "top_5"][f"recall_{round(100 * t)}"] == pytest.approx(L.recall_at(part, raw, 5, t).first().recall)
    errors = {r.split: r for r in got["errors"].collect()}
    whole = E.error_summary(got["events"], got["segments"]).first()
    assert all(errors["all"][c] == pytest.approx(whole[c]) for c in whole.asDict())
    assert {r.side for r in got["boundary"].collect()} == {"left", "right"} and got["items"].where("method = 'final'").count() == items.count()


def test_sql_functions_equal_operators(spark):
    sql.register(spark)
    rng = np.random.default_rng(7)
    _, p = segments(spark, rng, 70, "p")
    _, g = segments(spark, rng, 50, "g")
    p.createOrReplaceTempView("sql_props")
    rows = spark.sql("select * from seg_merge(table(select * from sql_props) partition by video_id order by (ts, te, pred_id), 0.4)")
    key = lambda df: sorted((r.video_id, r.pred_id, r.ts, r.te, r.conf, r.merged) for r in df.collect())
    assert key(rows) == key(L.merge_overlaps(p, 0.4))
    kept = spark.sql("select * from seg_nms(table(select * from sql_props where conf >= 0.25) partition by video_id order by (conf desc, pred_id), 0.3, 6)")
    assert sorted(r.pred_id for r in kept.collect()) == sorted(r.pred_id for r in L.greedy_nms(p, 0.25, 0.3, 6).collect())
    close = I.pairs(g, p).where("tiou >= 0.3")
    n = {r.video_id: r.n for r in spark.sql("select video_id, seg_matches(gt_id, pred_id, tiou) as n from {c} group by video_id", c=close).collect()}
    assert n == {r.video_id: r["count"] for r in L.hungarian(g, p, 0.3).groupBy("video_id").count().collect()}
    x = rng.standard_normal((40, 4))
    spark.createDataFrame([("v", k, x[k].tolist()) for k in range(40)], "video_id string, step long, emb array<double>").createOrReplaceTempView("sql_series")
    got = spark.sql("select * from seg_medoids(table(select * from sql_series) partition by video_id order by (step), 5, 0)").collect()
    assert sorted(r.step for r in got) == sorted(L.kmedoids(x, 5, 0)[0].tolist())


def test_kernel_states_do_not_grow_with_queries(spark, monkeypatch):
    """States of a (query, item) are as many as blocks hold the item, not as many as matrices of ``CELLS`` scores."""
    from segquery.operators import score_states as K

    seg = spark.createDataFrame([(i, i // 300, float(i), i + 1.0, [float((i * 37 + j * 11) % 19) - 9 for j in range(4)]) for i in range(600)], "seg_row long, video_id long, ts double, te double, emb array<double>").coalesce(1)
    q = spark.createDataFrame([(k, [float((k * 13 + j * 7) % 17) - 8 for j in range(4)]) for k in range(50)], "query_id long, q_emb array<double>")
    monkeypatch.setattr(K, "CELLS", 50 * 8)
    got = K.item_best(q, seg, 1)
    assert got.count() == 50 * 2
    want = K.pair_terms(q, seg).groupBy("query_id", "video_id").agg(F.max("score").alias("score"))
    key = lambda d: sorted((r.query_id, r.video_id, round(r.score, 9)) for r in d.collect())
    assert key(got) == key(want)
    assert sum(r.n for r in K.item_lse(q, seg, 0.1).collect()) == 50 * 600
    monkeypatch.setattr(K, "BLOCK_ROWS", 64)
    monkeypatch.setattr(K, "BLOCK_ITEMS", 1)
    assert key(got.groupBy("query_id", "video_id").agg(F.max("score").alias("score"))) == key(want)


def test_own_item_loss_by_states(spark, monkeypatch):
    """The kernel's states give the loss of all pairs; queries without a positive have none."""
    from segquery.operators import losses, score_states as K

    seg = spark.createDataFrame([(i, i % 3, float(i), i + 1.0, [((i * 37 + j * 11) % 19) / 10 - 0.9 for j in range(4)]) for i in range(90)], "seg_row long, video_id long, ts double, te double, emb array<double>")
    q = spark.createDataFrame([(k, k % 4, [((k * 13 + j * 7) % 17) / 10 - 0.8 for j in range(4)]) for k in range(20)], "query_id long, positive long, q_emb array<double>")
    flag = (F.col("seg_row") % 5 == 1) & (F.col("video_id") != 2)
    got = {r.query_id: round(r.loss, 9) for r in losses.own_item_loss(q, seg, "positive", flag, 0.1).collect()}
    monkeypatch.setattr(K, "BLOCK_BYTES", 0)
    want = {r.query_id: round(r.loss, 9) for r in losses.own_item_loss(q, seg, "positive", flag, 0.1).collect()}
    assert got == want and len(got) == 10


def test_join_form_meets_in_blocks(spark, monkeypatch):
    """The join form gives all pairs from a few rows of blocks: the cross join itself has no row for each pair."""
    from segquery.operators import score_states as K, vectors as V

    monkeypatch.setattr(K, "PAIR_ROWS", 16)
    seg = spark.createDataFrame([(i, i % 3, float(i), i + 1.0, [float((i * 7 + j) % 5) for j in range(3)]) for i in range(70)], "seg_row long, video_id long, ts double, te double, emb array<float>")
    q = spark.createDataFrame([(k, [float((k * 3 + j) % 4) for j in range(3)]) for k in range(40)], "query_id long, q_emb array<float>")
    got = V.pair_scores(q, seg, "join")
    assert "zip_with" not in got._jdf.queryExecution().analyzed().toString()
    key = lambda d: sorted((r.query_id, r.seg_row, r.video_id, r.ts, r.te, r.score) for r in d.collect())
    assert key(got) == key(K.pair_terms(q, seg)) and got.count() == 70 * 40


def test_all_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Segments in one partition: the pairs are made in tasks of a bounded number of them, segment by segment."""
    from segquery.operators import score_states as K, vectors as V

    monkeypatch.setattr(K, "TASK_PAIRS", 300, raising=False)
    seg = spark.createDataFrame([(i, i % 3, float(i), i + 1.0, [float((i * 7 + j) % 5) for j in range(3)]) for i in range(200)], "seg_row long, video_id long, ts double, te double, emb array<float>").coalesce(1)
    q = spark.createDataFrame([(k, [float((k * 3 + j) % 4) for j in range(3)]) for k in range(30)], "query_id long, q_emb array<float>")
    got = V.pair_scores(q, seg)
    key = lambda d: sorted((r.query_id, r.seg_row, r.video_id, r.ts, r.te, r.score) for r in d.collect())
    assert key(got) == key(K.pair_terms(q, seg)) and got.count() == 200 * 30
    tasks = [t for t in got.select("seg_row").rdd.map(lambda r: r.seg_row).glom().collect() if t]
    assert len(tasks) >= 15 and max(map(len, tasks)) <= 2 * 300
    assert all(len(list(itertools.groupby(t))) == len(set(t)) for t in tasks)
    assert V.pair_scores(q.limit(0), seg).count() == 0 == V.pair_scores(q, seg.limit(0)).count()


def test_sample_orders_few_rows(spark, monkeypatch):
    """Only rows up to a proven bound reach the window; groups of few rows and without a value are whole."""
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") < 30, 1).when(F.col("id") < 60, None).otherwise(0).alias("g"))
    from segquery.functions import exprs as X

    w = Window.partitionBy("g").orderBy(X.hash_uniform("s", "key"), "key")
    want = {(r.g, r.key) for r in rows.withColumn("r", F.row_number().over(w)).where("r <= 5").collect()}
    got = A.sample(rows, "key", 5, "s", "g")
    assert {(r.g, r.key) for r in got.collect()} == want and got.columns == rows.columns
    assert "BroadcastNestedLoopJoin" in got._jdf.queryExecution().executedPlan().toString() or "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_kmedoids_without_a_matrix(spark):
    """Memory is that of the vectors, not of their square; the medoids are those of the whole matrix."""
    import tracemalloc

    from segquery.operators import localize as L

    x = np.random.default_rng(5).normal(size=(4000, 8))
    tracemalloc.start()
    med, _, ok = L.kmedoids(x, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * x.nbytes and ok
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.maximum(0, 1 - z @ z.T)
    near = d[:, med].argmin(1)
    for c, m in enumerate(med):
        own = np.nonzero(near == c)[0]
        assert own[d[np.ix_(own, own)].sum(1).argmin()] == m


def test_merge_runs_in_streams(spark):
    """Islands are merged in sorted partitions: no group of pandas for each."""
    from segquery.operators import localize as L

    rows = [(v, 10 * v + k, 10 * k * (v % 2) + k, 10 * k * (v % 2) + k + 9, (k * 7 % 5) / 5 if k else None) for v in range(12) for k in range(6)]
    segs = spark.createDataFrame(rows, "video_id long, pred_id long, ts long, te long, conf double")
    got = L.merge_overlaps(segs.na.fill(0.1), 0.5)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().analyzed().toString()
    want = [tuple(r.values()) for v in range(12) for r in L.merged_rows([{"video_id": a, "pred_id": b, "ts": float(s), "te": float(e), "conf": 0.1 if c is None else c, "merged": 1} for a, b, s, e, c in rows if a == v], 0.5)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert L.merge_overlaps(segs, 0.5).count() == len(want)


def test_block_search_makes_no_row_for_query_and_block(spark):
    """Tasks keep k rows of a query; only the first blocks, some of each query, are dealt as rows."""
    seg = spark.createDataFrame([(i, i % 3, float(i), i + 1.0, [float((i * 37 + j * 11) % 23) - 11 for j in range(6)]) for i in range(400)], "seg_row long, video_id long, ts double, te double, emb array<double>")
    q = spark.createDataFrame([(k, [float((k * 13 + j * 7) % 17) - 8 for j in range(6)]) for k in range(30)], "query_id long, q_emb array<double>")
    blocks = B.vector_blocks(seg, 8).coalesce(2).persist()
    found = B.block_topk(q, blocks, 5)
    assert "collect_list" not in found._jdf.queryExecution().analyzed().toString()
    floor = np.full(30, -np.inf)
    assert B._best(B._Asked(q), blocks, 5, floor, "bigint").count() <= 30 * 5 * 2
    from segquery.operators import vectors as V

    key = lambda d: sorted((r.query_id, r.place, r.seg_row, round(r.score, 9)) for r in d.collect())
    assert key(found) == key(V.event_topk(V.pair_scores(q, seg), 5))


def test_merge_overlaps_takes_every_prediction(spark):
    """Each prediction is in one merged segment, whatever its confidence."""
    from segquery.plans import registry, seg_queries

    assert seg_queries
    d = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{d}/events.parquet").where("event_type not in ('purchase', 'signup')")
    rows = registry.QUERIES["merge_overlaps"](spark, d).collect()
    assert sum(r.merged for r in rows) == want.count()
    assert {r.video_id for r in rows} == {r.user_id for r in want.select("user_id").distinct().collect()}
    assert min(r.conf for r in rows) < 0.5


def test_pair_hashes_equal_the_uniform(spark):
    from segquery.functions import exprs as X
    from segquery.functions.hashes import pair_hashes

    a, b = np.array([0, 7, -12, 9_999, 10_000, 2**62]), np.array([5, -1, 10, 123_456, 99, -(2**63), 2**63 - 1])
    got = pair_hashes("cal", a, b)
    rows = spark.createDataFrame([(i, j, f"{x}_{y}") for i, x in enumerate(a.tolist()) for j, y in enumerate(b.tolist())], "i int, j int, key string")
    assert all(got[r.i, r.j] == r.u * 2**32 for r in rows.select("i", "j", X.hash_uniform("cal", "key").alias("u")).collect())
    wide = pair_hashes(1, np.arange(3), np.arange(40_000))
    few = spark.range(0, 40_000, 1999).select("id", X.hash_uniform(1, F.concat(F.lit("2_"), F.col("id"))).alias("u"))
    assert all(wide[2, r.id] == r.u * 2**32 for r in few.collect())
    with pytest.raises(ValueError, match="too long"):
        pair_hashes("x" * 40, a, b)
    with pytest.raises(ValueError, match="null"):
        pair_hashes(0, a, np.array([1.0, np.nan]))


@pytest.mark.parametrize("cells", [1 << 20, 1 << 10])
def test_pair_sample_equals_brute_force(spark, monkeypatch, cells):
    """The first pairs of each bin by (hash, key): of a rare bin, of an empty one and of one with fewer pairs than wanted."""
    from segquery.functions.hashes import pair_hashes

    monkeypatch.setattr(K, "CELLS", cells)
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((90, 8)), rng.standard_normal((700, 8))
    x[3], y[5] = 0, 0
    q = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(x)], "query_id long, q_emb array<double>")
    seg = spark.createDataFrame([(j * 7 - 50, j % 3, float(j), j + 1.0, v.tolist()) for j, v in enumerate(y)], "seg_row long, video_id long, ts double, te double, emb array<double>")
    score = x @ y.T
    edges = [-np.inf, -1.0, 0.0, float(np.sort(score.ravel())[-300]), float(np.sort(score.ravel())[-7]), 1e6]
    u = pair_hashes("s", np.arange(90) * 10, np.arange(700) * 7 - 50)
    want = set()
    for k, least in enumerate(edges):
        own = sorted((int(u[i, j]), f"{i * 10}_{j * 7 - 50}", i * 10, j * 7 - 50) for i, j in np.argwhere((score >= least - 1e-9) & (score < (edges[k + 1] if k < 5 else np.inf) - 1e-9)))
        want |= {(*r[2:], k) for r in own[:20]}
    assert {(r.query_id, r.seg_row, r.bin) for r in A.pair_sample(q, seg, edges, 20, "s").collect()} == want
    assert K.hash_best(q, seg, edges, 20, "s").count() <= 20 * 6 * (8 if cells == 1 << 20 else 90 * 700 // 900 + 100)
    monkeypatch.setattr(K, "BLOCK_BYTES", 100)
    assert {(r.query_id, r.seg_row, r.bin) for r in A.pair_sample(q, seg, edges, 20, "s").collect()} == want


def test_calibration_sample_makes_no_row_for_each_pair(spark, monkeypatch):
    from segquery.plans import registry, vec_queries

    assert vec_queries
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(V, "pair_scores", lambda *a: pytest.fail("all pairs are made"))
    rows = registry.QUERIES["calibration_sample"](spark, d).collect()
    assert len(rows) == 60


def test_join_of_blocks_is_dealt_by_pairs(spark, monkeypatch, tmp_path):
    """One file of each side: tasks are by the number of pairs, and none makes more than its share."""
    q = spark.createDataFrame([(i, [float((i * 37 + j * 11) % 23) - 11 for j in range(6)]) for i in range(100)], "query_id long, q_emb array<double>")
    seg = spark.createDataFrame([(i, i % 3, float(i), i + 1.0, [float((i * 13 + j * 7) % 29) - 14 for j in range(6)]) for i in range(400)], "seg_row long, video_id long, ts double, te double, emb array<double>")
    for name, d in (("q", q), ("s", seg)):
        d.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    q, seg = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("q", "s"))
    monkeypatch.setattr(K, "TASK_PAIRS", 1000)
    got = V.pair_scores(q, seg, "join").select("query_id", "seg_row", F.round("score", 9).alias("score"), F.spark_partition_id().alias("task"))
    rows = got.collect()
    assert len(rows) == len({(r.query_id, r.seg_row) for r in rows}) == 40_000
    sizes = [sum(1 for _ in g) for _, g in itertools.groupby(sorted(r.task for r in rows))]
    assert len(sizes) >= 40 and max(sizes) <= 1500
    assert {(r.query_id, r.seg_row): r.score for r in rows} == {(r.query_id, r.seg_row): r.score for r in V.pair_scores(q, seg).select("query_id", "seg_row", F.round("score", 9).alias("score")).collect()}
