"""Hand-computed cases, brute force on random data, and equivalences."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from segquery.functions import exprs as X
from segquery.operators import analysis as A
from segquery.operators import evaluation as E
from segquery.operators import intervals as I
from segquery.operators import localize as L
from segquery.operators import losses as Z
from segquery.operators import partitions as P
from segquery.operators import retrieval as R
from segquery.operators import stats as S
from segquery.operators import vectors as V


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(0, "A", 0.0, 10.0, [1.0, 0.0, 0.0]), (1, "A", 10.0, 20.0, [0.0, 0.6, 0.8]), (2, "B", 5.0, 9.0, [0.8, 0.0, 0.6]), (3, "B", 0.0, 5.0, [0.0, 1.0, 0.0]), (4, "C", 0.0, 30.0, [0.0, 0.0, 1.0])]
    return spark.createDataFrame(rows, "seg_row long, video_id string, ts double, te double, emb array<double>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, "A", 0.0, 10.0, [1.0, 0.0, 0.0]), (1, "A", 10.0, 20.0, [0.0, 1.0, 0.0]), (2, "C", 0.0, 20.0, [0.0, 0.0, 1.0])], "query_id long, positive string, gt_ts double, gt_te double, q_emb array<double>")


def test_maxsim(toy, queries):
    got = {(r.query_id, r.video_id): (round(r.score, 6), r.ts, r.te) for r in V.maxsim(V.pair_scores(queries, toy)).collect()}
    assert got[0, "A"] == (1.0, 0.0, 10.0) and got[0, "B"] == (0.8, 5.0, 9.0) and got[0, "C"] == (0.0, 0.0, 30.0)
    assert got[1, "B"] == (1.0, 0.0, 5.0) and got[1, "A"] == (0.6, 10.0, 20.0)


def test_modes_agree(toy, queries):
    a = {(r.query_id, r.seg_row): round(r.score, 9) for r in V.pair_scores(queries, toy).collect()}
    assert a == {(r.query_id, r.seg_row): round(r.score, 9) for r in V.pair_scores(queries, toy, "join").collect()}


def test_aggregates(toy, queries):
    p = V.pair_scores(queries, toy)
    value = lambda d: {(r.query_id, r.video_id): r.score for r in d.collect()}
    assert value(V.topk_mean(p, 1)) == pytest.approx(value(V.max_scores(p)))
    assert value(V.lse(p, 1e-4)) == pytest.approx(value(V.max_scores(p)), abs=1e-3)
    assert value(V.lse(p, 0.5))[0, "A"] == pytest.approx(0.5 * np.log(np.mean(np.exp([2.0, 0.0]))))
    with pytest.raises(ValueError):
        V.aggregated(p, "median")


def test_bias(spark, toy, queries):
    p = V.pair_scores(queries, toy)
    conf = spark.createDataFrame([(k, float(np.exp(0.5)) if k in (2, 3) else 1.0) for k in range(5)], "seg_row long, conf double")
    a, b = {(r.query_id, r.video_id): r.score for r in V.max_scores(p).collect()}, {(r.query_id, r.video_id): r.score for r in V.max_scores(V.biased(p, conf, 1.0)).collect()}
    assert all(b[k] - a[k] == pytest.approx(0.5 if k[1] == "B" else 0) for k in a)
    assert V.biased(p, conf, 0) is p


def test_partition_eval(toy, queries):
    r = R.partition_eval(V.maxsim(V.pair_scores(queries, toy)), queries.drop("q_emb"), toy).first()
    assert (round(r.r1, 2), r.median_rank, round(r.mean_rank, 4)) == (66.67, 1.0, 1.3333)
    assert round(r.moment_given_top1, 2) == 100.0 and round(r.vcmr_r1, 2) == 66.67 and r.vectors_per_item == pytest.approx(5 / 3)


def test_rank_of_missing_item_and_ties(spark):
    s = spark.createDataFrame([(0, "A", 0.5), (0, "B", 0.5), (0, "C", 0.9)], "query_id long, video_id string, score double")
    t = spark.createDataFrame([(0, "B"), (1, "A")], "query_id long, positive string")
    assert {r.query_id: r.rank for r in R.strict_ranks(s, t, 3).collect()} == {0: 2, 1: 4}


def test_rank_metrics(spark):
    r = R.rank_metrics(spark.createDataFrame([(1,), (3,), (12,)], "rank long")).first()
    assert (round(r.r1, 1), round(r.r5, 1), round(r.r10, 1), r.median_rank, round(r.mean_rank, 4)) == (33.3, 66.7, 66.7, 3.0, 5.3333)


def test_two_overlaps(spark):
    r = spark.range(1).select(X.tiou_hull(F.lit(0), F.lit(10), F.lit(5), F.lit(15)).alias("a"), X.tiou_union(F.lit(0), F.lit(1), F.lit(5), F.lit(6)).alias("b"), X.tiou_hull(F.lit(1), F.lit(1), F.lit(1), F.lit(1)).alias("c")).first()
    assert (round(r.a, 6), r.b, r.c) == (0.333333, 0.0, 0.0)


def test_gaps_and_fill(spark):
    s = spark.createDataFrame([("v", 10.0, 20.0, 60.0), ("v", 15.0, 30.0, 60.0)], "video_id string, ts double, te double, dur double")
    assert sorted((r.ts, r.te) for r in I.gaps(s).collect()) == [(0.0, 10.0), (30.0, 60.0)]
    assert sorted((r.ts, r.te) for r in I.fill_gaps(s, 5, 10).collect()) == [(0.0, 10.0), (30.0, 40.0), (40.0, 50.0), (50.0, 60.0)]
    assert I.fill_gaps(s.limit(0), 5, 10).count() == 0
    one = spark.createDataFrame([("v", 0.0, 0.5, 25.5)], "video_id string, ts double, te double, dur double")
    assert I.fill_gaps(one, 5, 10).count() == 3  # 2.5 rounds up
    assert round(I.coverage(s).first().coverage, 6) == round(20 / 60, 6) and round(I.overlap_ratio(s).first().overlap, 6) == 0.2


def test_interval_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(v), int(a), int(a + w), 400) for v in range(12) for a, w in zip(rng.integers(0, 300, 9), rng.integers(1, 90, 9), strict=True)]
    s = spark.createDataFrame(rows, "video_id long, ts long, te long, dur long")
    cover = {v: {t for x, a, b, _ in rows if x == v for t in range(a, b)} for v in range(12)}
    assert {r.video_id: r.covered for r in I.coverage(s).collect()} == {v: len(c) for v, c in cover.items()}
    free = {v: set() for v in range(12)}
    for r in I.gaps(s).collect():
        free[r.video_id] |= set(range(int(r.ts), int(r.te)))
    assert all(free[v] == set(range(400)) - cover[v] for v in range(12))
    islands = {v: set() for v in range(12)}
    for r in I.islands(s).collect():
        islands[r.video_id] |= set(range(r.ts, r.te))
    assert islands == cover


def test_extend_short(spark):
    s = spark.createDataFrame([(0, 0.0, 1.0, 10.0), (1, 9.5, 10.0, 10.0), (2, 1.0, 1.5, 1.8), (3, 2.0, 6.0, 10.0)], "k int, ts double, te double, dur double")
    assert {r.k: (r.ts, r.te, r.extended) for r in I.extend_short(s, 2.0).collect()} == {0: (0.0, 2.0, True), 1: (8.0, 10.0, True), 2: (0.0, 1.8, True), 3: (2.0, 6.0, False)}


def test_series_windows(spark):
    st = spark.createDataFrame([("v", i, i + 0.5) for i in range(8)], "video_id string, step int, t double")
    s = spark.createDataFrame([(0, "v", 1.0, 2.0, 8.0), (1, "v", 4.6, 4.9, 8.0)], "seg_id int, video_id string, ts double, te double, dur double")
    got = I.series_windows(s, st, 1.0).collect()
    assert sorted((r.step, r.relation) for r in got if r.seg_id == 0) == [(0, 0), (1, 1), (2, 2)]
    assert [r.step for r in I.series_windows(s, st, 0.0).collect() if r.seg_id == 1] == [4]


def test_generators(spark):
    v = spark.createDataFrame([("a", 43.0), ("b", 5.0), ("c", 30.0)], "video_id string, dur double")
    c = {x: sorted((r.ts, r.te) for r in P.chunks(v, 14.0, 2.0).collect() if r.video_id == x) for x in "abc"}
    assert c["a"] == [(0, 14), (14, 28), (28, 43)] and c["b"] == [(0, 5)] and c["c"] == [(0, 14), (14, 30)]
    for r in P.dense(v, 8.0).collect():
        assert r.ts + 4 < r.dur or r.k == 0
    random = P.random_contiguous(v.withColumn("m", F.lit(3)), F.col("m"), 1.0, 7)
    assert P.checks(random, v, 1.0, True).first().asDict() | {"n": 9} == {"n": 9, "items": 3, "outside": 0, "unsorted": 0, "short": 0, "loose": 0, "missing": 0}
    assert random.exceptAll(P.random_contiguous(v.withColumn("m", F.lit(3)), F.col("m"), 1.0, 7)).count() == 0
    u = P.union_of([P.whole(v), P.uniform(v, 1), P.uniform(v, 2)])
    assert u.count() == 9 and u.where("src = 1").count() == 0


def first(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_time_grid(spark):
    r = first(spark, a=X.grid_to_sec(F.lit(0), F.lit(300)), b=X.grid_to_sec(F.lit(255.5), F.lit(300)), c=X.grid_to_sec(F.lit(255.5), F.lit(300), F.lit(299)), d=X.grid_to_sec(F.lit(-3), F.lit(300), F.lit(299)), e=X.grid_to_sec(F.lit(10), F.lit(256)))
    assert (r.a, r.b, r.c, r.d, r.e) == (pytest.approx(0.5 * 300 / 256), pytest.approx(300.0), 299.0, 0.0, pytest.approx(10.5))
    for g in (0.0, 12.3, 100.25, 255.0):
        assert first(spark, x=X.sec_to_grid(X.grid_to_sec(F.lit(g), F.lit(417)), F.lit(417))).x == pytest.approx(g)
    assert first(spark, x=X.sec_to_grid(F.lit(0.5 * 300 / 256), F.lit(300))).x == pytest.approx(0.0)
    assert first(spark, x=X.grid_to_sec(F.lit(4), F.lit(9), fps=8, stride=4, window=16, steps=32)).x == pytest.approx(4.5 * (8 * 4 + 16) / 32 / 8)


def test_level_times(spark):
    r = first(spark, a=X.level_times(F.lit(256)), b=X.level_times(F.lit(256), 1), c=X.level_times(F.lit(512)))
    assert len(r.a) == 256 and r.a[:2] == [0.5, 1.5] and len(r.b) == 128 and r.b[:2] == [0.5, 2.5] and r.c[0] == 1.0


def test_frame_index(spark):
    r = first(spark, a=X.frame_index(F.lit(1.0), F.lit(3.0), 25.0, F.lit(1000)), b=X.frame_index(F.lit(0.1), F.lit(9.0), 30.0, F.lit(100), 4), c=X.frame_index(F.lit(2.0), F.lit(5.0), 10.0, F.lit(90), 1))
    assert r.a == [25, 32, 39, 46, 53, 60, 67, 75] and r.b == [3, 35, 67, 99] and r.c == [20]
    with pytest.raises(Exception, match="behind the last frame"):
        first(spark, x=X.frame_index(F.lit(9.0), F.lit(10.0), 10.0, F.lit(80)))


def test_small_departures(spark):
    """Borders: the capped end, the zero vector's scale, what is merged stands last, strictly less than the tie."""
    a, b = X.round_capped(F.lit(1.006), F.lit(9.998), F.lit(9.9975))
    assert tuple(first(spark, a=a, b=b)) == (1.01, 9.9975)
    codes, scale = X.quantised(F.array(F.lit(0.0), F.lit(0.0)))
    assert tuple(first(spark, c=codes, s=scale)) == ([0, 0], 1.0)
    s = P.perturbed(spark.createDataFrame([("v", k, 0.0, 9.996, 9.996) for k in range(40)], "video_id string, k int, ts double, te double, dur double"), 0.5, 1.0)
    assert s.where("te > dur").count() == 0 < s.where("te = dur").count()
    rows = spark.createDataFrame([("a", 46.5, 22.0), ("b", 46.25, 20.0), ("c", 46.0, 1.0)], "name string, r1 double, vectors double")
    assert S.pick_fill(rows, 0.25).first().name == "a" and S.pick_fill(rows, 0.3).first().name == "b"
    got = L.merged_rows([{"ts": a, "te": b, "conf": 0.5, "merged": 1} for a, b in ((0, 10), (1, 11), (30, 40), (50, 60))], 0.5)
    assert [s["ts"] for s in got] == [30, 50, 0]


def events(spark, rows):
    return spark.createDataFrame([(v, f"{v}{i}", float(a), float(b)) for i, (v, a, b) in enumerate(rows)], "video_id string, gt_id string, ts double, te double")


def found(spark, rows):
    return spark.createDataFrame([(v, f"{v}{i}", float(a), float(b), float(c)) for i, (v, a, b, c) in enumerate(rows)], "video_id string, pred_id string, ts double, te double, conf double")


def test_average_precision_of_the_known_case(spark):
    g = events(spark, [("A", 0, 10), ("A", 20, 30), ("B", 0, 10)])
    p = found(spark, [("A", 0, 10, 0.9), ("A", 1, 9, 0.8), ("A", 20, 30, 0.7), ("B", 50, 60, 0.6), ("B", 0, 10, 0.5)])
    assert L.average_precision(g, p, 0.5).first().ap == L.average_precision(g, p, 0.9).first().ap == pytest.approx((1 + 2 / 3 + 0.6) / 3)
    assert L.average_precision(g, p.limit(0), 0.5).first().ap == 0.0 and L.average_precision(g.limit(0), p, 0.5).first().ap == 0.0


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_average_precision_by_ranges(spark, ranges):
    rng = np.random.default_rng(ranges)
    conf, tp = rng.integers(0, 40, 500) / 40, rng.integers(0, 2, 500)
    rows = [(i, float(c), int(t)) for i, (c, t) in enumerate(zip(conf, tp, strict=True))]
    hit = np.array([t for _, _, t in sorted(rows, key=lambda r: (-r[1], r[0]))])
    best = np.maximum.accumulate((np.cumsum(hit) / np.arange(1, 501))[::-1])[::-1]
    g = spark.range(300)
    assert L.ap_of(spark.createDataFrame(rows, "pred_id long, conf double, tp long"), g, ranges).first().ap == pytest.approx((best * hit).sum() / 300)


def test_matchers(spark):
    """One to one beats greedy; any matcher goes into precision and recall."""
    g, p = events(spark, [("v", 0, 10), ("v", 4, 14)]), found(spark, [("v", 1, 11, 0.9), ("v", 0, 6, 0.8)])
    assert sorted((r.pred_id, r.gt_id) for r in L.hungarian(g, p, 0.5).collect()) == [("v0", "v1"), ("v1", "v0")]
    assert [(r.pred_id, r.gt_id) for r in L.greedy_match(g, p, 0.5).collect()] == [("v0", "v0")]
    more = p.unionByName(found(spark, [("w", 0, 1, 0.5)]))  # an item without events
    assert L.prf_at(g, more, 0.5).first().f1 == 1.0 and L.prf_at(g, more, 0.5, L.greedy_match).first().n_match == 1


def test_event_and_segment_rows(spark):
    g = events(spark, [("v", 0, 10), ("v", 10, 20), ("v", 30, 40), ("v", 60, 70)])
    p = found(spark, [("v", 0, 20, 0.9), ("v", 30, 34, 0.8), ("v", 35, 40, 0.7), ("v", 80, 90, 0.6)])
    e = {r.gt_id: r for r in E.event_rows(g, p).collect()}
    assert e["v3"].missed and not e["v0"].missed and e["v0"].in_merged_seg and e["v1"].in_merged_seg and not e["v2"].in_merged_seg
    assert e["v2"].fragmented and e["v2"].n_parts == 2 and e["v2"].best_seg == "v2" and e["v2"].match_50 == "v2" and e["v2"].tiou_50 == 0.5 and e["v2"].match_70 is None
    assert (e["v2"].left_offset, e["v2"].right_offset) == (5.0, 0.0) and e["v3"].left_offset is None
    s = {r.pred_id: r for r in E.segment_rows(g, p).collect()}
    assert s["v0"].merge and s["v0"].n_gt_covered == 2 and s["v3"].fp_no_overlap and s["v3"].unmatched and not s["v2"].unmatched and s["v1"].unmatched
    r = E.error_summary(E.event_rows(g, p), E.segment_rows(g, p)).first()
    assert (r.n_gt, r.pct_missed, r.pct_fragmented, r.pct_in_merged_seg, r.n_seg, r.pct_fp_no_overlap, r.pct_merge) == (4, 25.0, 25.0, 75.0, 4, 25.0, 25.0)  # the best segment of a missed event is the first one


def test_blocks(spark):
    g = events(spark, [("A", 0, 10), ("A", 22, 30), ("B", 0, 5)])
    p = found(spark, [("A", 0, 10, 1), ("A", 20, 30, 1), ("A", 40, 50, 1), ("C", 0, 1, 1)])
    r = E.loc_block(g, p, (0.5, 0.9)).first()
    assert (r.seg_per_video, r.p_50, r.r_50, r.p_90) == (1.5, pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(1 / 3))
    assert r.mean_tiou == pytest.approx((1 + 0.8 + 0) / 3) and r.cover_50 == pytest.approx(2 / 3)
    both = E.compared(g, {"m": p, "none": p.limit(0)}, {"all": g, "b": g.where("video_id = 'B'")}, (0.5,))
    assert {(x.split, x.method): x.f1_50 for x in both.collect()} == {("all", "m"): pytest.approx(2 / 3), ("all", "none"): 0.0, ("b", "m"): 0.0, ("b", "none"): 0.0}
    d = E.detector_stats(g, p).first()
    assert (d["items"], d.k_mean, d.k_max, d.k_many) == (2, 1.5, 3, 0) and d.missed == pytest.approx(100 / 3)


def test_clip_vectors(spark):
    f = spark.createDataFrame([("v", 0, [1.0, 0.0]), ("v", 1, [0.0, 1.0])], "video_id string, frame int, emb array<double>")
    c = spark.createDataFrame([("v", 0, [0, 0, 0, 1]), ("v", 1, [0, 5])], "video_id string, clip int, frames array<int>")
    (r,) = E.clip_vectors(c, f).collect()
    assert r.emb == [pytest.approx(3 / 10**0.5), pytest.approx(1 / 10**0.5)]


def test_line_interval(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(2 + 3 * x + e), float(w)) for i, (x, e, w) in enumerate(zip(rng.random(300), rng.normal(0, 0.3, 300), rng.integers(1, 9, 300), strict=True))]
    r = S.line_bootstrap(spark.createDataFrame(rows, "unit long, x double, y double, w double"), "x", "y", "w", "unit", 300).first()
    x, y, w = (np.array([q[k] for q in rows]) for k in (1, 2, 3))
    b = []
    for _ in range(400):
        i = rng.integers(0, 300, 300)
        m = np.stack([np.ones(300), x[i]], 1) * np.sqrt(w[i])[:, None]
        b.append(np.linalg.lstsq(m, y[i] * np.sqrt(w[i]), rcond=None)[0])
    lo, hi = np.percentile(b, [2.5, 97.5], axis=0)
    assert r.a_low < r.a < r.a_high and r.b_low < r.b < r.b_high
    assert (r.a_high - r.a_low) == pytest.approx(hi[0] - lo[0], rel=0.3) and (r.b_high - r.b_low) == pytest.approx(hi[1] - lo[1], rel=0.3)


def test_jaccard_join(spark):
    rng = np.random.default_rng(2)
    make = lambda n, key: [(i, sorted({f"w{int(x)}" for x in rng.integers(0, 40, rng.integers(0, 15))})) for i in range(n)]
    a, b = make(40, "a"), make(30, "b")
    for least in (0.2, 0.5, 0.8):
        got = A.jaccard_join(spark.createDataFrame(a, "i long, w array<string>"), spark.createDataFrame(b, "j long, w array<string>"), "i", "j", "w", least)
        want = {(i, j) for i, x in a for j, y in b if set(x) & set(y) and len(set(x) & set(y)) / len(set(x) | set(y)) >= least}
        assert {(r.i, r.j) for r in got.collect()} == want


def test_noise_calibration(spark):
    v = spark.createDataFrame([(f"v{i}", 100.0 + i) for i in range(30)], "video_id string, dur double")
    s = P.uniform(v, 5)
    low, high = P.calibrated_sigma(s, 0.9, 1.0, tol=0.01), P.calibrated_sigma(s, 0.5, 1.0, tol=0.01)
    assert 0 < low < high


def box(*rows):
    return [{"ts": a, "te": b, "conf": c, "merged": 1} for a, b, c in rows]


def test_merge_is_strict_and_takes_the_best_pair():
    assert len(L.merged_rows(box((0, 10, 0.5), (5, 15, 0.9)), 1 / 3)) == 2
    got = L.merged_rows(box((0, 10, 0.5), (1, 11, 0.9), (30, 40, 0.1)), 0.5)
    assert got[-1] == {"ts": 0, "te": 11, "conf": 0.9, "merged": 2} and len(got) == 2


def test_assignment_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        w = np.where(rng.random((n, m)) < 0.5, rng.random((n, m)) + min(n, m), 0.0)
        best = max(sum(w[i, j] for i, j in zip(a, b, strict=True)) for k in range(min(n, m) + 1) for a in itertools.combinations(range(n), k) for b in itertools.permutations(range(m), k))
        got = L.assign(w)
        assert sum(w[i, j] for i, j in got) == pytest.approx(best) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def preds_of(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "pred_id long, video_id string, ts double, te double, conf double")


def test_matching_beats_greedy(spark):
    g = spark.createDataFrame([(0, "v", 0.0, 10.0), (1, "v", 8.0, 18.0)], "gt_id long, video_id string, ts double, te double")
    p = preds_of(spark, [("v", 4.0, 14.0, 0.9), ("v", 0.0, 6.0, 0.5)])
    assert {(r.gt_id, r.pred_id) for r in L.hungarian(g, p, 0.4).collect()} == {(1, 0), (0, 1)}
    f = L.prf(g, p, L.hungarian(g, p, 0.4)).first()
    assert (f.precision, f.recall, f.f1) == (1.0, 1.0, 1.0)


def test_average_precision(spark):
    g = spark.createDataFrame([(0, "a", 0.0, 10.0), (1, "a", 20.0, 30.0), (2, "b", 0.0, 10.0)], "gt_id long, video_id string, ts double, te double")
    p = preds_of(spark, [("a", 0.0, 10.0, 0.9), ("a", 0.0, 10.0, 0.8), ("a", 20.0, 30.0, 0.7), ("b", 50.0, 60.0, 0.6), ("b", 0.0, 10.0, 0.5)])
    assert L.average_precision(g, p, 0.5).first().ap == pytest.approx((1 + 2 / 3 + 0.6) / 3)
    assert L.average_precision(g, p.limit(0), 0.5).first().ap == 0


def test_nms_theta_and_fallback(spark):
    p = preds_of(spark, [("a", 0.0, 10.0, 0.9), ("a", 1.0, 11.0, 0.8), ("a", 20.0, 30.0, 0.4), ("b", 0.0, 5.0, 0.1)])
    assert {r.pred_id for r in L.greedy_nms(p, 0.3, 0.3, 30).collect()} == {0, 2}
    assert {r.pred_id for r in L.theta_topk(p, 0.4).collect()} == {0, 1, 2}
    assert {r.pred_id for r in L.theta_topk(p, 0.4, 1, True).collect()} == {0, 3}


def test_error_flags(spark):
    g = spark.createDataFrame([(0, "v", 0.0, 10.0), (1, "v", 20.0, 40.0), (2, "v", 50.0, 60.0), (3, "v", 60.0, 70.0)], "gt_id long, video_id string, ts double, te double")
    p = preds_of(spark, [("v", 20.0, 28.0, 1.0), ("v", 30.0, 40.0, 1.0), ("v", 50.0, 70.0, 1.0)])
    f = {r.gt_id: r for r in L.error_flags(g, p).collect()}
    assert f[0].missed and f[1].fragmented and f[2].in_merged and f[3].in_merged and not f[1].in_merged


def test_kmedoids():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + 0.05 * rng.standard_normal((n, 8)) for c, n in zip(np.eye(8)[:3] * 5, (100, 150, 6), strict=True)])
    med, _, ok = L.kmedoids(x, 3)
    assert ok and sorted(np.searchsorted([100, 250], med, side="right")) == [0, 1, 2]
    assert len(L.kmedoids(np.ones((4, 3)), 3)[0]) == 3


def test_kmedoids_query_takes_whole_series(spark):
    from segquery.plans import seg_queries

    d = "/root/testdata/sf0.001"
    series = {}
    for r in sorted(spark.read.parquet(f"{d}/embeddings.parquet").collect(), key=lambda r: r.vec_id):
        series.setdefault(r.label, []).append(r)
    want = {(v, rows[k].vec_id) for v, rows in series.items() for k in L.kmedoids(np.array([r.embedding for r in rows], float), 4)[0]}
    assert {(r.video_id, r.step) for r in seg_queries.kmedoids(spark, d).collect()} == want


def test_bootstrap(spark):
    u = spark.createDataFrame([(k, 1, 1, 2) for k in range(5)], "unit long, x long, y long, n long")
    r = S.bootstrap(u, 50).first()
    assert (r["diff"], r.ci_low, r.ci_high, r.p) == (0.0, 0.0, 0.0, 1.0)
    r = S.bootstrap(u.withColumn("y", F.lit(0)).withColumn("n", F.lit(1)), 50).first()
    assert (r["diff"], r.ci_low, r.ci_high, r.p) == (100.0, 100.0, 100.0, 0.0)


def test_line(spark):
    r = S.weighted_line(spark.createDataFrame([(0.0, 1.0, 1), (1.0, 3.0, 2), (2.0, 5.0, 1)], "x double, y double, w long"), "x", "y", "w").first()
    assert (round(r.a, 9), round(r.b, 9)) == (1.0, 2.0)
    r = S.weighted_line(spark.createDataFrame([(2.0, 5.0, 1), (2.0, 5.0, 3)], "x double, y double, w long"), "x", "y", "w").first()
    assert (r.a, r.b) == (1.0, 2.0)


def test_selection(spark):
    rows = spark.createDataFrame([(0.25, 17.49), (0.30, 12.298), (0.35, 9.029), (0.40, 6.952), (0.45, 5.087)], "theta double, k double")
    assert S.choose_closest(rows, F.col("k"), 7.433, F.asc("theta")).first().theta == 0.40
    curve = spark.createDataFrame([(0.3, 20.0), (0.5, 30.0)], "level double, value double")
    assert round(S.equivalent_level(curve, 25.0).first().level, 6) == 0.4 and round(S.equivalent_level(curve, 35.0).first().level, 6) == 0.6
    hits = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 1), (1, 1, 0, 0), (1, 1, 1, 1)], "query_id long, fold long, candidate long, hit long")
    assert {r.fold: r.candidate for r in S.cv_pick(hits).collect()} == {0: 0, 1: 1}
    assert {r.query_id: r.candidate for r in S.out_of_fold(hits).collect()} == {0: 1, 1: 0}


def test_quantiser(spark):
    rng = np.random.default_rng(0)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((20, 16)))] + [(20, [0.0] * 16)]
    c, s = X.quantised("v")
    for r in spark.createDataFrame(rows, "i long, v array<double>").select("v", c.alias("c"), s.alias("s")).collect():
        assert max(abs(np.array(r.v) - np.array(r.c) * r.s)) <= r.s / 2 + 1e-12 and max(map(abs, r.c)) in (0, 127)


def test_samplers(spark):
    c = spark.createDataFrame([(i, f"v{i % 7}") for i in range(40)] + [(100 + i, "long") for i in range(8)], "caption_id long, video_id string")
    b = Z.one_per_video_batches(c, 8)
    assert b.count() == 48 and b.select("batch").distinct().count() == 8
    assert b.groupBy("batch", "video_id").count().where("count > 1").count() == 0 and b.groupBy("batch").count().where("count > 8").count() == 0
    d = Z.derangement(c, "caption_id")
    assert d.where("caption_id = partner").count() == 0 and d.select("partner").distinct().count() == 48


def test_fusion_and_encoder(spark):
    e = Z.encode(spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "id long, text string"))
    v = {r.id: r.emb for r in e.collect()}
    assert v[0] == v[2] != v[1] and np.linalg.norm(v[0]) == pytest.approx(1)
    both = e.withColumn("context", F.reverse("emb"))
    same = {r.id: r.fused for r in Z.near_unit_fusion(both, 0.0).collect()}
    assert all(np.allclose(same[k], v[k]) for k in v)
    near = {r.id: r.fused for r in Z.near_unit_fusion(both, 0.3).collect()}
    assert all(np.dot(near[k], v[k]) >= (1 - 0.09) ** 0.5 - 1e-9 for k in v)


def test_fingerprint_ignores_layout(spark):
    d = spark.range(100)
    line = F.col("id").cast("string")
    assert A.fingerprint(d.repartition(7), line).first().digest == A.fingerprint(d.coalesce(1), line).first().digest
    assert A.fingerprint(d, line).first().digest != A.fingerprint(d.where("id > 0"), line).first().digest


def test_union_of_scores(spark):
    a = spark.createDataFrame([(0, "A", 0.5), (0, "B", 0.1)], "query_id long, video_id string, score double")
    b = spark.createDataFrame([(0, "A", 0.4), (0, "B", 0.4), (0, "C", 0.2)], "query_id long, video_id string, score double")
    got = {r.video_id: (round(r.score, 6), r.from_main) for r in V.score_union(a, b, 0.1).collect()}
    assert got == {"A": (0.5, True), "B": (0.5, False), "C": (0.3, False)}


def test_average_precision_sorts_no_group_by_its_key(spark, capsys):
    """Predictions meet the cuts of their group in shares; joined by the group alone, all of them would be sorted in one task."""
    flags = spark.createDataFrame([("x", i, i / 10, i % 2) for i in range(10)], "split string, pred_id long, conf double, tp long")
    got = L.ap_by(flags, spark.createDataFrame([("x", 5), ("z", 1)], "split string, n_gt long"), "split")
    got.explain()
    plan = capsys.readouterr().out
    assert "percentile_approx" in plan and "_s#" in next(x for x in reversed(plan.splitlines()) if "Join [split" in x)
    assert {r.split: r.ap for r in got.collect()} == {"x": pytest.approx((1 + 2 / 3 + 3 / 5 + 4 / 7 + 5 / 9) / 5), "z": 0.0}
