"""Preparation, keys, connector, reports: small cases by hand and against plain Python."""

import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from segquery.functions import exprs as X
from segquery.operators import prepare as Q
from segquery.operators import reports as M
from segquery.operators import retrieval as R
from segquery.sources import shards, snapshots


def test_rounding_is_that_of_the_binary_value(spark):
    """As Python rounds and prints, ties and near ties included."""
    r = random.Random(1)
    xs = [0.0, 0.125, 0.375, 0.005, 0.015, 1.005, 2.675, 0.0005, 1.0005, 2.5, 12.345, 0.285, 1e6 + 0.125, 99.995, 7 / 128, -0.125, -3.335]
    xs += [r.uniform(0, 4000) for _ in range(300)] + [k / 1000 for k in range(0, 3000, 5)] + [k / 128 for k in range(300)] + [r.randrange(10**6) / 200 for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", X.round_exact("x", 3).alias("a"), X.round_exact("x", 2).alias("b"), X.decimals("x").alias("c"), X.seg_key_seconds(F.lit("v"), "x", "x").alias("k")).collect()
    for q in rows:
        assert (q.a, q.b, q.c, q.k) == (round(q.x, 3), round(q.x, 2), f"{q.x:.2f}", f"v__{q.x:.2f}_{q.x:.2f}")


def given(spark):
    videos = spark.createDataFrame([("a", 30.0), ("b", 10.0), ("c", 5.0)], "video_id string, dur double")
    events = spark.createDataFrame([(1, "a", 20.0, 40.0, "late"), (2, "a", -1.0, 4.0004, "early"), (3, "a", 29.5, 30.0, "gone"), (4, "b", 2.0, 2.0, "none"), (5, "b", 0.0, 10.0, "all"), (6, "z", 0.0, 1.0, "unknown")], "caption_id long, video_id string, ts double, te double, sentence string")
    return videos, events


def test_partitions_by_name(spark):
    videos, events = given(spark)
    parts = {n: sorted((r.video_id, r.k, r.ts, r.te) for r in d.collect()) for n, d in Q.build_partitions(videos, events, ("global", "gt", "uni_M_gt", "uni_3", "uni_chunk", "rand", "shift", "gt_noise_09"), sigmas={0.9: 0.05}).items()}
    assert parts["gt"] == [("a", 0, 0.0, 4.0), ("a", 1, 20.0, 30.0), ("b", 0, 0.0, 10.0)]
    assert parts["global"] == [("a", 0, 0.0, 30.0), ("b", 0, 0.0, 10.0), ("c", 0, 0.0, 5.0)]
    assert parts["uni_M_gt"] == [("a", 0, 0.0, 15.0), ("a", 1, 15.0, 30.0), ("b", 0, 0.0, 10.0)] and ("b", 1, 3.333, 6.667) in parts["uni_3"]
    assert [len(parts[n]) for n in ("rand", "shift", "gt_noise_09")] == [3, 3, 3]
    with pytest.raises(ValueError, match="unknown partitions"):
        Q.build_partitions(videos, events, ("nothing",))
    with pytest.raises(ValueError, match="in the gallery"):
        Q.train_side(videos, events, videos.where("video_id = 'a'"), ("gt",))
    assert [Q.noise_name("gt", 0.9), Q.noise_name("gt", 0.3, 7)] == ["gt_noise_09", "gt_noise_03_s7"]


def test_prepare_and_publish(spark, tmp_path):
    videos, events = given(spark)
    none = spark.createDataFrame([], "seg_key string"), spark.createDataFrame([], "caption_id long")
    made = Q.prepare(videos, events, *none)
    clips = {r.seg_key: (r.n, r.refs) for r in made["clips"].collect()}
    assert clips["b__0.00_10.00"] == (3, ["b__global__0", "b__gt__0", "b__uni_M_gt__0"]) and len(clips) == 7
    assert {r.caption_id: r.gt_seg_key for r in made["captions"].collect()} == {1: "a__20.00_30.00", 2: "a__0.00_4.00", 3: "", 4: "", 5: "b__0.00_10.00"}
    todo = {r.id: (r.video, r.timestamps) for r in made["clips_todo"].collect()}
    assert todo["a__0.00_4.00__av"] == ("a.mp4", [0.0, 4.0]) and len(todo) == 7 and made["texts_todo"].count() == 5
    some = Q.prepare(videos, events, made["clips"].where("video_id = 'a'").select("seg_key"), events.select("caption_id").limit(5))
    assert some["clips_todo"].count() == 2 and some["texts_todo"].count() <= 1
    told = Q.publish(made, str(tmp_path / "out"))
    assert told["splits"]["clips"]["rows"] == 7 and snapshots.current(spark, str(tmp_path / "out"), "captions").count() == 5
    rows = {r.partition: r for r in Q.summary(made["rows"]).collect()}
    assert (rows["gt"].videos, rows["gt"].segments, rows["gt"].per_video, rows["gt"].median_length) == (2, 3, 1.5, 10.0)


def test_protocol_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"chunk": 20.0, "uniform": [2, 4]}))
    p = Q.Protocol.load(spark, str(tmp_path / "p.json"))
    assert (p.chunk, p.uniform, p.tail) == (20.0, (2, 4), 1.0)
    (tmp_path / "q.json").write_text('{"nonsense": 1}')
    with pytest.raises(ValueError, match="nonsense"):
        Q.Protocol.load(spark, str(tmp_path / "q.json"))


def test_adapters(spark):
    segs = spark.createDataFrame([("v", 1, 5.0, 9.0004, 0.5), ("v", 0, 1.0, 2.0, 0.9)], "video_id string, k int, ts double, te double, conf double")
    said = spark.createDataFrame([("v", 0, "one"), ("v", 1, "two")], "video_id string, k int, caption string")
    (r,) = Q.final_events(segs, said, said.withColumn("caption", F.upper("caption"))).collect()
    assert [tuple(e) for e in r.events] == [(1.0, 2.0, 0.9, "one", "ONE"), (5.0, 9.0, 0.5, "two", "TWO")]
    flat = Q.of_events(Q.final_events(segs, said)).collect()
    assert sorted((x.pred_id, x.ts, x.te, x.conf) for x in flat) == [("v#0", 1.0, 2.0, 0.9), ("v#1", 5.0, 9.0, 0.5)]
    gt = Q.of_annotations(spark.createDataFrame([("v", [(1.0, 2.0)])], "video_id string, events array<struct<ts:double,te:double>>")).first()
    assert tuple(gt) == ("v", "v#0", 1.0, 2.0)
    x = spark.createDataFrame([([1.0], [2.0])], "emb_a array<double>, emb_b array<double>")
    assert Q.picked(x, "b", {"a": "emb_a", "b": "emb_b"}).first().emb == [2.0]
    with pytest.raises(KeyError, match="no source"):
        Q.picked(x, "c", {"a": "emb_a"})


def test_parity_gate(spark):
    ours = spark.createDataFrame([("r", 50.0), ("m", 10.0)], "metric string, value double")
    ref = spark.createDataFrame([("r", 50.5)], "metric string, value double")
    assert {r.metric: (r["diff"], r.ok) for r in Q.parity(ours, ref, 1.0, 4, 4).collect()} == {"r": (-0.5, True), "m": (None, True)}
    for args in ((0.1, 4, 4), (1.0, 3, 4)):
        with pytest.raises(AssertionError, match="largest gap"):
            Q.parity(ours, ref, *args)
    with pytest.raises(AssertionError):
        Q.parity(ours, ref.limit(0), 1.0)


def tars(folder):
    for s in range(4):
        with tarfile.open(folder / f"shard-{s}.tar", "w") as t:
            for i in range(5):
                data = f"content {s} {i}".encode() * (i + 1)
                info = tarfile.TarInfo(f"feats/v{s}{i}.npz")
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    with tarfile.open(folder / "shard-9.tar", "w") as t:
        info = tarfile.TarInfo("feats/v00.npz")  # a second copy of an item
        t.addfile(info, io.BytesIO(b""))


def test_shards_by_index(spark, tmp_path):
    tars(tmp_path)
    index = shards.index_shards(spark, str(tmp_path)).collect()
    assert len(index) == 20 and {r.video_id: r.shard for r in index}["v00"] == "shard-0.tar"
    (tmp_path / "index.json").write_text("".join(json.dumps(r.asDict()) + "\n" for r in index))
    every = {r.video_id: bytes(r.content) for r in shards.read_shards(spark, str(tmp_path)).collect()}
    assert every == {f"v{s}{i}": f"content {s} {i}".encode() * (i + 1) for s in range(4) for i in range(5)}
    for s in (0, 2, 3):  # only the shard that is needed is opened
        (tmp_path / f"shard-{s}.tar").unlink()
    some = shards.read_shards(spark, str(tmp_path), ["v11", "v13", "absent"])
    assert {r.video_id: r.shard for r in some.collect()} == {"v11": "shard-1.tar", "v13": "shard-1.tar"}
    assert shards.read_shards(spark, str(tmp_path), ["absent"]).count() == 0


def test_filters_on_the_key_prune(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    tars(tmp_path)
    rows = [{"video_id": f"v{s}{i}", "shard": f"shard-{s}.tar", "offset": 0, "size": 1} for s in range(4) for i in range(5)]
    (tmp_path / "index.json").write_text("\n".join(map(json.dumps, rows)))
    reader = shards._TarReader({"path": str(tmp_path)})
    other = GreaterThan(("video_id",), "v1")
    assert list(reader.pushFilters([In(("video_id",), ("v11", "v20")), other, EqualTo(("shard",), "x")])) == [other, EqualTo(("shard",), "x")]
    assert [(u.name, len(u.members)) for u in reader.partitions()] == [("shard-1.tar", 1), ("shard-2.tar", 1)]
    list(reader.pushFilters([EqualTo(("video_id",), "v20")]))
    assert [u.name for u in reader.partitions()] == ["shard-2.tar"]


def test_budget_and_levels(spark):
    videos = spark.createDataFrame([("a", 8.0), ("b", 8.0)], "video_id string, dur double")
    gt = spark.createDataFrame([("a", 0, 0.0, 4.0), ("a", 1, 4.0, 8.0), ("b", 2, 0.0, 8.0)], "video_id string, gt_id long, ts double, te double")
    props = spark.createDataFrame([("a", 0, 0.0, 4.0, 0.9), ("a", 1, 4.0, 8.0, 0.2), ("b", 2, 0.0, 1.0, 0.5)], "video_id string, pred_id long, ts double, te double, conf double")
    got = {(r.kind, r.k): (r.per_item, round(r.cover, 6)) for r in M.budget_curve(gt, props, videos, (1, 2), 0.9).collect()}
    assert got == {("top", 1): (1.0, 33.333333), ("top", 2): (1.5, 66.666667), ("uniform", 1): (1.0, 33.333333), ("uniform", 2): (2.0, 66.666667)}
    lv = {(r.kind, r.value): r.mean_k for r in M.levels(props, videos, (0.1, 0.5, 0.95), (1, 2)).collect()}
    assert lv == {("theta", 0.1): 1.5, ("theta", 0.5): 1.0, ("theta", 0.95): 0.0, ("topk", 1.0): 1.0, ("topk", 2.0): 1.5}


def test_two_column_report(spark, tmp_path):
    truth = spark.createDataFrame([(0, 1), (1, 2), (2, 9)], "query_id long, positive long")
    rows = [(q, v, float(x)) for q, xs in enumerate([[5, 4, 3], [5, 4, 6], [1, 2, 3]]) for v, x in enumerate(xs)]
    new = spark.createDataFrame(rows, "query_id long, video_id long, score double")
    old = new.withColumn("score", -F.col("score"))
    items = spark.createDataFrame([(0,), (1,), (2,)], "video_id long")
    ranks = M.gallery_ranks({"new": new, "old": old}, truth, {"all": items, "two": items.where("video_id > 0")})
    got = {(r.gallery, r["column"], r.query_id): r["rank"] for r in ranks.collect()}
    assert got == {("all", "new", 0): 2, ("all", "new", 1): 1, ("all", "new", 2): 4, ("all", "old", 0): 2, ("all", "old", 1): 3, ("all", "old", 2): 4, ("two", "new", 0): 1, ("two", "new", 1): 1, ("two", "new", 2): 3, ("two", "old", 0): 2, ("two", "old", 1): 2, ("two", "old", 2): 3}
    blocks, diffs = M.two_columns(ranks, "new", "old", n_boot=50)
    assert blocks.count() == 4 and diffs["two"].first()["diff"] == pytest.approx(200 / 3)
    wrote = M.write_report({"blocks": blocks, "none": blocks.limit(0)}, str(tmp_path), "val", ("blocks",))
    assert wrote == ["blocks"] and spark.read.json(str(tmp_path / "val_summary")).count() == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "val_blocks")).count() == 4
    told = spark.createDataFrame([("e", 2.5, 0.5), ("f", 3.0, -0.1)], "experiment string, diff double, ci_low double")
    assert {r.gate: r.open for r in M.gates(told, {"A": ("e", 2.0), "B": ("f", 2.0), "C": ("absent", 0.0)}).collect()} == {"A": True, "B": False, "C": False}
    assert R.rank_metrics(ranks, "gallery").count() == 2


def test_coverage_meets_events_once(spark):
    """Events are not repeated for each method: no key is made of a method's name, and any name will do."""
    gt = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 4.0, 8.0), (1, 1, 4.0, 8.0), (2, 2, 0.0, 8.0)], "video_id long, gt_id long, ts double, te double")
    props = spark.createDataFrame([(1, 0, 0.0, 4.0, 0.9), (1, 1, 4.0, 8.0, 0.2), (2, 2, 0.0, 1.0, 0.5), (3, 3, 0.0, 1.0, 0.9), (1, 4, 0.0, 8.0, None)], "video_id long, pred_id long, ts double, te double, conf double")
    methods = {"a#b": props.where("conf >= 0.2"), "none": props.limit(0), "late": props.where("conf >= 0.5")}
    got = {(r.method, r.threshold): (r.n_gt, r.per_item, r.cover) for r in M.method_coverage(gt, methods, (0.1, 0.9)).collect()}
    assert got == {("a#b", 0.1): (4, 1.5, 100.0), ("a#b", 0.9): (4, 1.5, 75.0), ("none", 0.1): (4, 0.0, 0.0), ("none", 0.9): (4, 0.0, 0.0), ("late", 0.1): (4, 1.0, 50.0), ("late", 0.9): (4, 1.0, 25.0)}
    cut = {(r.method, r.threshold): (r.n_gt, r.per_item, r.cover) for r in M.cut_coverage(gt, props, (0.2, 0.5), (0.1, 0.9)).collect()}
    assert cut == {(n, t): got[m, t] for n, m in (("theta_0.2", "a#b"), ("theta_0.5", "late")) for t in (0.1, 0.9)}
    assert M.method_coverage(gt.limit(0), methods, (0.1,)).count() == 0
