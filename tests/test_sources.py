import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from segquery.operators import analysis as A
from segquery.sources import readers, sinks


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    return str(path)


def test_jsonl(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", [{"id": "x_3", "video": "d/v1.mp4", "timestamps": [1, 2.5], "text": "a"}])
    m = readers.manifests(spark, {"val": p}).first()
    assert (m.event_id, m.video_id, m.ts, m.te, m.split) == (3, "v1", 1.0, 2.5, "val")
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{"id": "b"}\n{"id": "c')
    assert readers.jsonl_tolerant(spark, str(tmp_path / "bad.jsonl"), "id string").count() == 2
    assert readers.jsonl_tolerant(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()


def test_disjoint(spark):
    ok = spark.createDataFrame([("a", "val"), ("b", "dev")], "video_id string, split string")
    readers.assert_disjoint(ok)
    with pytest.raises(ValueError):
        readers.assert_disjoint(ok.unionByName(spark.createDataFrame([("a", "dev")], ok.schema)))


def test_annotations_and_partition_file(spark, tmp_path):
    ann = {"database": {"v": {"subset": "val", "duration": 100.0, "annotations": [{"segment": [k, k + 1], "sentence": f"s{k}"} for k in range(20)]}, "w": {"subset": "dev", "duration": 5.0, "annotations": []}}}
    (tmp_path / "ann.json").write_text(json.dumps(ann))
    got = readers.annotations(spark, str(tmp_path / "ann.json"), "val")
    assert got.count() == 16 and got.agg(F.max("event_id")).first()[0] == 15
    (tmp_path / "p.json").write_text(json.dumps({"v.mp4": [[-1, 20, 9], [90, 120], [99.5, 120]], "w": [[0, 3]], "x": [[0, 1]]}))
    dur = spark.createDataFrame([("v", 100.0), ("w", 5.0)], "video_id string, dur double")
    assert sorted((r.video_id, r.ts, r.te) for r in readers.partition_file(spark, str(tmp_path / "p.json"), dur).collect()) == [("v", 0, 20), ("v", 90, 100), ("w", 0, 3)]


@pytest.mark.parametrize("as_list", [True, False])
def test_custom_queries(spark, tmp_path, as_list):
    rows = [{"query": " a b ", "video_id": "v", "ts": 0, "te": 1}, {"query": "c", "video_id": "w", "ts": 0, "te": 1}]
    p = tmp_path / "q.json"
    p.write_text(json.dumps(rows) if as_list else "\n".join(map(json.dumps, rows)))
    got = readers.custom_queries(spark, str(p)).collect()
    assert [r.qid for r in got] == ["custom_000", "custom_001"] and got[0].key.startswith("q_") and len(got[0].key) == 14


def test_vectors(spark, tmp_path):
    store = str(tmp_path / "store")
    v = lambda rows: spark.createDataFrame(rows, "id string, emb array<double>")
    sinks.write_chunks(v([("a", [1.0, 0.0]), ("b", [0.0, 2.0])]), store, 0)
    sinks.write_chunks(v([("a", [0.0, 3.0])]), store, 1)
    got = readers.vector_store(spark, store)
    assert {r.id: r.emb for r in got.collect()} == {"a": [0.0, 3.0], "b": [0.0, 2.0]}
    assert readers.vector_store(spark, store, True).count() == 2
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "id string, n int")
    with pytest.raises(sinks.MissingVectors):
        sinks.collect_vectors(rows, got, "id")
    assert {r.id: r.emb for r in sinks.collect_vectors(rows, got, "id", True).collect()} == {"a": [0.0, 1.0], "b": [0.0, 1.0]}


def test_index_partition(spark, tmp_path):
    seg = spark.createDataFrame([("p0", 1), ("p1", 2)], "partition string, seg_row int")
    sinks.write_partitions(seg, str(tmp_path / "ix"))
    got = readers.segment_index(spark, str(tmp_path / "ix"), "p1")
    assert got.count() == 1 and "PartitionFilters: [isnotnull(partition" in got._jdf.queryExecution().toString()
    with pytest.raises(KeyError):
        readers.segment_index(spark, str(tmp_path / "ix"), "p9")
    with pytest.raises(KeyError):
        sinks.require_partitions(seg, ["p0", "p7"])


def test_archives_and_folder(spark, tmp_path):
    np.savez(tmp_path / "v.npz", z=np.arange(6.0).reshape(3, 2))
    got = readers.archives(spark, str(tmp_path / "*.npz"), "z")
    assert [r["values"] for r in got.orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]] and len(got.first().sha256) == 64
    spark.dataSource.register(readers.FolderSource)
    r = spark.read.format("segquery_folder").load(str(tmp_path)).first()
    assert r.video_id == "v" and r.bytes > 0


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.23456789, [1, 2]), ("b", None, None)], "k string, x double, l array<int>")
    sinks.write_csv(d, str(tmp_path / "c"))
    assert {r.k: r.x for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"a": "1.234568", "b": None}
    assert sinks.markdown(d.select("k", "x").orderBy("k")) == "| k | x |\n| --- | --- |\n| a | 1.23 |\n| b | - |"
    one = sinks.install(d, str(tmp_path / "v"), F.col("k"), "val")
    assert one == sinks.install(d, str(tmp_path / "v"), F.col("k"), "val")
    sinks.write_lines(d, str(tmp_path / "log"))
    sinks.write_lines(d, str(tmp_path / "log"), append=True)
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert A.latest_by(spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int"), "k", "n").first().n == 2


def test_stored_runs(spark, tmp_path):
    p = lines(tmp_path / "s.jsonl", [{"video_id": "b", "ts": 5, "te": 9, "conf": 0.6}, {"video_id": "b", "ts": 1, "te": 4.5, "conf": 0.8}, {"video_id": "a", "ts": 0, "te": 1}])
    assert [(r.video_id, r.k, r.ts, r.conf) for r in readers.segment_lines(spark, p).orderBy("video_id", "k").collect()] == [("a", 0, 0.0, None), ("b", 0, 1.0, 0.8), ("b", 1, 5.0, 0.6)]
    (tmp_path / "subset.json").write_text(json.dumps({"videos": [{"video_id": "a", "duration": 3.5}]}))
    (tmp_path / "durations.json").write_text(json.dumps({"a": 3.5, "b": 4}))
    assert [tuple(r) for r in readers.durations(spark, str(tmp_path / "subset.json")).collect()] == [("a", 3.5)]
    assert sorted(tuple(r) for r in readers.durations(spark, str(tmp_path / "durations.json")).collect()) == [("a", 3.5), ("b", 4.0)]
    assert readers.train_ids(spark, str(tmp_path / "none.jsonl")).count() == 0
    e = spark.createDataFrame([([1.0], "k", "a", 0.0, 1.0, "c")], "emb array<double>, seg_key string, video_id string, ts double, te double, caption string")
    e.write.parquet(str(tmp_path / "e"))
    e.withColumn("split", F.lit("val")).write.parquet(str(tmp_path / "f"))
    assert readers.event_index(spark, str(tmp_path / "e")).first().split == "" and readers.event_index(spark, str(tmp_path / "f"), "dev").count() == 0
    assert dict(readers.text_table(spark, str(tmp_path / "e")).dtypes)["emb"] == "array<float>"


def test_feature_series(spark, tmp_path):
    items = spark.createDataFrame([("a",), ("b",)], "video_id string")
    np.savez(tmp_path / "a.npz", z=np.eye(3, dtype=np.float16), t_sec=np.arange(3) + 0.5)
    with pytest.raises(FileNotFoundError, match="b"):
        readers.feature_series(spark, str(tmp_path), items)
    np.savez(tmp_path / "b.npz", z=np.ones((2, 3)), t_sec=np.array([0.5, 1.5]))
    np.savez(tmp_path / "c.npz", z=np.ones((2, 3)), t_sec=np.array([1.5, 0.5]))
    rows = readers.feature_series(spark, str(tmp_path), items).collect()
    assert sorted((r.video_id, r.step, r.t_sec) for r in rows) == [("a", 0, 0.5), ("a", 1, 1.5), ("a", 2, 2.5), ("b", 0, 0.5), ("b", 1, 1.5)]
    with pytest.raises(Exception, match="not a series"):
        readers.feature_series(spark, str(tmp_path), spark.createDataFrame([("c",)], "video_id string")).collect()


def test_logs_shards_pools(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"s0": ["x/a.npz", "b.npz"], "s1": ["c.npz"]}))
    assert [r.shard for r in readers.shard_index(spark, str(tmp_path / "m.json"), spark.createDataFrame([("c",)], "video_id string")).collect()] == ["s1"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"1")
    log = lines(tmp_path / "l.jsonl", [{"video_id": "a", "at": 1, "status": "failed"}, {"video_id": "a", "at": 2, "status": "ok", "file": "a.bin"}, {"video_id": "b", "at": 1, "status": "ok", "file": "b.bin"}, {"video_id": "c", "at": 1, "status": "failed"}])
    ok, failed = readers.feature_log(spark, log, str(tmp_path / "d"))
    assert [r.video_id for r in ok.collect()] == ["a"] and [r.video_id for r in failed.collect()] == ["c"]
    pool = readers.caption_pool(spark.createDataFrame([("v#1#10", "k"), ("v#1#2", "b"), ("w#0", "x")], "key string, caption string"))
    assert {r.video_id: r.captions for r in pool.collect()} == {"v#1": ["b", "k"], "w": ["x"]}
    s = spark.createDataFrame([("a", "val", 10.0), ("b", "val", 99.0), ("c", "dev", 1.0)], "video_id string, split string, dur double")
    assert [r.video_id for r in readers.split_rows(s.select("video_id"), s, "val", 50).collect()] == ["a"]


def test_dialects(spark):
    a = readers.segment_dialect(spark.createDataFrame([(1, 2, "x")], "t_s int, t_e int, c string")).first()
    b = readers.segment_dialect(spark.createDataFrame([("v", [[1.0, 2.0, 0.5], [3.0, 4.0]])], "video_id string, s array<array<double>>"), "s").collect()
    assert (a.ts, a.te, a.c) == (1.0, 2.0, "x") and [(r.video_id, r.ts, r.te) for r in b] == [("v", 1.0, 2.0), ("v", 3.0, 4.0)]
    with pytest.raises(ValueError):
        readers.segment_dialect(spark.range(1))
    raw = spark.createDataFrame([("v", [(1.0, 2.0, 0.5)])], "video_id string, proposals array<struct<t_s:double,t_e:double,conf:double>>")
    assert [tuple(r) for r in readers.proposals(raw).collect()] == [("v", "v#0", 1.0, 2.0, 0.5)]


def test_append_log_and_dead_letters(spark, tmp_path):
    from segquery.streaming import streams

    src, rows = tmp_path / "in", [(1, "a", 1.0), (2, "b", None), (1, "a", 1.0)]
    make = lambda x: spark.createDataFrame(x, "id long, v string, x double").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.mode("append").parquet(str(src))
    make(rows)
    read = lambda: spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    for more in ([], [(1, "a", 1.0), (3, "c", 2.0)]):
        if more:
            make(more)
        streams.append_log(read(), str(tmp_path / "log"), str(tmp_path / "ck"), "id")
        streams.with_dead_letters(read(), F.col("x").isNull(), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck2"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 2, 3]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 1, 1, 3] and [r.id for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]
