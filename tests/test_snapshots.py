"""Versions are published whole or not at all; keyed streams keep what they have seen."""

import pytest

from segquery.sources import snapshots as S
from segquery.streaming import streams


def rows(spark, n, k=0):
    return spark.createDataFrame([(f"v{i}", i + k, None if i % 3 == 0 else [float(i)]) for i in range(n)], "video_id string, x long, emb array<double>")


def seen(spark, root, split="val"):
    return sorted((r.video_id, r.x) for r in S.current(spark, root, split).collect())


def test_commit_and_equal_content(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        S.current(spark, root, "val")
    one = S.commit(spark, root, {"val": rows(spark, 5), "dev": rows(spark, 3)}, inputs={"a": "1"})
    assert seen(spark, root) == [(f"v{i}", i) for i in range(5)] and S.manifest(spark, root) == one and one["splits"]["val"]["rows"] == 5
    before = sorted(p.name for p in tmp_path.rglob("*.parquet"))
    assert S.commit(spark, root, {"val": rows(spark, 5).repartition(3), "dev": rows(spark, 3)}, inputs={"a": "1"}) == one
    assert sorted(p.name for p in tmp_path.rglob("*.parquet")) == before  # equal content writes nothing
    two = S.commit(spark, root, {"val": rows(spark, 5, 1), "dev": rows(spark, 3)})
    assert two["version"] != one["version"] and seen(spark, root)[0] == ("v0", 1)
    assert S.prune(spark, root) == [f"version={one['version']}"] and seen(spark, root)[0] == ("v0", 1)


@pytest.mark.parametrize("step", ["write", "move", "swap", "read"])
def test_killed_writer_leaves_the_old_table(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "table")
    S.commit(spark, root, {"val": rows(spark, 4)})

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        if step == "read":
            m.setattr(S, "hash_of", die)
        elif step == "swap":
            at = S._Files.write
            m.setattr(S._Files, "write", lambda self, path, text: die() if path.endswith("CURRENT") else at(self, path, text))
        else:
            m.setattr(S._Files, step, die)
        with pytest.raises(RuntimeError, match="killed"):
            S.commit(spark, root, {"val": rows(spark, 6)})
    assert seen(spark, root) == [(f"v{i}", i) for i in range(4)]
    S.commit(spark, root, {"val": rows(spark, 6)})
    assert len(seen(spark, root)) == 6


def test_incomplete_split(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(S.IncompleteVersion, match="v5"):
        S.commit(spark, root, {"val": rows(spark, 4)}, needs={"val": rows(spark, 6)})
    assert S.manifest(spark, root) is None


def test_stale_versions_are_rebuilt(spark, tmp_path):
    root, calls = str(tmp_path / "table"), []

    def build(n):
        calls.append(n)
        return {"val": rows(spark, n)}

    S.ensure(spark, root, {"in": rows(spark, 2)}, lambda: build(2))
    S.ensure(spark, root, {"in": rows(spark, 2).repartition(2)}, lambda: build(2))
    assert calls == [2]
    S.ensure(spark, root, {"in": rows(spark, 3)}, lambda: build(3))
    S.ensure(spark, root, {"in": rows(spark, 3)}, lambda: build(3), settings={"k": 1})
    assert calls == [2, 3, 3] and len(seen(spark, root)) == 3


def feed(spark, src, data):
    spark.createDataFrame(data, "id long, v string, at timestamp").write.mode("append").parquet(str(src))


def stream(spark, src):
    return spark.readStream.schema("id long, v string, at timestamp").parquet(str(src)).withWatermark("at", "1 hour")


def test_a_key_is_appended_once_for_ever(spark, tmp_path):
    """Also when it comes again in a later run, long behind the watermark."""
    import datetime as dt

    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    src, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    for k, data in enumerate(([(1, "a", day(0)), (2, "b", day(0))], [(3, "c", day(10))], [(1, "again", day(0)), (1, "again", day(30)), (4, "d", day(30))])):
        feed(spark, src, data)
        streams.append_log(stream(spark, src), log, check, "id")
        assert sorted(r.id for r in spark.read.parquet(log).collect()) == [[1, 2], [1, 2, 3], [1, 2, 3, 4]][k]


def test_last_record_of_each_key(spark, tmp_path):
    src, table, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    batches = [[(1, "a", 5), (1, "b", 7), (2, "x", 1)], [(1, "old", 6), (3, "n", 0)], [(1, "c", 9), (2, "y", 1), (2, "z", 0)]]
    want = [{1: "b", 2: "x"}, {1: "b", 2: "x", 3: "n"}, {1: "c", 2: "y", 3: "n"}]
    for data, held in zip(batches, want, strict=True):
        spark.createDataFrame(data, "id long, v string, seq long").write.mode("append").parquet(str(src))
        rows = spark.readStream.schema("id long, v string, seq long").parquet(str(src))
        streams.upsert_latest(rows, table, check, "id", "seq", buckets=2)
        got = streams.latest_records(spark, table, "id", "seq")
        assert {r.id: r.v for r in got.collect()} == held and got.columns == ["id", "v", "seq"]
    root = str(tmp_path / "compact")
    streams.compact(spark, table, root, "id", "seq")
    assert {r.id: r.v for r in S.current(spark, root, "all").collect()} == want[-1]


def test_streams_of_nothing(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([], "id long, v string, seq long").write.parquet(str(src))
    rows = spark.readStream.schema("id long, v string, seq long").parquet(str(src))
    assert streams.finished_latest(rows, "none", "id", "seq").count() == 0
