import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from segquery.llm import decontaminate, pii, quality
from segquery.llm.common import BATCH_BYTES, shared_dir, stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    at = stored(docs)
    seen = []
    for name, stage in P.STAGES:
        out = stored(stage(spark, at, sf))
        seen.append((name, at, out))
        if name != "packing":
            assert out.schema.names == docs.schema.names
        at = out
    by = {name: (a, b) for name, a, b in seen}
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}

    a, b = by["quality"]
    assert ids(a) - ids(b) == ids(quality.quality_scores(a, labels).where("not keep")) != set()
    good = ids(labels.where("quality = 1").join(a, "doc_id", "left_semi"))
    assert len(good & ids(b)) >= 0.98 * len(good)

    a, b = by["near_duplicates"]
    texts = {}
    for r in a.collect():
        texts.setdefault(" ".join(r.text.lower().split()), []).append(r.doc_id)
    for same in texts.values():
        assert len(set(same) & ids(b)) <= 1
    assert len(ids(b)) >= 0.8 * len(texts)

    a, b = by["decontamination"]
    assert ids(a) - ids(b) == ids(decontaminate.contamination(a, bench))

    a, b = by["pii"]
    w = pii.trained_weights()
    want = {r.doc_id: pii.masked(r.text, pii.all_spans(r.text, w)[1]) for r in a.collect()}
    assert {r.doc_id: r.text for r in b.collect()} == want

    a, b = by["packing"]
    assert sorted(r.doc_id for r in a.collect()) == sorted(r.doc_id for r in b.collect())


def tables(spark):
    import os

    return os.listdir(shared_dir(spark).removeprefix("file:") + "/segquery")


def test_run(spark, sf):
    """The rows of the last stage, and nothing stored on the way but the stages' results and its own."""
    at, before = spark.read.parquet(f"{sf}/documents.parquet"), tables(spark)
    for name, stage in P.STAGES:
        at = stored(stage(spark, at, sf))
    want, between = sorted(map(str, at.collect())), tables(spark)
    assert sorted(map(str, P.run(spark, sf).collect())) == want
    assert len(tables(spark)) - len(between) < len(between) - len(before)


def test_odd_rows(odd, empty, spark, sf):
    for rows in (odd, empty):
        at = stored(rows.select("doc_id", "text", "lang", "source", "n_chars"))
        for _, stage in P.STAGES:
            at = stored(stage(spark, at, sf))
        assert (at.count() > 0) == (rows is odd)


def test_stored_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf, None)
    wide = spark.range(0, 300, 1, 1).select(F.repeat(F.lpad(F.col("id").cast("string"), 10, "0"), 10_000).alias("text"))
    got = stored(wide.mapInArrow(sizes, "n long, size long")).collect()
    assert sum(r.n for r in got) == 300
    assert max(r.size for r in got) <= BATCH_BYTES + 200_000
    assert spark.conf.get(conf, None) == before
