import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from segquery.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    """Held-out accuracy: most toxic texts found, hardly a clean one flagged."""
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = d.join(lab.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.toxic_scores(known, lab).join(lab, "doc_id").where(toxicity.held_out()).collect()
    y, p, s = (np.array([r[k] for r in rows]) for k in ("toxic", "predicted", "score"))
    assert ((s >= 0) & (s <= 1)).all() and ((s >= 0.5) == (p == 1)).all()
    order = np.argsort(np.argsort(s)) + 1
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.9 and p[y == 1].mean() > 0.7 and p[y == 0].mean() < 0.02


def test_toxicity_reads_texts_only(odd, labels):
    a = sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.toxic_scores(odd, labels).collect())
    b = sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.toxic_scores(odd.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), labels).collect())
    assert a == b and len(a) == 15
    same = {s for i, s in a if i in ("0", "1")}
    assert len(same) == 1


def test_toxicity_never_learns_from_held_out_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    d = spark.createDataFrame([(i, "idiot" if i % 2 else "fine") for i in ids], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    assert toxicity.fit_toxic(d, lab) is None and {r.score for r in toxicity.toxic_scores(d, lab).collect()} == {0.0}


def test_toxicity_empty(empty, odd, labels):
    assert toxicity.toxic_scores(empty, labels).count() == 0
    assert toxicity.toxic_scores(odd, labels.limit(0)).count() == 15


def test_gradients():
    """Analytic steps against differences of the loss."""
    rng = np.random.default_rng(0)
    m = toxicity.ToxicCNN()
    m.table = rng.standard_normal(m.table.shape).astype(np.float32)
    docs = [np.array([(a & 63) | ((b & 63) << 32) for a, b in rng.integers(0, 64, (n, 2))], np.int64) for n in (5, 40, 17)]
    y = np.array([1, 0, 1], np.float32)
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * m.logits(docs)))))
    before = loss()
    g2 = {"table": np.full(len(m.table), 1e9, np.float32), "out": np.full(m.out.shape, 1e9), "out0": 1e9} | {("f", w): np.full(m.filters[w].shape, 1e9) for w in toxicity.WIDTHS} | {("b", w): np.full(toxicity.FILTERS, 1e9) for w in toxicity.WIDTHS}
    g2[("f", 2)] = np.full(m.filters[2].shape, 1.0)
    old = m.filters[2].copy()
    m._step(docs, y, g2)
    g = (g2[("f", 2)] - 1.0) ** 0.5
    m.filters[2] = old
    j, d, f = np.unravel_index(g.argmax(), g.shape)
    eps = 1e-2
    m.filters[2][j, d, f] += eps
    up = loss()
    m.filters[2][j, d, f] -= 2 * eps
    down = loss()
    assert abs((up - down) / (2 * eps)) == pytest.approx(g[j, d, f], rel=0.2, abs=2e-3) and before > 0


def test_score_does_not_depend_on_neighbours():
    """A text alone, before and behind others of every length has one score."""
    rng = np.random.default_rng(1)
    m = toxicity.ToxicCNN()
    m.table = rng.standard_normal(m.table.shape).astype(np.float32)
    docs = [np.array([a | (b << 32) for a, b in rng.integers(0, 1 << 17, (n, 2)).tolist()], np.int64) for n in range(40)]
    alone = np.concatenate([m.scores([d]) for d in docs])
    assert len(set(alone.round(6))) > 30
    assert m.scores(docs) == pytest.approx(alone, abs=1e-5) and m.scores(docs[::-1]) == pytest.approx(alone[::-1], abs=1e-5)


def test_quality_accuracy(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_scores(d, lab).join(lab, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum(r.keep for r in good) / len(good) > 0.99
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.keep for r in bad) / len(bad) > 0.9


def test_quality_held_out(spark):
    """Labels of a fifth of the rows are kept from the classifier, which judges these rows."""
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_scores(d, lab.where(~toxicity.held_out())).join(lab.where(toxicity.held_out()), "doc_id").collect()
    kept = {q: [r.keep for r in rows if r.quality == q] for q in (0, 1)}
    assert len(kept[0]) > 100 and len(kept[1]) > 600
    assert np.mean(kept[1]) > 0.99 and np.mean(kept[0]) < 0.1


def test_conflicting_labels_and_ids(spark):
    """Labels and texts that differ for one id count in one way, whatever their order."""
    texts = [(i, ("idiot moron " if i % 2 else "fine words ") * (1 + i % 7)) for i in range(60)] + [(8, "another text of eight"), (9, "IDIOT | ! | !")]
    given = [(i, i % 2, i % 2) for i in range(60)] + [(4, 0, 1), (4, 1, 0), (7, 0, 0)]
    d = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source")
    lab = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for of in (lambda x, y: toxicity.toxic_scores(x, y).select("doc_id", "score"), lambda x, y: quality.quality_scores(x, y).select("doc_id", "doc_score")):
        a, b = (sorted((r[0], round(r[1], 9)) for r in of(d(t).repartition(n), lab(g)).collect()) for t, g, n in ((texts, given, 1), (texts[::-1], given[::-1], 5)))
        assert a == b and len(a) == 62


def test_strength_of_sparse_sites(spark):
    """Thousands of hosts of one to three rows: the prior's strength by plain moments, and shrunk posteriors."""
    rng = np.random.default_rng(5)
    n = rng.integers(1, 4, 4000)
    share = rng.beta(2.0, 3.0, len(n))
    a = rng.binomial(n, share)
    groups = spark.createDataFrame(list(zip(a.astype(float).tolist(), n.tolist(), strict=True)), "a double, n long")
    m = a.sum() / n.sum()
    rho = max(0.0, float((n * (a / n - m) ** 2).sum()) - len(n) * m * (1 - m)) / float((m * (1 - m) * n).sum())
    got = quality._strength(groups, "a", "n", F.lit(float(m)))
    assert got == pytest.approx(min(10_000.0, max(2.0, 1 / rho - 1 if rho > 0 else 10_000.0)), rel=1e-6)


def test_quality_odd_rows(odd, labels, empty):
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == 15 and all(0 <= r.quality_score <= 1 and r.keep is not None for r in rows)
    assert {r.host for r in rows if r.doc_id in (3, 5)} == {""}
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r.keep for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {True}


def test_posteriors(spark, monkeypatch):
    """Sparse sites shrink to their parents: posteriors against plain arithmetic."""
    monkeypatch.setattr(quality, "_strength", lambda *a: 4.0)
    d = spark.createDataFrame([(i, "a " * (i + 1), "en", "big" if i < 9 else "small") for i in range(10)], "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.quality_scores(d, lab).collect()}
    p = {i: r.doc_score for i, r in rows.items()}
    mu = sum(p.values()) / 10
    assert rows[9].host_posterior == pytest.approx(mu) and rows[9].path_posterior == pytest.approx(mu)
    host = (sum(p[i] for i in range(1, 9)) + 4 * mu) / (8 + 4)
    assert rows[0].host_posterior == pytest.approx(host) and rows[0].path_posterior == pytest.approx((sum(p[i] for i in range(1, 9)) + 4 * host) / (8 + 4))
