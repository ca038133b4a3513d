"""Reports over several strategies, columns and galleries: each is one plan, not one for each combination."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as R
from .evaluation import tagged, tagged_pairs
from .intervals import split_evenly
from .partitions import uniform
from .stats import poisson_bootstrap


def method_coverage(gt: DataFrame, methods: dict[str, DataFrame], thresholds: tuple[float, ...]) -> DataFrame:
    """(method, threshold, n_gt, per_item, cover): share of events with a segment of tIoU >= threshold, in percent, and segments an item with events."""
    return tagged_coverage(gt, tagged(methods), list(methods), thresholds)


def tagged_coverage(gt: DataFrame, preds: DataFrame, names: list[str], thresholds: tuple[float, ...]) -> DataFrame:
    """``method_coverage`` of segments (video_id, method, ts, te), ``method`` being the place of its name.

    Events meet the segments of all methods at once and have one row with their best tIoU by each method, so neither
    they nor their items are repeated for each method. Both relations are read several times and made once.
    """
    gt, preds = (d.select(*c).persist(StorageLevel.DISK_ONLY) for d, c in ((gt, ("video_id", "gt_id", "ts", "te")), (preds, ("video_id", "method", "ts", "te"))))
    best = tagged_pairs(gt, preds).groupBy("video_id", "gt_id").agg(*[F.max(F.when(F.col("method") == k, F.col("tiou"))).alias(f"_b{k}") for k in range(len(names))])
    known = gt.select("video_id", "gt_id").join(best, ["video_id", "gt_id"], "left")
    hit = lambda k, t: F.coalesce(F.col(f"_b{k}"), F.lit(0.0)) >= t
    cells = [F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t"), R.pct(hit(k, t)).alias("cover")) for k in range(len(names)) for t in dict.fromkeys(thresholds)]
    per = known.agg(F.count("*").alias("n_gt"), F.array(*cells).alias("x")).where("n_gt > 0").select("n_gt", F.explode("x").alias("x"))
    items = gt.select("video_id").distinct()
    n = preds.groupBy("video_id", "method").agg(F.count("*").alias("_n")).join(items, "video_id", "left_semi").groupBy("method").agg(F.sum("_n").alias("_n"))
    out = per.crossJoin(items.agg(F.count("*").alias("_items"))).join(n, F.col("x.k") == F.col("method"), "left")  # one row of items
    name = F.element_at(F.array(*map(F.lit, names)), F.col("x.k") + 1)
    return out.select(name.alias("method"), F.col("x.t").alias("threshold"), "n_gt", (F.coalesce("_n", F.lit(0)) / F.col("_items")).alias("per_item"), F.col("x.cover").alias("cover"))


def cut_coverage(gt: DataFrame, props: DataFrame, thetas: tuple[float, ...], thresholds: tuple[float, ...], name: str = "theta") -> DataFrame:
    """``method_coverage`` of the methods ``<name>_<theta>``: proposals of a confidence >= theta; the proposals are made once for all of them."""
    at = F.array(*[F.when(F.col("conf") >= t, F.lit(k)) for k, t in enumerate(thetas)])
    cut = props.select("video_id", "ts", "te", F.explode(F.filter(at, F.isnotnull)).alias("method"))
    return tagged_coverage(gt, cut, [f"{name}_{t}" for t in thetas], thresholds)


def uniform_of(videos: DataFrame, ks: tuple[int, ...], name: str = "uniform") -> dict[str, DataFrame]:
    """Methods ``<name>_<k>``: k equal segments of each item."""
    return {f"{name}_{k}": uniform(videos, k).select("video_id", F.concat_ws("_", "video_id", "k").alias("pred_id"), "ts", "te", F.lit(1.0).alias("conf")) for k in ks}


def budget_curve(gt: DataFrame, props: DataFrame, videos: DataFrame, ks: tuple[int, ...], threshold: float = 0.5) -> DataFrame:
    """(kind, k, per_item, cover): coverage by the k most confident proposals and by k equal segments, for each budget."""
    w = Window.partitionBy("video_id").orderBy(F.desc("conf"), "pred_id")
    best = props.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(ks))
    within = F.filter(F.array(*[F.when(F.col("_r") <= k, F.lit(i)) for i, k in enumerate(ks)]), F.isnotnull)
    top = best.select("video_id", F.col("ts").cast("double").alias("ts"), F.col("te").cast("double").alias("te"), F.explode(within).alias("method"))
    whole = videos.select("video_id", F.lit(0.0).alias("ts"), F.col("dur").cast("double").alias("te"), F.posexplode(F.array(*map(F.lit, ks))).alias("_i", "_n")).where("_n >= 1")
    equal = split_evenly(whole, F.col("_n")).select("video_id", "ts", "te", (F.col("_i") + len(ks)).alias("method"))
    rows = tagged_coverage(gt, top.unionByName(equal), [f"{kind}_{k}" for kind in ("top", "uniform") for k in ks], (threshold,))
    return rows.select(F.substring_index("method", "_", 1).alias("kind"), F.substring_index("method", "_", -1).cast("int").alias("k"), "per_item", "cover")


def levels(props: DataFrame, items: DataFrame, thetas: tuple[float, ...], ks: tuple[int, ...]) -> DataFrame:
    """(kind, value, mean_k): segments an item keeps on average at each threshold of confidence and each top-k."""
    spark, of = props.sparkSession, items.agg(F.count_distinct("video_id").alias("_of"))
    grid = F.broadcast(spark.createDataFrame([(float(t),) for t in thetas], "value double"))  # as many rows as values
    sizes = F.broadcast(spark.createDataFrame([(float(k),) for k in ks], "value double"))
    props = props.select("video_id", "conf")
    kept = props.join(grid, F.col("conf") >= F.col("value")).groupBy("value").agg(F.count("*").alias("n"))
    kept = grid.join(kept, "value", "left").select(F.lit("theta").alias("kind"), "value", F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    most = props.groupBy("video_id").agg(F.count("*").alias("m")).crossJoin(sizes).groupBy("value").agg(F.sum(F.least("m", "value")).alias("n"))
    most = sizes.join(most, "value", "left").select(F.lit("topk").alias("kind"), "value", F.coalesce("n", F.lit(0.0)).alias("n"))
    return kept.unionByName(most).crossJoin(of).select("kind", "value", (F.col("n") / F.greatest("_of", F.lit(1))).alias("mean_k"))  # one row of items


def gallery_ranks(scores: dict[str, DataFrame], truth: DataFrame, galleries: dict[str, DataFrame]) -> DataFrame:
    """(gallery, column, query_id, rank): strict ranks of each query in each gallery (video_id) by each column of scores, counted at once.

    A positive that a gallery lacks ranks behind all of it.
    """
    tags = reduce(DataFrame.unionByName, [g.select("video_id", F.lit(n).alias("gallery")) for n, g in galleries.items()]).distinct()
    every = reduce(DataFrame.unionByName, [s.select("query_id", "video_id", "score", F.lit(c).alias("column")) for c, s in scores.items()]).join(tags, "video_id")
    found = R.strict_ranks(every, truth, 0, "gallery", "column")
    size = tags.groupBy("gallery").agg(F.count("*").alias("_size"))
    columns = truth.sparkSession.createDataFrame([(c,) for c in scores], "column string")
    wanted = truth.select("query_id").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(columns))  # a few galleries and columns
    return wanted.join(found, ["gallery", "column", "query_id"], "left").select("gallery", "column", "query_id", F.coalesce("rank", F.col("_size") + 1).alias("rank"))


def two_columns(ranks: DataFrame, new: str, old: str, unit: DataFrame | None = None, n_boot: int = 200, seed: object = 0) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(gallery, column, rank metrics) and, by gallery, the bootstrap of the difference of R@1 of two columns over units (query_id, unit)."""
    blocks = R.rank_metrics(ranks, "gallery", "column")
    hit = lambda c: F.max(F.when((F.col("column") == c) & (F.col("rank") <= 1), 1).otherwise(0))
    rows = ranks.groupBy("gallery", "query_id").agg(hit(new).alias("x"), hit(old).alias("y"))
    rows = rows.withColumn("unit", F.col("query_id")) if unit is None else rows.join(unit.select("query_id", "unit"), "query_id")
    units = rows.groupBy("gallery", "unit").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n"))
    names = [r.gallery for r in ranks.select("gallery").distinct().collect()]
    return blocks, {g: poisson_bootstrap(units.where(F.col("gallery") == g), n_boot, seed) for g in names}


def write_report(tables: dict[str, DataFrame], folder: str, prefix: str, summary: tuple[str, ...] = ()) -> list[str]:
    """One CSV table for each non-empty part, and one of JSON lines (part, row) with the parts of the summary; returns what it wrote.

    Parts are written by tasks, whatever their size.
    """
    from segquery.sources import sinks

    written = []
    for name, df in tables.items():
        if not df.isEmpty():
            sinks.write_csv(df, f"{folder}/{prefix}_{name}")
            written.append(name)
    if summary:
        rows = reduce(DataFrame.unionByName, [tables[n].select(F.lit(n).alias("part"), F.to_json(F.struct("*")).alias("row")) for n in summary])
        sinks.write_lines(rows, f"{folder}/{prefix}_summary")
    return written


def gates(rows: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, open): for each rule (experiment, least gain) whether its row of (experiment, diff, ci_low) gains that much with an interval above 0."""
    spark = rows.sparkSession
    asked = F.broadcast(spark.createDataFrame([(g, e, float(x)) for g, (e, x) in rules.items()], "gate string, experiment string, least double"))  # as many rows as rules
    ok = (F.col("diff") >= F.col("least")) & (F.col("ci_low") > 0)
    return asked.join(rows.select("experiment", "diff", "ci_low"), "experiment", "left").groupBy("gate").agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("open"))
