"""Ranks and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segquery.functions import exprs as X

from . import vectors as V
from .score_states import above


def pct(condition: Column) -> Column:
    return 100 * F.avg(F.when(condition, 1.0).otherwise(0.0))


def strict_ranks(scores: DataFrame, truth: DataFrame, gallery_size: int, *by: str) -> DataFrame:
    """(query_id, rank): 1 + number of items that score strictly higher than the query's own.

    ``truth`` is (query_id, positive); a positive outside the gallery ranks behind all of it. With ``by``, within each
    group of these columns of ``scores`` (then only positives inside have a row). The own score goes to the gallery's
    rows, which are counted where they are: nothing is sorted.
    """
    own = truth.select("query_id", F.col("positive").alias("video_id")).join(scores.select(*by, "query_id", "video_id", F.col("score").alias("own")), ["query_id", "video_id"]).drop("video_id")
    better = scores.select(*by, "query_id", "score").join(own, [*by, "query_id"]).where(above(F.col("score"), F.col("own"))).groupBy(*by, "query_id").agg(F.count("*").alias("n"))
    found = own.join(better, [*by, "query_id"], "left").select(*by, "query_id", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("rank"))
    if by:
        return found
    return truth.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("rank", F.lit(gallery_size + 1).cast("long")).alias("rank"))


def metric_columns(rank: str = "rank", ks: tuple[int, ...] = (1, 5, 10)) -> list[Column]:
    r = F.col(rank)
    return [F.count("*").alias("n"), *[pct(r <= k).alias(f"r{k}") for k in ks], F.percentile(r.cast("double"), F.lit(0.5)).alias("median_rank"), F.avg(r.cast("double")).alias("mean_rank")]


def rank_metrics(ranks: DataFrame, *by: str, rank: str = "rank") -> DataFrame:
    return ranks.groupBy(*by).agg(*metric_columns(rank))


def moment_hits(best: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(query_id, top1, moment): whether the best item is the query's own, and its segment fits the moment.

    ``best`` is maxsim; ``truth`` is (query_id, positive, gt_ts, gt_te).
    """
    top = best.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "video_id", "ts", "te")).alias("_t")).select("query_id", "_t.video_id", "_t.ts", "_t.te")
    both = truth.join(top, "query_id", "left")
    is_own = F.coalesce(F.col("video_id") == F.col("positive"), F.lit(False))
    fit = F.coalesce(X.tiou_hull("ts", "te", "gt_ts", "gt_te") >= threshold, F.lit(False))
    return both.select("query_id", is_own.alias("top1"), (is_own & fit).alias("moment"))


def partition_eval(best: DataFrame, truth: DataFrame, segments: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rank metrics, vectors an item, share of right moments among rank-1 queries and among all.

    Ties for the first place count as rank 1, as in ``strict_ranks``.
    """
    size = segments.select("video_id").distinct().count()
    ranks = strict_ranks(best, truth, size)
    own = best.withColumnRenamed("video_id", "positive").select("query_id", "positive", "ts", "te")
    rows = ranks.join(truth, "query_id").join(own, ["query_id", "positive"], "left")
    hit = F.coalesce(X.tiou_hull("ts", "te", "gt_ts", "gt_te") >= threshold, F.lit(False)) & (F.col("rank") == 1)
    out = rows.agg(*metric_columns(), (100 * F.sum(F.when(hit, 1.0).otherwise(0.0)) / F.nullif(F.sum(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)), F.lit(0.0))).alias("moment_given_top1"), pct(hit).alias("vcmr_r1"))
    per = segments.groupBy("video_id").agg(F.count("*").alias("k")).agg(F.avg("k").alias("vectors_per_item"))
    return out.crossJoin(per)  # one row each


def event_eval(queries: DataFrame, segments: DataFrame, truth: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """One row a query: strict rank of its own event, best item right, own item among k best events, fit of the best event.

    ``truth``: (query_id, own_row, positive, gt_ts, gt_te). The own event's score is known before the gallery is
    scored; the kernel counts what is higher.
    """
    asked = queries.select("query_id", "q_emb").join(truth.select("query_id", F.col("own_row").alias("seg_row")), "query_id")
    asked = asked.join(segments.select("seg_row", "emb"), "seg_row").select("query_id", "q_emb", X.dot("q_emb", "emb").alias("own"))
    better = V.counts(asked, segments, "own").groupBy("query_id").agg(F.sum("n").alias("n"))
    top = V.event_topk(V.query_pairs(asked, segments, k), k).join(truth, "query_id")
    first, own = F.col("place") == 1, F.col("video_id") == F.col("positive")
    per = top.groupBy("query_id").agg(F.bool_or(first & own).alias("video1"), F.bool_or(own).alias(f"video{k}"), F.bool_or(first & own & (X.tiou_hull("ts", "te", "gt_ts", "gt_te") >= threshold)).alias("tiou1"))
    return per.join(better, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("rank"), "video1", f"video{k}", "tiou1")


def event_summary(rows: DataFrame, k: int = 5) -> DataFrame:
    return rows.agg(*metric_columns(), F.avg(1 / F.col("rank")).alias("mrr"), pct(F.col("video1")).alias("video1"), pct(F.col(f"video{k}")).alias(f"video{k}"), pct(F.col("tiou1")).alias("tiou1"))
