"""Scoring of query vectors against segments, and reductions per item.

Relations: queries ``(query_id, q_emb)``, segments ``(seg_row, video_id, ts, te, emb[, ...])``,
pairs ``(query_id, seg_row, video_id, ts, te, score)``. Ties go to the earliest segment by
(ts, seg_row), then to the least video. What reduces pairs (``maxsim``, ``topk_mean``, ``lse``, ``event_topk``) takes
states of ``score_states`` as well: ``item_pairs``, ``item_sums`` and ``query_pairs`` make them while the queries
fit beside a task, and all pairs beyond.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segquery.functions import exprs as X

from . import score_states as K
from .numbering import numbered


def pair_scores(queries: DataFrame, segments: DataFrame, mode: str = "block") -> DataFrame:
    """Inner product of every query with every segment, for who asks for all pairs.

    ``block``: the queries (size checked) go with each task as one matrix and meet Arrow batches
    of segments in matrix products; ``join``: a cross join of blocks of both, for any number of queries.
    """
    if mode == "block" and K.fits(queries):
        return K.every_pair(queries, segments)
    return K.block_pairs(queries, segments)


def _once(states: DataFrame) -> DataFrame:
    """States on the executors' disks: ranks, aggregates and reports read them more than once, and the scores are made once."""
    return states.persist(StorageLevel.DISK_ONLY)


def item_pairs(queries: DataFrame, segments: DataFrame, k: int = 1, **options: object) -> DataFrame:
    """Pairs among which are the k best segments of each (query, item)."""
    return _once(K.item_best(queries, segments, k, **options)) if K.fits(queries, options.get("sources")) else K.pair_terms(queries, segments, **options)


def query_pairs(queries: DataFrame, segments: DataFrame, k: int, **options: object) -> DataFrame:
    """Pairs among which are the k best segments of each query."""
    return _once(K.query_best(queries, segments, k, **options)) if K.fits(queries, options.get("sources")) else K.pair_terms(queries, segments, **options)


def item_sums(queries: DataFrame, segments: DataFrame, tau: float, **options: object) -> DataFrame:
    """Log-sum-exp states of each (query, item) for ``lse``, or all pairs."""
    return _once(K.item_lse(queries, segments, tau, **options)) if K.fits(queries, options.get("sources")) else K.pair_terms(queries, segments, **options)


def counts(queries: DataFrame, segments: DataFrame, least: float | str, **options: object) -> DataFrame:
    """(query_id, video_id, n): an item's segments that score ``least`` or more, or strictly more than the query's column ``least``; partial counts, to be summed."""
    if K.fits(queries, options.get("sources")):
        return K.item_counts(queries, segments, least, **options)
    pairs = K.pair_terms(queries, segments, **options)
    if isinstance(least, str):
        pairs = pairs.join(queries.select("query_id", F.col(least).alias("_own")), "query_id")
    hit = K.above(F.col("score"), F.col("_own")) if isinstance(least, str) else F.col("score") >= least
    return pairs.groupBy("query_id", "video_id").agg(F.sum(hit.cast("long")).alias("n"))


def maxsim(pairs: DataFrame) -> DataFrame:
    """Best segment of each item for each query: (query_id, video_id, score, seg_row, ts, te)."""
    first = F.struct(-F.col("ts"), -F.col("seg_row"))
    best = F.max(F.struct(F.col("score"), first.alias("f"), "seg_row", "ts", "te")).alias("b")
    return pairs.groupBy("query_id", "video_id").agg(best).select("query_id", "video_id", "b.score", "b.seg_row", "b.ts", "b.te")


def max_scores(pairs: DataFrame) -> DataFrame:
    """As ``maxsim`` without the segment: a plain maximum keeps the aggregation in the hash path."""
    return pairs.groupBy("query_id", "video_id").agg(F.max("score").alias("score"))


def topk_mean(pairs: DataFrame, k: int) -> DataFrame:
    """Mean of the min(k, count) best segments of an item."""
    w = Window.partitionBy("query_id", "video_id").orderBy(F.desc("score"), "seg_row")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("query_id", "video_id").agg(F.avg("score").alias("score"))


def lse(pairs: DataFrame, tau: float) -> DataFrame:
    """tau * log(mean(exp(score / tau))) of an item's segments, shifted by the maximum.

    States (top, total, n), at most a few of a (query, item) from each task, merge in one pass; of plain pairs the maximum is
    found first.
    """
    if "total" not in pairs.columns:
        top = pairs.groupBy("query_id", "video_id").agg(F.max("score").alias("top"))
        both = pairs.join(top, ["query_id", "video_id"])
        return both.groupBy("query_id", "video_id").agg((F.first("top") + tau * F.log(F.avg(F.exp((F.col("score") - F.col("top")) / tau)))).alias("score"))
    s = pairs.groupBy("query_id", "video_id").agg(F.max("top").alias("m"), F.collect_list(F.struct("top", "total")).alias("s"), F.sum("n").alias("n"))
    total = F.aggregate("s", F.lit(0.0), lambda t, x: t + x["total"] * F.exp((x["top"] - F.col("m")) / tau))
    return s.select("query_id", "video_id", (F.col("m") + tau * F.log(total / F.col("n"))).alias("score"))


AGGREGATES = {"max": lambda p, **kw: max_scores(p), "topk_mean": lambda p, k=3, **kw: topk_mean(p, k), "lse": lambda p, tau=0.1, **kw: lse(p, tau)}


def aggregated(pairs: DataFrame, how: str = "max", **kw: float) -> DataFrame:
    """Strategy by name; an unknown one raises."""
    if how not in AGGREGATES:
        raise ValueError(f"aggregate {how!r}: one of {sorted(AGGREGATES)}")
    return AGGREGATES[how](pairs, **kw)


def biased(pairs: DataFrame, conf: DataFrame, beta: float) -> DataFrame:
    """Adds beta * log(conf) of the segment ``(seg_row, conf)``; beta 0 leaves the scores as they are."""
    if beta == 0:
        return pairs
    return pairs.join(conf.select("seg_row", "conf"), "seg_row").withColumn("score", F.col("score") + beta * F.log("conf")).drop("conf")


def with_bias(segments: DataFrame, conf: DataFrame) -> DataFrame:
    """Segments with ``bias``, the logarithm of their confidence ``(seg_row, conf)``: a term of a variant, weight beta.

    The join deals an item's segments to all tasks, each of which would have states of every item; ranges of items give each task few.
    """
    return segments.join(conf.select("seg_row", F.log("conf").alias("bias")), "seg_row").repartitionByRange("video_id", "seg_row")


def mean_pooled(segments: DataFrame) -> DataFrame:
    """One unit vector an item: direction of the sum; ts least, te greatest: (video_id, ts, te, emb)."""
    flat = segments.select("video_id", F.posexplode("emb").alias("pos", "x")).groupBy("video_id", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    vec = flat.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select("video_id", X.unit(F.col("v.x")).alias("emb"))
    span = segments.groupBy("video_id").agg(F.min("ts").alias("ts"), F.max("te").alias("te"))
    return span.join(vec, "video_id")


def video_topk(pairs: DataFrame, k: int) -> DataFrame:
    """The k best items of each query with their best segment: maxsim columns and ``place``."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id")
    return maxsim(pairs).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def event_topk(pairs: DataFrame, k: int) -> DataFrame:
    """The k best segments of each query; ties at the cut by row number."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seg_row")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def score_stats(queries: DataFrame, segments: DataFrame, **options: object) -> DataFrame:
    """One row (n, mean, std, least, most) of all scores; the variance counts as 1e-12 at least."""
    if K.fits(queries, options.get("sources")):
        m = K.merged_moments(K.moments(queries, segments, **options))
    else:
        s = F.col("score")
        m = K.pair_terms(queries, segments, **options).agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.var_pop(s).alias("var"), F.min(s).alias("least"), F.max(s).alias("most"))
    return m.select("n", "mean", F.sqrt(F.greatest("var", F.lit(1e-12))).alias("std"), "least", "most")


def cos_stats(pairs: DataFrame, *by: str) -> DataFrame:
    """n, mean and population deviation (variance at least 1e-12) of scores."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.sqrt(F.greatest(F.var_pop("score"), F.lit(1e-12))).alias("std"))


def spread(df: DataFrame, value: Column | str) -> DataFrame:
    v = X.col(value)
    return df.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))


def zscored(parts: list[tuple[str, float, float, float]]) -> dict[str, float]:
    """The variant weight * (score - mean) / std, summed over (vector column, weight, mean, std); sources of weight 0 are left out."""
    used = [(name, weight / std, mean) for name, weight, mean, std in parts if weight != 0]
    if not used:
        raise ValueError("all weights are 0")
    return {name: w for name, w, _ in used} | {"": -sum(w * mean for _, w, mean in used)}


def score_union(main: DataFrame, window: DataFrame, gamma: float) -> DataFrame:
    """max(main, window + gamma) for each (query, item); a tie is the main source's; ``from_main`` tells which."""
    w = window.select("query_id", "video_id", (F.col("score") + gamma).alias("other"))
    both = main.select("query_id", "video_id", F.col("score").alias("own")).join(w, ["query_id", "video_id"], "full")
    from_main = F.col("own").isNotNull() & (F.col("other").isNull() | (F.col("own") >= F.col("other")))
    return both.select("query_id", "video_id", F.when(from_main, F.col("own")).otherwise(F.col("other")).alias("score"), from_main.alias("from_main"))


def with_global(segments: DataFrame) -> DataFrame:
    """Segments and each item's pooled vector as a further segment with row number -1 - item's place by id."""
    pooled = mean_pooled(segments)
    more = numbered(pooled, "video_id").select((-1 - F.col("place")).alias("seg_row"), "video_id", "ts", "te", "emb")
    base = segments.select("seg_row", "video_id", "ts", "te", F.transform("emb", lambda x: x.cast("double")).alias("emb"))
    return base.unionByName(more.select(*base.columns))
