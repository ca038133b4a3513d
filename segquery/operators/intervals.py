"""Interval algebra on segments ``(video_id, ts, te, dur, ...)``; times are in one unit of the caller's choice.

Joins between segments meet in time bins: a segment enters each bin it touches, the key is (item, bin), and a pair
counts in its first common bin. Pairs without overlap are never made, so callers fill in their zeros. Running maxima
over an item's sorted segments replace sweeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segquery.functions import exprs as X

EPS = 1e-9
#: Bins of an item at most.
BINS = 1 << 16


def clamp(segs: DataFrame, tail: float = 1.0) -> DataFrame:
    """Cut to [0, dur]; segments without length or that start within ``tail`` of the end go."""
    cut = segs.withColumn("ts", F.greatest(F.lit(0), "ts")).withColumn("te", F.least("te", "dur"))
    return cut.where((F.col("te") > F.col("ts")) & (F.col("ts") <= F.col("dur") - tail))


def _before(order: tuple[str, ...] = ("ts", "te")) -> Column:
    w = Window.partitionBy("video_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.max("te").over(w)


def coverage(segs: DataFrame) -> DataFrame:
    """(video_id, dur, covered, coverage): length of the union and its share of the duration."""
    new = F.greatest(F.lit(0), F.col("te") - F.greatest(F.col("ts"), F.coalesce(F.col("_b"), F.col("ts"))))
    got = segs.withColumn("_b", _before()).groupBy("video_id").agg(F.max("dur").alias("dur"), F.sum(new).alias("covered"))
    return got.withColumn("coverage", F.when(F.col("dur") > 0, F.col("covered") / F.when(F.col("dur") > 0, F.col("dur"))).otherwise(0.0))


def overlap_ratio(segs: DataFrame) -> DataFrame:
    """(video_id, overlap): 1 - union / sum of lengths."""
    total = segs.groupBy("video_id").agg(F.sum(F.col("te") - F.col("ts")).alias("total"))
    both = coverage(segs).join(total, "video_id")
    return both.select("video_id", F.when(F.col("total") > 0, 1 - F.col("covered") / F.when(F.col("total") > 0, F.col("total"))).otherwise(0.0).alias("overlap"))


def gaps(segs: DataFrame, eps: float = EPS) -> DataFrame:
    """(video_id, ts, te, dur): maximal uncovered stretches of [0, dur], head and tail included."""
    own = segs.select("video_id", "ts", "te", "dur")
    ends = own.groupBy("video_id").agg(F.max("dur").alias("dur")).select("video_id", F.col("dur").alias("ts"), F.col("dur").alias("te"), "dur")
    every = own.unionByName(ends).withColumn("_b", F.greatest(F.coalesce(_before(), F.lit(0)), F.lit(0)))
    return every.where(F.col("ts") > F.col("_b") + eps).select("video_id", F.col("_b").alias("ts"), F.least("ts", "dur").alias("te"), "dur").where(F.col("te") > F.col("ts") + eps)


def split_evenly(segs: DataFrame, parts: Column) -> DataFrame:
    """Each segment in ``parts`` equal windows; ``k`` numbers them."""
    cut = segs.withColumn("_m", parts.cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    at = lambda k: F.col("ts") + (F.col("te") - F.col("ts")) * k / F.col("_m")
    return cut.withColumn("_s", at(F.col("k"))).withColumn("_e", at(F.col("k") + 1)).drop("ts", "te", "_m").withColumnsRenamed({"_s": "ts", "_e": "te"})


def fill_gaps(segs: DataFrame, least: float, step: float) -> DataFrame:
    """Gaps of at least ``least`` cut to max(1, round half up(length / step)) equal windows: (video_id, ts, te, dur, k)."""
    long = gaps(segs).where(F.col("te") - F.col("ts") >= least)
    return split_evenly(long, F.greatest(F.lit(1), F.floor((F.col("te") - F.col("ts")) / step + 0.5)))


def islands(segs: DataFrame) -> DataFrame:
    """(video_id, island, ts, te, members): merged segments; touching ones merge."""
    starts = F.when(F.col("ts") <= F.col("_b"), 0).otherwise(1)
    w = Window.partitionBy("video_id").orderBy("ts", "te").rowsBetween(Window.unboundedPreceding, 0)
    got = segs.select("video_id", "ts", "te").withColumn("_b", _before()).withColumn("island", F.sum(starts).over(w))
    return got.groupBy("video_id", "island").agg(F.min("ts").alias("ts"), F.max("te").alias("te"), F.count("*").alias("members"))


def outside_fraction(windows: DataFrame, segs: DataFrame) -> DataFrame:
    """``windows`` with ``outside``: the share of each that no segment of its item covers; ``window_id`` names them."""
    cover = islands(segs).select("video_id", F.col("ts").alias("_s"), F.col("te").alias("_e"))
    both = overlaps(windows.select("window_id", "video_id", "ts", "te"), cover, ("ts", "te"), ("_s", "_e"))
    inside = both.groupBy("window_id").agg(F.sum(X.intersection("ts", "te", "_s", "_e")).alias("_in"))
    length = F.col("te") - F.col("ts")
    share = F.when(length > 0, 1 - F.coalesce(F.col("_in"), F.lit(0)) / F.when(length > 0, length)).otherwise(0.0)
    return windows.join(inside, "window_id", "left").withColumn("outside", share).drop("_in")


def gap_windows(windows: DataFrame, segs: DataFrame, share: float = 0.5) -> DataFrame:
    """Windows at least ``share`` outside the segments; items without segments keep all."""
    return outside_fraction(windows, segs).where(F.col("outside") >= share)


def overlaps(a: DataFrame, b: DataFrame, a_ends: tuple[str, str], b_ends: tuple[str, str]) -> DataFrame:
    """Rows of ``a`` and ``b`` of one item whose segments share more than a point, each pair once.

    A bin is as wide as the item's segments are on average, so all segments of an item together enter
    at most three bins for each of them, however their lengths differ and however many the item has.
    The two relations share no name but ``video_id``; segments without length meet nothing.
    """
    (a0, a1), (b0, b1) = a_ends, b_ends
    a, b = a.where(F.col(a1) > F.col(a0)), b.where(F.col(b1) > F.col(b0))
    ends = lambda d, s, e: d.select("video_id", F.col(s).cast("double").alias("_s"), F.col(e).cast("double").alias("_e"))
    width = F.greatest(F.avg(F.col("_e") - F.col("_s")), (F.max("_e") - F.min("_s")) / BINS)
    widths = ends(a, a0, a1).unionByName(ends(b, b0, b1)).groupBy("video_id").agg(width.alias("_w"))

    def dealt(d: DataFrame, s: str, e: str, first: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / F.col("_w"))
        return d.join(widths, "video_id").withColumn(first, at(s)).withColumn("_bin", F.explode(F.sequence(F.col(first), at(e)))).drop("_w")

    both = dealt(a, a0, a1, "_fa").join(dealt(b, b0, b1, "_fb"), ["video_id", "_bin"])
    meet = (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)) & (F.col("_bin") == F.greatest("_fa", "_fb"))
    return both.where(meet).drop("_bin", "_fa", "_fb")


def pairs(gt: DataFrame, preds: DataFrame) -> DataFrame:
    """The (gt, prediction) pairs of an item that overlap: gt_id, pred_id, both intervals and ``tiou`` on the true union."""
    a = gt.select("video_id", "gt_id", F.col("ts").alias("g0"), F.col("te").alias("g1"))
    b = preds.select("video_id", "pred_id", F.col("ts").alias("p0"), F.col("te").alias("p1"), "conf")
    return overlaps(a, b, ("g0", "g1"), ("p0", "p1")).withColumn("tiou", X.tiou_union("g0", "g1", "p0", "p1"))


def best_tiou(gt: DataFrame, preds: DataFrame) -> DataFrame:
    """(video_id, gt_id, best): best tIoU over the item's predictions, 0 without any."""
    best = pairs(gt, preds).groupBy("gt_id").agg(F.max("tiou").alias("best"))
    return gt.select("video_id", "gt_id").join(best, "gt_id", "left").select("video_id", "gt_id", F.coalesce("best", F.lit(0.0)).alias("best"))


def best_match(gt: DataFrame, preds: DataFrame) -> DataFrame:
    """(gt_id, pred_id, tiou): the prediction of best tIoU, not one to one; first by (start, id) on ties; null without predictions.

    Where none overlaps, all predictions of the item tie at 0.
    """
    best = F.min(F.struct((-F.col("tiou")).alias("t"), F.col("p0").alias("s"), F.col("pred_id").alias("id")))
    top = pairs(gt, preds).groupBy("gt_id").agg(best.alias("_b"))
    first = preds.groupBy("video_id").agg(F.min(F.struct(F.col("ts").alias("s"), F.col("pred_id").alias("id"))).alias("_f"))
    both = gt.select("gt_id", "video_id").join(top, "gt_id", "left").join(first, "video_id", "left")
    return both.select("gt_id", F.coalesce("_b.id", "_f.id").alias("pred_id"), F.coalesce(-F.col("_b.t"), F.when(F.col("_f").isNotNull(), 0.0)).alias("tiou"))


def resolve(queries: DataFrame, events: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(gt_id, pred_id, tiou, status): the best overlapping event of a query's item, and why there is none."""
    known = events.select("video_id").distinct().withColumn("_k", F.lit(True))
    best = best_match(queries, events)
    both = queries.select("gt_id", "video_id").join(known, "video_id", "left").join(best, "gt_id")
    ok = F.col("tiou") >= threshold
    status = F.when(F.col("_k").isNull(), "item not in the database").when(ok, "found").otherwise("no event overlaps enough")
    return both.select("gt_id", F.when(ok, F.col("pred_id")).alias("pred_id"), "tiou", status.alias("status"))


def extend_short(segs: DataFrame, least: float) -> DataFrame:
    """Segments shorter than ``least`` grow around their middle, shifted inwards at borders; ``extended`` marks them."""
    short = F.col("te") - F.col("ts") < least
    mid = (F.col("ts") + F.col("te")) / 2
    start = F.greatest(F.lit(0.0), F.least(mid - least / 2, F.col("dur") - least))
    whole = F.lit(least) >= F.col("dur")
    ts = F.when(~short, F.col("ts").cast("double")).when(whole, 0.0).otherwise(start)
    te = F.when(~short, F.col("te").cast("double")).when(whole, F.col("dur").cast("double")).otherwise(start + least)
    return segs.withColumn("_s", ts).withColumn("_e", te).withColumn("extended", short).drop("ts", "te").withColumnsRenamed({"_s": "ts", "_e": "te"})


def window_around(t: Column, dur: Column, half: Column) -> tuple[Column, Column]:
    """[t - half, t + half], shifted inwards; a window longer than the item is the item."""
    size = F.least(2 * half, dur)
    start = F.greatest(F.lit(0.0), F.least(t - half, dur - size))
    return start, start + size


def centred(t: Column, dur: Column, k: Column) -> tuple[Column, Column]:
    """t -+ dur / 2k, clipped; t is clamped to the item first."""
    at = F.greatest(F.lit(0.0), F.least(t, dur.cast("double")))
    return F.greatest(F.lit(0.0), at - dur / (2 * k)), F.least(dur.cast("double"), at + dur / (2 * k))


def series_windows(segs: DataFrame, series: DataFrame, delta: float) -> DataFrame:
    """Steps of an item's series in [ts - delta, te + delta] and the one nearest to the middle.

    (seg_id, step, relation): relation 0 before, 1 inside, 2 after the segment; a step's time is
    clipped to the item. The nearest step is the first of least distance.
    """
    both = segs.select("seg_id", "video_id", "ts", "te", "dur").join(series.select("video_id", "step", "t"), "video_id").withColumn("t", F.greatest(F.lit(0.0), F.least(F.col("t").cast("double"), F.col("dur").cast("double"))))
    near = F.row_number().over(Window.partitionBy("seg_id").orderBy(F.abs(F.col("t") - (F.col("ts") + F.col("te")) / 2), "step"))
    member = (F.col("t") >= F.col("ts") - delta) & (F.col("t") <= F.col("te") + delta)
    rel = F.when(F.col("t") < F.col("ts"), 0).when(F.col("t") > F.col("te"), 2).otherwise(1)
    return both.withColumn("_n", near).where(member | (F.col("_n") == 1)).select("seg_id", "step", rel.alias("relation"))


def consecutive_distance(series: DataFrame, vec: str = "emb", key: str = "video_id", order: str = "step") -> DataFrame:
    """1 - cosine of a step's vector and the one before; null at an item's first step."""
    prev = F.lag(vec).over(Window.partitionBy(key).orderBy(order))
    return series.withColumn("_p", prev).select(key, order, F.when(F.col("_p").isNotNull(), 1 - X.dot(vec, "_p") / F.greatest(X.norm(vec) * X.norm("_p"), F.lit(1e-12))).alias("distance"))
