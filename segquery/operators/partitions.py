"""Generators: named ways of cutting each item ``(video_id, dur)`` into segments ``(video_id, k, ts, te, dur)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segquery.functions import exprs as X

from .intervals import clamp, split_evenly


def whole(videos: DataFrame) -> DataFrame:
    return videos.select("video_id", F.lit(0).alias("k"), F.lit(0.0).alias("ts"), F.col("dur").cast("double").alias("te"), "dur")


def given(events: DataFrame, videos: DataFrame, tail: float = 1.0) -> DataFrame:
    """Events of the gallery's items, clamped and numbered by time."""
    own = clamp(events.drop("dur").join(videos, "video_id"), tail)
    return own.withColumn("k", F.row_number().over(Window.partitionBy("video_id").orderBy("ts", "te")) - 1)


def uniform(videos: DataFrame, m: Column | int) -> DataFrame:
    """m equal segments; items with m < 1 (or null) give none."""
    m = F.lit(m) if isinstance(m, int) else m
    some = videos.withColumn("_n", m).where(F.col("_n") >= 1).withColumn("ts", F.lit(0.0)).withColumn("te", F.col("dur").cast("double"))
    return split_evenly(some, F.col("_n")).select("video_id", "k", "ts", "te", "dur")


def uniform_like(videos: DataFrame, segs: DataFrame) -> DataFrame:
    """As many equal segments as the item has in ``segs``."""
    return uniform(videos.join(segs.groupBy("video_id").agg(F.count("*").alias("_k")), "video_id"), F.col("_k"))


def chunks(videos: DataFrame, length: float = 14.0, least: float = 2.0) -> DataFrame:
    """Chunks of ``length``; a last one of at most ``least`` joins the one before."""
    n = F.greatest(F.lit(1), F.ceil(F.col("dur") / length).cast("int"))
    some = videos.withColumn("_n", n)
    tail = F.col("dur") - (F.col("_n") - 1) * F.lit(length)
    some = some.withColumn("_m", F.when((F.col("_n") > 1) & (tail <= least), F.col("_n") - 1).otherwise(F.col("_n")))
    some = some.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    te = F.when(F.col("k") == F.col("_m") - 1, F.col("dur").cast("double")).otherwise((F.col("k") + 1) * F.lit(length))
    return some.select("video_id", "k", (F.col("k") * F.lit(length)).alias("ts"), te.alias("te"), "dur")


def random_contiguous(videos: DataFrame, m: Column, least: float, seed: object = 0) -> DataFrame:
    """m contiguous segments of random length, at least ``least``: shares are Dirichlet(1) from hashed exponentials.

    Items too short for that are cut evenly.
    """
    some = videos.withColumn("_m", m).where(F.col("_m") >= 1)
    some = some.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("_m") - 1).cast("int"))))
    some = some.withColumn("_w", X.hash_exponential(seed, "video_id", F.col("k")))
    own = Window.partitionBy("video_id")
    free = F.col("dur") - F.col("_m") * F.lit(least)
    length = F.when(free < 0, F.col("dur") / F.col("_m")).otherwise(least + free * F.col("_w") / F.sum("_w").over(own))
    some = some.withColumn("_l", length)
    te = F.sum("_l").over(own.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    some = some.withColumn("te", te)
    return some.select("video_id", "k", (F.col("te") - F.col("_l")).alias("ts"), "te", "dur")


def shifted(segs: DataFrame, seed: object = 0, tail: float = 1.0) -> DataFrame:
    """Equal lengths, random starts in [0, min(dur - length, dur - tail)]."""
    length = F.col("te") - F.col("ts")
    start = X.hash_uniform(seed, F.concat_ws("#", "video_id", "k")) * F.greatest(F.lit(0), F.least(F.col("dur") - length, F.col("dur") - tail))
    return segs.select("video_id", "k", start.alias("ts"), (start + length).alias("te"), "dur")


def union_of(parts: list[DataFrame], per_unit: float = 100.0) -> DataFrame:
    """Segments of several partitions; equal to 0.01 units, the first partition's stays: (video_id, src, ts, te, dur)."""
    tagged = [p.select("video_id", F.lit(i).alias("src"), F.col("ts").cast("double").alias("ts"), F.col("te").cast("double").alias("te"), "dur") for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, tagged)
    w = Window.partitionBy("video_id", F.floor(F.col("ts") * per_unit + 0.5), F.floor(F.col("te") * per_unit + 0.5)).orderBy("src", "ts", "te")
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dense(videos: DataFrame, length: float) -> DataFrame:
    """Windows of ``length`` every half of it while their middle lies inside, clipped; short items have one."""
    n = F.greatest(F.lit(1), F.ceil((F.col("dur") - F.lit(length / 2)) / F.lit(length / 2)).cast("int"))
    some = videos.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    ts = F.col("k") * F.lit(length / 2)
    return some.select("video_id", "k", ts.alias("ts"), F.least(ts + length, F.col("dur").cast("double")).alias("te"), "dur")


def multi_level(videos: DataFrame, lengths: tuple[float, ...]) -> DataFrame:
    """Dense windows of several lengths, with ``level``."""
    return reduce(DataFrame.unionByName, [dense(videos, w).withColumn("level", F.lit(float(w))) for w in lengths])


def perturbed(segs: DataFrame, sigma: float | Column, least: float, seed: object = 0, digits: int = 2, key: Column | None = None) -> DataFrame:
    """Boundary noise: middle + sigma * length * u, length * exp(sigma * v), clipped; u, v are hashed normals of the segment.

    What becomes shorter than ``least`` is a window of ``least`` around the clipped middle. Rounded, the end stays
    within the duration.
    """
    key = F.concat_ws("#", "video_id", "k") if key is None else key
    length, mid = F.col("te") - F.col("ts"), (F.col("ts") + F.col("te")) / 2
    sigma = F.lit(sigma) if isinstance(sigma, (int, float)) else sigma
    c = mid + sigma * length * X.hash_normal(seed, key, 0)
    half = length * F.exp(sigma * X.hash_normal(seed, key, 1)) / 2
    lo, hi = F.greatest(F.lit(0.0), c - half), F.least(F.col("dur").cast("double"), c + half)
    at = F.greatest(F.lit(0.0), F.least(c, F.col("dur").cast("double")))
    start = F.greatest(F.lit(0.0), F.least(at - least / 2, F.col("dur") - least))
    small = hi - lo < least
    ts, te = F.when(small, start).otherwise(lo), F.when(small, F.least(start + least, F.col("dur").cast("double"))).otherwise(hi)
    ts, te = X.round_capped(ts, te, "dur", digits)
    return segs.select("video_id", "k", ts.alias("ts"), te.alias("te"), "dur")


def calibrated_sigma(segs: DataFrame, target: float, least: float, seed: object = 0, top: float = 4.0, tol: float = 0.005, rounds: int = 40, depth: int = 5) -> float:
    """Noise level at which the mean tIoU of segments and their noisy selves is ``target``, by bisection.

    The next ``depth`` halvings can only ask for 2^depth - 1 levels between the bounds; all of them are measured in one pass
    over the segments, so the number of jobs is that of the rounds over ``depth``.
    """
    spark = segs.sparkSession
    keyed = segs.withColumn("_base", F.struct("k", "ts", "te"))

    def means(levels: list[float]) -> dict[float, float]:
        grid = F.broadcast(spark.createDataFrame([(x,) for x in levels], "_sigma double"))  # 2^depth rows
        each = keyed.crossJoin(grid).withColumn("k", F.struct(F.col("_base.k").alias("k"), F.col("_base.ts").alias("ts"), F.col("_base.te").alias("te"), F.col("_sigma").alias("sigma")))
        noisy = perturbed(each, F.col("k.sigma"), least, seed, key=F.concat_ws("#", "video_id", "k.k"))
        got = noisy.groupBy(F.col("k.sigma").alias("sigma")).agg(F.avg(X.tiou_union("k.ts", "k.te", "ts", "te")).alias("m"))
        return {r.sigma: r.m for r in got.collect()}

    lo, hi, got = 0.0, top, 1.0
    known = means([top])
    if not known or known[top] > target:
        raise ValueError("the target needs more noise than allowed")
    for _ in range(rounds):
        mid = (lo + hi) / 2
        if mid not in known:
            known |= means([lo + (hi - lo) * j / 2**depth for j in range(1, 2**depth)])
        got = known[mid]
        if abs(got - target) <= tol:
            return mid
        lo, hi = (mid, hi) if got > target else (lo, mid)
    raise ValueError(f"mean tIoU {got} instead of {target}")


def checks(segs: DataFrame, videos: DataFrame, least: float = 0.0, contiguous: bool = False, tol: float = 0.01) -> DataFrame:
    """One row of violation counts: missing items, outside [0, dur], unsorted, too short, not contiguous."""
    w = Window.partitionBy("video_id").orderBy("k")
    own = segs.withColumn("_p", F.lag("te").over(w)).withColumn("_s", F.lag("ts").over(w))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    rows = own.agg(
        F.count("*").alias("n"), F.countDistinct("video_id").alias("items"), n((F.col("ts") < -tol) | (F.col("te") > F.col("dur") + tol)).alias("outside"), n(F.col("ts") < F.col("_s")).alias("unsorted"),
        n(F.col("te") - F.col("ts") < least - tol).alias("short"), n(F.lit(contiguous) & (F.abs(F.col("ts") - F.col("_p")) > tol)).alias("loose"),
    )
    missing = videos.select("video_id").distinct().join(segs.select("video_id").distinct(), "video_id", "left_anti").agg(F.count("*").alias("missing"))
    return rows.crossJoin(missing)


def same_lengths(a: DataFrame, b: DataFrame, tol: float = 0.01) -> DataFrame:
    """(video_id, n, same): whether an item has the same number of segments with the same sorted lengths."""
    def ordered(x: DataFrame, name: str) -> DataFrame:
        length = F.col("te") - F.col("ts")
        return x.select("video_id", length.alias(name), F.row_number().over(Window.partitionBy("video_id").orderBy(length)).alias("_r"))

    both = ordered(a, "la").join(ordered(b, "lb"), ["video_id", "_r"], "full")
    return both.groupBy("video_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.abs(F.col("la") - F.col("lb")) <= tol, F.lit(False))).alias("same"))


def shape(segs: DataFrame, *by: str) -> DataFrame:
    """Counts and lengths of a partition: n, items, mean, median and outer deciles."""
    length = (F.col("te") - F.col("ts")).cast("double")
    q = lambda p, name: F.percentile(length, F.lit(p)).alias(name)
    return segs.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("video_id").alias("items"), F.avg(length).alias("mean_length"), q(0.5, "median_length"), q(0.1, "p10_length"), q(0.9, "p90_length"))
