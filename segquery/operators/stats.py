"""Bootstrap, regression, cross-validation and selection rules; all draws are hashed, so repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segquery.functions import exprs as X

from .numbering import hash_numbered, numbered, tile


def bootstrap(units: DataFrame, n_boot: int = 200, seed: object = 0, unit: str = "unit") -> DataFrame:
    """One row (diff, ci_low, ci_high, p): 100 * (sum of x - sum of y) / sum of n over resampled units.

    ``units`` is (unit, x, y, n), one row a unit: a ratio of sums, so larger units weigh more. The
    draw (b, i) takes the unit at place floor(u * units); 95 % percentile interval; p is the share
    of resamples with a difference of at most 0.
    """
    base = numbered(units, unit)
    n = base.count()
    spark = units.sparkSession
    draws = spark.range(n_boot).withColumnRenamed("id", "b").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))))
    draws = draws.withColumn("place", F.floor(X.hash_uniform(seed, F.col("b"), F.col("i")) * n))
    per = draws.join(base, "place").groupBy("b").agg((100 * (F.sum("x") - F.sum("y")).cast("double") / F.sum("n")).alias("d"))
    ci = per.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("c"), F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)).alias("p"))
    point = base.agg((100 * (F.sum("x") - F.sum("y")).cast("double") / F.sum("n")).alias("diff"))
    return point.crossJoin(ci).select("diff", F.col("c")[0].alias("ci_low"), F.col("c")[1].alias("ci_high"), "p")


def copies(seed: object, unit: str, draw: Column) -> Column:
    """A hashed Poisson(1) number: how often a unit stands in a resample."""
    u = X.hash_uniform(seed, F.col(unit), draw)
    cut, total, term = [], 0.0, 0.36787944117144233  # 1 / e
    for k in range(1, 13):
        total += term
        cut.append(total)
        term /= k
    return sum((F.when(u >= c, 1).otherwise(0) for c in cut), F.lit(0))


def poisson_bootstrap(units: DataFrame, n_boot: int = 200, seed: object = 0, unit: str = "unit") -> DataFrame:
    """``bootstrap`` with a hashed Poisson(1) number of copies of each unit in each resample.

    Resamples with replacement approach it as units grow. No unit has a place and no draw is joined to one: all
    resamples are sums of one pass over the units.
    """
    drawn = units.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("_c", copies(seed, unit, F.col("b"))).where("_c > 0")
    diff = lambda w: 100 * (F.sum(F.col("x") * w) - F.sum(F.col("y") * w)).cast("double") / F.sum(F.col("n") * w)
    per = drawn.groupBy("b").agg(diff(F.col("_c")).alias("d"))
    ci = per.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("c"), F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)).alias("p"))  # one row a resample
    return units.agg(diff(F.lit(1)).alias("diff")).crossJoin(ci).select("diff", F.col("c")[0].alias("ci_low"), F.col("c")[1].alias("ci_high"), "p")


def weighted_line(rows: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """One row (a, b, n): weighted least squares y = a + b x; the least-norm solution where all x are equal."""
    return _lines(rows, x, y, w)


def _lines(rows: DataFrame, x: str, y: str, w: str, *by: str) -> DataFrame:
    sx = lambda c: F.sum(F.col(w) * c)
    x_, y_ = F.col(x), F.col(y)
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(w).cast("double")).alias("s"), sx(x_).alias("sx"), sx(y_).alias("sy"), sx(x_ * x_).alias("sxx"), sx(x_ * y_).alias("sxy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    flat = F.abs(det) < 1e-12 * F.greatest(F.lit(1.0), F.col("s") * F.col("sxx"))
    safe = F.when(~flat, det)
    mx, my = F.col("sx") / F.col("s"), F.col("sy") / F.col("s")
    b = F.when(flat, mx * my / (1 + mx * mx)).otherwise((F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / safe)
    a = F.when(flat, my / (1 + mx * mx)).otherwise((F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / safe)
    return s.select(*by, a.alias("a"), b.alias("b"), "n")


def line_bootstrap(rows: DataFrame, x: str, y: str, w: str, unit: str, n_boot: int = 200, seed: object = 0) -> DataFrame:
    """One row (a, b, n, a_low, a_high, b_low, b_high): the weighted line with 95 % percentile intervals over resampled units.

    ``rows`` has one row a unit. A resample gives each unit a hashed Poisson(1) number of copies,
    which a resample with replacement approaches as units grow: no draw is joined to a place, and
    all resamples are sums of one pass.
    """
    drawn = rows.select(unit, x, y, w, F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("_boot")).withColumn("_c", copies(seed, unit, F.col("_boot"))).where("_c > 0").withColumn("_w", F.col(w) * F.col("_c"))
    per = _lines(drawn, x, y, "_w", "_boot")
    ends = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    ci = per.agg(ends("a").alias("a"), ends("b").alias("b")).select(F.col("a")[0].alias("a_low"), F.col("a")[1].alias("a_high"), F.col("b")[0].alias("b_low"), F.col("b")[1].alias("b_high"))
    return weighted_line(rows, x, y, w).crossJoin(ci)  # one row each


def folds(items: DataFrame, key: str, seed: object = 0, n: int = 2) -> DataFrame:
    """(key, fold): hash order cut in n parts of equal size (the first ones one larger)."""
    return hash_numbered(items.select(key).distinct(), key, seed, total="_of").select(key, tile(F.col("place"), F.col("_of"), n).alias("fold"))


def cv_pick(hits: DataFrame) -> DataFrame:
    """(fold, candidate): most hits in each fold of (candidate, fold, hit); the earlier candidate on ties."""
    per = hits.groupBy("fold", "candidate").agg(F.sum("hit").alias("hits"))
    return per.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("hits"), "candidate"))).where("r = 1").select("fold", "candidate", "hits")


def out_of_fold(hits: DataFrame) -> DataFrame:
    """(query_id, fold, candidate, hit): each query takes the candidate that the other of two folds chose."""
    pick = cv_pick(hits).select((1 - F.col("fold")).alias("fold"), "candidate")
    return hits.join(pick, ["fold", "candidate"]).select("query_id", "fold", "candidate", "hit")


def choose_closest(rows: DataFrame, value: Column, target: Column | float, *ties: Column) -> DataFrame:
    """The row whose value is nearest to the target; ties in the order given."""
    target = target if isinstance(target, Column) else F.lit(target)
    return rows.orderBy(F.round(F.abs(value - target), 9), *ties).limit(1)


def pick_best(rows: DataFrame, metric: str, *ties: Column) -> DataFrame:
    """The row of best metric (rounded to six digits); ties in the order given."""
    return rows.orderBy(F.desc(F.round(metric, 6)), *ties).limit(1)


def pick_fill(rows: DataFrame, within: float = 0.3) -> DataFrame:
    """Among rows (r1, vectors, ...) less than ``within`` below the best r1: the fewest vectors, then the best r1."""
    best = rows.agg(F.max("r1").alias("_best"))
    return rows.crossJoin(best).where(F.col("r1") > F.col("_best") - within).drop("_best").orderBy("vectors", F.desc("r1"), "name").limit(1)


def pick_level(thetas: DataFrame, topks: DataFrame, target: float, miss: float = 0.5) -> DataFrame:
    """(kind, value, mean_k): the theta whose mean k is closest to the target (larger theta on ties); a top-k only if theta misses by over ``miss`` and it is strictly closer."""
    t = choose_closest(thetas, F.col("mean_k"), target, F.desc("value")).select(F.lit("theta").alias("kind"), F.col("value").cast("double").alias("value"), "mean_k", F.lit(0).alias("o"))
    k = choose_closest(topks, F.col("mean_k"), target, F.asc("value")).select(F.lit("topk").alias("kind"), F.col("value").cast("double").alias("value"), "mean_k", F.lit(1).alias("o"))
    gap = F.abs(F.col("mean_k") - target)
    both = t.unionByName(k).withColumn("gap", F.round(gap, 9))
    theta_ok = F.max(F.when((F.col("o") == 0) & (F.col("gap") <= miss), 1).otherwise(0)).over(Window.partitionBy())
    return both.withColumn("ok", theta_ok).where((F.col("ok") == 0) | (F.col("o") == 0)).orderBy("gap", "o").limit(1).select("kind", "value", "mean_k")


def equivalent_level(curve: DataFrame, target: float) -> DataFrame:
    """One row ``level``: where the piecewise-linear curve (level, value) reaches the target; end pieces are prolonged."""
    w = Window.orderBy("level")  # a handful of points
    seg = curve.withColumn("l2", F.lead("level").over(w)).withColumn("v2", F.lead("value").over(w)).withColumn("i", F.row_number().over(w)).where(F.col("l2").isNotNull())
    last = F.max("i").over(Window.partitionBy())
    lo, hi = F.least("value", "v2"), F.greatest("value", "v2")
    inside = (F.lit(target) >= lo) & (F.lit(target) <= hi)
    slope = F.col("v2") - F.col("value")
    at = F.col("level") + (F.lit(target) - F.col("value")) * (F.col("l2") - F.col("level")) / F.when(slope != 0, slope)
    ends = seg.withColumn("last", last).withColumn("at", at).withColumn("rank", F.when(inside, 0).when((F.col("i") == 1) & (F.abs(F.lit(target) - F.col("value")) <= F.abs(F.lit(target) - F.col("v2"))), 1).when(F.col("i") == F.col("last"), 2).otherwise(3))
    return ends.orderBy("rank", "i").limit(1).select(F.col("at").alias("level"))


def significant_down_to(curve: DataFrame) -> DataFrame:
    """One row ``level``: the lowest level of the unbroken run from the top whose lower bound ``ci_low`` is above 0."""
    w = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("ok", F.min(F.when(F.col("ci_low") > 0, 1).otherwise(0)).over(w)).where("ok = 1").agg(F.min("level").alias("level"))
