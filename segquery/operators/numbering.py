"""Places in a global order without a task that sees all rows.

Rows are cut into ranges of the order; a row's place is its place within the range plus the sizes of the ranges
before. Ranges come from a bounded sample of the order's keys, or, where the order is a hashed uniform number, from
the number itself. Only sizes, one row a range, ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segquery.functions import exprs as X

#: Keys of the sample, about, and ranges that it is cut into.
SAMPLE, RANGES = 4096, 64


def _key(order: list[Column | str]) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])


def ranged(df: DataFrame, *order: Column | str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``_p``: the number of its range of the ascending order (null first).

    The cuts are distinct keys drawn by hash, some ``SAMPLE`` of them whatever the number of rows, and constants
    of the plan, so every evaluation cuts alike.
    """
    keyed = df.withColumn("_k", _key(list(order)))
    step = max(1, df.count() // SAMPLE)
    drawn = keyed.where(F.pmod(F.xxhash64("_k"), F.lit(step)) == 0).select("_k").distinct().orderBy("_k").collect()
    kinds = [f.dataType for f in keyed.schema["_k"].dataType.fields]
    cuts = [drawn[i * len(drawn) // ranges]["_k"] for i in range(1, ranges)] if drawn else []
    if not cuts:
        return keyed.withColumn("_p", F.lit(0)).drop("_k")
    known = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(c, kinds, strict=True))]) for c in cuts])
    return keyed.withColumn("_p", F.size(F.filter(known, lambda c: c <= F.col("_k")))).drop("_k")


def placed(part: DataFrame, *order: Column | str, name: str = "place", total: str | None = None) -> DataFrame:
    """``part`` (with ``_p``) with each row's place, from 0, and on demand the number of all rows."""
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a range
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    known = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    out = part.withColumn("_w", within).join(F.broadcast(known), "_p").withColumn(name, F.col("_before") + F.col("_w"))
    return (out.withColumn(total, F.col("_all")) if total else out).drop("_p", "_w", "_before", "_all")


def numbered(df: DataFrame, *order: Column | str, name: str = "place", total: str | None = None) -> DataFrame:
    """``df`` with the place of each row in the ascending order of unique keys."""
    return placed(ranged(df, *order), *order, name=name, total=total)


def hash_numbered(df: DataFrame, key: str, seed: object = 0, name: str = "place", total: str | None = None) -> DataFrame:
    """``df`` with the place of each row in the hash order of its key; the key itself breaks ties."""
    ranges = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = df.withColumn("_u", X.hash_uniform(seed, key)).withColumn("_p", F.floor(F.col("_u") * ranges).cast("int"))
    return placed(part, "_u", key, name=name, total=total).drop("_u")


def tile(place: Column, total: Column, n: int) -> Column:
    """Which of ``n`` parts of equal size, the first ones one larger, a place lies in."""
    size, more = F.floor(total / n), total % n
    large = more * (size + 1)
    return F.when(place < large, F.floor(place / (size + 1))).otherwise(more + F.floor((place - large) / F.greatest(size, F.lit(1)))).cast("long")
