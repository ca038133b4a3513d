"""Connected components of an undirected edge table by repeated contraction.

Every round each vertex points to the neighbour (or itself) of least pseudo-random priority and
edges move to the vertices pointed at; loops and repeats go. A round shrinks the graph by a
constant factor in expectation, whatever its diameter. The maps of all rounds are written tables
and are composed backwards, so no key meets more rows than a vertex had neighbours. Tables of few rows
are written in few files, as each file costs an executor two child processes where Hadoop has no
native library (``chmod`` of it and of its checksum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, stored

#: Rows of a written file, where tables are small.
FILE_ROWS = 1 << 16
#: A table is small if the session's shuffle would write this many times the files that it needs.
TOO_MANY = 64


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, stored in as many files as it needs if that is far fewer than a shuffle has partitions."""
    files = -(-rows // FILE_ROWS)
    return stored(df.repartition(files) if n_partitions(df.sparkSession) >= TOO_MANY * files else df)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each vertex with an edge to another; vertices of one component share the root.

    Nulls and loops are no edges; repeated edges count once; no edges give an empty table.
    """
    lo, hi = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    cur = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo, hi).distinct())
    maps: list[DataFrame] = []
    sizes: list[int] = []
    while rows := cur.count():
        k = len(maps)
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(cur.select(F.col("b"), F.col("a")))
        rank = lambda c, k=k: F.xxhash64(c, F.lit(k))
        near = both.groupBy("u").agg(F.min(rank("v")).alias("h"), F.min_by("v", rank("v")).alias("v"))
        m = _packed(near.select("u", F.when(rank("u") < F.col("h"), F.col("u")).otherwise(F.col("v")).alias("p")), 2 * rows)
        maps.append(m)
        sizes.append(2 * rows)
        moved = cur.join(m.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(m.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        cur = _packed(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), rows)
    if not maps:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for m, rows in zip(reversed(maps[:-1]), reversed(sizes[:-1]), strict=True):
        up = out.select(F.col("node").alias("p"), "root")
        out = _packed(m.join(up, "p", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root")), rows)
    return out
