"""Error analysis: groups, hubs, near-duplicates, semantic hits, samples, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segquery.functions import exprs as X

from . import score_states as K
from . import vectors as V
from .retrieval import metric_columns, pct


def group_table(rows: DataFrame, group: Column, name: str = "grp", rank: str = "rank") -> DataFrame:
    """Rank metrics by group, groups without rows absent."""
    return rows.groupBy(group.alias(name)).agg(*metric_columns(rank))


def bin_label(value: Column, edges: list[float]) -> Column:
    """Number of the half-open bin [edges[i], edges[i+1]), the last one open; null below the first."""
    out = F.when(F.lit(False), F.lit(0))
    for i, lo in reversed(list(enumerate(edges))):
        out = F.when(value >= lo, i) if i == len(edges) - 1 else out.when(value >= lo, i)
    return out.cast("long")


def hub_counts(top: DataFrame, segments: DataFrame, k: int) -> DataFrame:
    """(seg_row, top1, topk): how often a segment is first and among the first k of ``event_topk``; never retrieved: 0."""
    per = top.groupBy("seg_row").agg(F.sum(F.when(F.col("place") == 1, 1).otherwise(0)).cast("long").alias("top1"), F.sum(F.when(F.col("place") <= k, 1).otherwise(0)).cast("long").alias("topk"))
    return segments.select("seg_row").join(per, "seg_row", "left").na.fill(0, ["top1", "topk"])


def hub_shares(hubs: DataFrame, group: str) -> DataFrame:
    """(group, events, share of events, share of top-k slots, share never retrieved) in percent."""
    every = Window.partitionBy()
    per = hubs.groupBy(group).agg(F.count("*").alias("events"), F.sum("topk").alias("slots"), pct(F.col("topk") == 0).alias("never"))
    return per.select(group, "events", (100 * F.col("events") / F.sum("events").over(every)).alias("event_share"), (100 * F.col("slots") / F.nullif(F.sum("slots").over(every), F.lit(0))).alias("slot_share"), "never")


def near_duplicates(queries: DataFrame, segments: DataFrame, tau: float) -> DataFrame:
    """(query_id, n_dup, n_dup_other): segments of cosine >= tau, and those of other items; a segment that is the query itself counts not.

    ``queries``: (query_id, q_emb, query_video). Hits are counted by item where the scores are made.
    """
    video = queries.select("query_id", "query_video")
    hits = V.counts(queries, segments, tau).join(video, "query_id").select("query_id", "n", (F.col("video_id") != F.col("query_video")).alias("other"))
    own = queries.join(segments.select(F.col("seg_row").alias("query_id"), "video_id", "emb"), "query_id").where(X.dot("q_emb", "emb") >= tau)
    every = hits.unionByName(own.select("query_id", F.lit(-1).cast("long").alias("n"), (F.col("video_id") != F.col("query_video")).alias("other")))
    return every.groupBy("query_id").agg(F.sum("n").alias("n_dup"), F.sum(F.when(F.col("other"), F.col("n")).otherwise(0)).alias("n_dup_other"))


def semantic_hits(top: DataFrame, tau: float, k: int) -> DataFrame:
    """(query_id, exact1, exactk, sem1, semk): whether hits have the query's label, or judged meaning >= tau.

    ``top``: (query_id, place, exact boolean, meaning double).
    """
    sem = F.col("exact") | (F.col("meaning") >= tau)
    first, any_ = F.col("place") == 1, F.col("place") <= k
    return top.groupBy("query_id").agg(F.bool_or(first & F.col("exact")).alias("exact1"), F.bool_or(any_ & F.col("exact")).alias("exactk"), F.bool_or(first & sem).alias("sem1"), F.bool_or(any_ & sem).alias("semk"))


def error_types(rows: DataFrame) -> DataFrame:
    """(kind, n, share) of rows with booleans exact1, same_video, sem1: right, same video, same meaning, other."""
    kind = F.when(F.col("exact1"), "right").when(F.col("same_video"), "same video").when(F.col("sem1"), "same meaning").otherwise("other")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).select("kind", "n", (100 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def flip_profile(rows: DataFrame, flags: list[str], values: list[str]) -> DataFrame:
    """(grp, n, and median, mean of each value) for each of several, possibly overlapping, boolean groups."""
    tagged = rows.select(*values, F.explode(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags])).alias("grp")).where(F.col("grp").isNotNull())
    aggs = [F.count("*").alias("n")]
    for v in values:
        aggs += [F.percentile(F.col(v).cast("double"), F.lit(0.5)).alias(f"{v}_median"), F.avg(v).alias(f"{v}_mean")]
    return tagged.groupBy("grp").agg(*aggs)


#: One in so many rows gives the bound of a sample; groups whose bounds go with all tasks at most.
BOUND_SHARE, BOUND_GROUPS = 64, 10_000


def sample(rows: DataFrame, key: str, n: int, seed: object = 0, *by: str) -> DataFrame:
    """n rows (a group) without replacement, by hash order.

    The n-th place among a share of a group's rows is no lower than the n-th of all, so only rows up to it are ordered: about
    n times ``BOUND_SHARE`` of a group. A group that has no n rows in the share is ordered whole.
    """
    u = X.hash_uniform(seed, key)
    if not by:
        return rows.orderBy(u, key).limit(n)
    first = lambda d: _first(d, key, n, *by)
    share = rows.where(F.pmod(F.xxhash64(key), F.lit(BOUND_SHARE)) == 0).withColumn("_u", u)
    bounds = first(share).where(F.col("_r") == n).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_u").alias("_most")).limit(BOUND_GROUPS)  # the others are ordered whole
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    near = rows.withColumn("_u", u).join(F.broadcast(bounds), same, "left").where(F.col("_most").isNull() | (F.col("_u") <= F.col("_most")))
    return first(near).select(*rows.columns)


def _first(rows: DataFrame, key: str, n: int, *by: str) -> DataFrame:
    """The n first rows of each group by (_u, key), with their place ``_r``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_u", key))).where(F.col("_r") <= n)


def pair_sample(queries: DataFrame, segments: DataFrame, edges: list[float], n: int, seed: object = 0) -> DataFrame:
    """(query_id, seg_row, bin): n pairs of each bin of scores without replacement, by the hash order of ``query_id_seg_row``.

    Pairs with whole numbers as ids are hashed where they are scored, and only the first of a block leave the kernel.
    """
    whole = all(isinstance(d.schema[c].dataType, T.IntegralType) for d, c in ((queries, "query_id"), (segments, "seg_row")))
    few = whole and K.fits(queries)
    pairs = K.hash_best(queries, segments, edges, n, seed) if few else V.pair_scores(queries, segments)
    rows = pairs.withColumn("bin", bin_label(F.col("score"), edges)).where("bin is not null").withColumn("key", F.concat_ws("_", "query_id", "seg_row"))
    got = _first(rows.withColumn("_u", X.hash_uniform(seed, "key")), "key", n, "bin") if few else sample(rows, "key", n, seed, "bin")
    return got.select("query_id", "seg_row", "bin")


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unique_segments(rows: DataFrame, key: str, ref: str) -> DataFrame:
    """(key, n, refs): equal keys once, with who refers to them."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(ref).cast("string"))), ",").alias("refs"))


def work_list(wanted: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Distinct wanted keys that are not done; the first ``limit`` by key."""
    todo = wanted.select(key).distinct().join(done.select(key), key, "left_anti")
    return todo.orderBy(key).limit(limit) if limit is not None else todo


def conf_alignment(cached: DataFrame, source: DataFrame, tol: float = 0.011) -> DataFrame:
    """(video_id, n_cached, n_source, bad): rows paired by place in time; ``bad`` counts pairs apart by over ``tol``, unpaired rows and conf <= 0."""
    def placed(d: DataFrame, *names: str) -> DataFrame:
        w = Window.partitionBy("video_id").orderBy("ts", "te")
        return d.select("video_id", *[F.col(a).alias(b) for a, b in zip(("ts", "te", "conf") if "conf" in d.columns else ("ts", "te"), names, strict=False)], F.row_number().over(w).alias("_r"))

    both = placed(cached.drop("conf"), "c0", "c1").join(placed(source, "s0", "s1", "conf"), ["video_id", "_r"], "full")
    bad = F.coalesce((F.abs(F.col("c0") - F.col("s0")) > tol) | (F.abs(F.col("c1") - F.col("s1")) > tol) | (F.col("conf") <= 0), F.lit(True))
    return both.groupBy("video_id").agg(F.count("c0").alias("n_cached"), F.count("s0").alias("n_source"), F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias("bad"))


def fingerprint(rows: DataFrame, line: Column) -> DataFrame:
    """One row (n, digest): SHA-256 over the hashes of all lines in sorted order, independent of how rows are spread.

    Lines are summed up in two steps, first within 256 groups of hashes, so no task holds all of
    them: the digest is of the groups' digests.
    """
    h = rows.select(F.sha2(line.cast("binary"), 256).alias("h"))
    part = h.groupBy(F.substring("h", 1, 2).alias("g")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("d"))
    return part.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), "").cast("binary"), 256).alias("digest"))


def cost_estimate(tasks: DataFrame, done: DataFrame, seconds: float) -> DataFrame:
    """(task, new_clips, seconds) of (task, seg_key): a clip costs where it is first needed, unless it is done."""
    first = tasks.groupBy("seg_key").agg(F.min("task").alias("task")).join(done.select("seg_key"), "seg_key", "left_anti")
    return first.groupBy("task").agg(F.count("*").alias("new_clips")).withColumn("seconds", F.col("new_clips") * F.lit(seconds))


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def require(found: DataFrame, expected: DataFrame, key: str, value: str, tol: float) -> DataFrame:
    """(key, expected, found, ok) for every expected key; a missing one is not ok."""
    e = expected.select(key, F.col(value).alias("expected"))
    return e.join(found.select(key, F.col(value).alias("found")), key, "left").withColumn("ok", F.coalesce(F.abs(F.col("found") - F.col("expected")) <= tol, F.lit(False)))


def jaccard_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, words: str, least: float) -> DataFrame:
    """(a_id, b_id, jaccard): all pairs of sets (arrays ``words``) with this similarity at least, which is above 0.

    Exact without all pairs: in a common order of words, rare ones first, two such sets share one
    of their first ``n - ceil(least n) + 1``. Sets are joined to the pairs that meet there.
    """
    sized = [t.select(F.col(i).alias("id"), F.col(words).alias("w"), F.size(words).alias("n")).where("n > 0") for t, i in ((a, a_id), (b, b_id))]
    # sets too small or large for all of the other side go first; one row of bounds
    reach = sized[1].agg((F.min("n") * least - 1e-9).alias("_lo"), (F.max("n") / least + 1e-9).alias("_hi"))
    sized[0] = sized[0].join(F.broadcast(reach), F.col("n").between(F.col("_lo"), F.col("_hi"))).select("id", "w", "n")
    flat = [t.select("id", "n", F.explode("w").alias("x")) for t in sized]
    # the order is by frequency on the second side: words that it lacks come first, meet nothing and need no row
    often = flat[1].groupBy("x").agg(F.count("*").alias("f"))
    first = []
    for t in flat:
        own = Window.partitionBy("id")
        place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "x"))
        first.append(t.join(often, "x").withColumn("r", place).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("id", "n", "x"))
    x, y = first[0], first[1].select(F.col("id").alias("id2"), F.col("n").alias("n2"), "x")
    fits = (F.col("n2") >= least * F.col("n") - 1e-9) & (F.col("n") >= least * F.col("n2") - 1e-9)
    met = x.join(y, "x").where(fits).select("id", "id2").distinct()
    wide = met.join(sized[0], "id").join(sized[1].select(F.col("id").alias("id2"), F.col("w").alias("w2")), "id2")
    out = wide.select(F.col("id").alias(a_id), F.col("id2").alias(b_id), X.jaccard("w", "w2").alias("jaccard"))
    return out.where(F.col("jaccard") >= least - 1e-12)
