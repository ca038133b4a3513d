"""Localisation reports: event and segment flags, blocks of metrics by method and split, detector statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from segquery.functions import exprs as X

from .intervals import best_match, best_tiou, overlaps, pairs
from .localize import ap_by, assigned, average_precision, competing, hungarian, prf_at, served
from .partitions import uniform

#: Share of a segment that has to lie in another for it to be covered.
COVER = 0.5
THRESHOLDS = (0.3, 0.5, 0.7)


def _name(kind: str, threshold: float) -> str:
    return f"{kind}_{round(100 * threshold)}"


def _covers(gt: DataFrame, preds: DataFrame, cover: float) -> DataFrame:
    """Pairs with ``holds`` (the prediction covers the event) and ``inside`` (the prediction lies in the event)."""
    inter = X.intersection("g0", "g1", "p0", "p1")
    share = lambda a, b: (inter > 0) & (inter >= cover * (F.col(b) - F.col(a)))
    return pairs(gt, preds).withColumn("holds", share("g0", "g1")).withColumn("inside", share("p0", "p1"))


def event_rows(gt: DataFrame, preds: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, boundary: float = 0.3, cover: float = COVER) -> DataFrame:
    """One row an event: best segment and tIoU, missed, parts inside it, fragmented, whether its best segment covers
    other events too, its one-to-one match by threshold, and the offsets of start and end to the match at ``boundary``."""
    both = _covers(gt, preds, cover)
    parts = both.where("inside").groupBy("gt_id").agg(F.count("*").alias("n_parts"))
    many = both.where("holds").groupBy("pred_id").agg(F.count("*").alias("_n")).where("_n >= 2").select(F.col("pred_id").alias("best_seg"), F.lit(True).alias("_many"))
    out = gt.select("video_id", "gt_id", "ts", "te").join(best_match(gt, preds).select("gt_id", F.col("pred_id").alias("best_seg"), F.col("tiou").alias("best_tiou")), "gt_id", "left").join(parts, "gt_id", "left").join(many, "best_seg", "left")
    n = F.coalesce("n_parts", F.lit(0))
    out = out.select("video_id", "gt_id", "ts", "te", F.coalesce("best_tiou", F.lit(0.0)).alias("best_tiou"), "best_seg", (F.coalesce("best_tiou", F.lit(0.0)) <= 0).alias("missed"), n.alias("n_parts"), (n >= 2).alias("fragmented"), F.coalesce("_many", F.lit(False)).alias("in_merged_seg"))
    # one matching for all thresholds and the boundary's
    at, k = (*thresholds, boundary), F.substring_index("video_id", "#", 1).cast("int")
    found = assigned(_at_thresholds(both, at)).select(k.alias("_k"), "gt_id", F.struct("pred_id", "tiou").alias("_m"))
    wide = found.groupBy("gt_id").agg(*[F.max(F.when(F.col("_k") == i, F.col("_m"))).alias(f"_m{i}") for i in range(len(at))])
    ends = preds.select(F.col("pred_id").alias("_p"), F.col("ts").alias("_s"), F.col("te").alias("_e"))
    last = F.col(f"_m{len(thresholds)}.pred_id")
    out = out.join(wide, "gt_id", "left").withColumn("_p", last).join(ends, "_p", "left")
    for i, t in enumerate(thresholds):
        out = out.withColumn(_name("match", t), F.col(f"_m{i}.pred_id")).withColumn(_name("tiou", t), F.coalesce(F.col(f"_m{i}.tiou"), F.lit(0.0)))
    return out.withColumn("left_offset", F.col("_s") - F.col("ts")).withColumn("right_offset", F.col("_e") - F.col("te")).drop("_p", "_s", "_e", *[f"_m{i}" for i in range(len(at))])


def segment_rows(gt: DataFrame, preds: DataFrame, threshold: float = 0.5, cover: float = COVER) -> DataFrame:
    """One row a prediction of an item with events: best tIoU, false (no overlap), unmatched one to one, events covered, merge (2 or more)."""
    known = preds.join(gt.select("video_id").distinct(), "video_id", "left_semi").select("video_id", "pred_id", "ts", "te", "conf")
    per = _covers(gt, known, cover).groupBy("pred_id").agg(F.max("tiou").alias("max_tiou"), F.sum(F.col("holds").cast("long")).alias("n_gt_covered"))
    matched = hungarian(gt, known, threshold).select("pred_id", F.lit(False).alias("_free"))
    out = known.join(per, "pred_id", "left").join(matched, "pred_id", "left")
    best, n = F.coalesce("max_tiou", F.lit(0.0)), F.coalesce("n_gt_covered", F.lit(0))
    return out.select("video_id", "pred_id", "ts", "te", "conf", best.alias("max_tiou"), (best <= 0).alias("fp_no_overlap"), F.coalesce("_free", F.lit(True)).alias("unmatched"), n.cast("long").alias("n_gt_covered"), (n >= 2).alias("merge"))


def error_summary(events: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: shares of missed, fragmented and merged events, of false, unmatched and merging segments, in percent."""
    pct = lambda c: F.coalesce(100 * F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"pct_{c}")
    a = events.agg(F.count("*").alias("n_gt"), *map(pct, ("missed", "fragmented", "in_merged_seg")))
    return a.crossJoin(segments.agg(F.count("*").alias("n_seg"), *map(pct, ("fp_no_overlap", "unmatched", "merge"))))  # one row each


def loc_block(gt: DataFrame, preds: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """One row: segments an item with events, mean best tIoU, and by threshold covered events, precision, recall, F1."""
    items = gt.select("video_id").distinct()
    known = preds.join(items, "video_id", "left_semi")
    size = items.agg(F.count("*").alias("_v")).crossJoin(known.agg(F.count("*").alias("_p")))
    best = best_tiou(gt, known)
    cover = [F.coalesce(F.avg(F.when(F.col("best") >= t, 1.0).otherwise(0.0)), F.lit(0.0)).alias(_name("cover", t)) for t in thresholds]
    out = size.select(F.when(F.col("_v") > 0, F.col("_p") / F.when(F.col("_v") > 0, F.col("_v"))).otherwise(0.0).alias("seg_per_video"))
    out = out.crossJoin(best.agg(F.coalesce(F.avg("best"), F.lit(0.0)).alias("mean_tiou"), *cover))
    for t in thresholds:
        p = prf_at(gt, known, t)
        out = out.crossJoin(p.select(F.col("precision").alias(_name("p", t)), F.col("recall").alias(_name("r", t)), F.col("f1").alias(_name("f1", t))))
    return out  # one row each


def _of_methods(gt: DataFrame, methods: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Events and predictions of several methods as items ``method#item``, predictions of items without events left out."""
    if any("#" in m for m in methods):
        raise ValueError("a method's name holds no #")
    key = lambda m: F.concat_ws("#", m, F.col("video_id").cast("string"))
    names = F.broadcast(gt.sparkSession.createDataFrame([(m,) for m in methods], "method string"))  # as many rows as methods
    events = gt.crossJoin(names).select(key("method").alias("video_id"), "gt_id", "ts", "te")
    every = reduce(DataFrame.unionByName, [p.select(key(F.lit(m)).alias("video_id"), "pred_id", "ts", "te", "conf") for m, p in methods.items()])
    return events, every.join(events.select("video_id").distinct(), "video_id", "left_semi")


def tagged(methods: dict[str, DataFrame]) -> DataFrame:
    """The predictions of all methods, ``method`` being a method's place: (video_id, method, pred_id, ts, te, conf)."""
    return reduce(DataFrame.unionByName, [p.select("video_id", F.lit(k).alias("method"), "pred_id", "ts", "te", "conf") for k, p in enumerate(methods.values())])


def tagged_pairs(gt: DataFrame, preds: DataFrame, *more: str) -> DataFrame:
    """(video_id, method, gt_id, g0, g1, p0, p1, tiou, more): ``pairs`` with the predictions of several methods at once. An event enters its bins once, not once for each method."""
    a = gt.select("video_id", "gt_id", F.col("ts").alias("g0"), F.col("te").alias("g1"))
    b = preds.select("video_id", "method", F.col("ts").alias("p0"), F.col("te").alias("p1"), *more)
    return overlaps(a, b, ("g0", "g1"), ("p0", "p1")).withColumn("tiou", X.tiou_union("g0", "g1", "p0", "p1"))


def _named(df: DataFrame, kind: str) -> DataFrame:
    """``method#item`` taken apart again."""
    rest = F.expr("substring(video_id, instr(video_id, '#') + 1)").cast(kind)
    return df.withColumn("method", F.substring_index("video_id", "#", 1)).withColumn("video_id", rest)


def _at_thresholds(close: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Rivals at several thresholds at once, as items ``place of the threshold#...``: one matching serves all."""
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t")) for k, t in enumerate(thresholds)]), lambda x: F.col("tiou") >= x["t"]))
    tagged = close.withColumn("_x", each).withColumn("video_id", F.concat_ws("#", F.col("_x.k").cast("string"), "video_id")).drop("_x")
    return competing(tagged, min(thresholds))


def item_rows(gt: DataFrame, methods: dict[str, DataFrame], thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """One row a method and item with events: n_gt, n_pred, best (sum of the events' best tIoU), and by threshold the events covered and matched.

    Overlaps are found once for all methods, and one matching serves all methods and thresholds.
    """
    events, preds = _of_methods(gt, methods)
    close = pairs(events, preds)
    best = events.select("video_id", "gt_id").join(close.groupBy("video_id", "gt_id").agg(F.max("tiou").alias("best")), ["video_id", "gt_id"], "left").na.fill(0.0, ["best"])
    per = best.groupBy("video_id").agg(F.count("*").alias("n_gt"), F.sum("best").alias("best"), *[F.sum((F.col("best") >= t).cast("long")).alias(_name("covered", t)) for t in thresholds])
    found = assigned(_at_thresholds(close, thresholds)).select(F.substring_index("video_id", "#", 1).cast("int").alias("k"), F.expr("substring(video_id, instr(video_id, '#') + 1)").alias("video_id"))
    matched = found.groupBy("video_id").agg(*[F.sum((F.col("k") == k).cast("long")).alias(_name("matched", t)) for k, t in enumerate(thresholds)])
    size = preds.groupBy("video_id").agg(F.count("*").alias("n_pred"))
    rows = per.join(size, "video_id", "left").join(matched, "video_id", "left").na.fill(0, ["n_pred", *[_name("matched", t) for t in thresholds]])
    kind = gt.schema["video_id"].dataType.simpleString()
    return _named(rows, kind).select("method", "video_id", "n_gt", "n_pred", "best", *[_name(c, t) for t in thresholds for c in ("covered", "matched")])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)


def by_item(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """The per-item report of ``item_rows``: mean best tIoU, and precision, recall and F1 by threshold."""
    m = lambda t: F.col(_name("matched", t)).cast("double")
    n = F.col("n_gt") + F.col("n_pred")
    return rows.select("method", "video_id", "n_gt", "n_pred", _ratio(F.col("best"), F.col("n_gt")).alias("mean_tiou"), *[c for t in thresholds for c in (_ratio(m(t), F.col("n_pred")).alias(_name("p", t)), _ratio(m(t), F.col("n_gt")).alias(_name("r", t)), _ratio(2 * m(t), n).alias(_name("f1", t)))])


def compared(gt: DataFrame, methods: dict[str, DataFrame], splits: dict[str, DataFrame], thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(split, method, ...): ``loc_block`` of each method on the items (video_id) of each split, which may share items.

    Items are matched once and summed up in each of their splits.
    """
    tags = reduce(DataFrame.unionByName, [items.select("video_id", F.lit(split).alias("split")) for split, items in splits.items()])
    tagged = item_rows(gt, methods, thresholds).join(tags.distinct(), "video_id")
    return _block(tagged.groupBy("split", "method"), thresholds, F.col("split")).drop("items", "n_gt", "n_pred")


def split_blocks(gt: DataFrame, methods: dict[str, DataFrame], splits: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, whole: str = "all") -> DataFrame:
    """(split, method, items, n_gt, n_pred, seg_per_video, mean_tiou, cover, p, r, f1 by threshold): each split of (video_id, split), disjoint, and all of them."""
    return rolled(item_rows(gt, methods, thresholds), splits, thresholds, whole)


def rolled(rows: DataFrame, splits: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, whole: str = "all") -> DataFrame:
    """``item_rows`` summed up by split and over all splits, as grouping sets of one pass."""
    tagged, split, method = rows.join(splits.select("video_id", "split").distinct(), "video_id"), F.col("split"), F.col("method")
    return _block(tagged.groupingSets([[split, method], [method]], split, method), thresholds, F.when(F.grouping("split") == 1, whole).otherwise(split))


def _block(grouped: GroupedData, thresholds: tuple[float, ...], split: Column) -> DataFrame:
    """Sums of ``item_rows`` as ratios."""
    sums = grouped.agg(split.alias("_split"), F.count("*").alias("items"), *[F.sum(c).alias(c) for c in ("n_gt", "n_pred", "best", *(_name(x, t) for t in thresholds for x in ("covered", "matched")))])
    n_gt, n_pred = F.col("n_gt"), F.col("n_pred")
    m = lambda t: F.col(_name("matched", t)).cast("double")
    out = [F.col("_split").alias("split"), "method", "items", "n_gt", "n_pred", _ratio(n_pred, F.col("items")).alias("seg_per_video"), _ratio(F.col("best"), n_gt).alias("mean_tiou")]
    for t in thresholds:
        out += [_ratio(F.col(_name("covered", t)), n_gt).alias(_name("cover", t)), _ratio(m(t), n_pred).alias(_name("p", t)), _ratio(m(t), n_gt).alias(_name("r", t)), _ratio(2 * m(t), n_gt + n_pred).alias(_name("f1", t))]
    return sums.select(*out)


def average_precisions(gt: DataFrame, methods: dict[str, DataFrame], splits: DataFrame, thresholds: tuple[float, ...], whole: str = "all") -> DataFrame:
    """(split, method, threshold, ap) for each split of (video_id, split), disjoint, and all: one matching for all methods and thresholds."""
    events, preds = _of_methods(gt.join(splits.select("video_id").distinct(), "video_id", "left_semi"), methods)
    kind, key = gt.schema["video_id"].dataType.simpleString(), ["video_id", "pred_id", "k"]
    hits = served(_at_thresholds(pairs(events, preds), thresholds)).select(F.expr("substring(video_id, instr(video_id, '#') + 1)").alias("video_id"), "pred_id", F.substring_index("video_id", "#", 1).cast("int").alias("k"), F.lit(1).cast("long").alias("tp"))
    every = preds.select("video_id", "pred_id", "conf", F.explode(F.array(*map(F.lit, range(len(thresholds))))).alias("k")).join(hits, key, "left").na.fill(0, ["tp"])
    twice = lambda d: d.join(splits.select("video_id", "split").distinct(), "video_id").withColumn("split", F.explode(F.array("split", F.lit(whole))))
    n = twice(gt).groupBy("split").agg(F.count("*").alias("n_gt"))
    groups = gt.sparkSession.createDataFrame([(m, k) for m in methods for k in range(len(thresholds))], "method string, k int")
    ap = ap_by(twice(_named(every, kind)).select("split", "method", "k", "pred_id", "conf", "tp"), n.crossJoin(F.broadcast(groups)), "split", "method", "k")
    at = F.element_at(F.array(*map(F.lit, thresholds)), F.col("k") + 1)
    return ap.select("split", "method", at.alias("threshold"), "ap")


def top_proposals(raw: DataFrame, gt: DataFrame, final: DataFrame, ns: tuple[int | str, ...] = (1, 5, 10, "pred", "gt")) -> dict[str, DataFrame]:
    """Methods ``top<n>``: an item's n most confident proposals; ``pred`` and ``gt``: as many as the item has final segments or events."""
    ranked = raw.withColumn("_r", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("conf"), "pred_id")))
    out = {}
    for n in ns:
        if isinstance(n, str):
            size = {"pred": final, "gt": gt}[n].groupBy("video_id").agg(F.count("*").alias("_n"))
            out[f"top_{n}"] = ranked.join(size, "video_id").where(F.col("_r") <= F.col("_n")).drop("_r", "_n")
        else:
            out[f"top_{n}"] = ranked.where(F.col("_r") <= n).drop("_r")
    return out


def split_evaluation(gt: DataFrame, raw: DataFrame, final: DataFrame, other: dict[str, DataFrame], durations: DataFrame, splits: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, map_thresholds: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9)) -> dict[str, DataFrame]:
    """All reports of an evaluation by split, and over all splits (``all``).

    blocks: final, other methods and uniform segments of the same number an item; recall: coverage by the N most confident raw
    proposals; ap, map: average precision of raw, final and others, and its mean over thresholds; items: a row a method and item;
    events, segments: flags of final segments; errors, boundary: shares of errors, offsets of the matched, by split.
    items, events and segments are marked to be kept, as several reports read them.
    """
    own = gt.join(splits.select("video_id").distinct(), "video_id", "left_semi")
    sized = {n: d.groupBy("video_id").agg(F.count("*").alias("m")) for n, d in (("pred", final), ("gt", own))}
    same = {f"uniform_{n}": uniform(durations.join(s, "video_id"), F.col("m")).select("video_id", F.concat_ws("_", F.lit(n), "video_id", "k").alias("pred_id"), "ts", "te", F.lit(1.0).alias("conf")) for n, s in sized.items()}
    text = lambda d: d.withColumn("pred_id", F.col("pred_id").cast("string"))
    rows = item_rows(own, {"final": text(final), **{n: text(d) for n, d in other.items()}, **same}, thresholds).persist()
    tops = split_blocks(own, top_proposals(raw, own, final), splits, thresholds)
    aps = average_precisions(own, {"raw": text(raw), "final": text(final), **{n: text(d) for n, d in other.items()}}, splits, map_thresholds)
    events, segments = event_rows(own, final, thresholds).persist(), segment_rows(own, final).persist()
    return {
        "blocks": rolled(rows, splits, thresholds), "recall": tops.select("split", F.col("method").alias("n"), *[F.col(_name("cover", t)).alias(_name("recall", t)) for t in thresholds], "mean_tiou"),
        "ap": aps, "map": aps.groupBy("split", "method").agg(F.avg("ap").alias("map")), "items": by_item(rows, thresholds), "events": events, "segments": segments,
        "errors": error_summary_by(events, segments, splits), "boundary": boundary_by(events, splits),
    }


def _twice(rows: DataFrame, splits: DataFrame, whole: str) -> DataFrame:
    return rows.join(splits.select("video_id", "split").distinct(), "video_id").withColumn("split", F.explode(F.array("split", F.lit(whole))))


def error_summary_by(events: DataFrame, segments: DataFrame, splits: DataFrame, whole: str = "all") -> DataFrame:
    """``error_summary`` of each split and of all."""
    pct = lambda c: F.coalesce(100 * F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"pct_{c}")
    a = _twice(events, splits, whole).groupBy("split").agg(F.count("*").alias("n_gt"), *map(pct, ("missed", "fragmented", "in_merged_seg")))
    b = _twice(segments, splits, whole).groupBy("split").agg(F.count("*").alias("n_seg"), *map(pct, ("fp_no_overlap", "unmatched", "merge")))
    return a.join(b, "split", "left").na.fill(0)


def boundary_by(events: DataFrame, splits: DataFrame, whole: str = "all") -> DataFrame:
    """(split, side, n, mean, mean_abs, std): offsets of start and end of the matched segments to their events."""
    rows = _twice(events, splits, whole).select("split", F.explode(F.create_map(F.lit("left"), "left_offset", F.lit("right"), "right_offset")).alias("side", "x")).where("x is not null")
    return rows.groupBy("split", "side").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.avg(F.abs("x")).alias("mean_abs"), F.stddev_pop("x").alias("std"))


def detector_stats(gt: DataFrame, preds: DataFrame, threshold: float = 0.5, missed_below: float = 0.3, many: int = 16) -> DataFrame:
    """One row: mean and largest number of predictions of an item with events, items with over ``many``, F1, AP, share of missed events."""
    items = gt.select("video_id").distinct()
    known = preds.join(items, "video_id", "left_semi")
    per = items.join(known.groupBy("video_id").agg(F.count("*").alias("k")), "video_id", "left").na.fill(0, ["k"])
    k = per.agg(F.count("*").alias("items"), F.avg("k").alias("k_mean"), F.max("k").alias("k_max"), F.sum((F.col("k") > many).cast("long")).alias("k_many"))
    miss = best_tiou(gt, known).agg((100 * F.avg(F.when(F.col("best") < missed_below, 1.0).otherwise(0.0))).alias("missed"))
    return k.crossJoin(prf_at(gt, known, threshold).select("f1")).crossJoin(average_precision(gt, known, threshold)).crossJoin(miss)  # one row each


def clip_vectors(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, clip, emb): unit mean of the vectors of a clip's frames; each frame of an item is read once.

    ``clips``: (video_id, clip, frames array), a repeated number counts as often as it stands there;
    ``frames``: (video_id, frame, emb). Clips with a frame that is missing go.
    """
    wanted = clips.select("video_id", "clip", F.size("frames").alias("_n"), F.explode("frames").alias("frame"))
    flat = wanted.join(frames.select("video_id", "frame", "emb"), ["video_id", "frame"]).select("video_id", "clip", "_n", "frame", F.posexplode("emb").alias("pos", "x"))
    mean = flat.groupBy("video_id", "clip", "_n", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("_have")).where("_have = _n")
    vec = mean.groupBy("video_id", "clip").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return vec.select("video_id", "clip", X.unit(F.col("v.x")).alias("emb"))


def target_curve(blocks: DataFrame, k: str, value: str, by: str) -> DataFrame:
    """Budget curve of (by, k, value): value of each strategy by its mean number of vectors, with the gap to the best at no more vectors."""
    w = Window.partitionBy(by).orderBy(k)
    best = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.select(by, k, value, best.alias("best_so_far"), (best - F.col(value)).alias("behind"))
