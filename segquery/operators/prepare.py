"""From items and events to what has to be encoded: partitions by name, segment rows, unique clips, work lists.

All is one plan over the tables; ``publish`` writes it as a version. Times are seconds; keys carry them with two decimals,
so that segments equal to a hundredth are one clip.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segquery.functions import exprs as X

from . import partitions as P
from .numbering import ranged


@dataclass(frozen=True)
class Protocol:
    """Settings of the partitions; ``load`` overrides them from a JSON file."""

    tail: float = 1.0
    chunk: float = 14.0
    chunk_least: float = 2.0
    noise_least: float = 1.0
    random_least: float = 2.0
    seed: str = "0"
    uniform: tuple[int, ...] = (1, 3, 5, 7, 10)
    noise: tuple[float, ...] = (0.9, 0.7, 0.5, 0.3)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Protocol:
        """The defaults with what a JSON object names; a name that is no setting raises."""
        given = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"no such settings: {sorted(unknown)}")
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def clamped(segs: DataFrame, tail: float = 1.0) -> DataFrame:
    """``intervals.clamp`` in seconds: times with three decimals, ``k`` numbers an item's segments by time."""
    cut = segs.withColumn("ts", F.greatest(F.lit(0.0), F.col("ts").cast("double"))).withColumn("te", F.least(F.col("te").cast("double"), F.col("dur").cast("double")))
    kept = cut.where((F.col("te") > F.col("ts")) & (F.col("ts") <= F.col("dur") - tail))
    return _by_time(kept.withColumn("ts", X.round_exact("ts", 3)).withColumn("te", X.round_exact("te", 3)))


def _by_time(segs: DataFrame) -> DataFrame:
    return segs.withColumn("k", F.row_number().over(Window.partitionBy("video_id").orderBy("ts", "te")) - 1)


def noise_name(base: str, target: float, seed: object | None = None) -> str:
    """``<base>_noise_<tenths>`` of a target tIoU, with a suffix for seeds other than the first."""
    return f"{base}_noise_{round(10 * target):02d}" + ("" if seed is None else f"_s{seed}")


def build_partitions(videos: DataFrame, events: DataFrame, names: tuple[str, ...] = ("global", "gt", "uni_M_gt"), protocol: Protocol = Protocol(), sigmas: dict[float, float] | None = None) -> dict[str, DataFrame]:
    """Partitions (video_id, k, ts, te, dur) of the items (video_id, dur) by name, from their events (video_id, ts, te).

    ``global``, ``gt``, ``uni_M_gt`` (as many equal parts as events), ``uni_<m>``, ``uni_chunk``, ``rand`` (as many random parts
    as events), ``shift`` (events moved), ``gt_noise_<tenths>`` (events blurred to a mean tIoU; ``sigmas`` names known
    noise levels, others are calibrated). An unknown name raises before anything runs.
    """
    gt = clamped(events.select("video_id", "ts", "te").join(videos, "video_id"), protocol.tail).select("video_id", "k", "ts", "te", "dur")
    many = videos.join(gt.groupBy("video_id").agg(F.count("*").alias("_k")), "video_id")
    three = lambda d: d.withColumn("ts", X.round_exact("ts", 3)).withColumn("te", X.round_exact("te", 3))

    def noisy(target: float, seed: str | None) -> DataFrame:
        sigma = (sigmas or {}).get(target)
        if sigma is None:
            sigma = P.calibrated_sigma(gt, target, protocol.noise_least, protocol.seed)
        return _by_time(P.perturbed(gt, sigma, protocol.noise_least, protocol.seed if seed is None else seed))

    makers = {
        "global": lambda: P.whole(videos), "gt": lambda: gt, "uni_M_gt": lambda: three(P.uniform(many, F.col("_k"))), "uni_chunk": lambda: P.chunks(videos, protocol.chunk, protocol.chunk_least),
        "rand": lambda: three(P.random_contiguous(many, F.col("_k"), protocol.random_least, protocol.seed)), "shift": lambda: three(_by_time(P.shifted(gt, protocol.seed, protocol.tail))),
        **{f"uni_{m}": lambda m=m: three(P.uniform(videos, m)) for m in protocol.uniform}, **{noise_name("gt", t): lambda t=t: noisy(t, None) for t in protocol.noise},
    }
    unknown = [n for n in names if n not in makers]
    if unknown:
        raise ValueError(f"unknown partitions {unknown}; have {sorted(makers)}")
    return {n: makers[n]().select("video_id", "k", F.col("ts").cast("double").alias("ts"), F.col("te").cast("double").alias("te"), "dur") for n in names}


def segment_table(parts: dict[str, DataFrame]) -> DataFrame:
    """(key, video_id, partition, k, ts, te, seg_key): every segment of every partition."""
    tagged = [p.select("video_id", F.lit(n).alias("partition"), F.col("k").cast("int").alias("k"), "ts", "te") for n, p in parts.items()]
    key = F.concat_ws("__", "video_id", "partition", "k").alias("key")
    return reduce(DataFrame.unionByName, tagged).select(key, "video_id", "partition", "k", "ts", "te", X.seg_key_seconds("video_id", "ts", "te").alias("seg_key"))


def unique_clips(rows: DataFrame) -> DataFrame:
    """(seg_key, video_id, ts, te, n, refs): segments of one key once, times with two decimals, with the rows that refer to them."""
    refs = F.array_sort(F.collect_set("key")).alias("refs")  # as many as partitions have segments there
    return rows.groupBy("seg_key").agg(F.first("video_id").alias("video_id"), F.min(X.round_exact("ts", 2)).alias("ts"), F.min(X.round_exact("te", 2)).alias("te"), F.count("*").alias("n"), refs)


def captions_of(events: DataFrame, videos: DataFrame, tail: float = 1.0) -> DataFrame:
    """(caption_id, video_id, sentence, gt_ts, gt_te, gt_seg_key): queries, each with the key of its own clip, empty where none is left."""
    given = events.join(videos, "video_id")
    ts, te = F.greatest(F.lit(0.0), F.col("ts").cast("double")), F.least(F.col("te").cast("double"), F.col("dur").cast("double"))
    own = F.when((te > ts) & (ts <= F.col("dur") - tail), X.seg_key_seconds("video_id", X.round_exact(ts, 3), X.round_exact(te, 3))).otherwise("")
    return given.select("caption_id", "video_id", "sentence", F.col("ts").alias("gt_ts"), F.col("te").alias("gt_te"), own.alias("gt_seg_key"))


def summary(rows: DataFrame) -> DataFrame:
    """(partition, videos, segments, per_video, median_length)."""
    length = F.percentile((F.col("te") - F.col("ts")), F.lit(0.5))
    return rows.groupBy("partition").agg(F.count_distinct("video_id").alias("videos"), F.count("*").alias("segments"), (F.count("*") / F.count_distinct("video_id")).alias("per_video"), length.alias("median_length"))


def prepare(videos: DataFrame, events: DataFrame, clips_done: DataFrame, texts_done: DataFrame, names: tuple[str, ...] = ("global", "gt", "uni_M_gt"), protocol: Protocol = Protocol(), sigmas: dict[float, float] | None = None) -> dict[str, DataFrame]:
    """Partitions, segment rows, unique clips, queries, and the work lists of what the stores (seg_key), (caption_id) lack.

    ``events``: (caption_id, video_id, ts, te, sentence). Safe to run again: what has been encoded leaves the lists.
    """
    parts = build_partitions(videos, events, names, protocol, sigmas)
    rows = segment_table(parts)
    clips, captions = unique_clips(rows), captions_of(events, videos, protocol.tail)
    todo = clips.join(clips_done.select("seg_key").distinct(), "seg_key", "left_anti").select(F.concat("seg_key", F.lit("__av")).alias("id"), F.concat("video_id", F.lit(".mp4")).alias("video"), F.array("ts", "te").alias("timestamps"), "refs")
    texts = captions.join(texts_done.select("caption_id").distinct(), "caption_id", "left_anti").select(F.col("caption_id").alias("id"), F.col("sentence").alias("text"))
    return {"partitions": reduce(DataFrame.unionByName, [p.withColumn("partition", F.lit(n)) for n, p in parts.items()]), "rows": rows, "clips": clips, "captions": captions, "clips_todo": todo, "texts_todo": texts}


def train_side(videos: DataFrame, events: DataFrame, gallery: DataFrame, names: tuple[str, ...], protocol: Protocol = Protocol(), sigmas: dict[float, float] | None = None) -> dict[str, DataFrame]:
    """The same partitions of training items; an item that the gallery (video_id) holds too raises."""
    both = videos.select("video_id").join(gallery.select("video_id").distinct(), "video_id", "left_semi").orderBy("video_id").limit(5).collect()
    if both:
        raise ValueError(f"training items in the gallery, among them {[r.video_id for r in both]}")
    return build_partitions(videos, events, names, protocol, sigmas)


def publish(made: dict[str, DataFrame], root: str, protocol: Protocol = Protocol()) -> dict:
    """What ``prepare`` made as one version under ``root``: its manifest."""
    from segquery.sources import snapshots

    return snapshots.commit(next(iter(made.values())).sparkSession, root, made, settings=asdict(protocol))


# ---------------------------------------------------------------- adapters


def picked(df: DataFrame, source: str, names: dict[str, str], to: str = "emb") -> DataFrame:
    """``df`` with the vector column of a source by its name as ``to``; an unknown source raises."""
    if source not in names:
        raise KeyError(f"no source {source!r}: one of {sorted(names)}")
    return df.withColumn(to, F.col(names[source]))


def final_events(segs: DataFrame, captions: DataFrame, oracle: DataFrame | None = None, keep: tuple[str, ...] = ("conf", "merged", "extended")) -> DataFrame:
    """(video_id, events): one row an item, its segments in time order as structs with three decimals, captions joined by (video_id, k).

    ``keep`` are columns that go along where ``segs`` has them; ``oracle`` adds ``caption_oracle``.
    """
    own = [c for c in keep if c in segs.columns]
    wide = segs.join(captions.select("video_id", "k", "caption"), ["video_id", "k"], "left")
    more = []
    if oracle is not None:
        wide = wide.join(oracle.select("video_id", "k", F.col("caption").alias("caption_oracle")), ["video_id", "k"], "left")
        more = ["caption_oracle"]
    event = F.struct(X.round_exact("ts", 3).alias("t_s"), X.round_exact("te", 3).alias("t_e"), *own, "caption", *more)
    return wide.groupBy("video_id").agg(F.array_sort(F.collect_list(event)).alias("events"))


def of_events(rows: DataFrame, column: str = "events") -> DataFrame:
    """(video_id, pred_id, ts, te, conf) from one row an item with structs (t_s, t_e[, conf])."""
    names = rows.schema[column].dataType.elementType.names
    flat = rows.select("video_id", F.posexplode(column).alias("k", "e"))
    conf = F.col("e.conf").cast("double") if "conf" in names else F.lit(None).cast("double")
    return flat.select("video_id", F.concat_ws("#", "video_id", "k").alias("pred_id"), F.col("e.t_s").cast("double").alias("ts"), F.col("e.t_e").cast("double").alias("te"), conf.alias("conf"))


def of_annotations(rows: DataFrame, column: str = "events") -> DataFrame:
    """(video_id, gt_id, ts, te) from one row an item with structs (ts, te)."""
    flat = rows.select("video_id", F.posexplode(column).alias("k", "e"))
    return flat.select("video_id", F.concat_ws("#", "video_id", "k").alias("gt_id"), F.col("e.ts").cast("double").alias("ts"), F.col("e.te").cast("double").alias("te"))


def in_parts(rows: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """``rows`` with ``part``: ranges of a key of about equal size, for work that is dealt to machines by hand."""
    return ranged(rows, key, ranges=parts).withColumnRenamed("_p", "part")


def require(condition: bool, told: str, strict: bool = True) -> str:
    """A gate: raises, or says what is wrong."""
    if not condition and strict:
        raise AssertionError(told)
    return "pass" if condition else told


def parity(ours: DataFrame, reference: DataFrame, tol: float, items: int | None = None, expected: int | None = None, strict: bool = True) -> DataFrame:
    """(metric, ours, reference, diff, ok) of (metric, value) against stored values; beyond ``tol``, without any, or with another number of items it raises."""
    both = ours.select("metric", F.col("value").alias("ours")).join(reference.select("metric", F.col("value").alias("reference")), "metric", "left")
    out = both.withColumn("diff", F.col("ours") - F.col("reference")).withColumn("ok", F.col("diff").isNull() | (F.abs("diff") <= tol))
    told = out.agg(F.max(F.abs("diff")).alias("gap")).first().gap
    require(told is not None and told <= tol and (expected is None or items == expected), f"largest gap {told} (allowed {tol}), {items} items of {expected}", strict)
    return out
