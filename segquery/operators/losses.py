"""Losses and samplers of training, as relations."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segquery.functions import exprs as X

from . import score_states as K
from .numbering import hash_numbered, numbered


def softmax_loss(pairs: DataFrame, tau: float, group: str = "query_id", positive: str = "is_positive") -> DataFrame:
    """(group, loss): log-sum-exp over all less log-sum-exp over the positives of score / tau; groups without a positive have none."""
    top = F.max("score").over(Window.partitionBy(group))
    e = F.exp((F.col("score") - top) / tau)
    rows = pairs.withColumn("e", e)
    per = rows.groupBy(group).agg(F.sum("e").alias("all"), F.sum(F.when(F.col(positive), F.col("e")).otherwise(0.0)).alias("pos"))
    return per.where("pos > 0").select(group, (F.log("all") - F.log("pos")).alias("loss"))


def own_item_loss(queries: DataFrame, segments: DataFrame, own: str, positive: Column, tau: float) -> DataFrame:
    """``softmax_loss`` of each query over the segments of the item that its column ``own`` names, by states: (query_id, loss)."""
    if not K.fits(queries):
        pairs = queries.join(segments, F.col(own) == F.col("video_id")).select("query_id", X.dot("q_emb", "emb").alias("score"), positive.alias("is_positive"))
        return softmax_loss(pairs, tau)
    s = K.own_softmax(queries, segments, own, positive, tau)
    top = s.groupBy("query_id").agg(F.max("top").alias("m"), F.sum("n").alias("n"), F.collect_list(F.struct("top", "total", "flagged")).alias("s"))  # as many as blocks of an item
    total = lambda c: F.aggregate("s", F.lit(0.0), lambda t, x: t + x[c] * F.exp((x["top"] - F.col("m")) / tau))
    return top.where("n > 0").select("query_id", (F.log(total("total")) - F.log(total("flagged"))).alias("loss"))


def soft_targets(pairs: DataFrame, tau: float, group: str = "query_id") -> DataFrame:
    """``pairs`` with ``target``: softmax of score / tau within the group."""
    w = Window.partitionBy(group)
    rows = pairs.withColumn("e", F.exp((F.col("score") - F.max("score").over(w)) / tau))
    return rows.withColumn("target", F.col("e") / F.sum("e").over(w)).drop("e")


def derangement(items: DataFrame, key: str, seed: object = 0) -> DataFrame:
    """(key, partner): items in hash order, each with the next one, the last with the first: no fixed point for two items or more."""
    rows = hash_numbered(items.select(key), key, seed, total="_of")
    after = rows.select(((F.col("place") + F.col("_of") - 1) % F.col("_of")).alias("place"), F.col(key).alias("partner"))
    return rows.join(after, "place").select(key, "partner")


def one_per_video_batches(captions: DataFrame, size: int, seed: object = 0) -> DataFrame:
    """(caption_id, video_id, batch): every caption once, at most one of a video in a batch, at most ``size`` in a batch.

    A caption's place among its video's captions, and the videos' order by number of captions,
    give the place in one sequence that is dealt round robin to the batches: two captions of one
    video are neighbours in it, so they never meet while a video has no more captions than
    there are batches.
    """
    given = captions.select("caption_id", "video_id")
    rows = given.join(given.groupBy("video_id").agg(F.count("*").alias("n")), "video_id")
    totals = rows.agg(F.count("*").alias("all"), F.max("n").alias("most")).first()
    batches = max(math.ceil((totals["all"] or 0) / size), totals["most"] or 0, 1)
    order = (-F.col("n"), X.hash_uniform(seed, "video_id"), "video_id", X.hash_uniform(seed, "caption_id"), "caption_id")
    return numbered(rows, *order).select("caption_id", "video_id", (F.col("place") % batches).cast("long").alias("batch"))


def near_unit_fusion(df: DataFrame, alpha: float) -> DataFrame:
    """(id, fused): unit(emb + alpha * unit(context)); alpha 0 leaves unit vectors as they are."""
    return df.select("id", X.unit(F.zip_with("emb", X.unit("context"), lambda e, c: e.cast("double") + alpha * c)).alias("fused"))


def encode(rows: DataFrame, dim: int = 8) -> DataFrame:
    """Stand-in at the model boundary: (id, text) to (id, emb), unit vectors from hashes of the text.

    A real encoder has the same shape: Arrow batches in, vectors out, once for each distinct text.
    """
    def run(batches):
        import hashlib

        import numpy as np

        for pdf in batches:
            out = []
            for t in pdf.text:
                x = np.frombuffer(hashlib.shake_256((t or "").encode()).digest(4 * dim), np.uint32) / 2**31 - 1
                out.append((x / max(1e-12, float(np.linalg.norm(x)))).tolist())
            yield pd.DataFrame({"id": pdf.id, "emb": out})

    return rows.select("id", "text").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, emb array<double>")
