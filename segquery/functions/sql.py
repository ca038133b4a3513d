"""Kernels under SQL names: table functions with ``PARTITION BY``, and a grouped aggregate.

``register(spark)`` makes them callable::

    SELECT * FROM seg_merge(TABLE(segs) PARTITION BY video_id ORDER BY (ts, te, pred_id), 0.5)
    SELECT * FROM seg_nms(TABLE(props) PARTITION BY video_id ORDER BY (conf DESC, pred_id), 0.3, 30)
    SELECT * FROM seg_medoids(TABLE(series) PARTITION BY video_id ORDER BY (step), 8, 0)
    SELECT video_id, seg_matches(gt_id, pred_id, tiou) FROM pairs GROUP BY video_id

A table function holds the rows of one partition, as the operators of the same kernels do; partition by islands
(``localize.islanded``) where an item is long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from segquery.operators import localize as L


class Merge:
    """Segments of a partition merged above a tIoU: (video_id, pred_id, ts, te, conf, merged)."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.threshold = 1.0

    def eval(self, row: Row, threshold: float) -> None:
        self.threshold = float(threshold)
        self.rows.append({"video_id": str(row["video_id"]), "pred_id": str(row["pred_id"]), "ts": float(row["ts"]), "te": float(row["te"]), "conf": float(row["conf"]), "merged": 1})

    def terminate(self) -> Iterator[tuple]:
        for r in L.merged_rows(self.rows, self.threshold):
            yield r["video_id"], r["pred_id"], r["ts"], r["te"], r["conf"], r["merged"]


class Suppress:
    """Segments of a partition in the order given, without those that overlap a kept one by more than a tIoU: (video_id, pred_id, ts, te, conf)."""

    def __init__(self) -> None:
        self.kept: list[list[float]] = []

    def eval(self, row: Row, most_overlap: float, most: int) -> Iterator[tuple]:
        box = [float(row["ts"]), float(row["te"])]
        if len(self.kept) < most and (not self.kept or L._tiou(np.array([box]), np.array(self.kept)).max() <= float(most_overlap)):
            self.kept.append(box)
            yield str(row["video_id"]), str(row["pred_id"]), *box, float(row["conf"])


class Medoids:
    """Medoid steps of a partition's vectors: (video_id, step, iterations, converged)."""

    def __init__(self) -> None:
        self.steps: list[int] = []
        self.vectors: list[list[float]] = []
        self.of, self.k, self.seed = "", 1, 0

    def eval(self, row: Row, k: int, seed: int) -> None:
        self.of, self.k, self.seed = str(row["video_id"]), int(k), int(seed)
        self.steps.append(int(row["step"]))
        self.vectors.append([float(x) for x in row["emb"]])

    def terminate(self) -> Iterator[tuple]:
        if self.steps:
            found, rounds, settled = L.kmedoids(np.array(self.vectors), self.k, self.seed)
            for i in found:
                yield self.of, self.steps[int(i)], int(rounds), bool(settled)


def match_count(gt_id: pd.Series, pred_id: pd.Series, tiou: pd.Series) -> int:
    """Number of pairs of the best one-to-one assignment; pairs of tIoU 0 are none."""
    gs, gi = np.unique(gt_id, return_inverse=True)
    ps, pi = np.unique(pred_id, return_inverse=True)
    t = np.zeros((len(gs), len(ps)))
    t[gi, pi] = tiou
    return len(L.assign(np.where(t > 0, t + min(t.shape), 0.0)))


def register(spark: SparkSession) -> None:
    """The functions of this module under their SQL names, for the session."""
    spark.udtf.register("seg_merge", F.udtf(Merge, returnType="video_id string, pred_id string, ts double, te double, conf double, merged int"))
    spark.udtf.register("seg_nms", F.udtf(Suppress, returnType="video_id string, pred_id string, ts double, te double, conf double"))
    spark.udtf.register("seg_medoids", F.udtf(Medoids, returnType="video_id string, step long, iterations int, converged boolean"))
    spark.udf.register("seg_matches", F.pandas_udf(match_count, "long"))
