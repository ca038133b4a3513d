"""Sinks: atomic tables, logs, CSV and markdown reports, versioned installs, collection of vectors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segquery.functions import exprs as X
from segquery.operators import numbering
from segquery.operators.analysis import fingerprint

from .readers import exists


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; the commit protocol publishes all files of a job or none."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Six decimals, nested cells as JSON."""
    cell = lambda name, kind: F.round(name, 6).alias(name) if kind in ("double", "float") else F.to_json(name).alias(name) if kind.startswith(("array", "struct", "map")) else F.col(name)
    df.select(*[cell(n, k) for n, k in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame) -> str:
    """A small result as a table; missing numbers as a dash, two decimals."""
    show = lambda v: "-" if v is None or v != v else f"{v:.2f}" if isinstance(v, float) else str(v)
    rows = [" | ".join(map(show, r)) for r in df.collect()]
    return "\n".join(f"| {x} |" for x in [" | ".join(df.columns), " | ".join("---" for _ in df.columns), *rows])


def write_chunks(vectors: DataFrame, path: str, chunk: int, size: int = 200) -> None:
    """Appends (id, emb) to a vector store as one more chunk."""
    vectors.select("id", "emb").withColumn("chunk", F.lit(chunk)).write.mode("append").option("maxRecordsPerFile", size).parquet(path)


class MissingVectors(ValueError):
    pass


def collect_vectors(rows: DataFrame, store: DataFrame, key: str = "seg_key", allow_missing: bool = False) -> DataFrame:
    """``rows`` with unit vectors of the store ``(key, emb)``; missing ones raise, or their rows go."""
    if not allow_missing:
        lost = rows.join(store, key, "left_anti").select(key).distinct().count()
        if lost:
            raise MissingVectors(f"{lost} keys have no vector")
    return rows.join(store, key).withColumn("emb", X.unit("emb"))


def write_partitions(segs: DataFrame, path: str) -> None:
    segs.write.mode("overwrite").partitionBy("partition").parquet(path)


def packed_videos(segs: DataFrame) -> DataFrame:
    """One row an item with its segments in time order: (video_id, n, segs)."""
    return segs.groupBy("video_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "te", "emb"))).alias("segs"))


def install(df: DataFrame, root: str, line, split: str) -> str:
    """Writes a split under its content's fingerprint; a second install of equal content changes nothing."""
    digest = fingerprint(df, line).first().digest[:8]
    path = f"{root}/version={digest}/split={split}"
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return path


def require_partitions(df: DataFrame, names: list[str]) -> None:
    got = {r[0] for r in df.select("partition").distinct().collect()}
    if set(names) - got:
        raise KeyError(f"missing partitions: {sorted(set(names) - got)}")


def provenance(**settings: object) -> str:
    return json.dumps(settings, sort_keys=True, ensure_ascii=False)


def events_table(events: DataFrame) -> DataFrame:
    """Equal windows of an item once, captions joined in order: (video_id, ts, te, captions, n)."""
    return events.groupBy("video_id", "ts", "te").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "caption"))), lambda x: x["caption"]), " | ").alias("captions"), F.count("*").alias("n"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``row``, its place from 0 in the order of a unique column."""
    return numbering.numbered(df, order, name="row")
