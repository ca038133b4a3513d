"""Sources: JSON lines, logs, annotations, partition files, vector stores, binary archives, CSV side tables."""

from __future__ import annotations

import hashlib
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from segquery.functions import exprs as X

MANIFEST = "id string, video string, timestamps array<double>, text string"
QUERIES = "query string, video_id string, ts double, te double, source_caption string"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a bad line fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Missing file: empty; truncated or bad lines are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_optional(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else None


def manifests(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Events of several splits: (event_id, video_id, ts, te, text, split)."""
    out = None
    for split, path in paths.items():
        m = jsonl(spark, path, MANIFEST)
        own = m.select(F.col("id"), X.event_ordinal("id").alias("event_id"), X.item_id("video").alias("video_id"), F.col("timestamps")[0].alias("ts"), F.col("timestamps")[1].alias("te"), "text", F.lit(split).alias("split"))
        out = own if out is None else out.unionByName(own)
    return out


def assert_disjoint(events: DataFrame) -> DataFrame:
    """Raises if an item is in two splits."""
    if not events.groupBy("video_id").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty():
        raise ValueError("items in more than one split")
    return events


def annotations(spark: SparkSession, path: str, subset: str, most: int = 16) -> DataFrame:
    """The first ``most`` annotations of each item of a subset: (video_id, event_id, ts, te, caption, dur)."""
    item = "struct<subset:string,duration:double,annotations:array<struct<segment:array<double>,sentence:string>>>"
    raw = spark.read.schema(f"database map<string,{item}>").option("multiLine", True).json(path)
    flat = raw.select(F.explode("database").alias("video_id", "v")).where(F.col("v.subset") == subset)
    flat = flat.select("video_id", F.col("v.duration").alias("dur"), F.posexplode(F.slice("v.annotations", 1, most)).alias("event_id", "a"))
    return flat.select("video_id", "event_id", F.col("a.segment")[0].alias("ts"), F.col("a.segment")[1].alias("te"), F.col("a.sentence").alias("caption"), "dur")


def custom_queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON list or JSON lines; rows without a needed field fail; (qid, key, query, video_id, ts, te, source_caption)."""
    head = spark.read.text(path).where("trim(value) <> ''").first()
    multi = head is not None and head.value.lstrip().startswith("[")
    q = spark.read.schema(QUERIES).option("multiLine", multi).option("mode", "FAILFAST").json(path)
    need = F.col("query").isNull() | F.col("video_id").isNull() | F.col("ts").isNull() | F.col("te").isNull()
    q = q.withColumn("query", F.when(need, F.raise_error(F.lit("a query needs query, video_id, ts and te"))).otherwise(F.col("query")))
    n = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1  # one hand-written file, which one task reads in any case
    return q.select(F.format_string("custom_%03d", n).alias("qid"), X.text_key("query").alias("key"), *q.columns)


def partition_file(spark: SparkSession, path: str, durations: DataFrame, tail: float = 1.0) -> DataFrame:
    """{item or item.mp4: [[ts, te, ...], ...]} of items with a duration, clamped: (video_id, k, ts, te, dur)."""
    from segquery.operators.intervals import clamp

    text = spark.read.option("wholetext", True).text(path)
    flat = text.select(F.explode(F.from_json("value", "map<string,array<array<double>>>")).alias("video_id", "s"))
    flat = flat.select(F.regexp_replace("video_id", r"\.mp4$", "").alias("video_id"), F.posexplode("s").alias("k", "x"))
    return clamp(flat.select("video_id", "k", F.col("x")[0].alias("ts"), F.col("x")[1].alias("te")).join(durations.select("video_id", "dur"), "video_id"), tail)


def segment_index(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """One partition of the index table; the filter is on the directory, so nothing else is read. Unknown: KeyError with what there is."""
    every = spark.read.parquet(path)
    got = every.where(F.col("partition") == partition)
    if got.isEmpty():
        raise KeyError(f"{partition}: one of {sorted(r[0] for r in every.select('partition').distinct().collect())}")
    return got


def vector_store(spark: SparkSession, path: str, keys_only: bool = False) -> DataFrame:
    """(id, emb): the vector of the last chunk of a key; ``keys_only`` reads no vectors."""
    t = spark.read.parquet(path)
    if keys_only:
        return t.select("id").distinct()
    w = Window.partitionBy("id").orderBy(F.desc("chunk"))
    return t.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("id", "emb")


def side_table(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Two columns of a CSV file."""
    return spark.read.option("header", True).csv(path).select(key, F.col(value).cast("long").alias(value))


def archives(spark: SparkSession, path: str, array: str) -> DataFrame:
    """numpy archives as rows (path, sha256, row, values) of one two-dimensional array; one task a file."""
    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content, strict=True):
                a = np.load(io.BytesIO(content))[array].astype(float)
                yield pd.DataFrame({"path": p, "sha256": hashlib.sha256(content).hexdigest(), "row": range(len(a)), "values": list(map(list, a.reshape(len(a), -1)))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sha256 string, row long, values array<double>")


def feature_rows(df: DataFrame, visual: str, audio: str) -> DataFrame:
    """Usable rows of an item: the shorter of its two series."""
    return df.withColumn("rows", F.least(F.size(visual), F.size(audio)))


def train_ids(spark: SparkSession, path: str) -> DataFrame:
    """(video_id) of a manifest; a missing file is an empty set."""
    return jsonl_tolerant(spark, path, MANIFEST).select(X.item_id("video").alias("video_id")).where("video_id <> ''").distinct()


def segment_lines(spark: SparkSession, path: str) -> DataFrame:
    """Predicted segments of JSON lines in time order within an item: (video_id, k, ts, te, conf); conf null where the file has none."""
    rows = jsonl(spark, path, "video_id string, ts double, te double, conf double")
    w = Window.partitionBy("video_id").orderBy("ts", "te", "conf")
    return rows.select("video_id", (F.row_number().over(w) - 1).cast("int").alias("k"), "ts", "te", "conf")


def durations(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, dur) of ``{"videos": [{video_id, duration}]}`` or of one object of numbers by item."""
    text = spark.read.option("wholetext", True).text(path)
    listed = text.select(F.explode(F.from_json("value", "videos array<struct<video_id:string,duration:double>>")["videos"]).alias("v")).select("v.video_id", F.col("v.duration").alias("dur"))
    plain = text.where(F.get_json_object("value", "$.videos").isNull()).select(F.explode(F.from_json("value", "map<string,double>")).alias("video_id", "dur"))
    return listed.unionByName(plain)


def event_index(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The event table (emb, seg_key, video_id, ts, te, caption, split); a file without splits has empty ones."""
    t = spark.read.parquet(path)
    t = t if "split" in t.columns else t.withColumn("split", F.lit(""))
    return t if split is None else t.where(F.col("split") == split)


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """The caption table; vectors of any width as single precision."""
    t = spark.read.parquet(path)
    return t.withColumn("emb", F.col("emb").cast("array<float>"))


def feature_series(spark: SparkSession, path: str, items: DataFrame, key: str = "z") -> DataFrame:
    """(video_id, step, t_sec, emb) of one archive an item (arrays ``key`` and ``t_sec``); an item without a file raises.

    A series is valid if rows and times are equally many, all numbers are finite and times rise; others raise.
    """
    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content, strict=True):
                with np.load(io.BytesIO(content)) as blob:
                    z, t = blob[key].astype(np.float32), blob["t_sec"].astype(float)
                if z.ndim != 2 or len(z) != len(t) or not np.isfinite(z).all() or not np.isfinite(t).all() or (np.diff(t) <= 0).any():
                    raise ValueError(f"{p}: not a series")
                yield pd.DataFrame({"video_id": p.rsplit("/", 1)[-1].rsplit(".", 1)[0], "step": range(len(z)), "t_sec": t, "emb": list(map(list, z))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    lost = items.select("video_id").distinct().join(files.select(X.item_id("path").alias("video_id")), "video_id", "left_anti")
    few = [r.video_id for r in lost.orderBy("video_id").limit(5).collect()]
    if few:
        raise FileNotFoundError(f"items without a series, among them {few}")
    wanted = files.withColumn("video_id", X.item_id("path")).join(items.select("video_id").distinct(), "video_id", "left_semi")
    return wanted.select("path", "content").mapInPandas(run, "video_id string, step int, t_sec double, emb array<float>")


def shard_index(spark: SparkSession, path: str, items: DataFrame | None = None) -> DataFrame:
    """(video_id, shard) of a manifest ``{shard: [file, ...]}``; with ``items`` only the shards that hold one of them."""
    text = spark.read.option("wholetext", True).text(path)
    every = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("shard", "files")).select("shard", F.explode("files").alias("f")).select(X.item_id("f").alias("video_id"), "shard")
    return every if items is None else every.join(items.select("video_id").distinct(), "video_id", "left_semi")


def feature_log(spark: SparkSession, log: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, failed) of an append-only log (video_id, at, status, file): the last line of an item counts; a record needs its file."""
    rows = jsonl_tolerant(spark, log, "video_id string, at double, status string, file string")
    last = rows.groupBy("video_id").agg(F.max_by(F.struct("status", "file", "at"), "at").alias("x")).select("video_id", "x.*")
    there = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return last.where("status = 'ok'").join(there, "file", "left_semi").select("video_id", "file", "at"), last.where("status <> 'ok'").select("video_id", "status", "at")


def split_rows(rows: DataFrame, splits: DataFrame, split: str, most: float | None = None) -> DataFrame:
    """Rows of the items of one split, of at most ``most`` seconds where that is given."""
    own = splits.where(F.col("split") == split)
    return rows.join((own if most is None else own.where(F.col("dur") <= most)).select("video_id").distinct(), "video_id", "left_semi")


def caption_pool(rows: DataFrame, key: str = "key", text: str = "caption") -> DataFrame:
    """(video_id, captions) from keys ``<item>#<i>``, in the order of i; the item may hold the sign itself."""
    item = F.regexp_extract(key, r"^(.*)#[^#]*$", 1)
    return rows.select(item.alias("video_id"), F.substring_index(key, "#", -1).cast("long").alias("i"), F.col(text).alias("c")).groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("captions"))


def segment_dialect(df: DataFrame, segments: str | None = None) -> DataFrame:
    """``ts`` and ``te`` from any spelling: columns ts/te or t_s/t_e, or a column ``segments`` of (start, end, ...) arrays, one row each."""
    if segments is not None:
        df = df.withColumn("_x", F.explode(segments))
        return df.select(*[c for c in df.columns if c not in (segments, "_x", "ts", "te")], F.col("_x")[0].cast("double").alias("ts"), F.col("_x")[1].cast("double").alias("te"))
    pick = lambda *names: F.coalesce(*[F.col(c).cast("double") for c in names if c in df.columns])
    if not ({"ts", "t_s"} & set(df.columns) and {"te", "t_e"} & set(df.columns)):
        raise ValueError("no start or end among the columns")
    return df.withColumns({"_s": pick("ts", "t_s"), "_e": pick("te", "t_e")}).drop("ts", "te", "t_s", "t_e").withColumnsRenamed({"_s": "ts", "_e": "te"})


def proposals(raw: DataFrame, of: str = "proposals") -> DataFrame:
    """(video_id, pred_id, ts, te, conf) from one row an item with an array of structs in either spelling."""
    fields = raw.schema[of].dataType.elementType.names
    flat = raw.select("video_id", F.posexplode(of).alias("pred_id", "p"))
    pick = lambda *names: F.coalesce(*[F.col(f"p.{n}").cast("double") for n in names if n in fields])
    return flat.select("video_id", F.concat_ws("#", "video_id", "pred_id").alias("pred_id"), pick("ts", "t_s").alias("ts"), pick("te", "t_e").alias("te"), F.coalesce(pick("conf") if "conf" in fields else F.lit(None).cast("double"), F.lit(0.0)).alias("conf"))


class _Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def partitions(self):
        import os

        return [_Shard(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder))]

    def read(self, partition: _Shard):
        import os

        with open(partition.path, "rb") as f:
            data = f.read()
        yield os.path.splitext(os.path.basename(partition.path))[0], len(data), hashlib.sha256(data).hexdigest()


class FolderSource(DataSource):
    """Feature source over a folder on each node: one task a file, (video_id, bytes, sha256)."""

    @classmethod
    def name(cls) -> str:
        return "segquery_folder"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("video_id", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FolderReader(self.options)
