"""Structured Streaming twins of batch operators: each equals its batch form on a finished input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segquery.sources import snapshots

#: Keyed state is kept by RocksDB.
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """``events`` as a stream of its file, with a timestamp in UTC and a watermark for late rows."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    s = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 16).parquet(folder)
    return s.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")


def tumbling(events: DataFrame, length: str) -> DataFrame:
    return events.groupBy(F.window("at", length).alias("w")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.unix_micros("w.start").alias("start_us"), "n", "cents")


def sliding(events: DataFrame, length: str, step: str) -> DataFrame:
    return events.groupBy(F.window("at", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def latest(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("event_id").alias("event_id"))


def append_log(rows: DataFrame, path: str, checkpoint: str, key: str) -> None:
    """Appends each key once for ever to the table at ``path``; a restart goes on behind what was written.

    The keys are the state, without a watermark that would let one come again; it lies in the RocksDB state store, so
    on the executors' disks and in the checkpoint, not in their memory.
    """
    spark = rows.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        _append(rows.dropDuplicates([key]), path, checkpoint)
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def _append(once: DataFrame, path: str, checkpoint: str) -> None:
    once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def upsert_latest(rows: DataFrame, path: str, checkpoint: str, key: str, order: str, buckets: int = 64) -> None:
    """Keeps the last record of each key by ``order`` in the table at ``path``, batch by batch.

    A batch is reduced to one record a key, and those that beat the table's are added as an epoch of its own: an epoch
    that runs again replaces itself. Buckets of keys are partitions, so a batch reads only those that it touches.
    ``latest_records`` reads the table, ``compact`` folds its epochs.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = _last(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r.bucket for r in last.select("bucket").distinct().collect()]  # as many as buckets
            if not touched:
                return
            if _exists(spark, path):
                held = spark.read.parquet(path).where(F.col("bucket").isin(touched) & (F.col("epoch") != epoch))
                last = last.join(_last(held, key, order).select(key, F.col(order).alias("_held")), key, "left").where(F.col("_held").isNull() | (F.col(order) >= F.col("_held"))).drop("_held")
            last.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "bucket").parquet(path)
        finally:
            last.unpersist()

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The record of greatest ``order`` of each key, of equal ones the greatest by its other columns; an aggregate, so a hot key is combined first."""
    rest = [c for c in rows.columns if c not in (key, order)]
    first = [c for c in ("epoch",) if c in rest]
    return rows.groupBy(key).agg(F.max(F.struct(order, *first, *[c for c in rest if c not in first])).alias("_x")).select(*[F.col(c) if c == key else F.col(f"_x.{c}") for c in rows.columns])


def latest_records(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The last record of each key of a table that ``upsert_latest`` writes."""
    return _last(spark.read.parquet(path), key, order).drop("epoch", "bucket")


def compact(spark: SparkSession, path: str, root: str, key: str, order: str) -> dict:
    """The last records as a version of their own under ``root``, published whole."""
    return snapshots.write_atomic(latest_records(spark, path, key, order), root)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def with_dead_letters(rows: DataFrame, bad: Column, good_path: str, bad_path: str, checkpoint: str) -> None:
    """Good rows to one table, rows with ``bad`` true or null to another; a batch that is run again replaces its own rows."""
    def write(batch: DataFrame, epoch: int) -> None:
        told = batch.withColumn("_bad", F.coalesce(bad, F.lit(True))).withColumn("epoch", F.lit(epoch))
        for wrong, path in ((False, good_path), (True, bad_path)):
            told.where(F.col("_bad") == wrong).drop("_bad").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="segquery-")
    return found


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Runs over what is there, in one go, and returns the result table, which the tasks write; nothing goes to the driver."""
    spark = stream.sparkSession
    root = f"{_shared(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/result")

    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not _exists(spark, f"{root}/result"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{root}/result")


def finished_latest(stream: DataFrame, name: str, key: str, order: str) -> DataFrame:
    """``upsert_latest`` over what is there, in one go, and its table read."""
    spark = stream.sparkSession
    root = f"{_shared(spark)}/streams/{name}-{uuid.uuid4().hex}"
    upsert_latest(stream, f"{root}/result", f"{root}/checkpoint", key, order)
    if not _exists(spark, f"{root}/result"):
        return spark.createDataFrame([], stream.schema)
    return latest_records(spark, f"{root}/result", key, order)
