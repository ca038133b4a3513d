"""Shared helpers: table access, durable intermediate tables, Arrow row streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of ids, some 16 bytes each, that are sent to all tasks beside texts instead of shuffling the texts.
BROADCAST_IDS = 1 << 21

#: Open scopes of ``passing``.
_made: list[list[str]] = []

#: Bytes of rows that a Python worker gets at a time while a table is stored, but for a row that is wider alone. Spark's
#: own bound is 10,000 rows, however wide: of sets of shingles or long texts these can be gigabytes.
BATCH_BYTES = 4 << 20

#: What holds while a table is stored.
_WHILE_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="segquery-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: the lineage ends here.

    A lost executor costs a read of the table, not a new computation. The shuffle files that the
    write needed are deleted when it has ended: nothing reads them any more. Python workers get
    ``BATCH_BYTES`` at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/segquery/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WHILE_STORED}
    for k, v in _WHILE_STORED.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for made in _made:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stored within are deleted at the end, but for those that are taken out of the list."""
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)
        jvm = spark.sparkContext._jvm
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def few(ids: DataFrame) -> DataFrame:
    """A stored table of ids, sent to all tasks if it has ``BROADCAST_IDS`` rows or fewer, by count; beyond, joins shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def n_partitions(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so extra columns cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_rows(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: T.StructType | str, chunk: int = 512) -> DataFrame:
    """Apply a generator of output tuples to streams of input tuples, Arrow batch by Arrow batch.

    ``fn`` gets an iterator over the rows of one task and yields tuples in the order of
    ``schema``; at most ``chunk`` output rows are held at once.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, chunk):
                    part = b.slice(at, chunk)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], names)

        for out in fn(rows()):
            held.append(out)
            if len(held) >= chunk:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return df.mapInArrow(run, schema)
