"""Connectors that plan: a reader base that prunes units by pushed filters, and tar shards read by an offset index.

``PlannedReader`` turns the filters on the key that Spark pushes down into a set of wanted keys, asks the source
which units hold them, and makes one task of each unit; a task opens its unit alone and yields the wanted members.
``TarShards`` (format ``segquery_tar``) is such a source: an index row says in which shard a member lies, where and how long,
so a task seeks to its members and reads nothing else. The index is a table that ``index_shards`` makes on the executors.
"""

from __future__ import annotations

import hashlib
import json
import os
from abc import abstractmethod
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Python sources get filters only where the session allows it.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Unit(InputPartition):
    """One task's work: a shard and its wanted members."""

    def __init__(self, name: str, members: list[tuple]) -> None:
        self.name, self.members = name, members


class PlannedReader(DataSourceReader):
    """Base of readers whose units are pruned by a key."""

    def __init__(self, key: str) -> None:
        self.key, self.wanted = key, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            got = None
            if isinstance(f, EqualTo) and f.attribute == (self.key,):
                got = {f.value}
            elif isinstance(f, In) and f.attribute == (self.key,):
                got = set(f.value)
            if got is None:
                yield f
            else:
                self.wanted = got if self.wanted is None else self.wanted & got

    @abstractmethod
    def units(self, wanted: set | None) -> list[Unit]:
        """The units that hold wanted members (None: all), each with those members."""

    @abstractmethod
    def members(self, unit: Unit) -> Iterator[tuple]:
        """Rows of a unit's members."""

    def partitions(self) -> list[Unit]:
        return self.units(self.wanted) or [Unit("", [])]

    def read(self, partition: Unit) -> Iterator[tuple]:
        return self.members(partition) if partition.name else iter(())


class _TarReader(PlannedReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__("video_id")
        self.folder, self.index = options["path"], options.get("index") or os.path.join(options["path"], "index.json")

    def units(self, wanted: set | None) -> list[Unit]:
        by: dict[str, list[tuple]] = {}
        with open(self.index, encoding="utf-8") as f:
            for line in f:
                r = json.loads(line)
                if wanted is None or r["video_id"] in wanted:
                    by.setdefault(r["shard"], []).append((r["offset"], r["size"], r["video_id"]))
        return [Unit(shard, sorted(members)) for shard, members in sorted(by.items())]

    def members(self, unit: Unit) -> Iterator[tuple]:
        with open(os.path.join(self.folder, unit.name), "rb") as f:
            for offset, size, video_id in unit.members:
                f.seek(offset)
                data = f.read(size)
                if len(data) != size:
                    raise OSError(f"{unit.name} is shorter than its index says")
                yield video_id, unit.name, data, hashlib.sha256(data).hexdigest()


class TarShards(DataSource):
    """(video_id, shard, content, sha256) of the members of tar files in a folder that all nodes mount."""

    @classmethod
    def name(cls) -> str:
        return "segquery_tar"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("video_id", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("sha256", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TarReader(self.options)


def index_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, shard, offset, size) of all regular members of the tar files in a folder, first one of a name; one task a file.

    Only headers are read. A member's item is its base name without extension.
    """
    def scan(rows: Iterator) -> Iterator:
        import tarfile

        import pandas as pd

        for pdf in rows:
            for path in pdf.path:
                found = []
                with tarfile.open(path.removeprefix("file:"), "r:") as t:
                    for m in t:
                        if m.isfile():
                            found.append((os.path.splitext(os.path.basename(m.name))[0], os.path.basename(path), m.offset_data, m.size))
                yield pd.DataFrame(found, columns=["video_id", "shard", "offset", "size"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(folder).select("path")
    every = files.repartition(max(1, files.count())).mapInPandas(scan, "video_id string, shard string, offset long, size long")
    first = F.min(F.struct("shard", "offset", "size")).alias("x")
    return every.groupBy("video_id").agg(first).select("video_id", "x.*")


def read_shards(spark: SparkSession, folder: str, items: list[str] | None = None, index: str | None = None) -> DataFrame:
    """The members of a folder's shards; with ``items`` only the shards that hold one of them are opened."""
    spark.dataSource.register(TarShards)
    spark.conf.set(PUSHDOWN, "true")
    rows = spark.read.format("segquery_tar").option("path", folder)
    rows = (rows.option("index", index) if index else rows).load()
    return rows if items is None else rows.where(F.col("video_id").isin(items))
