"""Tables with versions: written whole, checked, then published by swapping one pointer file.

``root/version=<digest>/split=<name>`` holds a version, ``MANIFEST.json`` beside it what it was made of and what it holds,
and ``root/CURRENT`` names the version that readers see. A writer works in a folder of its own until its splits have
been checked; the last step is one rename, so readers see the old version or the new one whole, wherever a
writer dies. Versions are named by content: installing equal content again writes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segquery.operators.analysis import fingerprint


class IncompleteVersion(ValueError):
    """A version lacks items, or what was written is not what was given."""


class _Files:
    """What a version needs of the file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def read(self, at: str) -> str | None:
        if not self.fs.exists(self.path(at)):
            return None
        stream = self.fs.open(self.path(at))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, at: str, text: str) -> None:
        """The file as a whole: under another name first, then renamed over the old one."""
        part = f"{at}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.swap(part, at)

    def swap(self, part: str, at: str) -> None:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(at).toUri() if self.path(at).toUri().getScheme() else self.fs.getUri(), self.conf)
        over = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        gate = self.jvm.java.lang.reflect.Array.newInstance(over.getClass(), 1)
        gate[0] = over
        context.rename(self.path(part), self.path(at), gate)

    def move(self, part: str, at: str) -> bool:
        return self.fs.rename(self.path(part), self.path(at))

    def drop(self, at: str) -> None:
        self.fs.delete(self.path(at), True)


def whole_line(df: DataFrame) -> Column:
    """A row as text, for fingerprints: its columns by name."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def hash_of(df: DataFrame) -> str:
    """SHA-256 of a table's rows, whatever their order and partitions."""
    return fingerprint(df, whole_line(df)).first().digest


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the version that readers see; None before the first."""
    files = _Files(spark, root)
    name = files.read(f"{root}/CURRENT")
    return None if name is None else json.loads(files.read(f"{root}/version={name.strip()}/MANIFEST.json"))


def current(spark: SparkSession, root: str, split: str) -> DataFrame:
    """A split of the version that readers see."""
    known = manifest(spark, root)
    if known is None or split not in known["splits"]:
        raise FileNotFoundError(f"{root} has no version with split {split!r}")
    return spark.read.parquet(f"{root}/version={known['version']}/split={split}")


def _check(name: str, given: DataFrame, needs: DataFrame | None, key: str) -> None:
    if needs is not None:
        lost = needs.select(key).distinct().join(given, key, "left_anti")
        few = [r[0] for r in lost.orderBy(key).limit(5).collect()]
        if few:
            raise IncompleteVersion(f"split {name!r} lacks {lost.count()} of its items, among them {few}")


def commit(spark: SparkSession, root: str, splits: dict[str, DataFrame], *, inputs: dict[str, str] | None = None, needs: dict[str, DataFrame] | None = None, key: str = "video_id", settings: dict | None = None) -> dict:
    """Publishes a version of ``splits`` and returns its manifest.

    ``needs``: items (a column ``key``) that a split must hold; ``inputs``: hashes of what the splits were made from.
    The hashes of the outputs name the version, and are compared with what was written before it is published.
    """
    files = _Files(spark, root)
    for name, df in splits.items():
        _check(name, df, (needs or {}).get(name), key)
    outputs = {name: fingerprint(df, whole_line(df)).first() for name, df in splits.items()}
    text = json.dumps({n: o.digest for n, o in sorted(outputs.items())})
    version = spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0][:16]
    told = {"version": version, "inputs": inputs or {}, "settings": settings or {}, "splits": {n: {"rows": o.n or 0, "sha256": o.digest} for n, o in outputs.items()}}
    at = f"{root}/version={version}"
    if files.read(f"{at}/MANIFEST.json") is None:
        part = f"{root}/.pending-{uuid.uuid4().hex}"
        try:
            for name, df in splits.items():
                df.write.parquet(f"{part}/split={name}")
                if hash_of(spark.read.schema(df.schema).parquet(f"{part}/split={name}")) != outputs[name].digest:
                    raise IncompleteVersion(f"split {name!r} was not written as it was given")
            files.write(f"{part}/MANIFEST.json", json.dumps(told, sort_keys=True))
            if not files.move(part, at) and files.read(f"{at}/MANIFEST.json") is None:
                raise OSError(f"cannot rename {part}")
        finally:
            files.drop(part)
    else:
        files.write(f"{at}/MANIFEST.json", json.dumps(told, sort_keys=True))  # equal content of other inputs
    files.write(f"{root}/CURRENT", version)
    return told


def ensure(spark: SparkSession, root: str, inputs: dict[str, DataFrame], build: Callable[[], dict[str, DataFrame]], **options: object) -> dict:
    """The manifest of a version made from ``inputs`` as they are: the current one, or a new one that ``build`` makes."""
    hashes = {n: hash_of(df) for n, df in inputs.items()}
    known = manifest(spark, root)
    if known is not None and known["inputs"] == hashes and known["settings"] == (options.get("settings") or {}):
        return known
    return commit(spark, root, build(), inputs=hashes, **options)


def prune(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Deletes what no reader sees: pending folders, and versions but the current one and the ``keep`` - 1 newest others."""
    files = _Files(spark, root)
    now = (files.read(f"{root}/CURRENT") or "").strip()
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in files.fs.listStatus(files.path(root)) if s.isDirectory()), reverse=True)
    old = [n for _, n in found if n.startswith("version=") and n != f"version={now}"][max(keep - 1, 0) :]
    gone = old + [n for _, n in found if n.startswith(".pending-")]
    for n in gone:
        files.drop(f"{root}/{n}")
    return sorted(gone)


def write_atomic(df: DataFrame, root: str) -> dict:
    """A table of one split, ``all``, replaced as a whole; ``current(spark, root, "all")`` reads it."""
    return commit(df.sparkSession, root, {"all": df})
