"""Prefix trie of conversations: which turns are shared, by how many, and what sharing them would save.

Every conversation becomes a chain of SHA-256 digests, one for each prefix, each over the digest before it and the next
turn; equal digests are equal prefixes. All prefixes are exploded and grouped by (depth, digest): these are the nodes.
For sums over subtrees each node goes to all its ancestors. The nodes whose smallest member is the same conversation
are the lower end of that conversation's path, so they are summed along it first and leave for the ancestors above as
one row: as many rows as there are prefixes, not their square. Groups are aggregated before they are shuffled; the
turns of one conversation pass through a task as a stream.

Defined results: turns are ordered by turn (null first), of equal turns by role and text; null role or text is empty;
rows without a conv_id belong to no conversation; repeated rows are turns of their own; without conversations there is
no root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, n_partitions, stored

#: The digest of the node without turns.
ROOT = hashlib.sha256(b"").digest()
#: Bytes of decimal ids that one row holds.
ENDS = 1 << 18


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, role, text): the turns of each conversation, numbered from 1."""
    empty = F.lit("")
    given = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return given.select("conv_id", F.row_number().over(order).alias("depth"), "role", "text")


def rebuilt(turns: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, depth, role, text): each conversation c under the first turns of conversation c - c % ``block``.

    crc32(decimal c) % ``heads`` turns are taken from there, c's own turns after its first as many follow. A conversation
    that has no turn left has one row of depth 0 without role and text.
    """
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("own")).withColumn("h", first).withColumn("base", F.expr(f"conv_id - conv_id % {block}"))
    base = turns.where(F.col("depth") < heads).select(F.col("conv_id").alias("base"), "depth", "role", "text")
    taken = convs.join(base, "base").where("depth <= h").select("conv_id", "depth", "role", "text")
    have = turns.groupBy("conv_id").agg(F.max("depth").alias("has")).select(F.col("conv_id").alias("base"), "has")
    short = convs.join(have, "base", "left").select("conv_id", "own", "h", F.least(F.coalesce("has", F.lit(0)), "h").alias("n"))
    kept = turns.withColumn("h", first).where("depth > h").join(short.select("conv_id", "n"), "conv_id").select("conv_id", (F.col("depth") - F.col("h") + F.col("n")).alias("depth"), "role", "text")
    bare = short.where("n = 0 and own <= h").select("conv_id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    numbered = F.col("depth").cast("int").alias("depth")
    return taken.select("conv_id", numbered, "role", "text").unionByName(kept.select("conv_id", numbered, "role", "text")).unionByName(bare)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, size, is_end): every prefix of every conversation, the empty one too.

    node and parent are the chained digests, size the code points of the last turn's text.
    """

    def chain(rows: Iterator[tuple]) -> Iterator[tuple]:
        last: tuple | None = None
        for conv_id, depth, role, text in rows:
            if last is None or last[0] != conv_id:
                if last is not None:
                    yield *last, True
                last = (conv_id, 0, ROOT, None, 0)
            if depth:
                yield *last, False
                who, said = role.encode(), text.encode()
                node = hashlib.sha256(last[2] + struct.pack("<QQ", len(who), len(said)) + who + said).digest()
                last = (conv_id, last[1] + 1, node, last[2], len(text))
        if last is not None:
            yield *last, True

    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.select("conv_id", "depth", "role", "text").repartition(n_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "depth")
    return map_rows(dealt, chain, f"conv_id {kind}, depth int, node binary, parent binary, size long, is_end boolean", chunk=4096)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the ids that end at a node, ascending, comma-joined.

    Ids are dealt by ranges of (node, id), so a node's ids may be many tasks' work; each sends them on
    packed, and only packed rows of a node meet.
    """

    def pack(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, first, ids, size = None, None, [], 0
        for node, conv_id in rows:
            if node != key or size > ENDS:
                if ids:
                    yield key, first, zlib.compress(",".join(ids).encode(), 1)
                key, first, ids, size = node, conv_id, [], 0
            ids.append(str(conv_id))
            size += len(ids[-1]) + 1
        if ids:
            yield key, first, zlib.compress(",".join(ids).encode(), 1)

    def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, running = None, None
        for node, _, packed in rows:
            if node != key:
                if running:
                    yield key, running.hexdigest()
                key, running = node, hashlib.sha256()
            else:
                running.update(b",")
            running.update(zlib.decompress(packed))
        if running:
            yield key, running.hexdigest()

    n, kind = n_partitions(ends.sparkSession), ends.schema["conv_id"].dataType.simpleString()
    packed = map_rows(ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id"), pack, f"node binary, first {kind}, ids binary", chunk=64)
    return map_rows(packed.repartition(n, "node").sortWithinPartitions("node", "first"), digest, "node binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node; turns as ``turns_of`` or ``rebuilt`` returns them.

    (node, depth, parent, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): conv_id is
    the smallest member, saved_tokens what storing each node's last text once saves in the node's subtree.
    """
    steps = stored(prefixes(turns))
    nodes = stored(steps.groupBy("depth", "node", "parent", "size").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = _end_digests(steps.where("is_end").select("node", "conv_id"))

    # an owner's nodes are the lower end of its path: sums from below, then the whole to every prefix above the first
    path = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    full = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = stored(full.withColumn("leaves", F.sum((F.col("n_children") == 0).cast("long")).over(path)).withColumn("saved", F.sum((F.col("n_convs") - 1) * F.col("size")).over(path)))
    tops = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("leaves").alias("leaves"), F.max("saved").alias("saved"))
    above = steps.select("conv_id", "depth", "node").join(tops, "conv_id").where("depth < top").groupBy("node").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))

    # a node's parent has the same owner, but for the first that an owner has
    parents = tops.where("top > 0").select("conv_id", F.col("top").alias("depth")).join(own.select("conv_id", "depth", "parent"), ["conv_id", "depth"])
    owners = parents.join(own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent").select("conv_id", "depth", "parent_conv_id")
    summed = own.join(above, "node", "left").join(ends, "node", "left").join(owners, ["conv_id", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return summed.select(
        "node", F.col("depth").cast("long").alias("depth"), "parent", "conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
