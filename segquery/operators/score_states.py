"""Scores of query vectors against segments, reduced where they are made.

The queries go with each task as one matrix (size checked); Arrow batches of segments, sorted by item within their
partition and put together to blocks, meet it in matrix products, some queries at a time, and only states leave the kernel: the
best segments of a query in an item or in a block, running log-sum-exp, counts, moments. States of any blocks merge with an
aggregate, so an item may lie in any number of tasks and a row for each query and segment exists nowhere. A block's rows do not
depend on the number of queries, so the states of a (query, item) are as many as the blocks that hold the item, and what a kernel
holds is bounded.

A variant is a sum of weighted terms: inner products (a vector column of the segments, named with the query's column in
``sources``), numeric columns of the segments, and under "" a constant. Several variants share one pass and are numbered
in a column ``variant``. ``same`` adds a weight where a query's column equals the segment's item.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segquery.functions import exprs as X
from segquery.functions.hashes import pair_hashes

#: Largest query matrix that goes with a task; more queries use the join form.
BLOCK_BYTES = 64 << 20
#: Scores that a kernel holds at once.
CELLS = 1 << 20
#: Segments and items of a block at most.
BLOCK_ROWS, BLOCK_ITEMS = 1 << 15, 1 << 8
#: Rows of a block of vectors that meets other such blocks.
PAIR_ROWS = 1 << 8
#: Pairs that a task makes where all of them are the result.
TASK_PAIRS = 1 << 24
#: Pairs that a task hashes where a few of them are the result.
HASH_PAIRS = 1 << 26
#: Scores that differ by less than this share of their size are ties: a product's last bits depend on the batch.
TIE = 1e-12
#: Columns that stand beside the score of a segment.
COLUMNS = ("seg_row", "video_id", "ts", "te")

Variant = dict[str, float]
_PLAIN: list[Variant] = [{"emb": 1.0}]
_SOURCES = {"emb": "q_emb"}


def above(score: Column, own: Column) -> Column:
    """Is a score strictly higher, and not by rounding?"""
    return score > own + TIE * (1 + F.abs(own))


def fits(queries: DataFrame, sources: dict[str, str] | None = None) -> bool:
    size = sum((F.size(c) for c in (sources or _SOURCES).values()), F.lit(0))
    return (queries.agg(F.sum(size)).first()[0] or 0) * 8 <= BLOCK_BYTES


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def stacked(vectors: list) -> np.ndarray:
    """Vectors as rows of a matrix, of none an empty one."""
    return np.array(vectors, np.float64).reshape(len(vectors), -1) if vectors else np.zeros((0, 0))


class Batch:
    """The scores [query, segment] of one variant and the segments that they belong to, items one after another."""

    def __init__(self, ids: np.ndarray, rows: pa.RecordBatch, score: np.ndarray, starts: np.ndarray, given: dict[str, np.ndarray]) -> None:
        self.ids, self.rows, self.score, self.starts, self.given = ids, rows, score, starts, given
        self.ends = np.append(starts[1:], rows.num_rows)

    def items(self) -> list[pa.Array]:
        """query_id and video_id of every (query, item), in the order of a ravelled [query, item] array."""
        n = len(self.starts)
        return [pa.array(np.repeat(self.ids, n)), self.rows.column("video_id").take(pa.array(np.tile(self.starts, len(self.ids))))]

    def pairs(self, q: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        """query_id, columns of the segment and score of chosen cells."""
        pick = pa.array(at)
        return [pa.array(self.ids[q]), *(self.rows.column(c).take(pick) for c in COLUMNS), pa.array(self.score[q, at])]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of all batches in blocks of ``BLOCK_ROWS`` and ``BLOCK_ITEMS`` at most, with the first place of each item."""
    def cut(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        whole = pa.concat_batches(held)
        item = whole.column("video_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        for at in range(0, len(starts), BLOCK_ITEMS):
            own = starts[at : at + BLOCK_ITEMS]
            end = starts[at + BLOCK_ITEMS] if at + BLOCK_ITEMS < len(starts) else whole.num_rows
            yield whole.slice(own[0], end - own[0]), own - own[0]

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            if n + part.num_rows > BLOCK_ROWS:
                yield from cut(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield from cut(held)


def _weighted(part: dict[str, np.ndarray], variant: Variant, bonus: np.ndarray | float, shape: tuple[int, int]) -> np.ndarray:
    """The scores of one variant; a term of weight 1 alone is not copied."""
    score = bonus + variant.get("", 0.0)
    for t, w in variant.items():
        if t and w:
            x = part[t] if w == 1 else w * part[t]
            score = x if np.isscalar(score) and score == 0 else score + x
    return score if np.shape(score) == shape else score + np.zeros(shape)


def kernel(queries: DataFrame, segments: DataFrame, reduce: Callable[[Batch], Iterator[list[pa.Array]]], fields: list[T.StructField], *, sources: dict[str, str] | None = None, variants: list[Variant] | None = None, same: tuple[str, float] | None = None, given: tuple[str, ...] = ()) -> DataFrame:
    """What ``reduce`` yields for each batch and variant, as rows of ``fields``; ``given`` are query columns that it reads."""
    sources, named = sources or _SOURCES, variants is not None
    variants = variants or _PLAIN
    own = sorted(set(sources.values()))
    more = (*given, *((same[0],) if same else ()))
    rows = queries.select("query_id", *own, *dict.fromkeys(c for c in more if c != "query_id")).where(" and ".join(f"{c} is not null" for c in own)).collect()  # its size has been checked
    ids = np.array([r.query_id for r in rows])
    matrix = {c: stacked([r[c] for r in rows]) for c in own}
    asked = {c: np.array([r[c] for r in rows]) for c in more}
    terms = sorted({t for v in variants for t in v if t})
    vectors, plain = [t for t in terms if t in sources], [t for t in terms if t not in sources]
    fields = fields + [T.StructField("variant", T.IntegerType())] * named
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in _blocks(batches) if len(ids) else ():
            x = {t: _matrix(b.column(t)).T for t in vectors}
            beside = {t: b.column(t).cast(pa.float64()).to_numpy(zero_copy_only=False)[None, :] for t in plain}
            step = max(1, CELLS // b.num_rows)
            for lo in range(0, len(ids), step):
                q = slice(lo, lo + step)
                own = {c: v[q] for c, v in asked.items()}
                part = {t: matrix[sources[t]][q] @ x[t] for t in vectors} | beside
                bonus = same[1] * (own[same[0]][:, None] == b.column("video_id").to_numpy(zero_copy_only=False)[None, :]) if same else 0.0
                for k, v in enumerate(variants):
                    for got in reduce(Batch(ids[q], b, _weighted(part, v, bonus, (len(ids[q]), b.num_rows)), starts, own)):
                        if len(got[0]):
                            yield pa.RecordBatch.from_arrays([*got, *([pa.array(np.full(len(got[0]), k, np.int32))] * named)], names)

    wanted = segments.select(*dict.fromkeys([*COLUMNS, *vectors, *plain])).where(" and ".join(f"{t} is not null" for t in vectors) or "true")
    return wanted.sortWithinPartitions("video_id", "ts", "seg_row").mapInArrow(run, T.StructType(fields))


def _fields(queries: DataFrame, segments: DataFrame, *columns: str) -> list[T.StructField]:
    return [T.StructField("query_id", queries.schema["query_id"].dataType), *(T.StructField(c, segments.schema[c].dataType) for c in columns)]


_SCORE = T.StructField("score", T.DoubleType())
_COUNT = T.StructField("n", T.LongType())


def item_best(queries: DataFrame, segments: DataFrame, k: int = 1, **options: object) -> DataFrame:
    """Pairs that hold the k best segments of each (query, item), of ties for the first place the earliest by (ts, seg_row)."""
    def reduce(b: Batch) -> Iterator[list[pa.Array]]:
        places = []
        if len(b.starts) == b.rows.num_rows:
            places.append(np.tile(b.starts, (len(b.ids), 1)))
        else:
            for lo, hi in zip(b.starts, b.ends, strict=True):
                part = b.score[:, lo:hi]
                if k == 1:
                    places.append(lo + part.argmax(1)[:, None])
                elif hi - lo <= k:
                    places.append(np.tile(np.arange(lo, hi), (len(b.ids), 1)))
                else:
                    places.append(lo + np.argpartition(-part, k - 1, axis=1)[:, :k])
        at = np.hstack(places)
        yield b.pairs(np.repeat(np.arange(len(b.ids)), at.shape[1]), at.ravel())

    return kernel(queries, segments, reduce, [*_fields(queries, segments, *COLUMNS), _SCORE], **options)


def query_best(queries: DataFrame, segments: DataFrame, k: int, **options: object) -> DataFrame:
    """Pairs that hold the k best segments of each query by (score, seg_row)."""
    def reduce(b: Batch) -> Iterator[list[pa.Array]]:
        n = b.rows.num_rows
        if n <= k:
            yield b.pairs(np.repeat(np.arange(len(b.ids)), n), np.tile(np.arange(n), len(b.ids)))
            return
        least = -np.partition(-b.score, k - 1, axis=1)[:, k - 1 : k]
        q, at = np.nonzero(b.score >= least)
        order = np.lexsort((b.rows.column("seg_row").to_numpy(zero_copy_only=False)[at], -b.score[q, at], q))
        q, at = q[order], at[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k  # ties at the cut
        yield b.pairs(q[first], at[first])

    return kernel(queries, segments, reduce, [*_fields(queries, segments, *COLUMNS), _SCORE], **options)


def every_pair(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """All pairs, of a few queries segment by segment, so that a written result repeats few ids at a time.

    The work is the number of pairs, not the size of the input: segments are dealt to tasks by it, however few files hold them.
    """
    def reduce(b: Batch) -> Iterator[list[pa.Array]]:
        m = b.rows.num_rows
        for lo in range(0, len(b.ids), PAIR_ROWS):
            q = np.arange(lo, min(lo + PAIR_ROWS, len(b.ids)))
            yield b.pairs(np.tile(q, m), np.repeat(np.arange(m), len(q)))

    return kernel(queries, _dealt(queries, segments, TASK_PAIRS), reduce, [*_fields(queries, segments, *COLUMNS), _SCORE])


def _dealt(queries: DataFrame, segments: DataFrame, most: int) -> DataFrame:
    """Segments in tasks of about ``most`` pairs."""
    return segments.repartition(_tasks(queries, segments, most))


def _tasks(queries: DataFrame, segments: DataFrame, most: int) -> int:
    """Tasks of about ``most`` pairs, no fewer than the cores."""
    return max(segments.sparkSession.sparkContext.defaultParallelism, -(-queries.count() * segments.count() // most))


def hash_best(queries: DataFrame, segments: DataFrame, edges: list[float], n: int, seed: object) -> DataFrame:
    """Pairs among which are, of each bin of scores [edges[i], edges[i+1]), the n first in the hash order of ``query_id_seg_row``.

    Every pair is scored and hashed in the kernel; of a block and a bin only pairs up to its n-th hash leave it, ties included. Ids are whole numbers.
    """
    def reduce(b: Batch) -> Iterator[list[pa.Array]]:
        score = b.score.ravel()
        u = pair_hashes(seed, b.ids, b.rows.column("seg_row").to_numpy(zero_copy_only=False)).ravel()
        # most blocks have n pairs of each bin among their lowest hashes; a bin that has not is looked through whole
        low = np.flatnonzero(u <= np.uint32(min(2**32 - 1, 64 * n * len(edges) * 2**32 // len(u))))
        label = np.searchsorted(edges, score[low], "right") - 1
        picked = []
        for k, least in enumerate(edges):
            own = low[label == k]
            if len(own) < n and len(low) < len(u):
                own = np.flatnonzero(~(score < least) & (score < edges[k + 1] if k + 1 < len(edges) else True))
            if len(own) > n:
                own = own[u[own] <= np.partition(u[own], n - 1)[n - 1]]
            picked.append(own)
        at = np.concatenate(picked)
        yield b.pairs(*np.divmod(at, b.rows.num_rows))

    return kernel(queries, _dealt(queries, segments, HASH_PAIRS), reduce, [*_fields(queries, segments, *COLUMNS), _SCORE])


def item_lse(queries: DataFrame, segments: DataFrame, tau: float, **options: object) -> DataFrame:
    """(query_id, video_id, top, total, n): maximum, sum of exp((score - top) / tau), number of segments."""
    def reduce(b: Batch) -> Iterator[list[pa.Array]]:
        n = b.ends - b.starts
        top = np.maximum.reduceat(b.score, b.starts, axis=1)
        total = np.add.reduceat(np.exp((b.score - np.repeat(top, n, axis=1)) / tau), b.starts, axis=1)
        yield [*b.items(), pa.array(top.ravel()), pa.array(total.ravel()), pa.array(np.tile(n, len(b.ids)).astype(np.int64))]

    fields = [T.StructField("top", T.DoubleType()), T.StructField("total", T.DoubleType()), _COUNT]
    return kernel(queries, segments, reduce, [*_fields(queries, segments, "video_id"), *fields], **options)


def own_softmax(queries: DataFrame, segments: DataFrame, own: str, flag: Column, tau: float) -> DataFrame:
    """(query_id, top, total, flagged, n): as ``item_lse``, over the item that a query's column ``own`` names; ``flagged`` sums over the segments with ``flag`` alone, which are ``n``."""
    def reduce(b: Batch) -> Iterator[list[pa.Array]]:
        item, marked = b.rows.column("video_id"), b.rows.column("_flag").to_numpy(zero_copy_only=False) > 0
        for lo, hi in zip(b.starts.tolist(), b.ends.tolist(), strict=True):
            q = np.flatnonzero(b.given[own] == item[lo].as_py())
            if len(q):
                score, hit = b.score[q, lo:hi], marked[lo:hi]
                top = score.max(1)
                e = np.exp((score - top[:, None]) / tau)
                yield [pa.array(b.ids[q]), pa.array(top), pa.array(e.sum(1)), pa.array(e[:, hit].sum(1)), pa.array(np.full(len(q), hit.sum(), np.int64))]

    fields = [*_fields(queries, segments), *(T.StructField(c, T.DoubleType()) for c in ("top", "total", "flagged")), _COUNT]
    given = segments.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("int"))
    return kernel(queries, given, reduce, fields, variants=[{"emb": 1.0, "_flag": 0.0}], given=(own,)).drop("variant")


def item_counts(queries: DataFrame, segments: DataFrame, least: float | str, **options: object) -> DataFrame:
    """(query_id, video_id, n): segments that score ``least`` or more; where it names a query's column, strictly more than that."""
    def reduce(b: Batch) -> Iterator[list[pa.Array]]:
        if isinstance(least, str):
            own = b.given[least].astype(float)[:, None]
            hit = b.score > own + TIE * (1 + np.abs(own))
        else:
            hit = b.score >= least
        n = np.add.reduceat(hit.astype(np.int64), b.starts, axis=1)
        yield [*b.items(), pa.array(n.ravel())]

    asked = (least,) if isinstance(least, str) else ()
    return kernel(queries, segments, reduce, [*_fields(queries, segments, "video_id"), _COUNT], given=asked, **options)


def moments(queries: DataFrame, segments: DataFrame, **options: object) -> DataFrame:
    """(n, mean, m2, least, most) of all scores of a batch; ``merged_moments`` makes one row of them."""
    def reduce(b: Batch) -> Iterator[list[pa.Array]]:
        x = b.score
        yield [pa.array([x.size], pa.int64()), *(pa.array([float(v)]) for v in (x.mean(), ((x - x.mean()) ** 2).sum(), x.min(), x.max()))]

    return kernel(queries, segments, reduce, [_COUNT, *(T.StructField(c, T.DoubleType()) for c in ("mean", "m2", "least", "most"))], **options)


def merged_moments(states: DataFrame, *by: str) -> DataFrame:
    """(n, mean, var, least, most): population moments; the sum of squares is taken around the batches' means."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    spread = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    return states.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), (F.greatest(spread, F.lit(0.0)) / n).alias("var"), F.min("least").alias("least"), F.max("most").alias("most"))


def block_pairs(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """All pairs with their inner products, for any number of queries: blocks of queries meet blocks of segments, each meeting is one matrix product.

    Both sides are dealt to as many parts that a task, one part of each, makes about ``TASK_PAIRS`` pairs, however few files hold them.
    """
    def packed(df: DataFrame, vector: str, columns: list[str]) -> DataFrame:
        kinds = dict(df.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, PAIR_ROWS):
                    b = whole.slice(at, PAIR_ROWS)
                    lists = [pa.array([b.column(c).to_pylist()], pa.list_(b.schema.field(c).type)) for c in columns]
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([_matrix(b.column(vector)).tobytes()], pa.binary())], [*columns, vector])

        fields = ", ".join(f"{c} array<{kinds[c]}>" for c in columns)
        return df.where(f"{vector} is not null").select(*columns, vector).mapInArrow(run, f"{fields}, {vector} binary")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                b = whole.slice(at, 1)
                ids, own = b.column(0).flatten(), [c.flatten() for c in b.columns[2:-1]]
                n, m = len(ids), len(own[0])
                x, y = (np.frombuffer(b.column(k)[0].as_buffer(), np.float64) for k in (1, b.num_columns - 1))
                score = x.reshape(n, -1) @ y.reshape(m, -1).T
                q, at_ = pa.array(np.repeat(np.arange(n), m)), pa.array(np.tile(np.arange(m), n))
                yield pa.RecordBatch.from_arrays([ids.take(q), *(c.take(at_) for c in own), pa.array(score.ravel())], ["query_id", *COLUMNS, "score"])

    parts = math.ceil(math.sqrt(_tasks(queries, segments, TASK_PAIRS)))
    blocks = packed(segments.repartition(parts), "emb", list(COLUMNS))
    both = packed(queries.repartition(parts), "q_emb", ["query_id"]).crossJoin(blocks.hint("shuffle_replicate_nl"))
    return both.select("query_id", "q_emb", *COLUMNS, "emb").mapInArrow(product, T.StructType([*_fields(queries, segments, *COLUMNS), _SCORE]))


def pair_terms(queries: DataFrame, segments: DataFrame, sources: dict[str, str] | None = None, variants: list[Variant] | None = None, same: tuple[str, float] | None = None) -> DataFrame:
    """All pairs with their scores as expressions, for any number of queries: what the kernels reduce."""
    sources = sources or _SOURCES
    every = queries.select("query_id", *sorted({*sources.values()}), *((F.col(same[0]).alias("_same"),) if same else ())).crossJoin(segments)
    bonus = F.when(F.col("_same") == F.col("video_id"), float(same[1])).otherwise(0.0) if same else F.lit(0.0)
    score = lambda v: sum((w * (X.dot(sources[t], t) if t in sources else F.col(t)) for t, w in v.items() if t and w), bonus + v.get("", 0.0))
    if variants is None:
        return every.select("query_id", *COLUMNS, score(_PLAIN[0]).alias("score"))
    each = F.posexplode(F.array(*map(score, variants))).alias("variant", "score")
    return every.select("query_id", *COLUMNS, each).select("query_id", *COLUMNS, "score", "variant")
