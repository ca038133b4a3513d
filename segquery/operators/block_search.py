"""Exact top-k search that skips blocks of vectors by a bound.

An index has one row for each block of near vectors: its mean, the radius around the mean, and the vectors. No vector of a
block scores more than ``q . centre + |q| * radius``. A search scores the blocks of highest bound until they hold k
vectors; the k-th score found there is a floor, and only blocks whose bound reaches the floor are scored as well. The
result is that of scoring everything; how much is skipped depends on the data, and ``block_report`` says it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import score_states as K

#: Vectors of a block at most; cells of the index at most, from a sample of as many vectors.
ROWS, CELLS = 1024, 1024
#: Share of a bound that rounding may take.
SLACK = 1e-9


def _nearest(segments: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """``segments`` with the number of the nearest centre and the distance to it."""
    half = (centres**2).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = K._matrix(part.column(part.schema.names.index("emb"))).reshape(part.num_rows, dim)
                cell = (x @ centres.T - half).argmax(1) if len(centres) else np.zeros(part.num_rows, int)
                far = np.sqrt(((x - centres[cell]) ** 2).sum(1)) if len(centres) else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*part.schema.names, "cell", "far"])

    fields = ", ".join(f"{c} {k}" for c, k in segments.dtypes)
    return segments.mapInArrow(run, f"{fields}, cell int, far double")


def vector_blocks(segments: DataFrame, rows: int = ROWS, cells: int = CELLS, seed: int = 0) -> DataFrame:
    """(cell, block, n, centre, radius, seg_row, video_id, ts, te, vectors): the index of ``segments``, a row a block.

    Vectors go to the nearest of a bounded sample of themselves, and each cell is cut into blocks by distance. Cells are
    dealt by ranges of (cell, distance), so that one with any share of the vectors is many tasks' work.
    """
    given = segments.select(*K.COLUMNS, "emb").where("emb is not null")
    size = given.agg(F.count("*").alias("n"), F.max(F.size("emb")).alias("dim")).first()
    step = max(1, size.n // max(1, min(cells, size.n // rows + 1)))
    drawn = given.where(F.pmod(F.xxhash64("seg_row", F.lit(seed)), F.lit(step)) == 0).orderBy("seg_row").limit(2 * cells).select("emb").collect()
    centres = np.unique(K.stacked([r.emb for r in drawn]), axis=0) if drawn else np.zeros((0, 0))
    kinds = dict(given.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def block(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            x = K._matrix(t.column("emb").combine_chunks())
            centre = x.mean(0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
            cell = t.column("cell")[0].as_py()
            name = f"{cell}-{t.column('seg_row')[0].as_py()}"
            lists = [pa.array([t.column(c).to_pylist()], pa.list_(t.schema.field(c).type)) for c in K.COLUMNS]
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([name]), pa.array([t.num_rows], pa.int32()), pa.array([centre.tolist()]), pa.array([radius]), *lists, pa.array([x.tobytes()])], ["cell", "block", "n", "centre", "radius", *K.COLUMNS, "vectors"])

        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            cell = held.column("cell").to_numpy()
            ends = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for lo, hi in itertools.pairwise(ends):
                last = hi == len(cell)  # the last cell may go on
                for at in range(lo, hi, rows):
                    if at + rows <= hi or not last:
                        yield block(held.slice(at, min(rows, hi - at)))
                if last:
                    held = held.slice(hi - (hi - lo) % rows) if hi > lo else None
        if held is not None and held.num_rows:
            yield block(held)

    near = _nearest(given, centres, int(size.dim or 0))
    dealt = near.repartitionByRange("cell", "far", "seg_row").sortWithinPartitions("cell", "far", "seg_row")
    lists = ", ".join(f"{c} array<{kinds[c]}>" for c in K.COLUMNS)
    return dealt.mapInArrow(pack, f"cell int, block string, n int, centre array<double>, radius double, {lists}, vectors binary")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """The index as a table partitioned by cell, so that a search opens only the cells that it needs."""
    blocks.write.mode("overwrite").partitionBy("cell").parquet(path)


class _Asked:
    """The queries as a matrix, size checked, sorted by id."""

    def __init__(self, queries: DataFrame) -> None:
        if not K.fits(queries):
            raise ValueError("more queries than go beside a task: search them in parts")
        rows = sorted(queries.select("query_id", "q_emb").where("q_emb is not null").collect(), key=lambda r: r.query_id)
        self.ids = np.array([r.query_id for r in rows])
        self.matrix = K.stacked([r.q_emb for r in rows])
        self.norms = np.sqrt((self.matrix**2).sum(1))

    def bounds(self, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
        top = self.matrix @ centres.T + self.norms[:, None] * radii[None, :]
        return top + SLACK * (1 + np.abs(top))


def _wanted(asked: _Asked, blocks: DataFrame, k: int, floor: np.ndarray | None) -> DataFrame:
    """(q, cell, block, bound, n): without a floor the blocks of a batch that a query would start with, else those whose bound reaches it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, 4 * K.CELLS // max(len(asked.ids), 1))
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows if len(asked.ids) else 0, step)):
            bound, n = asked.bounds(K._matrix(b.column(2)), b.column(3).to_numpy()), b.column(4).to_numpy()
            if floor is None:
                order = np.argsort(-bound, axis=1, kind="stable")
                size = n[order]
                ahead = np.cumsum(size, axis=1) - size < k
                q, at = np.nonzero(ahead)
                at = order[q, at]
            else:
                q, at = np.nonzero(bound >= floor[:, None])
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), b.column(0).take(pick), b.column(1).take(pick), pa.array(bound[q, at]), b.column(4).take(pick)], ["q", "cell", "block", "bound", "n"])

    return blocks.select("cell", "block", "centre", "radius", "n").mapInArrow(run, "q int, cell int, block string, bound double, n int")


def _scored(asked: _Asked, blocks: DataFrame, wanted: DataFrame, k: int, id_kind: str) -> DataFrame:
    """The k best segments of each wanted (query, block): pairs, with ``q``."""
    kinds = {c: t[6:-1] for c, t in blocks.select(*K.COLUMNS).dtypes}
    lists = wanted.groupBy("block").agg(F.sort_array(F.collect_list("q")).alias("qs"))  # as many as queries
    cells = [r.cell for r in wanted.select("cell").distinct().collect()]  # as many as cells
    opened = blocks.where(F.col("cell").isin(cells)) if cells else blocks.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                b = whole.slice(at, 1)
                qs = b.column(0).flatten().to_numpy()
                x = np.frombuffer(b.column(1)[0].as_buffer(), np.float64).reshape(-1, asked.matrix.shape[1])
                own = [c.flatten() for c in b.columns[2:]]
                score = asked.matrix[qs] @ x.T
                if x.shape[0] > k:
                    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                    q, j = np.nonzero(score >= least)
                    order = np.lexsort((own[0].to_numpy(zero_copy_only=False)[j], -score[q, j], q))
                    q, j = q[order], j[order]
                    first = np.arange(len(q)) - np.searchsorted(q, q) < k
                    q, j = q[first], j[first]
                else:
                    q, j = (a.ravel() for a in np.indices(score.shape))
                pick = pa.array(j)
                yield pa.RecordBatch.from_arrays([pa.array(qs[q].astype(np.int32)), pa.array(asked.ids[qs[q]]), *(c.take(pick) for c in own), pa.array(score[q, j])], ["q", "query_id", *K.COLUMNS, "score"])

    rows = opened.join(lists, "block").select("qs", "vectors", *K.COLUMNS)
    return rows.mapInArrow(run, f"q int, query_id {id_kind}, " + ", ".join(f"{c} {kinds[c]}" for c in K.COLUMNS) + ", score double")


def _best(asked: _Asked, blocks: DataFrame, k: int, floor: np.ndarray, id_kind: str) -> DataFrame:
    """Pairs among which are the k best segments of each query: a task's blocks are scored against the queries whose floor their bound reaches.

    A task keeps k rows of a query, and raises its floor by them; no row for a query and a block leaves it.
    """
    kinds = {c: t[6:-1] for c, t in blocks.select(*K.COLUMNS).dtypes}

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, K.CELLS // max(len(asked.ids), 1))
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows if len(asked.ids) else 0, step)):
            hit = (asked.bounds(K._matrix(b.column(1)), b.column(2).to_numpy()) >= floor[:, None]).any(0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit))], ["cell"])

    cells = [r.cell for r in blocks.select("cell", "centre", "radius").mapInArrow(needed, "cell int").distinct().collect()]  # as many as cells
    opened = blocks.where(F.col("cell").isin(cells)) if cells else blocks.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, held, n_held = floor.copy(), [], 0
        most = 2 * k * len(asked.ids) + (1 << 16)

        def merged() -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
            q, score = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            rows = pa.concat_batches([h[2] for h in held])
            order = np.lexsort((rows.column(0).to_numpy(zero_copy_only=False), -score, q))
            q, score = q[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last, stay = place == k - 1, place < k
            least[q[last]] = np.maximum(least[q[last]], score[last] - SLACK * (1 + np.abs(score[last])))
            return q[stay], score[stay], rows.take(pa.array(order[stay]))

        for whole in batches:
            for at in range(whole.num_rows):
                b = whole.slice(at, 1)
                qs = np.flatnonzero(asked.bounds(K._matrix(b.column(0)), b.column(1).to_numpy())[:, 0] >= least)
                x = np.frombuffer(b.column(2)[0].as_buffer(), np.float64).reshape(-1, asked.matrix.shape[1])
                own = pa.RecordBatch.from_arrays([c.flatten() for c in b.columns[3:]], list(K.COLUMNS))
                step = max(1, K.CELLS // len(x))
                for lo in range(0, len(qs), step):
                    part = qs[lo : lo + step]
                    score = asked.matrix[part] @ x.T
                    i, j = np.nonzero(score >= least[part][:, None])
                    if len(i):
                        held.append((part[i], score[i, j], own.take(pa.array(j))))
                        n_held += len(i)
                    if n_held > most:
                        held = [merged()]
                        n_held = len(held[0][0])
        if held:
            q, score, rows = merged()
            for lo in range(0, len(q), 1 << 14):
                s = slice(lo, lo + (1 << 14))
                yield pa.RecordBatch.from_arrays([pa.array(q[s].astype(np.int32)), pa.array(asked.ids[q[s]]), *rows.slice(lo, 1 << 14).columns, pa.array(score[s])], ["q", "query_id", *K.COLUMNS, "score"])

    found = opened.select("centre", "radius", "vectors", *K.COLUMNS)
    return found.mapInArrow(run, f"q int, query_id {id_kind}, " + ", ".join(f"{c} {kinds[c]}" for c in K.COLUMNS) + ", score double")


def _search(queries: DataFrame, blocks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    asked, kind = _Asked(queries), dict(queries.dtypes)["query_id"]
    ahead = Window.partitionBy("q").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    start = _wanted(asked, blocks, k, None).withColumn("_have", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where(F.col("_have") < k)
    place = Window.partitionBy("q").orderBy(F.desc("score"), "seg_row")
    least = _scored(asked, blocks, start, k, kind).withColumn("_r", F.row_number().over(place)).where(F.col("_r") == k).select("q", "score").collect()  # one row a query
    floor = np.full(len(asked.ids), -np.inf)
    for r in least:
        floor[r.q] = r.score
    floor = floor - SLACK * (1 + np.abs(np.where(np.isfinite(floor), floor, 0.0)))
    wanted = _wanted(asked, blocks, k, floor)  # read by the report alone
    found = _best(asked, blocks, k, floor, kind).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("q")
    return found, wanted


def block_topk(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best segments of each query, as ``vectors.event_topk`` finds them: pairs and ``place``.

    ``blocks``: ``vector_blocks``, kept (``write_blocks``, ``checkpoint`` or ``persist``), for it is read more than once.
    """
    return _search(queries, blocks, k)[0]


def block_report(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """One row (blocks, blocks_read, vectors, pairs_scored, pairs): what a search opens and scores of all there is."""
    wanted = _search(queries, blocks, k)[1]
    every = blocks.agg(F.count("*").alias("blocks"), F.sum("n").alias("vectors"))
    used = wanted.agg(F.count_distinct("block").alias("blocks_read"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs_scored"))
    return every.crossJoin(used).select("blocks", "blocks_read", "vectors", "pairs_scored", (F.col("vectors") * queries.count()).alias("pairs"))  # one row each
