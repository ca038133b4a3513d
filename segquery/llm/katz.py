"""Katz backoff language model: counting, exact normalisation and scoring of all texts.

Words are 64-bit ids (XXH64; the share of words that share an id is about V / 2^64). Tasks
count their documents in batches; counts travel as packed blocks, one for a batch and a bucket
of words, so a frequent word is one entry a batch, not a row an occurrence. The buckets (by the
n-gram's last word) hold the model's partitioned tables:

* words: id, count, backoff weight and denominator; bigrams: history id, word, count.

With Good-Turing discounts d(r) for counts r up to 5, fixed from the counts of counts of all
buckets, a token is scored recursively:

* P(w | h) = d(c(h,w)) c(h,w) / den(h) if the bigram was seen, else alpha(h) P(w)
* P(w) = d(c(w)) c(w) / N if the word was seen, else the mass that discounting left, P(unknown)
* alpha(h) = (1 - sum over seen P(w | h)) / (1 - sum over seen P(w)), so that each history's
  distribution over known words and the unknown word sums to 1. den(h) is c(h), or c(h) + 1
  where no mass would be left.

Defined results: a null text is empty and has one token, its end; a null id is no held-out
document; repeated rows count as rows; without training documents all scores are 0; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, stored, text_or_empty

#: Tokens of a batch: bounds a task's memory (about 60 bytes a token).
BATCH_TOKENS = 1_500_000
#: Counts up to this are discounted.
K = 5
END, START = 1, 2

_ROW = "kind string, batch string, bucket int, block binary, stats array<long>"


# ---------------------------------------------------------------- packed blocks


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block: narrowed, ``d_`` ones as differences, bytes of equal rank together."""
    out = {}
    for name, a in arrays.items():
        if name.startswith("d_"):
            a = np.diff(a.astype(np.uint64), prepend=np.uint64(0))
        if a.dtype.kind in "iu":
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        out[name] = (a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.compress(pickle.dumps(out, 5), 1)


def unpack(block: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, (kind, raw) in pickle.loads(zstandard.decompress(block)).items():
        size = np.dtype(kind).itemsize
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).reshape(-1).view(kind)
        out[name] = np.cumsum(a, dtype=np.uint64) if name in ("d_words", "d_hists") else np.cumsum(a.astype(np.int64)) if name.startswith("d_") else a
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {n: c[k].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}


def _out(kind: str, batch: str, bucket: int, block: bytes, stats: list[int] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([batch]), pa.array([bucket], pa.int32()), pa.array([block], pa.binary()), pa.array([stats], pa.list_(pa.int64()))], ["kind", "batch", "bucket", "block", "stats"])


# ---------------------------------------------------------------- counting


def word_ids(text: str) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    ids = np.fromiter(map(h, words), np.uint64, len(words))
    ids[ids <= START] += np.uint64(3)  # the two least ids stand for the ends of a text
    return ids


def held_out(doc_id: object, folds: int = 7, rest: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == rest


def _count(n_buckets: int, batch_tokens: int):
    def batch_of(name: str, ids: list, texts: list[np.ndarray], held: list[bool]) -> Iterator[pa.RecordBatch]:
        lens = np.array([len(t) for t in texts])
        flat = np.concatenate([np.r_[np.uint64(START), t, np.uint64(END)] for t in texts])
        starts = np.r_[0, np.cumsum(lens + 2)[:-1]]
        u, inv = np.unique(flat, return_inverse=True)
        by_bucket = np.lexsort((u, u % np.uint64(n_buckets)))
        place = np.empty(len(u), np.int64)
        place[by_bucket] = np.arange(len(u))
        u, inv = u[by_bucket], place[inv]
        train = np.repeat(~np.array(held), lens + 2)
        c_word = np.bincount(inv, weights=train, minlength=len(u)).astype(np.int64)  # of the start sign: training texts
        keep = np.ones(len(flat), bool)
        keep[starts] = False
        at = np.nonzero(keep)[0]
        b, b_inv = np.unique(inv[at] * len(u) + inv[at - 1], return_inverse=True)
        c_b = np.bincount(b_inv, weights=train[at], minlength=len(b)).astype(np.int64)
        bw, bh = b // len(u), b % len(u)
        bucket = (u % np.uint64(n_buckets)).astype(np.int64)
        w_edge = np.searchsorted(bucket, np.arange(n_buckets + 1))
        b_edge = np.searchsorted(bw, w_edge)
        for k in np.unique(bucket).tolist():
            ws, bs = slice(w_edge[k], w_edge[k + 1]), slice(b_edge[k], b_edge[k + 1])
            hs, h_at = np.unique(u[bh[bs]], return_inverse=True)
            yield _out("count", name, k, pack(d_words=u[ws], c=c_word[ws], d_w=bw[bs] - w_edge[k], d_hists=hs, h=h_at, cb=c_b[bs]))
        yield _out("text", name, zlib.crc32(name.encode()) % n_buckets, _pack_text(ids, lens, held, inv))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ids, texts, held, size = [], [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(word_ids(text.as_py()))
                held.append(held_out(ids[-1]))
                size += len(texts[-1]) + 2
                if size >= batch_tokens:
                    yield from batch_of(f"{part}-{n}", ids, texts, held)
                    ids, texts, held, size, n = [], [], [], 0, n + 1
        if ids:
            yield from batch_of(f"{part}-{n}", ids, texts, held)

    return run


def _pack_text(ids: list, lens: np.ndarray, held: list[bool], inv: np.ndarray) -> bytes:
    none = np.array([i is None for i in ids])
    return pack(ids=np.array([i or 0 for i in ids], np.int64).view(np.uint64), none=none.astype(np.uint8), lens=lens, held=np.array(held, np.uint8), inv=inv)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one bucket to its table, to counts for every batch, and to counts of counts."""
    for bucket, rows in groupby(_rows(batches), key=lambda r: r["bucket"]):
        names, blocks = [], []
        for r in rows:
            if r["kind"] == "text":
                yield _out("text", r["batch"], bucket, r["block"])
            else:
                names.append(r["batch"])
                blocks.append(unpack(r["block"]))
        if not blocks:
            continue
        words, w_inv = np.unique(np.concatenate([b["d_words"] for b in blocks]), return_inverse=True)
        hists, h_inv = np.unique(np.concatenate([b["d_hists"] for b in blocks]), return_inverse=True)
        w_off, h_off = np.r_[0, np.cumsum([len(b["d_words"]) for b in blocks])], np.r_[0, np.cumsum([len(b["d_hists"]) for b in blocks])]
        key = np.concatenate([w_inv[w + b["d_w"]] * len(hists) + h_inv[h + b["h"].astype(np.int64)] for b, w, h in zip(blocks, w_off, h_off, strict=False)])
        pairs, p_inv = np.unique(key, return_inverse=True)
        c = np.bincount(w_inv, weights=np.concatenate([b["c"] for b in blocks]), minlength=len(words)).astype(np.int64)
        cb = np.bincount(p_inv, weights=np.concatenate([b["cb"] for b in blocks]), minlength=len(pairs)).astype(np.int64)
        p_off = np.r_[0, np.cumsum([len(b["cb"]) for b in blocks])]
        for k, name in enumerate(names):
            at = w_inv[w_off[k] : w_off[k + 1]]
            yield _out("answer", name, bucket, pack(c=c[at], cb=cb[p_inv[p_off[k] : p_off[k + 1]]]))
            yield _out("asked", name, bucket, pack(d_at=at))
        real = c * (words != START)
        on = cb > 0
        stats = [int(real.sum()), int((real > 0).sum())] + [int((real == r).sum()) for r in range(1, K + 2)] + [int((cb == r).sum()) for r in range(1, K + 2)]
        pw, ph = pairs[on] // len(hists), pairs[on] % len(hists)
        yield _out("table", "", bucket, pack(d_words=words, c=c, d_w=pw, d_hists=hists, h=ph, cb=cb[on]), stats)


# ---------------------------------------------------------------- discounts


def discounts(n: list[int], k: int = K) -> np.ndarray:
    """d(0..k+1) from n_1..n_{k+1}: Good-Turing, or absolute discounting where the counts do not allow it; d(k+1) stands for all above."""
    d = np.ones(k + 2)
    if all(n):
        a = (k + 1) * n[k] / n[0]
        d[1 : k + 1] = [((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a) if a != 1 else 0.0 for r in range(1, k + 1)]
        if (d[1 : k + 1] > 0).all() and (d[1 : k + 1] < 1).all():
            return d
    cut = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    d[1 : k + 1] = [(r - cut) / r for r in range(1, k + 1)]
    return d


class Constants:
    """What all buckets need: totals and discounts; a few dozen numbers."""

    def __init__(self, stats: list[int]):
        self.n, self.v = stats[0], stats[1]
        n1, n2 = stats[2 : K + 3], stats[K + 3 :]
        self.d1, self.d2 = discounts(n1), discounts(n2)
        left = float(sum((1 - self.d1[r]) * r * n1[r - 1] for r in range(1, K + 1)))
        self.den = self.n if left > 0 else self.n + 1
        self.unknown = left / self.n if left > 0 else 1 / (self.n + 1)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        return np.where(c > 0, self.d1[np.minimum(c, K + 1)] * c / max(1, self.den), self.unknown)

    def discounted(self, cb: np.ndarray) -> np.ndarray:
        cb = cb.astype(np.int64)
        return self.d2[np.minimum(cb, K + 1)] * cb


# ---------------------------------------------------------------- backoff weights


def _sums(const: Constants, n_buckets: int):
    """For each history in a bucket, sums over its followers there, sent to the history's own bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            t = unpack(r["block"])
            h, hists = t["h"].astype(np.int64), t["d_hists"].astype(np.uint64)
            seen = np.bincount(h, weights=const.discounted(t["cb"]), minlength=len(hists))
            low = np.bincount(h, weights=const.unigram(t["c"])[t["d_w"]], minlength=len(hists))
            on, to = seen > 0, (hists % np.uint64(n_buckets)).astype(np.int64)
            for k in np.unique(to[on]).tolist():
                m = on & (to == k)
                yield _out("sum", str(r["bucket"]), k, pack(d_hists=hists[m], seen=seen[m], low=low[m]))

    return run


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket (table, then sums, then the asking batches) to backoff weights for every batch."""
    for bucket, rows in groupby(_rows(batches), key=lambda r: r["bucket"]):
        words = alpha = den = None
        parts = []

        def solve(parts=parts):
            seen, low = np.zeros(len(words)), np.zeros(len(words))
            for p in parts:
                at = np.searchsorted(words, p["d_hists"])
                seen[at] += p["seen"]
                low[at] += p["low"]
            d = count.astype(np.float64)
            d[(seen > 0) & (d - seen < 1e-9)] += 1
            return np.where(seen > 0, (1 - seen / np.maximum(d, 1)) / (1 - low), 1.0), d

        for r in rows:
            block = unpack(r["block"])
            if r["kind"] == "table":
                words, count = block["d_words"], block["c"]
            elif r["kind"] == "sum":
                parts.append(block)
            else:
                if alpha is None:
                    alpha, den = solve()
                yield _out("weight", r["batch"], bucket, pack(alpha=alpha[block["d_at"]], den=den[block["d_at"]].astype(np.int64)))


# ---------------------------------------------------------------- scoring


def _score(const: Constants):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), key=lambda r: r["batch"]):
            text, answers, weights = None, [], []
            for r in rows:  # by kind, then bucket: so answers are in the order of the batch's own index
                block = unpack(r["block"])
                if r["kind"] == "text":
                    text = block
                else:
                    (answers if r["kind"] == "answer" else weights).append(block)
            c = np.concatenate([a["c"] for a in answers]).astype(np.int64)
            cb = np.concatenate([a["cb"] for a in answers]).astype(np.int64)
            alpha, den = np.concatenate([w["alpha"] for w in weights]), np.concatenate([w["den"] for w in weights]).astype(np.float64)
            inv, lens = text["inv"].astype(np.int64), text["lens"].astype(np.int64)
            starts = np.r_[0, np.cumsum(lens + 2)[:-1]]
            keep = np.ones(len(inv), bool)
            keep[starts] = False
            at = np.nonzero(keep)[0]
            b, b_inv = np.unique(inv[at] * len(c) + inv[at - 1], return_inverse=True)
            bw, bh = b // len(c), b % len(c)
            uni = const.unigram(c)
            p = np.where(cb > 0, const.discounted(cb) / np.maximum(den[bh], 1), alpha[bh] * uni[bw])
            first = np.r_[0, np.cumsum(lens + 1)[:-1]]
            score = np.add.reduceat(np.log10(p)[b_inv], first)
            base = np.add.reduceat(np.log10((c + 1) / (const.n + const.v + 1))[inv[at]], first)
            known = np.add.reduceat((c > 0)[inv[at]].astype(np.int64), first)
            none = text["none"].astype(bool)
            ids = pa.array(text["ids"].astype(np.uint64).view(np.int64), pa.int64(), mask=none)
            yield pa.RecordBatch.from_arrays([ids, pa.array(text["held"].astype(bool)), pa.array(lens + 1), pa.array(known), pa.array(np.full(len(lens), const.n)), pa.array(base), pa.array(score)], names)

    return run


def katz_scores(docs: DataFrame, batch: int = BATCH_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a document.

    Learns from the documents that are not held out; ``base_score`` is the add-one unigram's.
    """
    tables, const = katz_model(docs, batch)
    n_buckets = n_partitions(docs.sparkSession)
    table, asked = tables.where("kind = 'table'"), tables.where("kind = 'asked'")
    sums = table.mapInArrow(_sums(const, n_buckets), _ROW)
    order = F.when(F.col("kind") == "table", 0).when(F.col("kind") == "sum", 1).otherwise(2)
    own = table.unionByName(sums).unionByName(asked)
    weights = own.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", order, "batch").mapInArrow(_weigh, _ROW)
    parts = tables.where("kind in ('answer', 'text')").unionByName(stored(weights))
    return parts.repartition(n_buckets, "batch").sortWithinPartitions("batch", "kind", "bucket").mapInArrow(_score(const), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def katz_model(docs: DataFrame, batch: int = BATCH_TOKENS) -> tuple[DataFrame, Constants]:
    """The partitioned tables and the constants of the model."""
    spark = docs.sparkSession
    n_buckets = n_partitions(spark)
    counted = text_or_empty(docs).mapInArrow(_count(n_buckets, batch), _ROW)
    tables = stored(counted.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(_merge, _ROW), by=("kind",))
    tables = tables.select("kind", "batch", "bucket", "block", "stats")
    sums = tables.where("kind = 'table'").select(F.posexplode("stats").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    stats = [0] * (2 + 2 * (K + 1))
    for r in sums:
        stats[r.k] = r.n
    return tables, Constants(stats)


def ngram_rows(tables: DataFrame) -> DataFrame:
    """The model's tables as rows: (word, history, count); history null for single words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            t = unpack(r["block"])
            w = np.r_[t["d_words"], t["d_words"][t["d_w"]]].astype(np.int64)
            h = np.r_[np.zeros(len(t["d_words"]), np.int64), t["d_hists"][t["h"].astype(np.int64)]].astype(np.int64)
            none = np.r_[np.ones(len(t["d_words"]), bool), np.zeros(len(t["h"]), bool)]
            c = np.r_[t["c"].astype(np.int64), t["cb"].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(w[c > 0]), pa.array(h[c > 0], mask=none[c > 0]), pa.array(c[c > 0])], ["word", "history", "count"])

    return tables.where("kind = 'table'").mapInArrow(run, "word long, history long, count long")
