"""Removal of repeated substrings by bucket-pointer refinement.

Every byte is removed that a ``length``-byte string covers which also starts elsewhere. Strings
are put in buckets and buckets are refined, as a suffix sorter of this kind does:

1. Initial buckets are q-grams (q = length / 4). Of the q-grams in a string only the one of least
   hash stands for it; equal strings choose the same at the same place. So a text of n bytes
   enters about 2 n / (length - q) of its q-grams, and a bucket of one is finished: none of its
   strings is repeated.
2. The strings of the other buckets are refined where the bucket lies: a position's bucket of
   2q bytes is the pair of its q-bucket and the q-bucket q bytes further on, and the pair of
   2q-buckets, so made, gives the bucket of 4q bytes. Members of buckets of one drop out at each
   depth. Groups of one final bucket with two starts are repeated strings.
3. Buckets with over ``HOT`` members (a passage that very many texts share) are refined as
   tables, so no task holds such a bucket. The members' starts are taken in ranges at equal
   distances from the q-gram. Members are bucketed by the bytes that all strings of a range hold
   (alone there: none of them is repeated) and by the bytes that any of them holds (not alone:
   all of them are repeated); what neither decides is bucketed again with ranges a quarter as
   wide. A passage costs its members a few rows at its two ends, whatever its length.

Texts that are equal as a whole are one text with a number of copies. Strings are compared by
64-bit hashes of q bytes and, in step 3, by 128-bit hashes.

Defined results: null text is empty; shorter texts than ``length`` lose nothing; copies of a
text of at least ``length`` bytes are removed wholly; repeated rows are copies; null ids are
kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored, text_or_empty

LENGTH = 400
#: Members of an initial bucket beyond which it is refined as a table.
HOT = 4_000
#: Bytes of context that are refined at a time; a bucket is never split.
CHUNK = 3_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.frombuffer(hashlib.shake_256(b"byte values").digest(2048), np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2^64, kept for texts of usual size."""
    key = f"{base}"
    got = _powers.get(key)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 17), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 1 << 22:
            _powers[key] = got
    return got[:n]


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each position, by differences of running sums."""
    n = len(data)
    if n < q:
        return np.zeros(0, np.uint64)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=run[1:])
    h = (run[q:] - run[:-q]) * _power(_INVERSE, n - q + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of the q-grams that stand for the strings of a text."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    h, w = gram_hashes(data, q), length - q + 1
    chosen = np.empty(n, np.int64)
    step = 1 << 22
    for s in range(0, n, step):  # places within a stretch fit the low 24 bits
        part = h[s : s + step + w - 1]
        rank = (part & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(part), dtype=np.uint64)
        fill = np.full(-(-len(part) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        fill[: len(part)] = rank
        box = fill.reshape(-1, w)
        left = np.minimum.accumulate(box, 1).ravel()
        right = np.minimum.accumulate(box[:, ::-1], 1)[:, ::-1].ravel()
        m = min(step, n - s)
        chosen[s : s + m] = s + (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.nonzero(np.r_[True, chosen[1:] != chosen[:-1]])[0]
    place = chosen[first]
    return h[place], place, first, np.r_[first[1:] - 1, n - 1]


def repeated_starts(contexts: list[bytes], length: int, q: int) -> Iterator[np.ndarray]:
    """For each context, whether the string at each of its starts begins at another start too.

    A context holds all bytes of its strings. Buckets are refined from q to 2q to 4q = length
    bytes by sorting pairs of bucket numbers; positions in buckets of one are dropped.
    """
    sizes = np.array([len(c) for c in contexts])
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(flat))  # bytes up to the context's end
    grams = gram_hashes(flat, q)
    bucket = np.full(len(flat), -1, np.int64)
    at = np.nonzero(room[: len(grams)] >= q)[0]
    _, bucket[at], count = np.unique(grams[at], return_inverse=True, return_counts=True)
    alive = np.zeros(len(flat), bool)
    alive[at] = count[bucket[at]] > 1
    depth = q
    while depth < length:
        at = np.nonzero(alive & (room >= 2 * depth))[0]
        at = at[alive[at + depth]]  # a string is repeated only if its later part is
        pair = bucket[at] * (bucket.max(initial=0) + 1) + bucket[at + depth]
        deeper, kept = np.full(len(flat), -1, np.int64), np.zeros(len(flat), bool)
        _, deeper[at], count = np.unique(pair, return_inverse=True, return_counts=True)
        # at full depth each start stands once, so two members are two places; before, overlapping contexts may repeat a place
        kept[at] = count[deeper[at]] > 1
        bucket, alive, depth = deeper, kept, 2 * depth
    for s, e in zip(ends - sizes, ends, strict=True):
        yield alive[s : e - length + 1]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return list(zip(np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist(), strict=True))


def crowded_runs(texts: DataFrame, length: int, q: int, hot: int) -> DataFrame:
    """(uid, runs): runs (s, e) of repeated starts in the buckets of over ``hot`` members of ``texts`` (uid, text, a).

    Members with the same bytes around them are one context with a number of places, which is
    judged once; a line that a text repeats without end has few of them.
    """
    far = length - q  # of a start from its q-gram
    widths = [1, *(2 * 4**k for k in range(32) if 2 * 4**k <= length // 3)][::-1]

    def around(rows: Iterator[tuple]) -> Iterator[tuple]:
        for uid, text, a in rows:
            raw = text.encode("utf-8", "surrogatepass")
            found: dict[bytes, tuple[int, int, int, bytes, list[int]]] = {}
            for x in a:
                if x["members"] > hot:
                    p = x["place"]
                    shape = min(p, far), p - x["hi"], p - x["lo"]
                    context = raw[max(0, p - far) : p + length]
                    found.setdefault(xxhash.xxh128_digest(f"{shape}".encode() + context), (*shape, context, []))[4].append(p)
            for cid, (before, least, most, context, places) in found.items():
                yield uid, cid, before, least, most, context, places

    laid = stored(map_rows(texts.select("uid", "text", "a"), around, "uid binary, cid binary, before int, least int, most int, context binary, places array<int>", 256))
    one = [F.first(c).alias(c) for c in ("before", "least", "most", "context")]  # equal for one cid
    held = stored(laid.groupBy("cid").agg(F.sum(F.size("places")).alias("n"), *one))
    reach = held.select("cid", "least", "most")
    first = F.col("least") - F.col("least") % widths[0]
    todo = held.withColumn("todo", F.sequence(first, F.col("most"), F.lit(widths[0])))
    out: list[DataFrame] = []
    for depth, width in enumerate(widths):

        def keys(rows: Iterator[tuple], width: int = width) -> Iterator[tuple]:
            def key(data: bytes, seed: int) -> tuple[int, int]:
                k = xxhash.xxh128_intdigest(data, seed)
                return (k & (2**64 - 1)) - 2**63, (k >> 64) - 2**63

            for cid, n, before, context, todo in rows:
                for d in todo:
                    last = min(d + width - 1, far)
                    all_hold = key(context[before - d : before - last + length], 2 * d)
                    whole = before >= last and before - d + length <= len(context)
                    any_holds = all_hold if width == 1 else key(context[before - last : before - d + length], 2 * d + 1) if whole else (None, None)
                    yield cid, n, d, *all_hold, *any_holds

        leaves = stored(map_rows(todo.select("cid", "n", "before", "context", "todo"), keys, "cid binary, n long, d int, i1 long, i2 long, o1 long, o2 long", 2048))
        # equal bytes are judged once: a group of two places or more is repeated, whatever its size
        groups = stored(leaves.where("o1 is not null").groupBy("o1", "o2", "i1", "i2").agg(F.sum("n").alias("n"), F.min(F.struct("cid", "d")).alias("x")))
        # tables of their own, so that the joins have plain exchanges on both sides and hot keys are split
        again = stored(groups.where("n > 1").select("o1", "o2", "x"))
        whole = leaves.join(again.select("o1", "o2"), ["o1", "o2"]).join(reach, "cid")
        out.append(whole.select("cid", (-F.least(F.lit(width - 1) + F.col("d"), "most")).alias("s"), (-F.greatest("d", "least")).alias("e")))
        if width == 1:
            break
        cut_off = leaves.where("o1 is null").select("cid", "n", "d", "i1", "i2")  # by the text's ends
        shared = stored(groups.select("i1", "i2", "n").unionByName(cut_off.select("i1", "i2", "n")).groupBy("i1", "i2").agg(F.sum("n").alias("n")).where("n > 1").select("i1", "i2"))
        alone = groups.where("n = 1").select("x.*", "i1", "i2").unionByName(cut_off.drop("n")).join(shared, ["i1", "i2"]).select("cid", "d")
        step = widths[depth + 1]
        # one of the contexts with the same bytes stays, for those that share only a part with it
        parts = alone.unionByName(again.select("x.*"))
        parts = parts.select("cid", F.explode(F.sequence("d", F.col("d") + width - step, F.lit(step))).alias("d"))
        parts = parts.join(reach, "cid").where((F.col("d") <= F.col("most")) & (F.col("d") + step > F.col("least")))
        parts = parts.groupBy("cid").agg(F.collect_list("d").alias("todo"))  # at most a context's own ranges
        todo = stored(held.join(parts, "cid"))
        if todo.isEmpty():
            break
    runs = out[0]
    for more in out[1:]:
        runs = runs.unionByName(more)
    ranges = stored(runs.groupBy("cid").agg(F.collect_list(F.struct("s", "e")).alias("ranges")))  # at most a context's own starts
    at = F.flatten(F.transform("places", lambda p: F.transform("ranges", lambda r: F.struct((p + r["s"]).alias("s"), (p + r["e"]).alias("e")))))
    return laid.select("uid", "cid", "places").join(ranges, "cid").select("uid", at.alias("runs"))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of ``docs``."""
    q = length // 4
    if q * 4 != length:
        raise ValueError("length must be a multiple of 4")

    def first_pass(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            raw = text.encode("utf-8", "surrogatepass")
            h, place, lo, hi = anchors(np.frombuffer(raw, np.uint8), length, q)
            yield doc_id, xxhash.xxh128_digest(raw), len(raw), hashlib.sha256(raw).hexdigest(), h.view(np.int64).tolist(), place.tolist(), lo.tolist(), hi.tolist()

    seen = stored(map_rows(text_or_empty(docs), first_pass, "doc_id long, uid binary, n_bytes long, sha string, h array<long>, place array<int>, lo array<int>, hi array<int>", 512))
    texts = stored(seen.groupBy("uid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")))
    # anchors of one row for each distinct text
    one = seen.where(F.size("h") > 0).dropDuplicates(["uid"])
    flat = stored(one.select("uid", F.explode(F.arrays_zip("h", "place", "lo", "hi")).alias("a")).select("uid", "a.*"))
    # a table of its own, so that the join has plain exchanges on both sides and hot q-grams are split
    shared = stored(flat.groupBy("h").agg(F.count("*").alias("members")).where("members > 1"))
    live = flat.join(shared, "h").groupBy("uid").agg(F.collect_list(F.struct("h", "members", "place", "lo", "hi")).alias("a"))  # at most a text's own anchors

    def keyed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, xxhash.xxh128_digest(text.encode("utf-8", "surrogatepass")), text

    least = F.lit(-(2**63))  # stands for a null id, so that the keys below are plain columns
    reps = live.join(texts.select("uid", F.coalesce("rep", least).alias("row")), "uid")
    own = map_rows(text_or_empty(docs).where(F.octet_length("text") >= length), keyed, "doc_id long, uid binary, text string", 512)
    own = own.select("uid", F.coalesce("doc_id", least).alias("row"), "text")
    found = stored(own.join(reps, ["uid", "row"]).dropDuplicates(["uid", "row"]).select("uid", "text", "a"))

    def contexts(rows: Iterator[tuple]) -> Iterator[tuple]:
        for uid, text, a in rows:
            raw = text.encode("utf-8", "surrogatepass")
            for x in a:
                if x["members"] <= hot:
                    yield x["h"], uid, x["lo"], raw[x["lo"] : x["hi"] + length]

    def refine(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, size, last = [], 0, None

        def flush() -> Iterator[tuple]:
            for (_, uid, lo, _), flags in zip(held, repeated_starts([x[3] for x in held], length, q), strict=True):
                for s, e in _runs(flags):
                    yield uid, lo + s, lo + e

        for row in rows:
            if size >= chunk and row[0] != last:
                yield from flush()
                held.clear()
                size = 0
            last = row[0]
            held.append(row)
            size += len(row[3])
        if held:
            yield from flush()

    parts = map_rows(found, contexts, "h long, uid binary, lo int, context binary", 512)
    runs = map_rows(parts.repartition("h").sortWithinPartitions("h"), refine, "uid binary, s int, e int", 2048)

    spans = runs.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    crowded = found.where(F.exists("a", lambda x: x["members"] > hot))
    if not crowded.isEmpty():
        spans = spans.unionByName(crowded_runs(crowded, length, q, hot))
    spans = spans.groupBy("uid").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"))  # at most a text's own starts

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for uid, text, runs in rows:
            raw = text.encode("utf-8", "surrogatepass")
            kept, at, removed, n = hashlib.sha256(), 0, 0, 0
            for r in runs:  # starts s..e remove the bytes s..e+length-1
                s, e = r["s"], r["e"] + length
                if s > at or not n:
                    kept.update(raw[at:s])
                    n += 1
                    at = s
                removed += max(0, e - at)
                at = max(at, e)
            kept.update(raw[at:])
            yield uid, removed, n, kept.hexdigest()

    partly = map_rows(found.join(spans, "uid").select("uid", "text", "runs"), cut, "uid binary, n_removed long, n_spans long, kept string", 512)
    verdict = texts.join(partly, "uid", "left").select("uid", "copies", "n_removed", "n_spans", "kept")
    out = seen.select("doc_id", "uid", "n_bytes", "sha").join(verdict, "uid", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
