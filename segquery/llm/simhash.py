"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint sets a bit where over half of the shingle hashes set it. Two fingerprints within
``radius`` bits have a common point within half the radius of both, so every distinct
fingerprint emits all points of its ball of half the radius, points are shuffled, and those that
meet there are compared bit by bit. At most ``1 + bits`` (for radius 2) distinct fingerprints
can share a point, whatever the number of copies: documents with one fingerprint are one
vertex.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked
like any other; with fewer words than a shingle, the whole sequence is one shingle; repeated
rows are copies of each other. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, map_rows, passing, stored, text_or_empty
from .graph import components

SEED = 42


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, seed)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    return np.array([h(joined[s:e], seed) for s, e in zip(starts, ends[size - 1 :], strict=True)], np.uint64)


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, unsigned."""
    if not len(hashes):
        return 0
    per_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    set_in = (per_byte @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * set_in > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, _signed(fingerprint(shingle_hashes(words_of(text), words)))

    return map_rows(text_or_empty(docs), run, "doc_id long, fp long", 2048)


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` set bits."""
    return [_signed(sum(1 << k for k in c)) for r in range(radius + 1) for c in combinations(range(bits), r)]


def ball_links(values: DataFrame, bits: int = 64, radius: int = 2, key: str = "fp", ahead: int = 1) -> DataFrame:
    """(a, b): pairs of distinct values of ``key`` within ``radius`` bits, enough to connect all such pairs.

    Values that meet in a point follow one another in order there, and neighbours are paired
    (each with the next ``ahead``); all of them lie within ``radius`` of each other.
    """
    if radius % 2:
        raise ValueError("the radius must be even: only then all values that meet are within it")
    masks = F.array(*[F.lit(m) for m in ball(bits, -(-radius // 2))])
    points = values.select(key).distinct().select(F.col(key).alias("a"), F.explode(masks).alias("m"))
    points = points.select("a", F.col("a").bitwiseXOR(F.col("m")).alias("point"))
    w = Window.partitionBy("point").orderBy("a")
    pairs = points.select("a", F.array(*[F.lead("a", k).over(w) for k in range(1, ahead + 1)]).alias("next")).where(F.col("next")[0].isNotNull())
    pairs = pairs.select("a", F.explode("next").alias("b")).where(F.col("b").isNotNull())
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint``: 16 lower-case hexadecimal digits; ``component_id``: the smallest doc_id that
    links of at most ``radius`` bits reach, the row's own included.
    """
    fps = stored(fingerprints(docs, words))
    one = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = components(ball_links(one, 64, radius))
    linked = comp.join(one, comp.node == one.fp).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = one.join(linked.join(least, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    out = fps.join(of_fp, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- links by similarity


#: Points of a block, which one task sorts at a time; points that a task packs at a time.
BLOCK_POINTS, TASK_POINTS = 1 << 18, 1 << 20
#: Members of a point of which all pairs are taken.
FEW = 4
#: Members of a point this far apart are not compared by tag: the point is crowded.
FAR_APART = 64
_MIX = 0x9E3779B97F4A7C15


def _planes(x: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then their next bytes and so on, compressed."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def expected_bits(similarity: float) -> float:
    """Share of SimHash bits that differ between two sets of this Jaccard similarity and equal size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(n: int, similarity: float, radius: int = 2, recall: float = 0.97) -> tuple[int, int]:
    """(bits, tables): bits so that hardly more than two strangers meet in a point, tables for the recall."""
    bits = min(48, max(20, math.ceil(math.log2(max(n, 2))) + 7))
    p = expected_bits(similarity)
    hit = sum(math.comb(bits, r) * p**r * (1 - p) ** (bits - r) for r in range(radius + 1))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def similar_components(docs: DataFrame, words: int = 5, min_similarity: float = 0.8, recall: float = 0.97) -> DataFrame:
    """(doc_id, component_id): near-duplicates of at least ``min_similarity`` (Jaccard, word shingles).

    At this similarity 64-bit fingerprints differ in about ten bits, too many for one ball.
    Several shorter, independent SimHashes are taken instead, each searched with balls of radius
    2; their number follows from the recall wanted at the threshold itself and their width from
    the number of distinct texts. Pairs that meet are verified on their whole shingle sets.

    The first table alone is searched and verified first. It connects most of a large family of
    near copies, and from then on only texts of different components are paired: a family costs
    about its size once, not once for each table. Where more texts of different components meet
    than are paired, ``crowd_links`` searches all of these again, exactly.

    Copies (equal word sequences) are one vertex, named by their least doc_id; texts without words
    are copies of each other. Where rows of one id differ in text, the texts are copies of each
    other too and the one of least digest is compared with the rest. A row without an id has a
    component only as a copy of one with an id.
    """
    with passing(docs.sparkSession) as made:
        out = stored(_similar(text_or_empty(docs), words, min_similarity, recall))
        made.pop()  # the result stays, all that it was made from goes
    return out


def _similar(docs: DataFrame, words: int, min_similarity: float, recall: float) -> DataFrame:
    def keyed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, xxhash.xxh128_digest(b" ".join(words_of(text)))

    ids = stored(map_rows(text_or_empty(docs), keyed, "doc_id long, copy binary", 2048))
    reps = stored(ids.groupBy("copy").agg(F.min("doc_id").alias("rep")))
    bits, tables = tables_for(reps.count(), min_similarity, 2, recall)
    per = 64 // bits  # sketches from one 64-bit fingerprint
    seeds = -(-tables // per)
    mask = (1 << bits) - 1

    width = bits + (tables - 1).bit_length()
    tag_bits = min(32, 64 - width - bits.bit_length())  # of one more sketch, carried beside each value
    p = expected_bits(min_similarity)
    most = math.ceil(tag_bits * p + 3 * math.sqrt(tag_bits * p * (1 - p)))

    def sketch(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            ws = words_of(text)
            base = np.unique(shingle_hashes(ws, words, 7))  # as sets: so the similarity counts them
            if not len(base):
                continue
            got: list[int] = []
            for k in range(seeds + 1):  # a bijection of the shingle hash gives the next hash function
                x = base + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                fp = fingerprint(x ^ (x >> np.uint64(31)))
                got += [fp >> (bits * j) & mask for j in range(per)] if k < seeds else [fp & ((1 << tag_bits) - 1)]
            yield doc_id, xxhash.xxh128_digest(b" ".join(ws)), got[:tables], got[-1]

    # texts of copies are sketched too: that is less work than to shuffle all texts in order to leave them out
    every = map_rows(text_or_empty(docs), sketch, "rep long, copy binary, s array<long>, tag long", 1024)
    named = every.join(reps, ["rep", "copy"], "left_semi").groupBy("rep").agg(F.min_by(F.struct("s", "tag"), "copy").alias("of"))
    sketches = stored(named.select("rep", "of.s", "of.tag"))

    # the table's number stands above the bits (beyond 32 of them from some 2^20 texts on), so one pass searches all tables
    def flat(t: Column, v: Column, comp: Column) -> list[Column]:
        return [F.col("rep"), F.col("tag"), comp.alias("c"), t.alias("t"), (v + t.cast("long") * F.lit(1 << bits)).alias("v")]

    # what is left of chance meetings: a loose bound (four sigma) on all sketches together, before sets are compared
    far = p * bits * tables + 4 * math.sqrt(bits * tables * p * (1 - p)) * 1.5
    sx, sy = sketches.select(F.col("rep").alias("x"), F.col("s").alias("sx")), sketches.select(F.col("rep").alias("y"), F.col("s").alias("sy"))
    differ = F.aggregate(F.zip_with("sx", "sy", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)

    def linked(values: DataFrame, near: DataFrame) -> DataFrame:
        met = _pairs(values, near)
        return stored(verified(docs, stored(met.join(sx, "x").join(sy, "y").where(differ <= far).select("x", "y")), words, min_similarity))

    one = stored(sketches.select(*flat(F.lit(0), F.col("s")[0], F.lit(0).cast("long"))))
    links = linked(one, _met(one, width, bits, tag_bits, most, True))
    comp = components(links, "x", "y").select(F.col("node").alias("rep"), F.col("root"))
    ranked = sketches.join(comp, "rep", "left").select("rep", "tag", "root", F.posexplode("s").alias("t", "s1"))
    # the code of a component: 0 for a text that has no link yet
    every = stored(ranked.select(*flat(F.col("t"), F.col("s1"), F.when(F.col("root").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("root").bitwiseOR(F.lit(1))))))
    near = _met(every, width, bits, tag_bits, most, False)
    links = stored(links.unionAll(linked(every, near)))

    comp = components(links, "x", "y").select(F.col("node").alias("doc_id"), F.col("root").alias("comp"))
    crowd = near.where("b is null").select(F.col("a").alias("v"), F.col("ta").alias("tag"), F.col("ca").alias("c")).distinct()
    of = every.join(crowd.where("c = 0"), ["v", "tag", "c"], "left_semi").select("rep").unionAll(every.join(crowd.where("c <> 0").select("c").distinct(), "c", "left_semi").select("rep"))
    of = of.select(F.col("rep").alias("doc_id")).distinct().join(comp, "doc_id", "left")
    of = stored(of.select("doc_id", F.coalesce("comp", "doc_id").alias("comp")))
    if not of.isEmpty():
        links = links.unionAll(crowd_links(docs, of, words, min_similarity))
    return _classes(ids, reps, links)


def _pairs(flat: DataFrame, near: DataFrame) -> DataFrame:
    """(x, y): texts of equal value and tag with one of them, and one text for each value, tag and component that meet."""
    heads = stored(flat.groupBy("v", "tag", "c").agg(F.min_by("rep", F.xxhash64("rep", "t")).alias("head"), F.count("*").alias("n")))
    top = heads.groupBy("v", "tag").agg(F.min_by(F.struct("head", "c"), F.xxhash64("head")).alias("top"), F.sum("n").alias("n")).where("n > 1").select("v", "tag", F.col("top.head").alias("head"), F.col("top.c").alias("hc"))
    same = flat.join(top, ["v", "tag"]).where("rep <> head and (c = 0 or c <> hc)").select(F.col("rep").alias("x"), F.col("head").alias("y"))
    of = lambda p, n: heads.select(F.col("v").alias(p), F.col("tag").alias(f"t{p}"), F.col("c").alias(f"c{p}"), F.col("head").alias(n))
    met = near.where("b is not null").select("a", "ta", "ca", "b", "tb", "cb").distinct()
    met = met.join(of("a", "x"), ["a", "ta", "ca"]).join(of("b", "y"), ["b", "tb", "cb"]).select("x", "y")
    return same.unionAll(met).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _met(flat: DataFrame, width: int, bits: int, tag_bits: int, most: int, chains: bool) -> DataFrame:
    """(a, ta, ca, b, tb, cb): values, tags and components that meet within radius 2, the tags differing in ``most`` bits or fewer and the components not the same; with b null, those of a crowded point.

    ``width``: bits of a value with its table's number. A point, the bit that was turned to reach it
    and the tag are one number of 64 bits. A task sorts the points of its values, cuts them into
    blocks of the range of (mixed) points and shuffles the differences, so a point costs some six
    bytes instead of a row. The number of blocks follows from the number of points, so that each
    fits in ``BLOCK_POINTS``, but for the texts of one value. Of ``FEW`` members of a point all pairs
    are taken that tags and components allow. A point of more is crowded, and one where texts that
    are equal in value and tag stand as one beside others: its members with such a pair are left to
    another search, those without a component each, of the others their component (a 0, ta 0, ca): all its texts are
    searched then. With ``chains`` members are paired with the next two only, and none is left.
    """
    total = flat.count() * (bits + 1)
    block_bits = min(width, math.ceil(math.log2(max(total / BLOCK_POINTS, 4))))
    shift, low = np.uint64(64 - width), np.uint64((1 << width) - 1)
    masks = np.array([0, *(1 << k for k in range(bits))], np.uint64)
    turned = np.arange(bits + 1, dtype=np.uint64) << np.uint64(tag_bits)
    tag_mask = np.uint64((1 << tag_bits) - 1)
    mix, unmix = np.uint64(_MIX), np.uint64(pow(_MIX, -1, 1 << 64))

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        v, tag, c = np.concatenate(parts, 1)[:, :, None]
        x = ((((v ^ masks) * mix) & low) << shift | turned | tag).ravel()
        order = np.argsort(x)
        x, c = x[order], np.broadcast_to(c, (len(v), bits + 1)).ravel()[order]
        block = (x >> np.uint64(64 - block_bits)).astype(np.int64)
        first = np.nonzero(np.r_[True, block[1:] != block[:-1]])[0]
        diff = np.diff(x, prepend=np.uint64(0))
        diff[first] = x[first]
        cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(x)], strict=True))
        columns = [pa.array(block[first]), *(pa.array([_planes(y[s:e]) for s, e in cuts], pa.binary()) for y in (diff, c))]
        return pa.RecordBatch.from_arrays(columns, ["block", "points", "comps"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts.append(np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(3)]))
            n += batch.num_rows
            if n * (bits + 1) >= TASK_POINTS:
                yield packed(parts)
                parts, n = [], 0
        if n:
            yield packed(parts)

    def met(points: list[bytes], comps: list[bytes]) -> pa.RecordBatch:
        x = np.concatenate([np.cumsum(_unplaned(p), dtype=np.uint64) for p in points])
        c = np.concatenate([_unplaned(p) for p in comps])
        order = np.lexsort((c, x))
        x, c = x[order], c[order]
        alone = np.r_[False, (x[1:] == x[:-1]) & (c[1:] == c[:-1]) & (c[1:] != 0)]  # texts of one component, value and tag stand as one
        x, c = x[~alone], c[~alone]
        run = np.cumsum(np.r_[0, (x[1:] ^ x[:-1]) >> shift != 0]) if len(x) else np.zeros(0, np.int64)
        other = np.r_[False, (run[1:] == run[:-1]) & ((c[1:] != c[:-1]) | (c[1:] == 0))] if len(x) else np.zeros(0, bool)
        mixed = np.bincount(run, other) > 0  # points with texts of more than one component
        x, c, run = (y[mixed[run]] for y in (x, c, run))
        size = np.bincount(run)
        turn = (x >> np.uint64(tag_bits)) & np.uint64((1 << bits.bit_length()) - 1)
        v = (((x >> shift) * unmix) & low) ^ masks[turn]
        ends = lambda i: [v[i], x[i] & tag_mask, c[i]]
        copies = np.bincount(run[1:], x[1:] == x[:-1], len(size)) > 0 if len(x) else np.zeros(0, bool)
        full = (size > FEW) | copies & (size > 2)
        crowd, pairs = np.zeros(len(x), bool), [np.zeros((2, 0), np.int64)]
        for k in range(1, 3 if chains else FAR_APART + 1):
            at = np.nonzero(run[k:] == run[:-k])[0]
            if not len(at):
                break
            if k == FAR_APART:
                far = np.zeros(len(size), bool)
                far[run[at]] = True
                crowd |= far[run]
                break
            to = at + k
            can = (np.bitwise_count((x[at] ^ x[to]) & tag_mask) <= most) & ((c[at] != c[to]) | (c[at] == 0))
            if not chains:  # two values within the radius share two points or, if equal, all: one of them counts
                can &= np.where(turn[at] == turn[to], turn[at] == 0, (v[at] < v[to]) == (turn[at] < turn[to]))
            at, to = at[can], to[can]
            left = full[run[at]] & (not chains)
            crowd[at[left]] = crowd[to[left]] = True
            pairs.append(np.stack([at, to])[:, ~left & (x[at] != x[to])])
        p = np.concatenate(pairs, 1)
        found = np.unique(np.stack(ends(p[0]) + ends(p[1])), axis=1).view(np.int64)
        crowd = np.stack(ends(np.nonzero(crowd)[0]))
        crowd[:2, crowd[2] != 0] = 0  # a family is named once, not text by text
        crowd = np.unique(crowd, axis=1).view(np.int64)
        columns = [pa.concat_arrays([pa.array(f), pa.array(g)]) for f, g in zip(found[:3], crowd, strict=True)]
        columns += [pa.concat_arrays([pa.array(f), pa.nulls(crowd.shape[1], pa.int64())]) for f in found[3:]]
        return pa.RecordBatch.from_arrays(columns, ["a", "ta", "ca", "b", "tb", "cb"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for block, *blobs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if block != last and held:
                    yield met(*zip(*held, strict=True))
                    held = []
                last = block
                held.append([b.as_py() for b in blobs])
        if held:
            yield met(*zip(*held, strict=True))

    blocks = flat.select("v", F.col("tag").cast("long"), F.col("c").cast("long")).mapInArrow(spread, "block long, points binary, comps binary")
    dealt = blocks.repartition(max(1, (1 << block_bits) // 4), "block").sortWithinPartitions("block")
    return stored(dealt.mapInArrow(meet, "a long, ta long, ca long, b long, tb long, cb long"))


def crowd_links(docs: DataFrame, crowd: DataFrame, words: int, min_similarity: float) -> DataFrame:
    """(x, y): all pairs of the texts of ``crowd`` (doc_id, comp) with this similarity that are of different components.

    Exact: in any common order of shingles, two such sets share one of their first ``n - ceil(s n)
    + 1``, the places of the first shingle that they share bound what they can share at all, and
    so do 512 bits that say which ranges of hashes hold an odd number of a set: sets that differ in
    d shingles differ in at most d of them.
    Shingles within one component come first (they cannot join two), then rare ones before common
    ones. So what a large family shares stands at the end and makes no candidates, and a text with
    too much of its own meets nobody.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, comp, text in zip(*batch.columns, strict=True):
                h = np.unique(shingle_hashes(words_of(text.as_py()), words, 7))
                odd = np.packbits(np.bincount((h >> np.uint64(64 - 9)).astype(np.int64), minlength=512) & 1).tobytes()
                same = [pa.array(np.full(len(h) + 1, x)) for x in (doc_id.as_py(), comp.as_py(), len(h))]
                yield pa.RecordBatch.from_arrays([*same, pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(h.view(np.int64))]), pa.concat_arrays([pa.array([odd], pa.binary()), pa.nulls(len(h), pa.binary())])], ["doc_id", "comp", "n", "h", "odd"])

    # one text an id, the least where its rows differ
    of = text_or_empty(docs).join(few(crowd), "doc_id").groupBy("doc_id", "comp").agg(F.min("text").alias("text"))
    known = stored(of.mapInArrow(sets, "doc_id long, comp long, n long, h long, odd binary"))
    flat, odds = known.where("h is not null").drop("odd"), known.where("odd is not null").select("doc_id", "odd")
    between = flat.groupBy("h").agg(F.count("*").alias("texts"), F.min("comp").alias("least"), F.max("comp").alias("last")).where("least <> last").select("h", "texts")
    of_doc = Window.partitionBy("doc_id")
    ranked = flat.join(between, "h").select("doc_id", "comp", "n", "h", F.row_number().over(of_doc.orderBy("texts", "h")).alias("at"), F.count("*").over(of_doc).alias("left"))
    prefix = ranked.withColumn("at", F.col("n") - F.col("left") + F.col("at")).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * min_similarity - 1e-9) + 1)
    share = min_similarity / (1 + min_similarity)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(xs: list[np.ndarray], ys: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["x", "y"])

        def matched(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            doc, comp, n, at, *odd = np.concatenate(parts, 1)
            order = np.argsort(n, kind="stable")
            doc, comp, n, rest, odd = doc[order], comp[order], n[order], (n - at + 1)[order], np.stack(odd)[:, order].view(np.uint64)  # bits are counted of unsigned numbers
            xs, ys, held = [], [], 0
            for i, end in enumerate(np.searchsorted(n, np.floor(n / min_similarity + 1e-9), "right").tolist()):
                j = slice(i + 1, end)
                both = share * (n[j] + n[i]) - 1e-9  # least number of shared shingles
                can = np.nonzero((comp[j] != comp[i]) & (np.minimum(rest[j], rest[i]) >= both))[0]
                can = can[np.bitwise_count(odd[:, j][:, can] ^ odd[:, i : i + 1]).sum(0, dtype=np.int64) <= (n[j] + n[i] - 2 * both)[can] + 1e-6]
                other = doc[j][can]
                if len(other):
                    xs.append(np.minimum(other, doc[i]))
                    ys.append(np.maximum(other, doc[i]))
                    held += len(other)
                if held > BLOCK_POINTS:
                    yield batch_of(xs, ys)
                    xs, ys, held = [], [], 0
            if held:
                yield batch_of(xs, ys)

        last, held = None, []
        for batch in batches:
            h = batch.column(0).to_numpy()
            odd = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.int64).reshape(-1, 8).T
            rows = np.concatenate([np.stack([batch.column(k).to_numpy() for k in (1, 2, 3, 4)]), odd])
            cuts = [0, *(np.nonzero(h[1:] != h[:-1])[0] + 1).tolist(), len(h)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and h[s] != last:
                    yield from matched(held)
                    held = []
                last = h[s]
                held.append(rows[:, s:e])
        if held:
            yield from matched(held)

    postings = prefix.join(odds, "doc_id").select("h", "doc_id", "comp", "n", F.col("at").cast("long").alias("at"), "odd")
    spread = postings.repartition("h").sortWithinPartitions("h")
    pairs = stored(spread.mapInArrow(meet, "x long, y long").distinct())
    return verified(docs, pairs, words, min_similarity)


def verified(docs: DataFrame, pairs: DataFrame, words: int, min_similarity: float) -> DataFrame:
    """The pairs (x, y) of ids whose sets of shingles have this Jaccard similarity at least."""
    named = stored(pairs.select(F.col("x").alias("doc_id")).unionAll(pairs.select("y")).distinct())

    def sets(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            ws = words_of(text)
            yield doc_id, xxhash.xxh128_digest(b" ".join(ws)), np.unique(shingle_hashes(ws, words, 7)).tobytes()

    of = stored(map_rows(text_or_empty(docs).join(few(named), "doc_id", "left_semi"), sets, "doc_id long, copy binary, h binary", 64).groupBy("doc_id").agg(F.min_by("h", "copy").alias("h")))

    def check(rows: Iterator[tuple]) -> Iterator[tuple]:
        for x, y, p, q in rows:
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            if both >= min_similarity * (len(p) + len(q) - both):
                yield x, y

    wide = pairs.join(of.select(F.col("doc_id").alias("x"), F.col("h").alias("p")), "x").join(of.select(F.col("doc_id").alias("y"), F.col("h").alias("q")), "y")
    return map_rows(wide.select("x", "y", "p", "q"), check, "x long, y long", 64)


def _classes(ids: DataFrame, reps: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links, "x", "y")
    least = comp.groupBy("root").agg(F.min("node").alias("component_id"))
    of_rep = comp.join(least, "root").select(F.col("node").alias("rep"), "component_id")
    of_copy = reps.join(of_rep, "rep", "left").select("copy", F.coalesce("component_id", "rep").alias("component_id"))
    return ids.join(of_copy, "copy", "left").select("doc_id", "component_id")
