"""Phrase collocations: merged count-min sketches, exact counts of the survivors, scores, subsumption.

Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+`` after A-Z are
lower-cased; phrases never leave a piece. Three steps:

1. Every task adds the n-grams of its texts to a count-min sketch of ``ROWS`` rows. What it sends on are the cells
   it has touched, 2^16 neighbours a block and the blocks of a row in at most 2^8 groups, so the number of groups
   sent follows the input and not the width. The groups of all tasks are added. A cell's sum is never less than the
   count of any n-gram in it.
2. Of the merged sketch only "reaches ``min_count``" is needed, one bit a cell, so its size is proven:
   ``ROWS * 2**MAX_BITS / 8`` bytes at most. Tasks read the texts again and count exactly the n-grams whose
   cells, and those of all n-grams inside them, reach ``min_count``. Nothing frequent can be lost; what passes by
   chance falls to its exact count. The width follows the input up to ``MAX_BITS``; beyond that more passes by
   chance, results are the same.
3. Joins of the exact counts give each candidate its lowest-scoring cut, and candidates that occur only inside a
   longer one are dropped.

Defined results: a null text is empty; a null lang is ``und`` and counts with rows that say so; ids are not read,
so repeated rows count each time; texts without words and empty tables give no phrases; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few, map_rows, n_partitions, stored

#: Rows of the sketch.
ROWS = 2
#: log2 of the cells of a row at most: 32 MB of bits a row.
MIN_BITS, MAX_BITS = 16, 28
#: log2 of the cells of a block, and of the groups that a row's blocks travel in.
BLOCK, GROUPS = 16, 8
#: Words whose n-grams are counted at once, bytes of text that are split at once, words that a task names at once.
HELD_WORDS, HELD_BYTES, VOCABULARY = 1 << 21, 1 << 22, 1 << 19
#: Odd multipliers: of the sketch's rows, of a phrase's next word.
_ROW_MUL, _NEXT_MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 0xD6E8FEB86659FD93
#: A-Z lower-cased is left to bytes.lower(); every mark that ends a piece becomes a full stop, which no word holds.
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)



class _Words(dict):
    """Numbers of words in order of appearance; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.names: list[bytes] = []
        self.hashes = array("Q")
        self[b"."]

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return k


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts that begin and end between pieces."""
    data, at = text.lower().translate(_ENDS), 0
    while at < len(data):
        end = data.find(b".", at + HELD_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end + 1


def _numbered(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, np.ndarray, _Words]]:
    """(lang, numbers of words with 0 after each piece, words), some ``HELD_WORDS`` at a time."""
    words, texts, ids = _Words(), {}, {}
    held = n_bytes = 0

    def split() -> int:
        n = 0
        for lang, parts in texts.items():
            found = b" . ".join(parts).replace(b".", b" . ").split()
            ids.setdefault(lang, []).append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            ids[lang].append(np.zeros(1, np.int32))
            n += len(found)
        texts.clear()
        return n

    for lang, text in rows:
        for part in _parts(text):
            texts.setdefault(lang, []).append(part)
            n_bytes += len(part)
            if n_bytes >= HELD_BYTES:
                held, n_bytes = held + split(), 0
            if held >= HELD_WORDS:
                yield from ((k, np.concatenate(v), words) for k, v in ids.items())
                ids, held = {}, 0
                if len(words) > VOCABULARY:
                    words = _Words()
    split()
    yield from ((k, np.concatenate(v), words) for k, v in ids.items())


def _levels(lang: str, ids: np.ndarray, words: _Words, most: int, passes: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) of the n-grams of which all parts pass."""
    word = np.array(words.hashes, np.uint64)[ids] ^ np.uint64(xxhash.xxh64_intdigest(lang, 1))
    live, hashes = ids != 0, word
    for n in range(1, most + 1):
        if n > 1:
            live = live[:-1] & live[1:]
        places = np.flatnonzero(live)
        own = hashes[places]
        if n > 1:
            own = own * np.uint64(_NEXT_MUL) + word[places + n - 1] + np.uint64(n)
        if passes is not None:
            through = passes(own)
            live[places[~through]] = False
            places, own = places[through], own[through]
        if not len(places):
            return
        yield n, places, own
        hashes = np.zeros(len(live), np.uint64)
        hashes[places] = own


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * np.uint64(_ROW_MUL[row])) >> np.uint64(64 - bits)).astype(np.uint32)


def _counted(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cells = np.sort(cells)
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[starts], np.diff(np.append(starts, len(cells)))


def sketch(texts: DataFrame, most: int, min_count: int, bits: int) -> list[np.ndarray]:
    """For each row of the merged sketch one bit a cell: does its count reach ``min_count``?"""
    kind = np.min_scalar_type(min_count)  # sums need not go on beyond min_count
    each = 1 << max(0, bits - BLOCK - GROUPS)  # blocks of a group

    def add(rows: Iterator[tuple]) -> Iterator[tuple]:
        for lang, ids, words in _numbered(rows):
            hashes = np.concatenate([h for _, _, h in _levels(lang, ids, words, most)] or [np.zeros(0, np.uint64)])
            for row in range(ROWS) if len(hashes) else ():
                cells, counts = _counted(_cells(hashes, row, bits))
                low, counts = (cells & np.uint32((1 << BLOCK) - 1)).astype(np.uint16), np.minimum(counts, min_count).astype(kind)
                ends = np.searchsorted(cells, np.arange((1 << (bits - BLOCK)) + 1, dtype=np.uint64) << np.uint64(BLOCK))
                sizes = np.diff(ends).astype(np.uint32).reshape(-1, each)
                for group in np.flatnonzero(sizes.any(1)):
                    at = slice(ends[group * each], ends[(group + 1) * each])
                    yield int(row), int(group), sizes[group].tobytes(), low[at].tobytes(), counts[at].tobytes()

    def merge(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, total = None, np.zeros(0, np.int64)
        for row, group, sizes, low, counts in rows:
            if (row, group) != key:
                if key:
                    yield *key, np.packbits(total >= min_count).tobytes()
                key, total = (row, group), np.zeros(each << BLOCK, np.int64)
            at = np.repeat(np.arange(each) << BLOCK, np.frombuffer(sizes, np.uint32)) + np.frombuffer(low, np.uint16)
            total[at] += np.frombuffer(counts, kind)
        if key:
            yield *key, np.packbits(total >= min_count).tobytes()

    spark = texts.sparkSession
    parts = map_rows(texts, add, "row int, part int, sizes binary, low binary, counts binary", chunk=64)
    dealt = parts.repartition(n_partitions(spark), "row", "part").sortWithinPartitions("row", "part")
    merged = stored(map_rows(dealt, merge, "row int, part int, bits binary", chunk=16))
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    for x in merged.toLocalIterator():  # at most ROWS * 2**MAX_BITS / 8 bytes in all
        at = x["part"] * (each << BLOCK) // 8
        out[x["row"]][at : at + len(x["bits"])] = np.frombuffer(x["bits"], np.uint8)
    return out


def _distinct(n: int, ids: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``places`` stand for the different n-grams, and their counts; equal hashes are held against the words themselves."""
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    new = np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]])
    at, group = places[order], np.cumsum(new) - 1
    first = at[new]
    if any((ids[at + k] != ids[first[group] + k]).any() for k in range(n)):
        _, index, counts = np.unique(ids[places[:, None] + np.arange(n)], axis=0, return_index=True, return_counts=True)
        return index, counts
    return order[new], np.bincount(group)


def phrase_counts(docs: DataFrame, max_words: int = 5, min_count: int = 100, bits: int | None = None, *, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of up to ``max_words`` words that occur ``min_count`` times or more.

    Returns (lang, phrase, words, f) and (lang, n), n counting all word occurrences. ``bits`` sets the width
    of the sketch's rows; as given it follows the size of the texts.
    """
    if min_count < 1 or max_words < 1:
        raise ValueError("min_count and max_words are at least 1")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if bits is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(MIN_BITS, min(MAX_BITS, (size * max_words // 60).bit_length()))  # some eight n-grams a cell
    maps = spark.sparkContext.broadcast(sketch(texts, max_words, min_count, bits))

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        def passes(hashes: np.ndarray) -> np.ndarray:
            through = np.ones(len(hashes), bool)
            for row, known in enumerate(maps.value):
                left = np.flatnonzero(through)
                cells = _cells(hashes[left], row, bits)
                through[left] = (known[cells >> np.uint32(3)] >> (7 - (cells & np.uint32(7))).astype(np.uint8)) & 1 == 1
            return through

        for lang, ids, words in _numbered(rows):
            yield lang, -1, b"%d" % np.count_nonzero(ids)
            packs: list[list[bytes]] = [[] for _ in range(packets)]
            for n, places, hashes in _levels(lang, ids, words, max_words, passes):
                index, counts = _distinct(n, ids, places, hashes)
                named = [[words.names[i] for i in ids[places[index] + k].tolist()] for k in range(n)]
                to = ((hashes[index] >> np.uint64(32)) % np.uint64(packets)).tolist()
                for at, c, *phrase in zip(to, counts.tolist(), *named, strict=True):
                    packs[at].append(b"%b\t%d" % (b" ".join(phrase), c))  # no phrase holds a tab or a line feed
            for at, lines in enumerate(packs):
                if lines:
                    yield lang, at, b"\n".join(lines)

    def merge(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (lang, packet), own in itertools.groupby(rows, lambda r: r[:2]):
            if packet < 0:
                yield lang, None, 0, sum(int(r[2]) for r in own)
                continue
            total: dict[bytes, int] = {}
            for _, _, lines in own:
                for line in lines.split(b"\n"):
                    phrase, _, c = line.partition(b"\t")
                    total[phrase] = total.get(phrase, 0) + int(c)
            for phrase, f in total.items():
                if f >= min_count:
                    yield lang, phrase.decode(), phrase.count(b" ") + 1, f

    # partial counts travel packed, a row for each language and packet, and so many packets that a merging task holds a small part of the survivors
    packets = max(1, n_partitions(spark) // 4)
    found = map_rows(texts, count, "lang string, packet int, lines binary", chunk=64)
    dealt = found.repartition(n_partitions(spark), "lang", "packet").sortWithinPartitions("lang", "packet")
    counts = stored(map_rows(dealt, merge, "lang string, phrase string, words int, f long", chunk=4096))
    maps.destroy()
    return counts.where("phrase is not null"), counts.where("phrase is null").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, **options: object) -> DataFrame:
    """All scored phrases of two words or more that no longer phrase subsumes: (lang, phrase, a, l, r, n, score).

    score: floor(1000 * a * n / (l * r)) for the cut of a phrase with the least score (of ties the earliest),
    a its count, l and r those of the two parts, n all words of the language. Products are decimals of 38 digits.
    """
    counts, totals = phrase_counts(docs, max_words, min_count, **options)
    longer = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, size: F.concat_ws(" ", F.slice("w", start, size))
    cuts = longer.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    heads, tails = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = (
        cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(few(totals), "lang")
        .select("lang", "phrase", "a", "n", F.struct(F.expr("cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))").alias("score"), "k", "l", "r").alias("cut"))
        .groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    )
    # a count falls with every word that is added, so a longer phrase of equal count leaves one of one word more with that count
    inside = longer.where("words > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("f").alias("a")).distinct()
    kept = scored.join(inside, ["lang", "phrase", "a"], "left_anti")
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def top_collocations(docs: DataFrame, limit: int = 2000, **options: object) -> DataFrame:
    """Each language's first ``limit`` phrases by score, count and phrase (in order of bytes), ranked from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs, **options).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
