"""Byte-level BPE encoding and decoding with a rank file.

A text is cut by the tokenizer's pattern into pre-tokens. A pre-token that is a token stays whole; in any other the
pair of neighbours of least rank is merged until no neighbours merge, of equal ranks the leftmost first. The pairs
wait in a rank queue: one bucket of positions a rank, and a bitmap of the ranks whose buckets hold any, under a bitmap
of the words of that bitmap, so the next rank is two find-first-set steps away. Positions are those of a linked
list of tokens; an entry whose pair has changed meanwhile is stale and skipped. A bucket is worked off from left to right
until a pair of lower rank appears. The work is therefore about in proportion to the bytes of a pre-token, however long
it is. The pre-tokens of a text that a worker does not know yet share one queue, as lists without links between them.

Defined results: a null or empty text has no tokens; rows keep their id, null ids and repeated rows too; special
tokens do not exist, so their strings are text; extra columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty

#: log2 of the ranks under one bit of the upper bitmap.
WORD = 8
#: Pre-tokens that a Python worker remembers, some, and the longest of them in characters.
REMEMBERED, SHORT = 1 << 19, 64

_coders: dict[bytes, Coder] = {}


def ranks_of(path: str) -> bytes:
    """A rank file (base64 of a token, its rank), read once on the driver; it is sent to the tasks."""
    with open(path, "rb") as f:
        return f.read()


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: bytes) -> None:
        self.tokens: dict[bytes, int] = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines()) if t}
        self.bytes_of = {r: t for t, r in self.tokens.items()}
        self.single = [self.tokens[bytes([b])] for b in range(256)]
        self.shift = max(self.bytes_of).bit_length()
        #: Rank of the token that two neighbours make, by both their ids.
        self.pairs = {self.tokens[t[:k]] << self.shift | self.tokens[t[k:]]: r for t, r in self.tokens.items() for k in range(1, len(t)) if t[:k] in self.tokens and t[k:] in self.tokens}
        self.known: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token's bytes by the rank queue."""
        return self.merged_all([piece])[0]

    def merged_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of several pre-tokens by one rank queue: their lists of tokens are parts of one array, without links between them."""
        pairs, shift, single = self.pairs.get, self.shift, self.single
        low = (1 << WORD) - 1
        token: list[int] | array = [single[b] for piece in pieces for b in piece]
        n = len(token)
        after: list[int] | array = list(range(1, n + 1))
        before: list[int] | array = list(range(-1, n - 1))
        ends = list(accumulate(map(len, pieces)))
        for e in ends:
            if e:
                after[e - 1] = n
            if e < n:
                before[e] = -1
        if n > 1 << 16:
            token, after, before = array("i", token), array("i", after), array("i", before)
        buckets: dict[int, list[int]] = {}
        lower: dict[int, int] = {}
        upper = 0
        for i in range(n):
            if after[i] < n:
                r = pairs(token[i] << shift | token[i + 1])
                if r is not None:
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        buckets[r] = [i]
                        lower[r >> WORD] = lower.get(r >> WORD, 0) | 1 << (r & low)
                        upper |= 1 << (r >> WORD)
        while upper:
            word = (upper & -upper).bit_length() - 1
            bits = lower[word]
            r = word << WORD | (bits & -bits).bit_length() - 1
            lower[word] = bits & (bits - 1)
            if not lower[word]:
                upper &= upper - 1
            bucket = buckets.pop(r)
            bucket.sort()  # nearly sorted: positions came from left to right
            for at, i in enumerate(bucket, 1):
                j = after[i]
                if j >= n or token[i] < 0 or pairs(token[i] << shift | token[j]) != r:
                    continue  # stale
                token[i], token[j] = r, -1
                after[i] = k = after[j]
                left, sooner = before[i], False
                if k < n:
                    before[k] = i
                    q = pairs(r << shift | token[k])
                    if q is not None:
                        sooner = q < r
                        if q in buckets:
                            buckets[q].append(i)
                        else:
                            buckets[q] = [i]
                            lower[q >> WORD] = lower.get(q >> WORD, 0) | 1 << (q & low)
                            upper |= 1 << (q >> WORD)
                if left >= 0:
                    q = pairs(token[left] << shift | r)
                    if q is not None:
                        sooner = sooner or q < r
                        if q in buckets:
                            buckets[q].append(left)
                        else:
                            buckets[q] = [left]
                            lower[q >> WORD] = lower.get(q >> WORD, 0) | 1 << (q & low)
                            upper |= 1 << (q >> WORD)
                if sooner and at < len(bucket):  # a pair of lower rank comes first; the rest of the bucket waits
                    buckets[r] = bucket[at:]
                    lower[word] = lower.get(word, 0) | 1 << (r & low)
                    upper |= 1 << word
                    break
        return [[t for t in token[s:e] if t >= 0] for s, e in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: list[str]) -> None:
        """Remembers the ids of pre-tokens, each as four bytes, least first."""
        split, names = [], []
        for piece in pieces:
            data = piece.encode()
            whole = self.tokens.get(data)
            if whole is None:
                split.append(data)
                names.append(piece)
            else:
                self.known[piece] = whole.to_bytes(4, "little")
        for piece, ids in zip(names, self.merged_all(split) if split else (), strict=True):
            self.known[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str, pattern: regex.Pattern) -> bytes:
        pieces = pattern.findall(text)
        fresh = set(pieces).difference(self.known)
        if fresh:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                fresh = set(pieces)
            self.learn(list(fresh))
        ids = b"".join(map(self.known.__getitem__, pieces))
        for piece in fresh:
            if len(piece) > SHORT:
                del self.known[piece]
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(ranks: bytes) -> Coder:
    """The coder of a rank file, made once in a Python worker."""
    if ranks not in _coders:
        _coders.clear()
        _coders[ranks] = Coder(ranks)
    return _coders[ranks]


def _mapped(df: DataFrame, ranks: bytes, fn: Callable[[Coder, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file, whatever the size of the data
    return map_rows(df, lambda rows: fn(coder(shared.value), rows), schema, chunk=64)


def encoded(docs: DataFrame, ranks: bytes, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the tokens of every text, packed as unsigned integers of four bytes, least first."""

    def run(known: Coder, rows: Iterator[tuple]) -> Iterator[tuple]:
        cut = regex.compile(pattern)
        for doc_id, text in rows:
            yield doc_id, known.encode(text, cut)

    kind = docs.schema[id_col].dataType.simpleString()
    return _mapped(text_or_empty(docs, id_col, text_col), ranks, run, f"doc_id {kind}, ids binary")


def decoded(tokens: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, ids, text): the bytes that packed ids stand for; ``cast("string")`` where they are UTF-8. Null ids: no bytes."""

    def run(known: Coder, rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, ids in rows:
            yield doc_id, ids, known.decode(ids or b"")

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return _mapped(tokens.select("doc_id", "ids"), ranks, run, f"doc_id {kind}, ids binary, text binary")


def round_trip_digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of texts that were encoded and decoded again."""
    both = decoded(encoded(docs, ranks, pattern), ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
