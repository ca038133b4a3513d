"""Byte-level BPE against the plain merge loop and the public library."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from segquery.llm import bpe

RANKS = bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(RANKS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(piece, tokens):
    """The pair of least rank merges, the leftmost first, until none is left."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(tokens[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in tokens]
        if not found:
            return [tokens[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_queue_equals_plain_merging(coder):
    r = random.Random(1)
    letters = "aaabbcdeé ñ漢字😀\n09"
    for n in [*range(1, 40), 200, 300]:
        piece = "".join(r.choice(letters) for _ in range(n)).encode()
        assert coder.merged(piece) == plain(piece, coder.tokens)
    for piece in (b"a" * 257, b"ab" * 100, bytes(range(256)), b"\xff\xfe" * 40, b"aab" * 70):
        assert coder.merged(piece) == plain(piece, coder.tokens)


def test_any_rank_file():
    """Ranks in any order, also ones no training gives: a merge may make a pair of lower rank than its own."""
    r = random.Random(4)
    for _ in range(60):
        more = {bytes(r.choice(b"abc") for _ in range(r.randrange(2, 6))) for _ in range(25)}
        order = [bytes([b]) for b in range(256)] + sorted(more)
        r.shuffle(order)
        coder = bpe.Coder(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(order)))
        for n in (1, 2, 5, 30, 120):
            piece = bytes(r.choice(b"abcd") for _ in range(n))
            assert coder.merged(piece) == plain(piece, coder.tokens)
        many = [bytes(r.choice(b"abcd") for _ in range(r.randrange(12))) for _ in range(40)]
        assert coder.merged_all(many) == [plain(x, coder.tokens) for x in many]


def test_memory_that_runs_over(coder, library, monkeypatch):
    """What a worker forgets, and what is too long to remember, is encoded again."""
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "SHORT", 3)
    pattern, own = bpe.regex.compile(public_tokenizers.PATTERN), bpe.Coder(RANKS)
    for text in ["one two three four five six", "one two", "", "seven eight nine ten one one", "x" * 40]:
        assert np.frombuffer(own.encode(text, pattern), "<u4").tolist() == library.encode_ordinary(text)
        assert all(len(p) <= 3 for p in own.known)


def test_long_pretokens(coder, library):
    """Pre-tokens of 100,000 bytes equal the library's; four times the length costs about four times as much."""
    r = random.Random(2)
    texts = ["a" * 100_000, "".join(r.choice("abcdefghij") for _ in range(100_000)), "漢字" * 20_000, "=-" * 50_000, " " * 50_000, "0123456789" * 5_000]
    pattern = bpe.regex.compile(public_tokenizers.PATTERN)
    for t in texts:
        assert np.frombuffer(coder.encode(t, pattern), "<u4").tolist() == library.encode_ordinary(t)
    took = []
    for n in (50_000, 200_000):
        piece = "".join(r.choice("abcdefghij") for _ in range(n)).encode()
        t = time.process_time()
        coder.merged(piece)
        took.append(time.process_time() - t)
    assert took[1] < 10 * max(took[0], 0.05)


def test_every_character_is_cut_as_the_library_cuts(library):
    """Letters, numbers, white space and the rest are the same sets in both regular expression engines."""
    coder = bpe.Coder(RANKS)
    pattern = bpe.regex.compile(public_tokenizers.PATTERN)
    for lo in range(0, 0x110000, 0x400):
        chars = [chr(c) for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1 {c}{c}!" for c in chars)
        if np.frombuffer(coder.encode(text, pattern), "<u4").tolist() != library.encode_ordinary(text):
            odd = [c for c in chars if np.frombuffer(coder.encode(f"a{c}1 {c}{c}!", pattern), "<u4").tolist() != library.encode_ordinary(f"a{c}1 {c}{c}!")]
            import unicodedata

            assert all(unicodedata.category(c) == "Cn" or unicodedata.unidata_version < "16" for c in odd), [hex(ord(c)) for c in odd]


def test_query_digests(spark, odd, odd_rows, empty, library):
    got = bpe.round_trip_digests(odd, RANKS, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, text, *_ in odd_rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trip_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_decodes_null_and_any_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(np.array([97, 50_000, 0], "<u4").tobytes()))], "doc_id long, ids binary")
    coder = bpe.Coder(RANKS)
    got = {r.doc_id: bytes(r.text) for r in bpe.decoded(rows, RANKS).collect()}
    assert got == {1: b"", 2: coder.bytes_of[97] + coder.bytes_of[50_000] + coder.bytes_of[0]}


def test_corpus_equals_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert ids == {r.doc_id: library.encode_ordinary(r.text or "") for r in docs.collect()}
