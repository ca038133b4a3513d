import hashlib
import struct
import zlib

import numpy as np
import pytest

from segquery.llm import media_tiff as M


@pytest.mark.parametrize("compression", [M.RAW, M.LZW, M.DEFLATE, M.DEFLATE_OLD, M.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 256, (37, 53), dtype=np.uint8), np.repeat(rng.integers(0, 4, (20, 10, 3), dtype=np.uint8), 5, axis=1), np.zeros((1, 1), np.uint8)]
    got = list(M.read_pages(M.encode(pages, compression, predictor, 7, tile, order)))
    assert [p.error for p in got] == [None] * 3
    for p, want in zip(got, pages, strict=True):
        assert (p.pixels.reshape(want.shape) == want).all() and p.compression == compression


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 1000, 70_000])
def test_codecs(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), bytes(n), (b"abc" * n)[:n]):
        assert M.packbits_decode(M.packbits_encode(data), n) == data
        assert M.lzw_decode(M.lzw_encode(data), n) == data


def test_known_lzw_stream():
    # the example of the format's description: 7 7 7 8 8 7 7 6 6
    assert M.lzw_decode(M.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert raw == M.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) and M.packbits_decode(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA]), 10) == bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4)


def test_damaged(spark):
    good = M.encode([np.zeros((4, 4), np.uint8)])
    loop = bytearray(good)
    cases = [(0, b""), (1, b"nope"), (2, good[:20]), (3, good), (4, None), (5, bytes(loop[:8]) + b"\xff" * 30)]
    got = M.tiff_pages(spark.createDataFrame(cases, "doc_id long, media binary")).collect()
    assert {r.doc_id: r.error is None for r in got} == {0: False, 1: False, 2: False, 3: True, 5: False}


def hand_made(tags, strips, order="<"):
    """A file with one directory: tags as {number: (type, values)}, strips appended."""
    kinds = {3: "H", 4: "I"}
    at = 8 + 2 + 12 * (len(tags) + 2) + 4
    extra, rows = b"", []
    offsets, pos = [], None
    body = lambda t: {**t, 273: (4, [0] * len(strips)), 279: (4, [len(s) for s in strips])}
    size = sum(struct.calcsize(kinds[k]) * len(v) for k, v in body(tags).values() if struct.calcsize(kinds[k]) * len(v) > 4)
    pos = at + size
    for s in strips:
        offsets.append(pos)
        pos += len(s)
    for tag, (kind, values) in sorted({**body(tags), 273: (4, offsets)}.items()):
        raw = struct.pack(f"{order}{len(values)}{kinds[kind]}", *values)
        if len(raw) > 4:
            rows.append(struct.pack(order + "HHII", tag, kind, len(values), at + len(extra)))
            extra += raw
        else:
            rows.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(rows)) + b"".join(rows) + bytes(4) + extra + b"".join(strips)


@pytest.mark.parametrize("order", ["<", ">"])
def test_planes_and_floats(order):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    planes = [np.ascontiguousarray(rgb[r : r + 4, :, c]).tobytes() for c in range(3) for r in (0, 4)]
    tags = {256: (3, [5]), 257: (3, [6]), 258: (3, [8, 8, 8]), 259: (3, [1]), 277: (3, [3]), 278: (3, [4]), 284: (3, [2])}
    (p,) = M.read_pages(hand_made(tags, planes, order))
    assert p.error is None and (p.pixels == rgb).all()
    x = rng.standard_normal((6, 5)).astype(np.float32)
    high_first = np.ascontiguousarray(x.astype(">f4").view(np.uint8).reshape(6, 5, 4).transpose(0, 2, 1)).reshape(6, 20)
    coded = np.diff(high_first, axis=1, prepend=np.uint8(0)).astype(np.uint8)
    tags = {256: (3, [5]), 257: (3, [6]), 258: (3, [32]), 259: (3, [8]), 317: (3, [3]), 339: (3, [3])}
    (p,) = M.read_pages(hand_made(tags, [zlib.compress(coded.tobytes())], order))
    assert p.error is None and (p.pixels[:, :, 0] == x).all()


def test_no_damage_escapes():
    """Every byte of header and directories set to other values: no exception, and equal bytes give equal samples."""
    good = M.encode([np.arange(48, dtype=np.uint8).reshape(6, 8), np.zeros((5, 4, 3), np.uint8)], M.DEFLATE, 2, 2)
    tiled = M.encode([np.arange(64, dtype=np.uint8).reshape(8, 8)], M.RAW, 1, 7, (16, 16))
    n_errors = 0
    for data in (good, tiled):
        for at in range(len(data)):
            for value in (0, 1, 0x7F, 0xFF, data[at] ^ 0x10):
                hurt = data[:at] + bytes([value]) + data[at + 1 :]
                a, b = list(M.read_pages(hurt)), list(M.read_pages(hurt))
                n_errors += any(p.error for p in a)
                assert [(p.error, None if p.pixels is None else p.pixels.tobytes()) for p in a] == [(p.error, None if p.pixels is None else p.pixels.tobytes()) for p in b]
    assert n_errors > 200


@pytest.mark.parametrize("tags", [{322: (3, [0])}, {256: (4, [])}, {257: (4, [4 * 10**9])}, {278: (3, [2])}, {277: (3, [0])}, {278: (3, [0])}])
def test_sizes_that_cannot_be(tags):
    fine = {256: (3, [4]), 257: (3, [4]), 258: (3, [8]), 259: (3, [1]), 277: (3, [1]), 278: (3, [4])}
    (p,) = M.read_pages(hand_made(fine, [bytes(16)]))
    assert p.error is None
    (p,) = M.read_pages(hand_made(fine | tags, [bytes(16)])) if 322 not in tags else M.read_pages(hand_made(fine | tags | {323: (3, [4]), 324: (4, [8]), 325: (4, [16])}, [bytes(16)]))
    assert p.error and p.pixels is None


def test_query_values(odd, odd_rows):
    got = sorted(M.tiff_digests(M.tiff_media(odd)).collect(), key=str)
    want = []
    for i, t, *_ in odd_rows:
        raw = (t or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:])))
    assert [tuple(r)[:5] for r in got] == sorted(want, key=str)
    assert all(r.media_bytes > 0 and r.feature for r in got) and len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_pages_of_long_texts(spark):
    d = spark.createDataFrame([(1, "x" * (M.WIDTH * M.ROWS_PER_PAGE * 2 + 5))], "doc_id long, text string")
    assert [r.page for r in M.tiff_pages(M.tiff_media(d)).orderBy("page").collect()] == [0, 1, 2]


def test_empty(empty):
    assert M.tiff_digests(M.tiff_media(empty)).count() == 0 and M.tiff_pages(M.tiff_media(empty)).count() == 0
