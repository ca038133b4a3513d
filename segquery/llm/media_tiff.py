"""Media columns: TIFF containers as binary columns.

Writer and reader of baseline TIFF in plain Python and numpy. The reader walks the chain of
image directories and decodes strips or tiles that are stored raw, with PackBits, LZW or
deflate, undoes horizontal and floating-point differencing and yields one image per directory:
integers of 8 or 16 bits or floats of 32, samples beside one another or in planes.

Defined results: null media gives no page; bytes that are no TIFF, or a directory that is
damaged, give one row with ``error`` set and null pixels. Damaged are: images without rows or
columns, strips or tiles that are missing, too short or without rows or columns, sizes beyond
what the data can hold, tags outside the data; depths and layouts other than those above are
errors of the same form. Equal input bytes give equal stored bytes. Any further columns of the input are
ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty

#: Fixed values of the format.
RAW, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
TAG = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325, "format": 339}
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I"}

#: No codec of the format makes more than so many bytes of one.
MOST_EXPANSION = 1400

WIDTH = 576
ROWS_PER_PAGE = 4096
ROWS_PER_STRIP = 512


class Page(NamedTuple):
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray | None
    error: str | None


# ---------------------------------------------------------------- compression


def packbits_encode(data: bytes) -> bytes:
    out, lit, i, n = bytearray(), 0, 0, len(data)

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = data[k : min(k + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            literal(lit, i)
            out += bytes((257 - (j - i), data[i]))
            lit = j
        i = j
    literal(lit, n)
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; a width ends one code early."""
    book: dict[bytes, int] = {}
    acc = used = 0
    out = bytearray()
    width = 9

    def put(code: int) -> None:
        nonlocal acc, used
        acc = (acc << width) | code
        used += width
        while used >= 8:
            used -= 8
            out.append(acc >> used & 255)
        acc &= (1 << used) - 1

    def reset() -> None:
        nonlocal width
        book.clear()
        book.update({bytes((k,)): k for k in range(256)})
        width = 9

    reset()
    put(256)
    nxt, cur = 258, b""
    for value in data:
        longer = cur + bytes((value,))
        if longer in book:
            cur = longer
            continue
        put(book[cur])
        book[longer] = nxt
        nxt += 1
        if nxt == 4094:
            put(256)
            reset()
            nxt = 258
        elif nxt + 1 > 1 << width:
            width += 1
        cur = bytes((value,))
    if cur:
        put(book[cur])
        nxt += 1
        if nxt + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if used:
        out.append(acc << (8 - used) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes((k,)) for k in range(256)] + [b"", b""]
    book, width, prev = list(base), 9, b""
    out, acc, have = bytearray(), 0, 0
    for byte in data:
        acc = (acc << 8) | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = acc >> have
        acc &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            book, width, prev = list(base), 9, b""
            continue
        if code < len(book):
            entry = book[code]
        elif code == len(book) and prev:
            entry = prev + prev[:1]
        else:
            raise ValueError("LZW code outside the table")
        out += entry
        if prev:
            book.append(prev + entry[:1])
        prev = entry
        if len(book) + 1 >= 1 << width and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def _pack(data: bytes, how: int) -> bytes:
    if how == RAW:
        return data
    if how == LZW:
        return lzw_encode(data)
    if how in (DEFLATE, DEFLATE_OLD):
        return zlib.compress(data, 1)
    if how == PACKBITS:
        return packbits_encode(data)
    raise ValueError(f"compression {how}")


def _unpack(data: bytes, how: int, size: int) -> bytes:
    if how == RAW:
        return data
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, size)
    if how == PACKBITS:
        return packbits_decode(data, size)
    raise ValueError(f"unknown compression {how}")


# ---------------------------------------------------------------- writer


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = ROWS_PER_STRIP, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """One directory for each ``uint8`` array of shape (rows, columns) or (rows, columns, samples).

    ``tile`` gives (rows, columns) in multiples of 16; else strips are written.
    """
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for pix in pages:
        pix = pix[:, :, None] if pix.ndim == 2 else pix
        rows, cols, samples = pix.shape
        parts: list[np.ndarray] = []
        if tile:
            th, tw = tile
            full = np.zeros((-(-rows // th) * th, -(-cols // tw) * tw, samples), np.uint8)
            full[:rows, :cols] = pix
            parts = [full[r : r + th, c : c + tw] for r in range(0, rows, th) for c in range(0, cols, tw)]
        else:
            parts = [pix[r : r + rows_per_strip] for r in range(0, rows, rows_per_strip)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                diff = part.copy()
                diff[:, 1:] -= part[:, :-1]
                part = diff
            packed = _pack(np.ascontiguousarray(part).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        entries = {
            TAG["width"]: (4, [cols]), TAG["height"]: (4, [rows]), TAG["bits"]: (3, [8] * samples), TAG["compression"]: (3, [compression]),
            TAG["photometric"]: (3, [1 if samples < 3 else 2]), TAG["samples"]: (3, [samples]), TAG["planar"]: (3, [1]), TAG["predictor"]: (3, [predictor]),
        }
        if tile:
            entries |= {TAG["tile_width"]: (4, [tile[1]]), TAG["tile_height"]: (4, [tile[0]]), TAG["tile_offsets"]: (4, offsets), TAG["tile_counts"]: (4, counts)}
        else:
            entries |= {TAG["strip_offsets"]: (4, offsets), TAG["rows_per_strip"]: (4, [rows_per_strip]), TAG["strip_counts"]: (4, counts)}
        out += b"\0" * (len(out) % 2)
        at = len(out)
        struct.pack_into(order + "I", out, link, at)
        head = bytearray(struct.pack(order + "H", len(entries)))
        tail = bytearray()
        tail_at = at + 2 + 12 * len(entries) + 4
        for tag in sorted(entries):
            kind, values = entries[tag]
            raw = struct.pack(f"{order}{len(values)}{TYPE_CODE[kind]}", *values)
            head += struct.pack(order + "HHI", tag, kind, len(values))
            if len(raw) <= 4:
                head += raw.ljust(4, b"\0")
            else:
                head += struct.pack(order + "I", tail_at + len(tail))
                tail += raw + b"\0" * (len(raw) % 2)
        link = at + len(head)
        out += head + b"\0\0\0\0" + tail
    return bytes(out)


# ---------------------------------------------------------------- reader


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, list[int]] = {}
    for k in range(n):
        where = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, where)
        size = TYPE_SIZE.get(kind, 1) * count
        src = where + 8 if size <= 4 else struct.unpack_from(order + "I", data, where + 8)[0]
        if src + size > len(data):
            raise ValueError(f"tag {tag} lies outside the data")
        if kind in TYPE_CODE and count:
            tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, src))
    (nxt,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, nxt


def _image(data: bytes, order: str, tags: dict[int, list[int]], index: int) -> Page:
    one = lambda name, default=None: tags.get(TAG[name], [default])[0]
    width, height, samples, bits = one("width"), one("height"), one("samples", 1), one("bits", 1)
    how, predictor, planar, form = one("compression", RAW), one("predictor", 1), one("planar", 1), one("format", 1)
    if not width or not height or not samples:
        raise ValueError("image without rows, columns or samples")
    kind = np.dtype(order + {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}.get((bits, form), "V"))
    if kind.kind == "V" or len(set(tags.get(TAG["bits"], [bits]))) > 1 or planar not in (1, 2) or predictor not in ((1, 3) if form == 3 else (1, 2)):
        raise ValueError(f"{bits} bits, format {form}, planar {planar}, predictor {predictor}")
    tiled = TAG["tile_offsets"] in tags
    offsets, counts = (tags[TAG[f"{'tile' if tiled else 'strip'}_{x}"]] for x in ("offsets", "counts"))
    # blocks of rows x columns, over the image; each sample has blocks of its own where they are planar
    th, tw = (one("tile_height", 0), one("tile_width", 0)) if tiled else (min(one("rows_per_strip", height), height), width)
    if not th or not tw:
        raise ValueError("strips or tiles without rows or columns")
    down, across, planes, deep = -(-height // th), -(-width // tw), samples if planar == 2 else 1, 1 if planar == 2 else samples
    if len(offsets) != down * across * planes or len(counts) != len(offsets):
        raise ValueError(f"{len(offsets)} strips or tiles of {down * across * planes}")
    if th * tw * deep * kind.itemsize * down * across * planes > MOST_EXPANSION * len(data):
        raise ValueError("more samples than the data can hold")

    def block(off: int, count: int, rows: int) -> np.ndarray:
        size = rows * tw * deep * kind.itemsize
        raw = _unpack(data[off : off + count], how, size)
        if len(raw) < size:
            raise ValueError("too few bytes in a strip or tile")
        if predictor == 3:  # differences of bytes, of which the highest of a row come first
            flat = np.cumsum(np.frombuffer(raw[:size], np.uint8).reshape(rows, -1, deep), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, tw * deep)
            return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(">f4").reshape(rows, tw, deep)
        a = np.frombuffer(raw[:size], kind).reshape(rows, tw, deep)
        return np.cumsum(a, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else a

    pixels = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (off, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, at = divmod(k, down * across)
        r, c = at // across * th, at % across * tw
        part = block(off, count, th if tiled else min(th, height - r))
        pixels[r : r + th, c : c + tw, plane : plane + deep] = part[: height - r, : width - c]
    return Page(index, width, height, samples, bits, how, predictor, pixels, None)


def read_pages(data: bytes) -> Iterator[Page]:
    """Every image of the directory chain; a loop in the chain ends it."""
    failed = lambda k, e: Page(k, 0, 0, 0, 0, 0, 0, None, f"{type(e).__name__}: {e}")
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        yield failed(0, ValueError("no TIFF header"))
        return
    (at,), seen, k = struct.unpack_from(order + "I", data, 4), set(), 0
    while at and at not in seen:
        seen.add(at)
        try:
            tags, nxt = _directory(data, order, at)
        except (ValueError, struct.error) as e:
            yield failed(k, e)
            return
        try:
            yield _image(data, order, tags, k)
        except (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error) as e:
            yield failed(k, e)
        at, k = nxt, k + 1


# ---------------------------------------------------------------- DataFrame operators


def payload_of(text: str) -> bytes:
    """UTF-8, filled with bytes 255 to a positive multiple of the row width."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\xff")


def tiff_media(docs: DataFrame, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as the samples of a TIFF, ``ROWS_PER_PAGE`` rows a page."""

    def run(rows):
        for doc_id, text in rows:
            pix = np.frombuffer(payload_of(text), np.uint8).reshape(-1, WIDTH)
            media = encode([pix[k : k + ROWS_PER_PAGE] for k in range(0, len(pix), ROWS_PER_PAGE)], compression, predictor)
            yield doc_id, len(text.encode("utf-8", "surrogatepass")), media

    return map_rows(text_or_empty(docs), run, "doc_id long, n_bytes long, media binary")


def tiff_pages(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row for each page of the binary column ``media``."""

    def run(rows):
        for k, data in rows:
            for p in read_pages(data):
                yield k, p.index, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, None if p.pixels is None else p.pixels.tobytes(), p.error

    given = df.select(F.col(key).alias("doc_id"), F.col(media).alias("media")).where("media is not null")
    return map_rows(given, run, "doc_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string", 64)


def features_of(pixels: np.ndarray) -> str:
    """Mean, deviation, eight histogram shares and a 64-bit average hash of the samples."""
    flat = pixels.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    values, n = np.arange(256), len(flat)
    mean = float(counts @ values) / n
    var = float(counts @ (values * values)) / n - mean * mean
    shares = counts.reshape(8, 32).sum(1) / n
    cells = np.add.reduceat(flat.astype(np.int64), np.linspace(0, n, 65).astype(int)[:-1]) / np.diff(np.linspace(0, n, 65).astype(int))
    bits = int("".join("1" if c > mean else "0" for c in cells), 2)
    return f"mean={mean:.6f};std={max(var, 0) ** 0.5:.6f};hist={','.join(f'{s:.6f}' for s in shares)};ahash={bits:016x}"


def tiff_digests(df: DataFrame) -> DataFrame:
    """Per row of (doc_id, n_bytes, media): the samples of all pages in order, digested.

    A medium with a damaged page fails the job: here the stored form is ours.
    """

    def run(rows):
        for doc_id, n_bytes, media in rows:
            whole, n_pages = [], 0
            for p in read_pages(media):
                if p.error:
                    raise ValueError(f"document {doc_id}, page {p.index}: {p.error}")
                whole.append(p.pixels.reshape(-1))
                n_pages += 1
            pix = np.concatenate(whole)
            payload = pix.tobytes()
            yield doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features_of(pix), n_pages

    return map_rows(df, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")
