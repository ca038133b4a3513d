"""The hashed uniform of ``exprs.hash_uniform`` for all pairs of whole numbers, in numpy.

The uniform of a key is the first 32 bits of md5 of seed#key#0. For keys that are two numbers joined by ``_`` the message is one block,
and each of its bytes belongs to one of the two numbers alone, so the words of a pair are those of its ends put together.
"""

from __future__ import annotations

import math

import numpy as np

#: Pairs that are hashed together: a few arrays of this length stay in a core's cache.
CELLS = 1 << 15
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_STEPS = [(w, k, np.array(k, np.uint32), np.array(t, np.uint32), np.array(32 - t, np.uint32)) for w, k, t in list(zip(_WORD, _ADDED, _TURNS, strict=True))[:61]]


def _empty(n: int) -> np.ndarray:
    """An array that begins with a cache line: operations on it are a tenth faster."""
    raw = np.empty(4 * n + 64, np.uint8)
    at = -raw.ctypes.data % 64
    return raw[at : at + 4 * n].view(np.uint32)


def _first_word(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """First 32 bits, as a number, of md5 of ``n`` messages of one block; steps 61 to 63 do not touch them."""
    a, b, c, d, f = (_empty(n) for _ in range(5))
    for x, start in zip((a, b, c, d), _START, strict=True):
        x.fill(start)
    for i, (at, k, added, left, right) in enumerate(_STEPS):
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(a, f, a)
        w = words[at]
        if isinstance(w, int):
            np.add(a, np.uint32((w + k) & 0xFFFFFFFF) if w else added, a)
        else:
            np.add(w, added, f)
            np.add(a, f, a)
        np.left_shift(a, left, f)
        np.right_shift(a, right, a)
        np.bitwise_or(a, f, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
    return np.add(b, np.uint32(_START[0]), b).byteswap(inplace=True)


def _joined(p: np.ndarray, q: np.ndarray) -> int | np.ndarray:
    """One word of all pairs of messages' ends; a number if all have the same."""
    if (p == p[0]).all() and (q == q[0]).all():
        return int(p[0] | q[0])
    out = _empty(len(p) * len(q))
    np.bitwise_or(p[:, None], q[None, :], out.reshape(len(p), -1))
    return out


def _by_length(ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(digits, places, bytes of the decimal texts) of numbers whose texts are equally long."""
    if ids.dtype.kind not in "iu":
        raise ValueError("ids are whole numbers, none of them null")
    text = ids.astype("S20")
    size = np.char.str_len(text)
    raw = text.view(np.uint8).reshape(len(ids), 20)
    return [(int(k), at, raw[at, :k]) for k in np.unique(size) for at in [np.flatnonzero(size == k)]]


def _words(n: int, *parts: tuple[int, bytes | np.ndarray]) -> np.ndarray:
    """The 16 words of ``n`` blocks with bytes at given places, else zero: [word, block]."""
    block = np.zeros((n, 64), np.uint8)
    for at, part in parts:
        part = np.frombuffer(part, np.uint8) if isinstance(part, bytes) else part
        block[:, at : at + part.shape[-1]] = part
    return np.ascontiguousarray(block.view("<u4").astype(np.uint32).T)


def pair_hashes(seed: object, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[a, b] of uint32: ``hash_uniform(seed, "a_b")`` times 2**32."""
    out = np.empty((len(a), len(b)), np.uint32)
    start = f"{seed}#".encode()
    for la, rows, left in _by_length(a):
        for lb, cols, right in _by_length(b):
            end = len(start) + la + 1 + lb
            if end + 2 > 55:
                raise ValueError(f"seed {seed!r} is too long for keys of one block")
            x = _words(len(rows), (0, start), (len(start), left), (len(start) + la, b"_"))
            y = _words(len(cols), (len(start) + la + 1, right), (end, b"#0\x80"), (56, ((end + 2) * 8).to_bytes(8, "little")))
            for lo in range(0, len(cols), CELLS):
                z = y[:, lo : lo + CELLS]
                m = z.shape[1]
                step = max(1, CELLS // m)
                for at in range(0, len(rows), step):
                    w = x[:, at : at + step]
                    n = w.shape[1] * m
                    out[np.ix_(rows[at : at + step], cols[lo : lo + CELLS])] = _first_word([_joined(p, q) for p, q in zip(w, z, strict=True)], n).reshape(-1, m)
    return out
