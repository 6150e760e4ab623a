"""MD5 of many short texts at once, for orders that must agree with SQL's ``md5``."""

from __future__ import annotations

import math

import numpy as np

_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts whose sums are worked on together, so that they stay in a core's cache.
CHUNK = 1 << 13


def md5_high(columns: np.ndarray, end: bytes) -> np.ndarray:
    """The first 64 bits, in the order of the hex digits, of the MD5 of texts of one length, each followed by ``end``.

    ``columns`` has a row of bytes for each place of the texts.
    """
    length, n = columns.shape
    whole = length + len(end)
    tail = end + b"\x80" + b"\0" * (-(whole + 9) % 64) + (whole * 8).to_bytes(8, "little")
    out = np.empty(n, np.uint64)
    for at in range(0, n, CHUNK):
        out[at : at + CHUNK] = _high(columns[:, at : at + CHUNK], tail)
    return out


def _high(columns: np.ndarray, tail: bytes) -> np.ndarray:
    length, n = columns.shape
    words: list = []
    for k in range(0, length + len(tail), 4):
        if k >= length:
            words.append(int.from_bytes(tail[k - length : k - length + 4], "little"))
            continue
        word = np.zeros(n, np.uint32)
        for j in range(4):
            word |= np.uint32(tail[k + j - length] << 8 * j) if k + j >= length else columns[k + j].astype(np.uint32) << np.uint32(8 * j)
        words.append(word)
    state = [np.full(n, x, np.uint32) for x in _START]
    f, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for block in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
                g = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
                g = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
                g = (3 * i + 5) % 16
            else:
                np.bitwise_not(d, out=f)
                f |= b
                f ^= c
                g = 7 * i % 16
            f += a
            word = words[block + g]
            if isinstance(word, int):
                f += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
            else:
                f += np.uint32(_SINES[i])
                f += word
            np.left_shift(f, np.uint32(_TURNS[i]), out=turned)
            f >>= np.uint32(32 - _TURNS[i])
            f |= turned
            f += b
            a, b, c, d, f = d, f, b, c, a
        state = [x + y for x, y in zip(state, (a, b, c, d), strict=True)]
    return state[0].byteswap().astype(np.uint64) << np.uint64(32) | state[1].byteswap()
