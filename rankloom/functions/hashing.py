"""Draws derived from md5, so that any engine can repeat them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | str | int) -> Column:
    """First 32 bits of the md5 of the parts joined by ':' as a bigint."""
    cols = [F.lit(str(p)) if isinstance(p, int) else F.col(p).cast("string") if isinstance(p, str)
            else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) fixed by the parts."""
    return hash32(*parts) / F.lit(4294967296.0)


_TENS = 10 ** np.arange(1, 19, dtype=np.int64)
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
# Numbers hashed at once.
_AT_ONCE = 1 << 16


def _md5_of_block(words: list, n: int) -> np.ndarray:
    """First word of the md5 of ``n`` messages of one block, given as 16 words each a number or an array."""
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        if isinstance(words[g], np.ndarray) or words[g]:
            f += words[g]
        high = f >> np.uint32(32 - _TURNS[i])
        f <<= np.uint32(_TURNS[i])
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return a + _START[0]


def hash32_numbers(*parts: np.ndarray | int) -> np.ndarray:
    """``hash32`` of whole numbers from 0 on, for many at once inside a task.

    Their text, 55 characters at most, fits one block of md5; numbers of the same lengths are hashed together.
    """
    arrays = np.broadcast_arrays(*[np.atleast_1d(np.asarray(p, dtype=np.int64)) for p in parts])
    sizes = [np.searchsorted(_TENS, x, side="right") + 1 for x in arrays]
    layout = np.zeros(len(arrays[0]), dtype=np.int64)
    for s in sizes:
        layout = layout * 20 + s
    out = np.empty(len(layout), dtype=np.int64)
    for kind in np.unique(layout):
        same = np.flatnonzero(layout == kind)
        lengths = [int(s[same[0]]) for s in sizes]
        total = sum(lengths) + len(lengths) - 1
        if total > 55:
            raise ValueError("the numbers are too long for one block")
        for lo in range(0, len(same), _AT_ONCE):
            rows = same[lo:lo + _AT_ONCE]
            words: list = [np.uint32(0)] * 16

            def put(at: int, char) -> None:
                words[at // 4] = words[at // 4] | (char << np.uint32(8 * (at % 4)))

            end = 0
            for x, length in zip(arrays, lengths):
                left = x[rows]
                end += length
                for back in range(1, length + 1):
                    rest = left // 10
                    put(end - back, (left - rest * 10 + 48).astype(np.uint32))
                    left = rest
                put(end, np.uint32(58 if end < total else 128))  # ':', or the mark behind the text
                end += 1
            words[14] = np.uint32(8 * total)
            out[rows] = _md5_of_block(words, len(rows)).byteswap()
    return out


def uniform_numbers(*parts: np.ndarray | int) -> np.ndarray:
    """``uniform`` of whole numbers from 0 on."""
    return hash32_numbers(*parts) / 4294967296.0
