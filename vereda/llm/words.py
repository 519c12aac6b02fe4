"""Words of many texts at once, as arrays: bounds, hashes and hashes of word runs.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and
carriage return.  All of these are ASCII, so cutting UTF-8 bytes cuts no character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import mix, stream, text_bytes

_BYTE = stream(256, 11) | np.uint64(1)
_PLACE = stream(1 << 12, 12)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """``first[i]:first[i+1]`` are the words of text i; ``start``/``end`` are byte bounds."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    if not len(data):
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begin[edge] = solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[edge[1:] - 1] = solid[edge[1:] - 1]
    start = np.flatnonzero(begin)
    return Words(data, start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word: a multilinear hash of its bytes, then a finaliser."""
    global _PLACE
    if not len(w.start):
        return np.zeros(0, np.uint64)
    size = w.end - w.start
    if size.max() > len(_PLACE):
        _PLACE = stream(int(size.max()), 12)
    solid = w.data[~_SPACE[w.data]]
    begin = np.cumsum(size) - size
    place = np.arange(len(solid)) - np.repeat(begin, size)
    value = _BYTE[solid] * _PLACE[place]
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values (len(h)-k+1 of them), by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    power, level, have, made = h, 1, None, 0
    while True:
        if k & level:
            if have is None:
                have, made = power, level
            else:
                n = len(h) - made - level + 1
                have = mix(have[:n] * _A + (power[made : made + n] ^ _B) * _B)
                made += level
        if made == k:
            return have if k > 1 else have.copy()
        n = len(power) - level
        power = mix(power[:n] * _A + (power[level : level + n] ^ _B) * _B)
        level *= 2


def within(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs of length k, numbered by their first word, lie in one text."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n + k, bool)
    for j in range(1, k):  # a run that starts less than k words before a text's end leaves it
        at = first[1:] - j
        ok[at[at >= np.repeat(first[0], len(at))]] = False
    return ok[:n]
