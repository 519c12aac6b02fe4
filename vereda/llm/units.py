"""Encoding texts through their distinct units, remembered by each worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import Lookup, mix, stream

#: Units whose ids a worker remembers from batch to batch.
KNOWN = 1 << 20
_BYTE = stream(256, 31) | np.uint64(1)

#: Bytes of units, each followed by a zero byte, and the units' sizes → ids, and where each unit's begin.
Encoder = Callable[[bytes, np.ndarray], tuple[np.ndarray, np.ndarray]]


def hashes(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and size of the units that tile the bytes from each start to the next."""
    size = np.diff(np.append(start, len(data)))
    place = np.arange(len(data)) - np.repeat(start, size)
    power = stream(max(int(size.max(initial=1)), 1), 32)
    return mix(np.add.reduceat(_BYTE[data] * power[place], start) + size.astype(np.uint64)), size


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """The array with space for n values at least; it doubles, so adding is cheap."""
    if n <= len(held):
        return held
    out = np.zeros(max(n, 2 * len(held)), held.dtype)
    out[: len(held)] = held
    return out


class Memory:
    """Hash of a unit → its ids; forgets everything when it would hold more than KNOWN.

    Units are told apart by 64 bits of hash: among KNOWN units a new one meets the hash of
    another with probability 2**-44."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.find = Lookup()
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(0, np.uint16), 0

    def encode(self, raw: bytes, start: np.ndarray, encoder: Encoder, chars: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and where each unit's begin; new units go to the
        encoder, about ``chars`` characters at once."""
        h, size = hashes(np.frombuffer(raw, np.uint8), start)
        row = self.find.find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            own, pick, back = np.unique(h[new], return_index=True, return_inverse=True)
            if self.find.n + len(own) > KNOWN:
                self.clear()
                new = np.arange(len(h))
                own, pick, back = np.unique(h, return_index=True, return_inverse=True)
            self._learn(own, raw, start[new[pick]], size[new[pick]], encoder, chars)
            row[new] = back + (self.find.n - len(own))
        at, count = self.at[row], self.n[row].astype(np.int64)
        first = np.cumsum(count) - count
        return self.pool[np.repeat(at - first, count) + np.arange(count.sum())], np.append(first, count.sum())

    def _learn(self, own: np.ndarray, raw: bytes, start: np.ndarray, size: np.ndarray, encoder: Encoder, chars: int) -> None:
        row, done = self.find.n, np.cumsum(size + 1)
        self.at, self.n = _room(self.at, row + len(own)), _room(self.n, row + len(own))
        data, a = np.frombuffer(raw, np.uint8), 0
        while a < len(own):
            z = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + chars, side="right")))
            some = size[a:z]
            end = np.cumsum(some + 1)
            held = np.zeros(int(end[-1]), np.uint8)
            first = end - some - 1
            step = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
            held[np.repeat(first, some) + step] = data[np.repeat(start[a:z], some) + step]
            got, first = encoder(held.tobytes(), some)
            self.pool = _room(self.pool, self.used + len(got))
            self.pool[self.used : self.used + len(got)] = got
            self.at[row + a : row + z] = first[:-1] + self.used
            self.n[row + a : row + z] = np.diff(first)
            self.used += len(got)
            a = z
        self.find.add(own)
