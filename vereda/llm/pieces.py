"""SentencePiece encoding and decoding by suffix-array matching.

The distinct space-led units of a batch are concatenated and indexed by a suffix array.  Every
piece of the vocabulary is searched in it by bisection, which gives the range of its
occurrences.  Each occurrence is an edge over the text; sorted by position, the edges are
relaxed from left to right.  The vocabulary is a BPE one, so relaxing keeps for every position
the one piece that can stand last before it: an edge holds if its piece and the piece before
it would not merge otherwise (undoing both pieces' merges in reverse order shows that).  The
ids equal those of the sentencepiece library.

Characters that are no piece become their bytes; a text gets a leading space, and decoding
takes it off again.  Units never share a piece across their edges, since no piece holds a
space after another character (checked when the tables are built).

Defined cases: a null or empty text has no ids and decodes to the empty text; the character
U+2581 is read as a space, as in the library; repeated rows are each encoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Lookup, slices
from .units import Memory

SPACE = "▁"
#: Characters of distinct units that are indexed at once; some 30 arrays have a number for each.
INDEX_CHARS = 1 << 18
_BIG = 1 << 30
_CODE, _GROUP = 12, 5  # bits of a character's code; characters in one integer key


def _bpe(text: str, rank: dict[str, int]) -> list[str]:
    parts = list(text)
    while len(parts) > 1:
        best = min(((rank.get(parts[i] + parts[i + 1], _BIG), i) for i in range(len(parts) - 1)))
        if best[0] == _BIG:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def _bisect(keys: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, after: bool) -> np.ndarray:
    """For each target its place in its own sorted range of the keys."""
    low, high = low.copy(), high.copy()
    while (on := np.flatnonzero(low < high)).size:
        mid = (low[on] + high[on]) // 2
        got, want = keys[mid], target[on]
        up = got <= want if after else got < want
        low[on[up]] = mid[up] + 1
        high[on[~up]] = mid[~up]
    return low


@dataclass
class Tables:
    """What is needed of a vocabulary, as arrays; a few megabytes."""

    code: np.ndarray  # code point → character code, 0 for none
    base: np.ndarray  # character code → id
    rank: np.ndarray  # id → order of merging, -1 for one character
    left: np.ndarray
    right: np.ndarray
    pair: Lookup
    pair_id: np.ndarray
    ids: np.ndarray  # searched pieces
    size: np.ndarray  # their lengths
    keys: np.ndarray  # their characters, _GROUP to a key, lowest and highest continuation
    byte0: int
    blob: np.ndarray  # id → bytes
    blob_at: np.ndarray
    memo_key: np.ndarray = field(default_factory=lambda: np.zeros(1 << 21, np.uint32))
    memo: np.ndarray = field(default_factory=lambda: np.zeros(1 << 21, bool))
    memory: Memory = field(default_factory=Memory)

    @classmethod
    def load(cls, path: str) -> Tables:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in plain}
        if any(SPACE in t.lstrip(SPACE) for t in text.values()):
            raise ValueError("a piece holds a space after another character")
        place = {t: i for i, t in text.items()}
        order = {text[i]: k for k, i in enumerate(sorted(plain, key=lambda i: -sp.get_score(i))) if len(text[i]) > 1}
        chars = sorted({c for t in text.values() for c in t})
        if len(chars) >= 1 << _CODE or max(map(len, text.values())) > 4 * _GROUP:
            raise ValueError("the vocabulary has too many characters or too long pieces")
        code = np.zeros(0x110000, np.uint16)
        code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        code[ord(" ")] = code[ord(SPACE)]
        base = np.array([-1, *(place.get(c, -1) for c in chars)])
        rank, left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        keep, pairs = [], {}
        for i, t in text.items():
            if len(t) == 1:
                keep.append(i)
                continue
            rank[i] = order[t]
            for k in range(1, len(t)):
                if t[:k] in place and t[k:] in place:
                    pairs[place[t[:k]] << 16 | place[t[k:]]] = i
            halves = _bpe(t, {k: v for k, v in ((t[a:b], order.get(t[a:b], _BIG)) for a in range(len(t)) for b in range(a + 2, len(t) + 1)) if v < order[t]})
            if len(halves) == 2 and all(h in place for h in halves):  # else merging never makes this piece
                left[i], right[i] = place[halves[0]], place[halves[1]]
                keep.append(i)
        ids = np.array(keep)
        lengths = np.array([len(text[i]) for i in keep])
        keys = np.zeros((4, 2, len(keep)), np.uint64)
        for row, i in enumerate(keep):
            digits = [int(code[ord(c)]) for c in text[i]]
            for end, fill in ((0, 0), (1, (1 << _CODE) - 1)):
                full = digits + [fill] * (4 * _GROUP - len(digits))
                for g in range(4):
                    value = 0
                    for d in full[g * _GROUP : (g + 1) * _GROUP]:
                        value = value << _CODE | d
                    keys[g, end, row] = value
        blobs = [bytes([i - sp.piece_to_id("<0x00>")]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        edge = np.concatenate(([0], np.cumsum([len(b) for b in blobs])))
        found = np.array(list(pairs.keys()), np.uint64)
        return cls(code, base, rank, left, right, Lookup(found), np.array(list(pairs.values())), ids, lengths, keys, sp.piece_to_id("<0x00>"), np.frombuffer(b"".join(blobs), np.uint8), edge)

    # -- which pieces may stand side by side -------------------------------------------

    def _undo(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        good = np.ones(len(x), bool)
        todo, limit = np.arange(len(x)), np.full(len(x), _BIG)
        while len(todo):
            row = self.pair.find(x.astype(np.uint64) << np.uint64(16) | y.astype(np.uint64))
            crossed = (row >= 0) & (self.rank[self.pair_id[row]] < limit)
            good[todo[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            todo, x, y, rx, ry = todo[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            limit = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return good

    def side_by_side(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = (x.astype(np.uint32) << np.uint32(16) | y.astype(np.uint32)) + np.uint32(1)
        slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(11)
        out = self.memo[slot]
        miss = self.memo_key[slot] != key
        if miss.any():
            new, back = np.unique(key[miss], return_inverse=True)
            pair = new - np.uint32(1)
            good = self._undo((pair >> np.uint32(16)).astype(np.int64), (pair & np.uint32(0xFFFF)).astype(np.int64))
            at = (new * np.uint32(0x9E3779B1)) >> np.uint32(11)
            self.memo_key[at], self.memo[at] = new, good
            out[miss] = good[back]
        return out

    # -- suffix array, edges, relaxation ------------------------------------------------

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every occurrence of every piece."""
        n = len(code)
        pad = np.concatenate((code, np.zeros(4 * _GROUP, code.dtype))).astype(np.uint64)
        key = np.zeros(n + 3 * _GROUP, np.uint64)
        for j in range(_GROUP):
            key = key << np.uint64(_CODE) | pad[j : j + len(key)]
        order = np.argsort(key[:n])
        rank = np.zeros(n + 2 * _GROUP, np.uint64)
        for step in (_GROUP, 2 * _GROUP):
            ahead = key[order] if step == _GROUP else both[order]
            rank[order] = np.cumsum(np.concatenate(([True], ahead[1:] != ahead[:-1]))).astype(np.uint64)
            both = rank[:n] << np.uint64(32)
            both[: n - step if n > step else 0] |= rank[step:n]
            order = np.argsort(both)
        sorted_keys = [key[order + g * _GROUP] for g in range(4)]
        low = np.searchsorted(sorted_keys[0], self.keys[0, 0], "left")
        high = np.searchsorted(sorted_keys[0], self.keys[0, 1], "right")
        for g in range(1, 4):
            more = np.flatnonzero((self.size > g * _GROUP) & (low < high))
            if len(more):
                a = _bisect(sorted_keys[g], low[more], high[more], self.keys[g, 0, more], False)
                high[more] = _bisect(sorted_keys[g], low[more], high[more], self.keys[g, 1, more], True)
                low[more] = a
        count = high - low
        at = order[np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
        return at, np.repeat(self.size, count), np.repeat(self.ids, count)

    def relax(self, code: np.ndarray) -> np.ndarray:
        """For each character the id of the piece that begins there, or -1."""
        n = len(code)
        start, size, piece = self.edges(code)
        crossed = np.zeros(n + 1, np.int64)
        long = size > 1
        np.add.at(crossed, start[long] + 1, 1)
        np.add.at(crossed, start[long] + size[long], -1)
        cut = np.cumsum(crossed)[:n] == 0
        token = np.full(n, -1)
        alone = cut & np.concatenate((cut[1:], [True]))
        known = alone & (code > 0)
        token[known] = self.base[code[known]]
        begin = np.flatnonzero(cut)
        segment = np.cumsum(cut) - 1
        use = ~alone[start]
        start, size, piece = start[use], size[use], piece[use]
        level = start + size - begin[segment[start]]
        # by the place of their end; a radix sort where the levels are short integers
        order = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
        start, size, piece, level = start[order], size[order], piece[order], level[order]
        last, origin = np.full(n + 1, -1), np.full(n + 1, -1)
        edge = np.concatenate(([0], np.flatnonzero(level[1:] != level[:-1]) + 1, [len(level)])) if len(level) else [0]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            s, p = start[a:b], piece[a:b]
            before = last[s]
            good = cut[s]
            inner = np.flatnonzero(~good & (before >= 0))
            good[inner] = self.side_by_side(before[inner], p[inner])
            e = s[good] + size[a:b][good]
            last[e], origin[e] = p[good], s[good]
        ends = np.append(begin[1:], n)
        at = ends[~alone[begin]]
        first = begin[~alone[begin]]
        while len(at):
            token[origin[at]] = last[at]
            at = origin[at]
            on = at > first
            at, first = at[on], first[on]
        return token

    def encode_units(self, held: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units (each is followed by a zero byte) one after the other, and where
        each unit's begin."""
        points = np.frombuffer(held.decode().encode("utf-32-le"), np.uint32)
        leads = np.concatenate(([0], np.cumsum((np.frombuffer(held, np.uint8) & 0xC0) != 0x80)))
        owner_size = np.diff(leads[np.concatenate(([0], np.cumsum(size + 1)))])
        code = self.code[points]
        gap = np.cumsum(owner_size) - 1
        code[gap] = 0
        token = self.relax(code)
        owner = np.repeat(np.arange(len(size)), owner_size)
        strange = token < 0
        strange[gap] = False
        strange &= code == 0
        count = (token >= 0).astype(np.int64)
        wide = points[strange]
        count[strange] = 1 + (wide > 0x7F) + (wide > 0x7FF) + (wide > 0xFFFF)
        out = np.repeat(token, count)
        if strange.any():
            at = np.repeat(strange, count)
            out[at] = np.frombuffer("".join(map(chr, wide.tolist())).encode(), np.uint8) + self.byte0
        return out.astype(np.uint16), np.concatenate(([0], np.cumsum(np.bincount(owner, count, len(size)).astype(np.int64))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        raw = b"".join([b" " + t.encode() if t else b"" for t in texts]).replace(SPACE.encode(), b" ")
        sizes = np.array([len(t.replace(SPACE, " ").encode()) + 1 if t else 0 for t in texts])
        data = np.frombuffer(raw, np.uint8)
        edge = np.concatenate(([0], np.cumsum(sizes)))
        if not len(data):
            return np.zeros(0, np.uint16), edge
        blank = data == 32
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[edge[:-1][sizes > 0]] = True
        start = np.flatnonzero(begin)
        out, first = self.memory.encode(raw, start, self.encode_units, INDEX_CHARS)
        return out, first[np.searchsorted(start, edge)]

    def decode(self, ids: np.ndarray, edge: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts, each with its leading space, and where each text's begin."""
        size = np.diff(self.blob_at)[ids]
        first = np.concatenate(([0], np.cumsum(size)))
        data = self.blob[np.repeat(self.blob_at[ids] - first[:-1], size) + np.arange(first[-1])]
        return data.tobytes(), first[edge]



def encoded(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """``docs`` without the text, with n_pieces, ids_crc32 (of the ids as little-endian 32-bit
    integers), decoded_sha256 of the text decoded from the ids, and round_trip; and with the
    ids themselves.  Columns of these names are replaced."""
    import hashlib

    names = ["n_pieces", "ids_crc32", "decoded_sha256", "round_trip", "ids"]
    keep = [c for c in docs.columns if c not in ("text", *names)]
    shared = docs.sparkSession.sparkContext.broadcast(Tables.load(model))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean", *(["ids array<int>"] if with_ids else [])])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids, edge = tables.encode(texts)
            raw, at = tables.decode(ids, edge)
            wide = ids.astype("<u4")
            back = [raw[at[i] + 1 : at[i + 1]] for i in range(len(texts))]
            columns = [
                pa.array(np.diff(edge)),
                pa.array([zlib.crc32(wide[edge[i] : edge[i + 1]]) for i in range(len(texts))], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in back]),
                pa.array([t == own.encode() for t, own in zip(back, texts, strict=True)]),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], names=[*keep, *names[: len(columns)]])

    return docs.select(*keep, "text").mapInArrow(rows, schema)
