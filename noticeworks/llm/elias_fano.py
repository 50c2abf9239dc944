"""Elias-Fano coding of monotone sequences in numpy, queried by whole arrays."""

from __future__ import annotations

import json

import numpy as np

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th set bit (from 0) of each word."""
    pos, r = np.zeros(len(x), np.int64), r.copy()
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
        up = r >= low
        r -= np.where(up, low, 0)
        pos += np.where(up, half, 0)
        x = np.where(up, x >> np.uint64(half), x)
    return pos


class Bits:
    """A bit vector with select of ones or zeros: ``before`` counts them ahead of each word."""

    def __init__(self, words: np.ndarray, before: np.ndarray, ones: bool):
        self.words, self.before, self.flip = words, before, np.uint64(0) if ones else _ALL

    @staticmethod
    def counted(words: np.ndarray, ones: bool) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bitwise_count(words if ones else ~words).astype(np.int64))[:-1]])

    def select(self, rank: np.ndarray) -> np.ndarray:
        """Positions of the bits of these ranks, all of which exist."""
        word = np.searchsorted(self.before, rank, "right") - 1
        return word * 64 + _select_in_word(self.words[word] ^ self.flip, rank - self.before[word])


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays that hold a non-decreasing sequence of unsigned 64-bit values."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
    high = (values >> np.uint64(low)).astype(np.int64)
    size = (int(high[-1]) if n else 0) + n + 2
    words = np.zeros((size >> 6) + 2, np.uint64)
    at = high + np.arange(n)
    np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    lows = [np.zeros(0, np.uint8)]
    for i in range(0, n if low else 0, 1 << 16):  # each step packs whole bytes
        part = values[i : i + (1 << 16)]
        raw = (part[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        lows.append(np.packbits(raw.ravel(), bitorder="little"))
    return {
        "head": np.array([n, low, int(high[-1]) if n else -1], np.int64),
        "upper": words,
        "zeros": Bits.counted(words, False),
        "ones": Bits.counted(words, True),
        "lower": np.concatenate([*lows, np.zeros(16, np.uint8)]),
    }


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low, self.top = (int(x) for x in arrays["head"])
        self.zeros = Bits(arrays["upper"], arrays["zeros"], False)
        self.ones = Bits(arrays["upper"], arrays["ones"], True)
        raw = arrays["lower"]
        self.lower = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        self.mask = np.uint64((1 << self.low) - 1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        return self.lower[bit >> 3] >> (bit & 7).astype(np.uint64) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self.ones.select(i) - i
        return high.astype(np.uint64) << np.uint64(self.low) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element equal to each value, -1 where there is none: the successor, if it is the value itself."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high = (values >> np.uint64(self.low)).astype(np.int64)
        todo = np.flatnonzero((high >= 0) & (high <= self.top))
        high, low = high[todo], values[todo] & self.mask
        at = np.zeros(len(todo), np.int64)
        later = high > 0
        at[later] = self.zeros.select(high[later] - 1) + 1
        index, words = at - high, self.zeros.words
        for _ in range(3):  # most buckets hold an element or two
            one = words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1
            todo, high, low, at, index = todo[one], high[one], low[one], at[one], index[one]
            if not len(todo):
                return out
            there = self._low(index)
            hit = there == low
            out[todo[hit]] = index[hit]
            go = there < low
            todo, high, low, at, index = todo[go], high[go], low[go], at[go] + 1, index[go] + 1
        if not len(todo):
            return out
        end = self.zeros.select(high) - high  # a large one is searched by halves
        stop = end.copy()
        while len(who := np.flatnonzero(index < end)):
            mid = (index[who] + end[who]) >> 1
            less = self._low(mid) < low[who]
            index[who] = np.where(less, mid + 1, index[who])
            end[who] = np.where(less, end[who], mid)
        inside = np.flatnonzero(index < stop)
        hit = inside[self._low(index[inside]) == low[inside]]
        out[todo[hit]] = index[hit]
        return out


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one buffer that can be mapped into memory."""
    head, parts, at = {}, [], 0
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = (a.dtype.str, len(a), at)
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 64)
        parts.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def unpack(buffer) -> dict[str, np.ndarray]:
    """Views of the arrays of a packed buffer; nothing is copied."""
    raw = np.frombuffer(buffer, np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    return {name: np.frombuffer(buffer, np.dtype(kind), size, 8 + n + at) for name, (kind, size, at) in head.items()}
