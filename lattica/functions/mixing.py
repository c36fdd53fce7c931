"""A context-mixing coder that codes many byte strings in lockstep.

The bits of a string depend on each other, those of different strings don't: a step codes the next bit of every
string at once, so each step is a few numpy operations over all of them.  All arithmetic is on integers, which makes encoder
and decoder agree everywhere.  Strings are sorted by length, so those that are still being coded are a prefix.
"""

from __future__ import annotations

import numpy as np

ORDERS = (0, 1, 2, 3, 4, 6)
#: Slots of a context's table, and of the table of places where four bytes occurred.
SLOTS, PLACES = 1 << 13, 1 << 12
#: Strings coded together; their tables take some 200 KB each.
LANES = 256
LIMIT, RATE, START = 30, 10, 20000
_MIX = 0x9E3779B97F4A7C15


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.clip(np.rint(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int64)
    squash = np.clip(np.rint(65536 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, 65504).astype(np.int64)
    return stretch, squash, np.rint(65536 / (np.arange(LIMIT + 1) + 1.6)).astype(np.int64)


class _Model:
    """Predicts the next bit of each of ``lanes`` strings from its own past."""

    def __init__(self, lanes: int, longest: int, stride: int):
        self.stretch, self.squash, self.rate = _tables()
        self.stride, self.lanes = stride, lanes
        self.kinds = len(ORDERS) + (2 if stride else 0)
        self.p = np.full((self.kinds, lanes, SLOTS), 32768, np.uint16)
        self.n = np.zeros((self.kinds, lanes, SLOTS), np.uint8)
        self.weights = np.full((lanes, 256, self.kinds + 2), START, np.int64)
        self.seen = np.zeros((lanes, longest + 8), np.uint8)  # the past, after eight zeros
        self.places = np.zeros((lanes, PLACES), np.int64)
        self.copied, self.run = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.trust = np.full((lanes, 32), 49152, np.int64)

    def begin(self, t: int, a: int) -> None:
        """Contexts of byte ``t`` of the first ``a`` strings."""
        self.a, self.rows = a, np.arange(a)
        past = self.seen[:a, t : t + 8].astype(np.uint64)
        self.context = np.zeros((self.kinds, a), np.uint64)
        for i, order in enumerate(ORDERS):
            h = np.full(a, order + 1, np.uint64)
            for k in range(order):
                h = (h ^ past[:, 7 - k]) * np.uint64(_MIX)
                h ^= h >> np.uint64(29)
            self.context[i] = h
        if self.stride:
            above = self.seen[:a, t + 8 - self.stride] if t + 8 >= self.stride else np.zeros(a, np.uint8)
            h = (above.astype(np.uint64) + np.uint64(1000)) * np.uint64(_MIX)
            self.context[-2], self.context[-1] = h, (h ^ past[:, 7]) * np.uint64(_MIX)
        if t >= 4:
            key = (past[:, 4] << np.uint64(24) | past[:, 5] << np.uint64(16) | past[:, 6] << np.uint64(8) | past[:, 7]) * np.uint64(_MIX)
            key = (key >> np.uint64(52)).astype(np.int64)
            found = self.places[self.rows, key]
            self.copied[:a] = np.where(self.run[:a] > 0, self.copied[:a], found)
            self.places[self.rows, key] = t
        self.node = np.ones(a, np.int64)
        self.guess = self.seen[self.rows, self.copied[:a] + 8].astype(np.int64) | 256
        self.follows = self.copied[:a] > 0

    def chance(self, k: int) -> np.ndarray:
        """Probability of a one for bit ``k`` from the top, in parts of 65536."""
        a, rows = self.a, self.rows
        slot = (self.context + self.node.astype(np.uint64)) * np.uint64(_MIX)
        self.slot = (slot >> np.uint64(51)).astype(np.int64)
        self.at = (np.arange(self.kinds)[:, None], rows[None, :], self.slot)
        self.inputs = np.zeros((a, self.kinds + 2), np.int64)
        self.now = self.p[self.at].astype(np.int64)
        self.inputs[:, : self.kinds] = self.stretch[self.now >> 4].T
        self.live = self.follows & (self.guess >> (8 - k) == self.node)
        self.says = self.guess >> (7 - k) & 1
        self.bucket = np.minimum(self.run[:a], 31)
        sure = self.stretch[self.trust[rows, self.bucket] >> 4]
        self.inputs[:, -2] = np.where(self.live, np.where(self.says == 1, sure, -sure), 0)
        self.inputs[:, -1] = 128
        w = self.weights[rows, self.node]
        x = np.clip((w * self.inputs).sum(1) >> 16, -2047, 2047)
        self.out = self.squash[x + 2047]
        return self.out

    def learn(self, bit: np.ndarray) -> None:
        rows, target = self.rows, np.where(bit == 1, 65535, 0)
        count = self.n[self.at]
        self.p[self.at] = self.now + ((target[None, :] - self.now) * self.rate[count] >> 16)
        self.n[self.at] = np.minimum(count + 1, LIMIT)
        self.weights[rows, self.node] += self.inputs * (target - self.out)[:, None] * RATE >> 17
        old = self.trust[rows, self.bucket]
        right = np.where(self.says == bit, 65535, 0)
        self.trust[rows, self.bucket] = np.where(self.live, old + (right - old >> 6), old)
        self.follows &= self.says == bit
        self.node = self.node << 1 | bit

    def end(self, t: int) -> None:
        """The byte is known."""
        a = self.a
        self.seen[:a, t + 8] = self.node & 255
        hit = (self.copied[:a] > 0) & (self.guess == self.node)
        self.run[:a] = np.where(hit, self.run[:a] + 1, 0)
        self.copied[:a] += hit


def _shared(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.flatnonzero((low ^ high) >> 24 == 0)


def _split(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    return low + ((high - low) * p >> 16)


def _encode(parts: list[bytes], stride: int) -> list[bytes]:
    sizes = np.array([len(x) for x in parts])
    longest = int(sizes[0])
    model = _Model(len(parts), longest, stride)
    data = np.zeros((len(parts), longest), np.int64)
    for i, x in enumerate(parts):
        data[i, : len(x)] = np.frombuffer(x, np.uint8)
    low, high = np.zeros(len(parts), np.int64), np.full(len(parts), 0xFFFFFFFF, np.int64)
    out, end = np.zeros((len(parts), 2 * longest + 16), np.uint8), np.zeros(len(parts), np.int64)
    for t in range(longest):
        a = int((sizes > t).sum())
        model.begin(t, a)
        for k in range(8):
            mid = _split(low[:a], high[:a], model.chance(k))
            bit = data[:a, t] >> (7 - k) & 1
            low[:a], high[:a] = np.where(bit == 1, low[:a], mid + 1), np.where(bit == 1, mid, high[:a])
            model.learn(bit)
            while len(go := _shared(low[:a], high[:a])):
                out[go, end[go]] = high[go] >> 24
                end[go] += 1
                low[go], high[go] = low[go] << 8 & 0xFFFFFFFF, high[go] << 8 & 0xFFFFFFFF | 255
        model.end(t)
    return [out[i, : end[i]].tobytes() + int(low[i]).to_bytes(4, "big") for i in range(len(parts))]


def _decode(parts: list[bytes], sizes: np.ndarray, stride: int) -> list[bytes]:
    longest = int(sizes[0])
    model = _Model(len(parts), longest, stride)
    width = max(len(x) for x in parts) + 8
    coded, given = np.zeros((len(parts), width), np.int64), np.array([len(x) for x in parts])
    for i, x in enumerate(parts):
        coded[i, : len(x)] = np.frombuffer(x, np.uint8)
    low, high = np.zeros(len(parts), np.int64), np.full(len(parts), 0xFFFFFFFF, np.int64)
    code = coded[:, 0] << 24 | coded[:, 1] << 16 | coded[:, 2] << 8 | coded[:, 3]
    end = np.full(len(parts), 4, np.int64)
    for t in range(longest):
        a = int((sizes > t).sum())
        model.begin(t, a)
        for k in range(8):
            mid = _split(low[:a], high[:a], model.chance(k))
            bit = (code[:a] <= mid).astype(np.int64)
            low[:a], high[:a] = np.where(bit == 1, low[:a], mid + 1), np.where(bit == 1, mid, high[:a])
            model.learn(bit)
            while len(go := _shared(low[:a], high[:a])):
                code[go] = code[go] << 8 & 0xFFFFFFFF | coded[go, np.minimum(end[go], width - 1)]
                end[go] += 1
                low[go], high[go] = low[go] << 8 & 0xFFFFFFFF, high[go] << 8 & 0xFFFFFFFF | 255
        model.end(t)
    if (end != given).any() or (code != low).any():
        raise ValueError("the coded data is damaged")
    return [model.seen[i, 8 : 8 + n].tobytes() for i, n in enumerate(sizes)]


def _grouped(sizes: list[int]) -> list[list[int]]:
    """Places of the strings that are not empty, the longest first, ``LANES`` at a time."""
    order = sorted((i for i, n in enumerate(sizes) if n), key=lambda i: -sizes[i])
    return [order[i : i + LANES] for i in range(0, len(order), LANES)]


def pack(parts: list[bytes], stride: int = 0) -> list[bytes]:
    """Each string coded by itself; ``stride`` is the row length if they are matrices.  Empty strings stay empty."""
    out = [b""] * len(parts)
    for group in _grouped([len(x) for x in parts]):
        for i, x in zip(group, _encode([parts[i] for i in group], stride), strict=True):
            out[i] = x
    return out


def unpack(parts: list[bytes], sizes: list[int], stride: int = 0) -> list[bytes]:
    """The strings of these sizes back; data that is too short, too long or not what ``pack`` ends with raises."""
    out = [b""] * len(parts)
    if any((n == 0) != (len(x) == 0) or 0 < len(x) < 4 for x, n in zip(parts, sizes, strict=True)):
        raise ValueError("the coded data is damaged")
    for group in _grouped(sizes):
        for i, x in zip(group, _decode([parts[i] for i in group], np.array([sizes[i] for i in group]), stride), strict=True):
            out[i] = x
    return out
