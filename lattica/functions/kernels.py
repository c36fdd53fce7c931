"""Array kernels that run inside Arrow batches: reshaping, raw DEFLATE, block keys."""

from __future__ import annotations

import zlib
from math import isqrt

import numpy as np

#: Most bytes that a byte of raw DEFLATE can stand for.
DEFLATE_RATIO = 1032


def deflate(data: bytes, level: int = 9) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def inflate(data: bytes, n: int) -> bytes:
    """Exactly ``n`` bytes, and nothing after them."""
    d = zlib.decompressobj(-15)
    out = d.decompress(data, n + 1)
    if len(out) != n or not d.eof or d.unused_data:
        raise ValueError("the DEFLATE data is damaged")
    return out


def fold(data: bytes, w: int) -> np.ndarray:
    """Rows of ``w``, the last filled up with zeros."""
    h = -(-len(data) // w)
    out = np.zeros(h * w, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(h, w)


def fits(kind: str, k: int, w: int) -> bool:
    return w % {"bitplanes": 8, "deint": k}.get(kind, 1) == 0


def forward(m: np.ndarray, kind: str, k: int) -> np.ndarray:
    h, w = m.shape
    if kind == "bitplanes":
        bits = np.unpackbits(m, axis=1, bitorder="little").reshape(h, w, 8)
        return np.packbits(bits.transpose(2, 0, 1).reshape(8 * h, w), axis=1, bitorder="little")
    if kind == "deint":
        return np.concatenate([m[:, p::k] for p in range(k)])
    out, d = m.copy(), k or 1
    a, b = (out[:, 1:], m[:, :-1]) if kind.startswith("left") else (out[d:], m[:-d] if d < h else m[:0])
    if kind.endswith("sub"):
        np.subtract(a, b, out=a)
    else:
        np.bitwise_xor(a, b, out=a)
    return out


def inverse(m: np.ndarray, kind: str, k: int) -> np.ndarray:
    h, w = m.shape
    if kind == "bitplanes":
        planes = np.unpackbits(m, axis=1, bitorder="little").reshape(8, h // 8, w * 8)
        return np.packbits(planes.transpose(1, 2, 0), axis=2, bitorder="little").reshape(h // 8, w * 8)
    if kind == "deint":
        out = np.empty((h // k, w * k), np.uint8)
        for p in range(k):
            out[:, p::k] = m[p * (h // k) : (p + 1) * (h // k)]
        return out
    run = np.add if kind.endswith("sub") else np.bitwise_xor
    if kind.startswith("left"):
        return run.accumulate(m, axis=1, dtype=np.uint8)
    out = m.copy()
    for first in range(min(k or 1, h)):
        out[first :: k or 1] = run.accumulate(m[first :: k or 1], axis=0, dtype=np.uint8)
    return out


def chain_forward(data: bytes, w: int, chain) -> bytes | None:
    """The folded and reshaped bytes; None if a step doesn't fit."""
    m = fold(data, w)
    for kind, k in chain:
        if not fits(kind, k, m.shape[1]):
            return None
        m = forward(m, kind, k)
    return m.tobytes()


def chain_inverse(data: bytes, w: int, n: int, chain) -> bytes:
    shapes, h = [], -(-n // w)
    for kind, k in chain:
        by = {"bitplanes": 8, "deint": k}.get(kind, 1)
        w, h = w // by, h * by
        shapes.append((w, h))
    m = np.frombuffer(data, np.uint8).reshape(h, w)
    for kind, k in reversed(chain):
        m = inverse(m, kind, k)
    return m.tobytes()[:n]


def default_width(n: int) -> int:
    return max(8, 1 << max(0, isqrt(max(n, 1)).bit_length() - 1))


def entropy(data: bytes) -> float:
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = c[c > 0] / max(len(data), 1)
    return float(-(p * np.log2(p)).sum()) if len(data) else 0.0


def lag_scores(data: bytes, sample: int = 16384, low: int = 4, high: int = 1024) -> np.ndarray:
    """Share of the commonest difference (modulo 256) between bytes ``lag`` apart, for lags from ``low``."""
    a = np.frombuffer(data[:sample], np.uint8)
    top = min(high, len(a) // 2)
    return np.array([np.bincount(a[g:] - a[:-g]).max() / (len(a) - g) for g in range(low, top + 1)], np.float64)


def detect_widths(data: bytes, most: int = 3, sample: int = 16384) -> list[int]:
    """Record widths, as ``operators.stats.detect_widths`` finds them."""
    scores = lag_scores(data, sample)
    if not len(scores):
        return []
    limit = max(0.05, np.sort(scores)[len(scores) // 2] + 0.02)
    left, right = np.concatenate(([0], scores[:-1])), np.concatenate((scores[1:], [0]))
    at = np.flatnonzero((scores >= limit) & (scores > left) & (scores >= right))
    out: list[int] = []
    for g in at[np.argsort(-scores[at], kind="stable")] + 4:
        if len(out) < most and not any(g % x == 0 for x in out):
            out.append(int(g))
    return out


#: Base and modulus of rolling hashes.
ROLL, PRIME = 263, (1 << 31) - 1

_CRC = 0xEDB88320


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if v & 1:
            out ^= row
        v >>= 1
    return out


def crc_joined(a: int, b: int, n: int) -> int:
    """CRC-32 of two parts together, from those of the parts and the length of the second one.

    Adding a zero bit is a linear map of 32 bits; ``n`` bytes of them are its power by squaring.
    """
    step = [_CRC, *(1 << k for k in range(31))]
    n *= 8
    while n:
        if n & 1:
            a = _times(step, a)
        step = [_times(step, row) for row in step]
        n >>= 1
    return a ^ b
