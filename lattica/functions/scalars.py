"""Scalar functions: widths, sizes, zigzag numbers, video row lengths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes a pixel, and the factor of the height as a fraction, by pixel format.
PIXELS = {
    "rgb24": (3, 1, 1),
    "bgr24": (3, 1, 1),
    "gray8": (1, 1, 1),
    "gray": (1, 1, 1),
    "y8": (1, 1, 1),
    "gray16": (2, 1, 1),
    "rgba": (4, 1, 1),
    "bgra": (4, 1, 1),
    "argb": (4, 1, 1),
    "yuv420": (1, 3, 2),
    "yuv420p": (1, 3, 2),
    "i420": (1, 3, 2),
}


def default_width(n: Column) -> Column:
    """Largest power of two whose square is at most ``n``; 8 at least."""
    root = F.floor(F.sqrt(n.cast("double")))
    return F.greatest(F.lit(8), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(root, F.lit(1)))))).cast("int")


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    u = u.cast("long")
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1)))


def parse_size(text: str) -> int:
    """``"1.5G"`` and the like, in bytes; units are powers of 1024."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)(?:i?B)?\s*", text, re.I)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** " KMGT".index(m[2].upper() or " "))


def format_size(n: int) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024 or unit == "GiB":
            return f"{n:.4g} {unit}"
        n /= 1024
    return ""


def video_rows(spec: str) -> tuple[int, int]:
    """``(bytes a row, rows a frame)`` of ``"WxH"`` or ``"WxH:format"``; the format is bgr24 if not given."""
    m = re.fullmatch(r"(\d+)x(\d+)(?::(\w+))?", spec)
    if not m or (m[3] or "bgr24").lower() not in PIXELS:
        raise ValueError(f"not a video size: {spec!r}")
    w, h = int(m[1]), int(m[2])
    each, up, down = PIXELS[(m[3] or "bgr24").lower()]
    if not w or not h or h * up % down:
        raise ValueError(f"not a video size: {spec!r}")
    rows = h * up // down
    if rows > 65535:
        raise ValueError("a frame has more than 65535 rows")
    return w * each, rows


def bit_length(n: Column) -> Column:
    """Bits of a number that is not negative; none for zero."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n.cast("long"))))


def uvarint_size(n: Column) -> Column:
    """Bytes of a number that is not negative in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(bit_length(n) / 7).cast("int"))


def round_up(n: Column, k: int) -> Column:
    """The next multiple of ``k``."""
    return n + F.pmod(-n, F.lit(k))
