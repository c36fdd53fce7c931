"""Sizes and budgets: segments, super-segments, memory to decode, and which layouts are worth a slow coder."""

from __future__ import annotations

#: Limits and defaults of segments and super-segments, bytes.
SEGMENT = (1 << 10, 1 << 16, 1 << 26)
BIG = (1 << 12, 1 << 30)
BIG_BYTES_PER_BYTE = 128
MOST_CM = 1 << 24
#: Bytes of memory for a byte to decode, by mode.
NEED = {"fractal": 12, "prep": 4, "segmented": 3, "cm": 2}


def segment_size(asked: int = 0, width: int = 0, frame_rows: int = 0, most_cm: int = 0) -> int:
    """Bytes of a segment: none if negative, the default if 0; video takes two to eight whole frames."""
    if frame_rows > 0 and width > 0 and asked >= 0:
        frame = frame_rows * width
        return min(max(frame, frame * min(8, max(2, (most_cm or MOST_CM) // frame))), SEGMENT[2])
    if asked < 0:
        return 0
    return min(max(asked, SEGMENT[0]), SEGMENT[2]) if asked else SEGMENT[1]


def big_segment_size(memory: int, asked: int = 0) -> int:
    """Bytes of a super-segment: as asked, or a share of the memory in whole MiB, at least one."""
    if asked > 0:
        return min(max(asked, BIG[0]), BIG[1])
    return max(min(memory // BIG_BYTES_PER_BYTE, BIG[1]) >> 20 << 20, 1 << 20)


def decode_need(mode: str, n: int) -> int:
    """Bytes of memory that decoding ``n`` bytes of a mode takes, on the high side."""
    tables = (40 << min(max(n.bit_length() + 1, 12), 21)) + (8 << 20) if mode == "cm" else 0
    return NEED.get(mode, 2) * n + tables


def fractal_attempts(ranked: list[tuple[int, int, tuple]], square: int) -> list[tuple[int, int, tuple]]:
    """Of layouts ``(cost, width, chain)``, best first: the best, and the plain one of the square width.

    Where that width was not tried, the first plain one takes its place if the best has a chain.
    """
    best, rest = ranked[:1], ranked[1:]
    plain = [c for c in rest if not c[2]]
    own = [c for c in plain if c[1] == square][:1]
    return best + (own or (plain[:1] if best and best[0][2] else []))


def cm_attempts(ranked: list[tuple[int, int, tuple]], n: int, most: int = 0, video: bool = False) -> list[tuple[int, int, tuple]]:
    """Layouts for the slow coder: a frame difference first if it is video, the best, the plain stream, the best plain fold."""
    framed = [c for c in ranked if c[2] and c[2][0][0].startswith("frame")][:1] if video else []
    best = [c for c in ranked[:1] if c not in framed]
    plain = [c for c in ranked[1:] if not c[2] and not (not ranked[0][2] and c[1] == ranked[0][1])][:1]
    limit = 1 if n > 4 << 20 else 2 if n > 1 << 20 else 3
    limit = most if most > 0 else max(limit, 3) if video else limit
    return (framed + best + [(0, 0, ())] + plain)[:limit]
