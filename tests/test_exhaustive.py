"""The exhaustive matcher against loops over cells."""

from collections import Counter

import numpy as np
import pytest

from lattica.operators import match


def searched(m, size, stride, real_w, real_h):
    out = {}
    side = m.shape[0]
    doms = [(x, y) for y in range(0, side - 2 * size + 1, stride) for x in range(0, side - 2 * size + 1, stride)]
    for ry in range(0, side, size):
        for rx in range(0, side, size):
            cells = [(x, y) for y in range(size) for x in range(size) if rx + x < real_w and ry + y < real_h]
            best = None
            for dx, dy in doms:
                if not (dx + 2 * size <= rx or rx + size <= dx or dy + 2 * size <= ry or ry + size <= dy):
                    continue
                small = m[dy : dy + 2 * size : 2, dx : dx + 2 * size : 2]
                for iso, o in enumerate(match._orient(small[None])):
                    pairs = [(int(m[ry + y, rx + x]), int(o[0, y, x])) for x, y in cells]
                    for code, f in enumerate((None, lambda g, t: (g - t) % 256, lambda g, t: g ^ t)):
                        if f is None:
                            c, hits = 0, sum(g == t for g, t in pairs)
                        else:
                            seen, c, hits = Counter(), 0, 0
                            for g, t in pairs:
                                seen[f(g, t)] += 1
                                if seen[f(g, t)] > hits:
                                    c, hits = f(g, t), seen[f(g, t)]
                        if best is None or len(cells) - hits < best[-1]:
                            best = (dx, dy, iso, code, c, len(cells) - hits)
            if cells and best:
                out[rx, ry] = best
    return out


@pytest.mark.parametrize("size, stride, real", [(4, 2, (16, 16)), (4, 4, (13, 9)), (8, 4, (16, 16))])
def test_exhaustive(spark, size, stride, real):
    rng = np.random.default_rng(size + stride)
    m = rng.integers(0, 4, (16, 16), dtype=np.uint8) * 9
    t = spark.createDataFrame([(1, 16, bytearray(m.tobytes()), *real)], "tile_id int, w int, content binary, real_w int, real_h int")
    got = {(r.rx, r.ry): (r.dx, r.dy, r.iso, r.code, r.c, r.misses) for r in match.exhaustive(t, size, stride).collect()}
    assert got == searched(m, size, stride, *real)
    assert match.exhaustive(t.limit(0), size, stride).count() == 0
