"""Finding blocks that copy other blocks: a hash join on canonical blocks.

A block minus its first cell (modulo 256), or exclusive or with it, is its canonical form; two blocks of the
same form differ by a value map.  Range blocks (nodes) are looked up among domain blocks, taken as they
are or every second cell, in the eight orientations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Candidates that a key keeps from either end of its ids.
CANDIDATES = 4


def _orient(b: np.ndarray) -> list[np.ndarray]:
    """A stack of square blocks in the eight orientations, in the order of ``geometry.ISOMETRIES``."""
    t = b.transpose(0, 2, 1)
    return [b, t[:, :, ::-1], b[:, ::-1, ::-1], t[:, ::-1, :], b[:, :, ::-1], b[:, ::-1, :], t, t[:, ::-1, ::-1]]


def _windows(m: np.ndarray, side: int, stride: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ``side`` cells, every ``scale``-th, at multiples of ``stride``; with their places."""
    span = side * scale
    h, w = m.shape
    if h < span or w < span:
        return np.empty((0, side, side), np.uint8), np.empty(0, int), np.empty(0, int)
    v = np.lib.stride_tricks.sliding_window_view(m, (span, span))[::stride, ::stride, ::scale, ::scale]
    dy, dx = np.meshgrid(np.arange(v.shape[0]) * stride, np.arange(v.shape[1]) * stride, indexing="ij")
    return v.reshape(-1, side, side), dx.ravel(), dy.ravel()


def blocks(tiles: DataFrame, size: int, stride: int, kinds: tuple[int, ...] = (0, 1)) -> tuple[DataFrame, DataFrame]:
    """Nodes and domains of square tiles ``tile_id, w, content, start`` whose sides ``size`` divides.

    Nodes: ``tile_id, rx, ry, skip, first, block``.  Domains: ``tile_id, kind, dx, dy, iso, id, first, block``; kind 0 is
    decimated, kind 1 as it is.  ``block`` is the plain block, row by row, domains in their orientation.
    """
    kind_of = tiles.schema["tile_id"].dataType.simpleString()

    def made(domain: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    m = np.frombuffer(r["content"], np.uint8).reshape(-1, r["w"])
                    jobs = [(k, 2 - k, stride) for k in kinds] if domain else [(1, 1, size)]
                    for kind, scale, step in jobs:
                        v, dx, dy = _windows(m, size, step, scale)
                        for iso, o in enumerate(_orient(v) if domain else [v]):
                            flat = np.ascontiguousarray(o).reshape(len(o), size * size)
                            if not len(flat):
                                continue
                            n = len(flat)
                            ints = [dx, dy, np.full(n, kind), np.full(n, iso), (flat != r["start"]).sum(axis=1), flat[:, 0]]
                            wide = ((kind << 29) + (np.arange(n) << 3) + iso).astype(np.int64)
                            data = pa.Array.from_buffers(pa.binary(size * size), n, [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
                            ids = pa.array([r["tile_id"]], b.schema.field("tile_id").type).take(pa.array(np.zeros(n, np.int64)))
                            yield pa.RecordBatch.from_arrays(
                                [ids, *(pa.array(x.astype(np.int32)) for x in ints), pa.array(wide), data],
                                ["tile_id", "x", "y", "kind", "iso", "skip", "first", "id", "block"],
                            )

        return tiles.select("tile_id", "w", "content", "start").mapInArrow(
            run, f"tile_id {kind_of}, x int, y int, kind int, iso int, skip int, first int, id long, block binary"
        )

    nodes = made(False).select("tile_id", F.col("x").alias("rx"), F.col("y").alias("ry"), "skip", "first", "block")
    domains = made(True).select("tile_id", "kind", F.col("x").alias("dx"), F.col("y").alias("dy"), "iso", "id", "first", "block")
    return nodes, domains


def _keyed(df: DataFrame) -> DataFrame:
    """Two rows for each block: its additive and its exclusive-or form."""
    kind_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(at).to_pylist()
            for code in (1, 2):
                keys = []
                for x in rows:
                    a = np.frombuffer(x, np.uint8)
                    keys.append((a - a[0] if code == 1 else a ^ a[0]).tobytes())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([code] * len(rows), pa.int32()), pa.array(keys, pa.binary())], [*b.schema.names, "code", "key"])

    return df.mapInArrow(run, f"{kind_of}, code int, key binary")


def match(nodes: DataFrame, domains: DataFrame, size: int, candidates: int | None = CANDIDATES) -> DataFrame:
    """``tile_id, rx, ry, kind, dx, dy, iso, code, c``: for each node that copies a domain, the one to use.

    A domain must not overlap the node, and one of kind 1 must lie before it in raster order.  Additive forms come
    before exclusive-or ones, lower ids before higher.  ``candidates`` keeps that many of the
    lowest and of the highest ids of a key, before the join; None keeps all.
    """
    n = _keyed(nodes.where("skip > 0").select("tile_id", "rx", "ry", F.col("first").alias("nf"), "block"))
    d = _keyed(domains.select("tile_id", "kind", "dx", "dy", "iso", "id", F.col("first").alias("df"), "block")).drop("block")
    if candidates:
        # Only keys that nodes ask for; then the ends of each, which Spark limits before the shuffle.
        d = d.join(n.select("tile_id", "code", "key").distinct(), ["tile_id", "code", "key"], "left_semi")
        by = W.partitionBy("tile_id", "code", "key")
        low = d.withColumn("r", F.row_number().over(by.orderBy("id"))).where(F.col("r") <= candidates)
        high = d.withColumn("r", F.row_number().over(by.orderBy(F.desc("id")))).where(F.col("r") <= candidates)
        d = low.union(high).drop("r").distinct()
    span = F.when(F.col("kind") == 0, 2 * size).otherwise(size)
    apart = (F.col("dx") + span <= F.col("rx")) | (F.col("rx") + size <= F.col("dx")) | (F.col("dy") + span <= F.col("ry")) | (F.col("ry") + size <= F.col("dy"))
    before = (F.col("dy") + size <= F.col("ry")) | ((F.col("dy") + size - 1 == F.col("ry")) & (F.col("dx") + size <= F.col("rx")))
    found = n.join(d, ["tile_id", "code", "key"]).where(apart & ((F.col("kind") == 0) | before))
    c = F.when(F.col("code") == 1, F.pmod(F.col("nf") - F.col("df"), F.lit(256))).otherwise(F.col("nf").bitwiseXOR(F.col("df")))
    pick = F.min(F.struct("code", "id", "kind", "dx", "dy", "iso", c.cast("int").alias("c")))
    best = found.groupBy("tile_id", "rx", "ry").agg(pick.alias("p"))
    return best.select("tile_id", "rx", "ry", "p.kind", "p.dx", "p.dy", "p.iso", F.when(F.col("p.c") == 0, 0).otherwise(F.col("p.code")).alias("code"), "p.c")


def probe(tiles: DataFrame) -> DataFrame:
    """``tile_id, nodes, hits, copy_hits, worth``: whether matching is worth its cost, from sizes 8 and 4."""
    out = None
    for size in (8, 4):
        nodes, domains = blocks(tiles, size, size)
        flat = F.col("block") == F.unhex(F.repeat(F.hex(F.substring("block", 1, 1)), size * size))
        live = nodes.where((F.col("skip") > 0) & ~flat)
        got = match(live, domains, size)
        one = live.select("tile_id", "rx", "ry").join(got.select("tile_id", "rx", "ry", "kind"), ["tile_id", "rx", "ry"], "left")
        part = one.groupBy("tile_id").agg(F.count(F.lit(1)).alias("nodes"), F.count("kind").alias("hits"), F.count_if(F.col("kind") == 1).alias("copy_hits"))
        out = part if out is None else out.union(part)
    total = out.groupBy("tile_id").agg(*(F.sum(c).alias(c) for c in ("nodes", "hits", "copy_hits")))
    return total.withColumn("worth", (F.col("hits") >= 16) & (F.col("hits") * 1000 >= F.col("nodes") * 40))


def _agreeing(diff: np.ndarray) -> np.ndarray:
    """How often the commonest value of each row occurs."""
    n = len(diff)
    flat = diff.astype(np.int64) + (np.arange(n) << 8)[:, None]
    return np.bincount(flat.ravel(), minlength=n << 8).reshape(n, 256).max(axis=1)


def _first_commonest(diff: np.ndarray) -> int:
    """The commonest value; of several, the one that is complete first."""
    counts = np.bincount(diff, minlength=256)
    last = {int(v): i for i, v in enumerate(diff)}
    return min(np.flatnonzero(counts == counts.max()).tolist(), key=lambda v: last[v])


def exhaustive(tiles: DataFrame, size: int, stride: int) -> DataFrame:
    """``tile_id, rx, ry, dx, dy, iso, code, c, misses``: for each node the decimated domain that agrees in most of its real cells.

    Tiles are ``tile_id, w, content, real_w, real_h``; cells beyond the real ones don't count, and nodes without any are left out, as
    are those that every domain overlaps.  Every domain is tried in eight orientations as it is (code 0), with a constant added
    (1) and exclusive or with one (2); the first code, then the first domain, then the first orientation wins a tie.
    The work of a tile grows with nodes times domains, and a tile is a task's, so tiles should be small.
    """
    kind_of = tiles.schema["tile_id"].dataType.simpleString()
    names = ("rx", "ry", "dx", "dy", "iso", "code", "c", "misses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for r in b.to_pylist():
                m = np.frombuffer(r["content"], np.uint8).reshape(-1, r["w"])
                doms, dx, dy = _windows(m, size, stride, 2)
                if not len(doms):
                    continue
                turned = np.stack([np.ascontiguousarray(o).reshape(len(doms), -1) for o in _orient(doms)], axis=1)
                nodes, rx, ry = _windows(m, size, size, 1)
                ys, xs = np.divmod(np.arange(size * size), size)
                for node, x, y in zip(nodes.reshape(len(nodes), -1), rx.tolist(), ry.tolist(), strict=True):
                    real = (x + xs < r["real_w"]) & (y + ys < r["real_h"])
                    apart = np.flatnonzero((dx + 2 * size <= x) | (x + size <= dx) | (dy + 2 * size <= y) | (y + size <= dy))
                    if not real.any() or not len(apart):
                        continue
                    d = turned[apart][:, :, real].reshape(len(apart) * 8, -1)
                    forms = node[real] - d, node[real] ^ d
                    agree = np.stack([(d == node[real]).sum(axis=1), *(_agreeing(f) for f in forms)])
                    at = int(agree.max(axis=0).argmax())
                    code = int(agree[:, at].argmax())
                    c = _first_commonest(forms[code - 1][at]) if code else 0
                    dom = apart[at >> 3]
                    ids.append(r["tile_id"])
                    rows.append((x, y, int(dx[dom]), int(dy[dom]), at & 7, code, c, int(real.sum() - agree[code, at])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("tile_id").type), *(pa.array(x, pa.int32()) for x in cols)], ["tile_id", *names])

    return tiles.select("tile_id", "w", "content", "real_w", "real_h").mapInArrow(run, f"tile_id {kind_of}, " + ", ".join(f"{n} int" for n in names))
