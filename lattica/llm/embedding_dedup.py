"""Embedding near-duplicates: PCA-ordered tiled comparison with early stops.

Vectors are scaled to unit length and rotated onto their principal axes, largest
variance first.  The products of the leading axes are accumulated
first; the rest of a product is at most the product of the two suffix norms, so a pair stops as
soon as that bound cannot reach the threshold.  Tiles are cut along the first axis,
and tiles further apart on it than two similar unit vectors can be are never compared.
Whether a pair links is decided on the given components in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import connected_components, owned, stored, tile_count
from lattica.llm.simhash_dedup import Forest

#: Slack of the bounds: far above rounding in double precision, far below any decision.
SLACK = 1e-9


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; scaled by powers of two first, so that squares of extreme components stay finite."""
    x, y = (np.ldexp(z, -np.frexp(np.abs(z).max(axis=1, keepdims=True))[1]) for z in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that squares of extreme components stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tile:
    """Rows of one tile: as given, rotated, and the norms of what follows each block of axes."""

    def __init__(self, given: np.ndarray, axes: np.ndarray, step: int):
        self.given, self.turned = given, unit(given) @ axes
        self.cuts = list(range(step, given.shape[1], step)) + [given.shape[1]]
        tail = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = [np.sqrt(tail[:, c]) if c < given.shape[1] else np.zeros(len(given)) for c in self.cuts]


def tile_links(a: Tile, b: Tile, same: bool, threshold: float, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (row of a, row of b) of the links, strip by strip; within one tile each pair once."""
    for s in range(0, len(a.given), rows):
        e = min(len(a.given), s + rows)
        c = a.cuts[0]
        got = a.turned[s:e, :c] @ b.turned[:, :c].T
        can = got + a.suffix[0][s:e, None] * b.suffix[0][None, :] >= threshold - SLACK
        if same:
            can &= np.arange(s, e)[:, None] < np.arange(len(b.given))[None, :]
        i, j = np.nonzero(can)
        so_far = got[i, j]
        i += s
        for k in range(1, len(a.cuts)):
            if not len(i):
                break
            lo, hi = a.cuts[k - 1], a.cuts[k]
            so_far = so_far + np.einsum("ij,ij->i", a.turned[i, lo:hi], b.turned[j, lo:hi])
            go = so_far + a.suffix[k][i] * b.suffix[k][j] >= threshold - SLACK
            i, j, so_far = i[go], j[go], so_far[go]
        if len(i):
            yes = exact_cosine(a.given[i], b.given[j]) >= threshold
            yield i[yes], j[yes]


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Axes by falling variance, from sums over all unit vectors (dim x dim numbers a task)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, square = np.zeros(dim), 0, np.zeros((dim, dim))
        for b in batches:
            x = unit(_rows(b.column(0), dim))
            total, n, square = total + x.sum(axis=0), n + len(x), square + x.T @ x
        if n:
            flat = np.concatenate(([n], total, square.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["k", "x"])

    parts = vectors.select("v").mapInArrow(sums, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(1 + dim + dim * dim)
    for r in parts:
        flat[r["k"]] = r["x"]
    mean = flat[1 : 1 + dim] / max(flat[0], 1)
    cov = flat[1 + dim :].reshape(dim, dim) / max(flat[0], 1) - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    return axes[:, np.argsort(values)[::-1]]


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _of_one_width(classes: DataFrame, dim: int, threshold: float, tile: int, step: int) -> DataFrame:
    """``kind, x, y``: kind 0, links of class x to y vectors of other classes; kind 1, an edge."""
    spark = classes.sparkSession
    n = classes.count()
    parts = tile_count(spark, n, tile, max(tile, (1 << 26) // (8 * dim)))
    tile = -(-2 * n // parts)
    axes = principal_axes(classes, dim)
    first = axes[:, 0].copy()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(unit(_rows(b.column(2), dim)) @ first)], ["id", "n", "v", "at"]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, store = TaskContext.get().partitionId(), 0, 0, []

        def out() -> pa.RecordBatch:
            ids, ns, vs, at = (np.concatenate(x) for x in zip(*store, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([part * 1048576 + k], pa.int64()), pa.array([at.min()]), pa.array([at.max()])]
                + [pa.array([x.tobytes()], pa.binary()) for x in (ids, ns, vs)],
                ["tile", "low", "high", "ids", "ns", "vs"],
            )

        for b in batches:
            at = 0
            while at < b.num_rows:
                take = b.slice(at, min(b.num_rows - at, tile - held))
                store.append((take.column(0).to_numpy(), take.column(1).to_numpy(), _rows(take.column(2), dim), take.column(3).to_numpy()))
                at, held = at + take.num_rows, held + take.num_rows
                if held == tile:
                    yield out()
                    k, held, store = k + 1, 0, []
        if held:
            yield out()

    placed = stored(classes.mapInArrow(project, "id long, n long, v array<double>, at double"), "placed")
    tiles = stored(
        placed.repartitionByRange(parts, "at", "id")
        .sortWithinPartitions("at", "id")
        .mapInArrow(cut, "tile long, low double, high double, ids binary, ns binary, vs binary"),
        "tiles",
    )
    # Unit vectors with a cosine of t are sqrt(2 - 2t) apart, so no further on any axis.
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    width = max(reach, 1e-3)
    cell = lambda c: F.floor(c / width).cast("int")
    spans = tiles.select("tile", "low", "high")
    left = spans.select(F.col("tile").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence(cell(F.col("low") - reach), cell(F.col("high") + reach))).alias("c"))
    right = spans.select(F.col("tile").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("c"))
    pairs = left.join(right, "c").where((F.col("a") <= F.col("b")) & (F.col("lb") - F.col("ha") <= reach) & (F.col("la") - F.col("hb") <= reach)).select("a", "b").distinct()

    def side(name: str) -> DataFrame:
        return tiles.select(F.col("tile").alias(name), *(F.col(c).alias(c + name) for c in ("ids", "ns", "vs")))

    work = pairs.join(side("a"), "a").join(side("b"), "b").repartition(
        max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts * (parts + 1) // 2), "a", "b"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                same = r["a"] == r["b"]
                at, bt = (Tile(np.frombuffer(r["vs" + c]).reshape(-1, dim), axes, step) for c in "ab")
                ids = np.frombuffer(r["idsa"] if same else r["idsa"] + r["idsb"], np.int64)
                na, nb = (np.frombuffer(r["ns" + c], np.int64) for c in "ab")
                base = 0 if same else len(at.given)
                links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
                for i, j in tile_links(at, bt, same, threshold):
                    np.add.at(links, i, nb[j])
                    np.add.at(links, j + base, na[i])
                    for x, start in zip(*np.unique(i, return_index=True), strict=True):
                        stop = np.searchsorted(i, x, "right")
                        forest.join(np.append(j[start:stop] + base, x))
                some = np.flatnonzero(links)
                u, v = forest.edges()
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([0, 1], [len(some), len(u)]), pa.int32()),
                            pa.array(np.concatenate((ids[some], ids[u]))),
                            pa.array(np.concatenate((links[some], ids[v]))),
                        ],
                        ["kind", "x", "y"],
                    )

    return work.mapInArrow(compare, "kind int, x long, y long")


@owned
def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = 2048, step: int = 16) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``).

    Equal vectors are one class and are compared once; ``n_links`` counts vectors, not classes.
    Null, empty and zero vectors, vectors with null or non-finite components and rows
    without vec_id link with nothing, nor do vectors of different lengths: their
    component is themselves.  Rows that repeat a vec_id are counted one by one in
    ``n_links``; a vec_id is meant to name one vector.  Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = (
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & ~F.coalesce(F.exists("v", bad), F.lit(True))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    rows = stored(rows.withColumn("ok", F.coalesce(good, F.lit(False))), "vectors")
    classes = stored(
        rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "n", "v"), "classes"
    )
    # One round for each length of vector; a table of embeddings has one, or a few.
    found = None
    for r in classes.select(F.size("v").alias("d")).distinct().collect():
        part = _of_one_width(classes.where(F.size("v") == r["d"]), r["d"], threshold, tile, step)
        found = part if found is None else found.union(part)
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    found = stored(found, "links")
    counts = found.where("kind = 0").groupBy("x").agg(F.sum("y").alias("others"))
    comps = connected_components(found.where("kind = 1").select(F.col("x").alias("src"), F.col("y").alias("dst")))
    known = stored(
        classes.join(counts, classes.id == counts.x, "left")
        .join(comps, classes.id == comps.node, "left")
        .select("v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")),
        "known",
    )
    linked = rows.where("ok").join(known, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.union(alone)
