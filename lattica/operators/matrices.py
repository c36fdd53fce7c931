"""Matrices a row each: the same reshaping and geometry as on cells, without a shuffle.

``matrix``: blob_id, w, h, content (w * h bytes, row by row).  An operator is a numpy function of one matrix inside
an Arrow batch, so a scan, any number of operators and a result by row are one stage.  The forms on cells
(``reshape``, ``geometry``) are for matrices that are too large for a row; tests hold one against the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import kernels
from lattica.operators.reshape import MOST_STEPS, Step

#: Limits of the format.
MOST_CELLS, MOST_BLOCK = 1 << 30, 1 << 16


def matrices(blobs: DataFrame, width: int | None = None) -> DataFrame:
    """Blobs folded at a width (by default from their length), the last row filled up with zeros; an empty blob has none."""
    kind = blobs.schema["blob_id"].dataType.simpleString()
    if width is not None and width < 1:
        raise ValueError("a width is at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(b.column(0), [kernels.fold(x, width or kernels.default_width(len(x))) for x in _bytes(b.column(1))])

    return blobs.where(F.octet_length("content") > 0).select("blob_id", "content").mapInArrow(run, _spec(kind))


def _spec(kind: str) -> str:
    return f"blob_id {kind}, w int, h int, content binary"


def _bytes(column: pa.Array) -> Iterator[memoryview]:
    return (memoryview(x.as_buffer()) for x in column)


def _batch(ids: pa.Array, made: list[np.ndarray]) -> pa.RecordBatch:
    cols = [ids, pa.array([m.shape[1] for m in made], pa.int32()), pa.array([m.shape[0] for m in made], pa.int32()), pa.array([m.tobytes() for m in made], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["blob_id", "w", "h", "content"])


def _read(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8).reshape(h, w) for w, h, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), _bytes(b.column(3)), strict=True)]


def mapped(matrix: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``f`` of every matrix."""
    kind = matrix.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(b.column(0), [np.ascontiguousarray(f(m), np.uint8) for m in _read(b)])

    return matrix.select("blob_id", "w", "h", "content").mapInArrow(run, _spec(kind))


def _step(m: np.ndarray, step: Step) -> np.ndarray:
    step.shape(m.shape[1], m.shape[0])  # raises if the step doesn't fit
    return kernels.forward(m, step.kind, step.k)


def _back(m: np.ndarray, step: Step) -> np.ndarray:
    n = {"bitplanes": 8, "deint": step.k}.get(step.kind, 1)
    if m.shape[0] % n:
        raise ValueError(f"{step.kind} made no matrix of {m.shape[0]} rows")
    return kernels.inverse(m, step.kind, step.k)


def forward(matrix: DataFrame, *chain: Step) -> DataFrame:
    """The steps of a chain, one after the other; a step that a width doesn't fit raises."""
    if len(chain) > MOST_STEPS:
        raise ValueError(f"a chain has at most {MOST_STEPS} steps")

    def f(m: np.ndarray) -> np.ndarray:
        for s in chain:
            m = _step(m, s)
        return m

    return mapped(matrix, f)


def inverse(matrix: DataFrame, *chain: Step) -> DataFrame:
    """What ``forward`` was given."""

    def f(m: np.ndarray) -> np.ndarray:
        for s in reversed(chain):
            m = _back(m, s)
        return m

    return mapped(matrix, f)


def window(m: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A window, which must lie inside."""
    if min(x, y) < 0 or min(w, h) < 1 or x + w > m.shape[1] or y + h > m.shape[0]:
        raise IndexError(f"no window {w}x{h} at ({x}, {y}) in {m.shape[1]}x{m.shape[0]}")
    return m[y : y + h, x : x + w]


def view(matrix: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    return mapped(matrix, lambda m: window(m, x, y, w, h))


def decimate(matrix: DataFrame) -> DataFrame:
    """The top left cell of every two by two; a last odd row or column keeps its own."""
    return mapped(matrix, lambda m: m[::2, ::2])


#: Symmetries of a square by number: what the destination shows.
ORIENTED = (
    lambda m: m,
    lambda m: m[::-1].T,
    lambda m: m[::-1, ::-1],
    lambda m: m.T[::-1],
    lambda m: m[:, ::-1],
    lambda m: m[::-1],
    lambda m: m.T,
    lambda m: m[::-1, ::-1].T,
)


def valued(m: np.ndarray, kind: int, c: int) -> np.ndarray:
    """0 as it is (``c`` must be 0), 1 plus ``c`` modulo 256, 2 exclusive-or with ``c``."""
    if kind not in (0, 1, 2) or not 0 <= c <= 255 or (kind == 0 and c):
        raise ValueError(f"no value map {kind} with {c}")
    return m if kind == 0 else m + np.uint8(c) if kind == 1 else m ^ np.uint8(c)


def fused(m: np.ndarray, halve: bool, iso: int, kind: int, c: int) -> np.ndarray:
    """A square block decimated, oriented and mapped in one go."""
    if m.shape[0] != m.shape[1]:
        raise ValueError("only squares are turned")
    return valued(ORIENTED[iso](m[::2, ::2] if halve else m), kind, c)


def oriented(matrix: DataFrame, iso: int, halve: bool = False, kind: int = 0, c: int = 0) -> DataFrame:
    return mapped(matrix, lambda m: fused(m, halve, iso, kind, c))


def residual(matrix: DataFrame, other: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Exclusive-or with an approximation that is made of the matrix itself."""
    return mapped(matrix, lambda m: m ^ other(m))


def padded(matrix: DataFrame, block: int, start: int) -> DataFrame:
    """Filled up with ``start`` to whole blocks."""
    if not 1 <= block <= MOST_BLOCK:
        raise ValueError("a block has 1 to 65536 rows")
    return mapped(matrix, lambda m: np.pad(m, ((0, -m.shape[0] % block), (0, -m.shape[1] % block)), constant_values=start))


def tiles(matrix: DataFrame, size: int) -> DataFrame:
    """``blob_id, x0, y0, w, h, content``: squares of ``size``, smaller at the right and lower edge."""
    kind = matrix.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in enumerate(_read(b)):
                at = [(x, y, m[y : y + size, x : x + size]) for y in range(0, m.shape[0], size) for x in range(0, m.shape[1], size)]
                ids = b.column(0).slice(k, 1).take(pa.array([0] * len(at)))
                cols = [[a[0] for a in at], [a[1] for a in at], [a[2].shape[1] for a in at], [a[2].shape[0] for a in at]]
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, pa.int32()) for c in cols), pa.array([a[2].tobytes() for a in at], pa.binary())], ["blob_id", "x0", "y0", "w", "h", "content"]
                )

    return matrix.mapInArrow(run, f"blob_id {kind}, x0 int, y0 int, w int, h int, content binary")


def skip_counts(matrix: DataFrame, size: int, start: int) -> DataFrame:
    """``blob_id, ny, nx, skip``: for each square of ``size``, smaller at the right and lower edge, its cells that are not ``start``."""
    kind = matrix.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in enumerate(_read(b)):
                other = np.pad(m != start, ((0, -m.shape[0] % size), (0, -m.shape[1] % size)))
                n = other.reshape(other.shape[0] // size, size, -1, size).sum(axis=(1, 3), dtype=np.int64)
                ny, nx = np.indices(n.shape, np.int32)
                ids = b.column(0).slice(k, 1).take(pa.array(np.zeros(n.size, np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(ny.ravel()), pa.array(nx.ravel()), pa.array(n.ravel())], ["blob_id", "ny", "nx", "skip"])

    return matrix.select("blob_id", "w", "h", "content").mapInArrow(run, f"blob_id {kind}, ny int, nx int, skip long")


def row_sums(matrix: DataFrame) -> DataFrame:
    """``blob_id, y, total, by_column``: the sum of a row's values, and of the values by their column."""
    kind = matrix.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in enumerate(_read(b)):
                ids = b.column(0).slice(k, 1).take(pa.array(np.zeros(len(m), np.int64)))
                by = m.astype(np.int64) @ np.arange(1, m.shape[1] + 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(m), dtype=np.int32)), pa.array(m.sum(axis=1, dtype=np.int64)), pa.array(by)], ["blob_id", "y", "total", "by_column"])

    return matrix.select("blob_id", "w", "h", "content").mapInArrow(run, f"blob_id {kind}, y int, total long, by_column long")


def histogram(blobs: DataFrame) -> DataFrame:
    """``blob_id, v, n``: how often each byte value occurs in a blob."""
    kind = blobs.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in _bytes(b.column(1))]
            if counts:
                at, v = np.nonzero(np.array(counts))
                n = np.array(counts)[at, v]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(v.astype(np.int32)), pa.array(n.astype(np.int64))], ["blob_id", "v", "n"])

    return blobs.select("blob_id", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(run, f"blob_id {kind}, v int, n long")
