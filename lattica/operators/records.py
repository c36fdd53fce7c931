"""Operators on rows in an order and on recipes: differences, offsets, probes, checksums, predicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import kernels
from lattica.functions.scalars import unzigzag, zigzag

#: Dense nodes and flat ones, in percent of real cells; bytes of recipes and anchors in an estimate.
ANCHOR_PERCENT = 25
HEADER_SIZE, RECIPE_SIZE, ANCHOR_SIZE = 16, 7, 5


def delta_columns(df: DataFrame, partition: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``ord``, the number of a row in its partition, and each column as the zigzag number of its difference to the row before; the first row's to zero."""
    w = W.partitionBy(*partition).orderBy(*order)
    return df.select(*partition, F.row_number().over(w).alias("ord"), *(zigzag(F.col(c).cast("long") - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(c) for c in columns))


def undelta_columns(df: DataFrame, partition: list[str], columns: list[str]) -> DataFrame:
    """The columns that ``delta_columns`` was given."""
    w = W.partitionBy(*partition).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return df.select(*partition, "ord", *(F.sum(unzigzag(F.col(c))).over(w).alias(c) for c in columns))


def split_offsets(df: DataFrame, shard: str) -> DataFrame:
    """``shard, n, first``: rows of each shard, and where they start when shards are laid out in order.

    Counts are combined before the window, which runs over shards, not rows.
    """
    counts = df.groupBy(F.col(shard).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("shard", "n", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("first"))


def overlaps(ax: Column, ay: Column, an: Column, bx: Column, by: Column, bn: Column) -> Column:
    """Whether two squares share a cell."""
    return (ax < bx + bn) & (bx < ax + an) & (ay < by + bn) & (by < ay + an)


def is_causal(dx: Column, dy: Column, rx: Column, ry: Column, size: Column) -> Column:
    """Whether a domain of the range's size ends before the range starts, row by row of blocks."""
    return (dy + size <= ry) | ((dy <= ry) & (dx + size <= rx))


def is_dense(skip: Column, real: Column, percent: int = ANCHOR_PERCENT) -> Column:
    """Whether enough of the real cells differ from the start value for an anchor to pay."""
    return skip * 100 > real * percent


def flat_blocks(cells: DataFrame, size: int) -> DataFrame:
    """``blob_id, ny, nx, flat``: whether all cells of a block are equal."""
    at = [F.col("blob_id"), F.expr(f"cast(y div {size} as int)").alias("ny"), F.expr(f"cast(x div {size} as int)").alias("nx")]
    return cells.groupBy(*at).agg((F.min("v") == F.max("v")).alias("flat"))


def shared_cells(ranges: DataFrame) -> DataFrame:
    """``tile_id, y, x, n``: cells in more than one of the squares ``tile_id, rx, ry, size``; none if they are disjoint."""
    cells = ranges.select("tile_id", "rx", "ry", "size", F.explode(F.sequence(F.lit(0), F.col("size") * F.col("size") - 1)).alias("k"))
    at = cells.select("tile_id", (F.col("ry") + F.expr("k div size")).cast("int").alias("y"), (F.col("rx") + F.col("k") % F.col("size")).cast("int").alias("x"))
    return at.groupBy("tile_id", "y", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def estimated_size(recipes: DataFrame, raw: str = "raw", data: str = "data") -> DataFrame:
    """``tile_id, size``: bytes that a tile's recipes take, about."""
    own = F.when(F.col(raw), F.lit(ANCHOR_SIZE) + F.octet_length(data)).otherwise(F.lit(RECIPE_SIZE))
    return recipes.groupBy("tile_id").agg((F.sum(own) + HEADER_SIZE).cast("long").alias("size"))


def worst_failing(recipes: DataFrame) -> DataFrame:
    """Of ``tile_id, ord, mis`` the row with the most wrong cells of each tile; on ties the first of the plan."""
    best = F.max_by(F.struct("ord", "mis"), F.struct(F.col("mis"), -F.col("ord")))
    return recipes.groupBy("tile_id").agg(best.alias("b")).select("tile_id", "b.ord", "b.mis")


def tile_stats(encoded: DataFrame) -> DataFrame:
    """``mode, tiles, bytes, size``: tiles by how they are stored, with their bytes before and after."""
    return encoded.groupBy("mode").agg(
        F.count(F.lit(1)).alias("tiles"), F.sum("n").cast("long").alias("bytes"), F.sum(F.octet_length("payload")).cast("long").alias("size")
    )


def repeats_at(blobs: DataFrame, lag: int, probes: int = 65536) -> DataFrame:
    """``blob_id, same, total, repeats``: of up to about ``probes`` places, those equal to the byte ``lag`` before; over 5 % is a repeat."""
    kind = blobs.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                a = np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8)
                at = np.arange(lag, len(a), max(1, (len(a) - lag) // probes))
                rows.append((int((a[at] == a[at - lag]).sum()), len(at)))
            same, total = (pa.array([r[k] for r in rows], pa.int64()) for k in range(2))
            yield pa.RecordBatch.from_arrays([b.column(0), same, total], ["blob_id", "same", "total"])

    found = blobs.select("blob_id", "content").mapInArrow(run, f"blob_id {kind}, same long, total long")
    return found.withColumn("repeats", F.expr("same * 20 > total"))


def crc_of_segments(segments: DataFrame) -> DataFrame:
    """``blob_id, n, crc``: a blob's CRC-32 from those of its segments ``blob_id, segment, content``.

    Only a checksum and a length of each segment are gathered for a blob, not its bytes.
    """
    kind = segments.schema["blob_id"].dataType.simpleString()
    each = segments.select("blob_id", F.struct("segment", F.crc32("content").alias("crc"), F.octet_length("content").cast("long").alias("n")).alias("s"))
    lists = each.groupBy("blob_id").agg(F.array_sort(F.collect_list("s")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs, ns = [], []
            for parts in b.column(1).to_pylist():
                crc = n = 0
                for p in parts:
                    crc, n = kernels.crc_joined(crc, p["crc"], p["n"]), n + p["n"]
                crcs.append(crc)
                ns.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], ["blob_id", "n", "crc"])

    return lists.mapInArrow(run, f"blob_id {kind}, n long, crc long")


def rolling_hashes(blobs: DataFrame, span: int = 64, every: int = 64) -> DataFrame:
    """``blob_id, pos, hash``: polynomial hashes modulo 2**31 - 1 of the ``span`` bytes that end at each ``every``-th place."""
    kind = blobs.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in enumerate(b.column(1)):
                a = np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8)
                at = np.arange(span - 1, len(a), every)
                h = np.zeros(len(at), np.int64)
                for i in range(span):
                    h = (h * kernels.ROLL + a[at - span + 1 + i] + 1) % kernels.PRIME
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1).take(pa.array(np.zeros(len(at), np.int64))), pa.array(at), pa.array(h)], ["blob_id", "pos", "hash"])

    return blobs.select("blob_id", "content").mapInArrow(run, f"blob_id {kind}, pos long, hash long")


def comparators(blobs: DataFrame) -> DataFrame:
    """``blob_id, n, zlib, bz2, xz``: sizes under general compressors of the standard library."""
    kind = blobs.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bz2
        import lzma
        import zlib

        for b in batches:
            data = [x or b"" for x in b.column(1).to_pylist()]
            sizes = [[len(x) for x in data], [len(zlib.compress(x, 9)) for x in data], [len(bz2.compress(x)) for x in data], [len(lzma.compress(x)) for x in data]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s, pa.int64()) for s in sizes)], ["blob_id", "n", "zlib", "bz2", "xz"])

    return blobs.select("blob_id", "content").mapInArrow(run, f"blob_id {kind}, n long, zlib long, bz2 long, xz long")
