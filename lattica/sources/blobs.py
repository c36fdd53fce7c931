"""Byte sequences and their relations.

``blob``: blob_id, content (binary).  ``bytes``: blob_id, pos, v.  ``cells``: blob_id, y, x, v, a
blob folded into rows of a width, the last one filled up with zeros.  A value is an INT from 0 to 255.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.scalars import default_width


def from_column(df: DataFrame, blob_id: str, content: str) -> DataFrame:
    """Blobs from a text (as UTF-8) or binary column; a null is empty."""
    kind = df.schema[content].dataType.simpleString()
    data = F.col(content) if kind == "binary" else F.encode(F.col(content).cast("string"), "UTF-8")
    return df.select(F.col(blob_id).alias("blob_id"), F.coalesce(data, F.lit(b"")).alias("content"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """One blob for each file; its id is the path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("blob_id"), "content")


def from_function(spark: SparkSession, blob_id: object, w: int, h: int, value: Column) -> DataFrame:
    """Cells computed from ``x`` and ``y``."""
    n = spark.range(w * h).select(F.expr(f"cast(id div {w} as int)").alias("y"), F.expr(f"cast(id % {w} as int)").alias("x"))
    return n.select(F.lit(blob_id).alias("blob_id"), "y", "x", F.pmod(value, F.lit(256)).cast("int").alias("v"))


def sierpinski(spark: SparkSession, n: int) -> DataFrame:
    return from_function(spark, f"sierpinski{n}", n, n, F.when(F.col("x").bitwiseAND(F.col("y")) == 0, 255).otherwise(0))


def gradient(spark: SparkSession, w: int, h: int) -> DataFrame:
    return from_function(spark, f"gradient{w}x{h}", w, h, F.col("x") * 3 + F.col("y"))


def repeated_rows(spark: SparkSession, w: int, h: int) -> DataFrame:
    return from_function(spark, f"rows{w}x{h}", w, h, F.expr("(7 * x) % 23 + y div 8"))


def smooth_field(spark: SparkSession, w: int, h: int) -> DataFrame:
    return from_function(spark, f"smooth{w}x{h}", w, h, F.expr("(x + y) div 4"))


def shifted_rows(spark: SparkSession, w: int, h: int) -> DataFrame:
    return from_function(spark, f"shifted{w}x{h}", w, h, F.expr("(5 * x) % 11 + (y div 8) * 3"))


def unfold(blobs: DataFrame) -> DataFrame:
    """``bytes`` of blobs.  Rows are made from the binary buffers, a part of a blob at a time."""
    id_type = blobs.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data = np.frombuffer(b.column(1)[k].as_buffer(), np.uint8)
                for at in range(0, len(data), 1 << 20):
                    part = data[at : at + (1 << 20)]
                    ids = pa.array([b.column(0)[k].as_py()], b.schema.field(0).type).take(pa.array(np.zeros(len(part), np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.arange(at, at + len(part))), pa.array(part.astype(np.int32))], ["blob_id", "pos", "v"]
                    )

    return blobs.select("blob_id", "content").mapInArrow(run, f"blob_id {id_type}, pos long, v int")


def fold(blobs: DataFrame, width: int | Column | None = None) -> DataFrame:
    """``cells`` of blobs, with ``w``; the width is a number, a column, or by default from the length.

    The last row is filled up with zeros before the bytes are laid out, so padding takes part in what follows.
    """
    n = F.octet_length("content")
    w = default_width(n) if width is None else F.lit(width) if isinstance(width, int) else width
    sized = blobs.where(n > 0).select("blob_id", "content", w.cast("int").alias("w"))
    pad = F.expr("cast(pmod(-octet_length(content), w) as int)")
    full = sized.select("blob_id", F.concat("content", F.unhex(F.repeat(F.lit("00"), pad))).alias("content"), "w")
    keyed = full.select(F.struct("blob_id", "w").alias("blob_id"), "content")
    return unfold_struct(keyed)


def unfold_struct(keyed: DataFrame) -> DataFrame:
    """Cells of blobs whose id is a struct of the id and a width."""
    id_type = keyed.schema["blob_id"].dataType["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ws = b.column(0).field(0), b.column(0).field(1).to_pylist()
            for k in range(b.num_rows):
                data, w = np.frombuffer(b.column(1)[k].as_buffer(), np.uint8), ws[k]
                step = max(1, (1 << 20) // w) * w
                for at in range(0, len(data), step):
                    part = data[at : at + step]
                    pos = np.arange(at, at + len(part))
                    same = ids.slice(k, 1).take(pa.array(np.zeros(len(part), np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [same, pa.array((pos // w).astype(np.int32)), pa.array((pos % w).astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(part), w, np.int32))],
                        ["blob_id", "y", "x", "v", "w"],
                    )

    return keyed.mapInArrow(run, f"blob_id {id_type}, y int, x int, v int, w int")


def flatten(cells: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Blobs from cells, row by row; ``lengths`` (blob_id, n) cuts the padding off.

    A row of cells is put together first, then the rows: both are as long as the matrix says.
    """
    rows = cells.groupBy("blob_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("c"))
    text = F.array_join(F.transform("c", lambda s: F.lpad(F.hex(s["v"]), 2, "0")), "")
    whole = rows.select("blob_id", "y", text.alias("h")).groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("y", "h"))).alias("r"))
    blobs = whole.select("blob_id", F.unhex(F.array_join(F.transform("r", lambda s: s["h"]), "")).alias("content"))
    if lengths is None:
        return blobs
    return blobs.join(lengths, "blob_id").select("blob_id", F.expr("substring(content, 1, cast(n as int))").alias("content"))


def segments(blobs: DataFrame, size: int = 65536) -> DataFrame:
    """``blob_id, segment, content``: fixed-size parts in order; an empty blob has one empty part."""
    last = F.expr(f"cast(greatest(octet_length(content) - 1, 0) div {size} as int)")
    parts = blobs.select("blob_id", "content", F.explode(F.sequence(F.lit(0), last)).alias("segment"))
    return parts.select("blob_id", "segment", F.expr(f"substring(content, segment * {size} + 1, {size})").alias("content"))
