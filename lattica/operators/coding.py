"""Blobs through the context-mixing coder: segments of a batch are coded together, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import mixing
from lattica.sources.blobs import segments

#: Bytes of a segment: each is coded with a fresh model, and a batch takes as many steps as its longest has bits.
SEGMENT = 4096


def _mapped(rows: DataFrame, column: str, f: Callable[[pa.RecordBatch], list[bytes]]) -> DataFrame:
    """``blob_id, segment, n, column``: what ``f`` makes of each batch."""
    kind = rows.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(f(b), pa.binary())], ["blob_id", "segment", "n", column])

    return rows.mapInArrow(run, f"blob_id {kind}, segment int, n int, {column} binary")


def mixed(blobs: DataFrame, size: int = SEGMENT, stride: int = 0) -> DataFrame:
    """``blob_id, segment, n, payload``: each segment coded; every payload is decoded and compared first.

    ``stride`` is the row length if the blobs are matrices.  A null blob has no segment, an empty one an empty one.
    """

    def run(b: pa.RecordBatch) -> list[bytes]:
        parts = b.column(3).to_pylist()
        coded = mixing.pack(parts, stride)
        if mixing.unpack(coded, [len(x) for x in parts], stride) != parts:
            raise ValueError("an encoding doesn't give the blob back")
        return coded

    cut = segments(blobs.where("content is not null"), size)
    return _mapped(cut.select("blob_id", "segment", F.octet_length("content").alias("n"), "content"), "payload", run)


def unmixed(rows: DataFrame, stride: int = 0) -> DataFrame:
    """``blob_id, segment, n, content``: the inverse of ``mixed``; damaged payloads raise."""
    return _mapped(rows.select("blob_id", "segment", "n", "payload"), "content", lambda b: mixing.unpack(b.column(3).to_pylist(), b.column(2).to_pylist(), stride))


def sizes(rows: DataFrame) -> DataFrame:
    """``blob_id, n, mixed``: bytes of each blob before and after; four more a segment tell its length."""
    return rows.groupBy("blob_id").agg(F.sum("n").cast("long").alias("n"), F.sum(F.octet_length("payload") + 4).cast("long").alias("mixed"))
