"""The encoding advisor: for each blob, which lossless encoding is smallest.

A blob is one row, so candidates are sized in an Arrow batch without a shuffle; large blobs are cut
into segments first and each segment is a row.  Candidates are stored, DEFLATE,
and DEFLATE after the best reshaping; the smallest wins, the earlier one on ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import kernels
from lattica.operators.reshape import CATALOGUE, KINDS, frame_chains
from lattica.sources.blobs import segments

#: Encodings by their number in a container.
MODES = {"stored": 0, "flate": 1, "prep": 2, "segmented": 4}


@dataclass(frozen=True)
class Options:
    """``width`` 0 looks for one; ``frame_rows`` adds the frame chains; ``segment_size`` 0 makes no segments."""

    width: int = 0
    frame_rows: int = 0
    segment_size: int = 65536
    search_sample: int = 65536
    no_prep: bool = False
    level: int = 9
    no_quick_reject: bool = False


PRESETS = {
    "default": Options(),
    "fast": Options(segment_size=262144, search_sample=16384, level=1),
    "fastest": Options(segment_size=1 << 20, no_prep=True, level=1),
}


def options(preset: str = "default", **changes) -> Options:
    """A preset, and then what is given explicitly."""
    return replace(PRESETS[preset], **changes)


def search(data: bytes, o: Options) -> list[tuple[int, int, tuple]]:
    """``(cost, width, chain)`` by cost, then shorter chain, then width, then the order of trial."""
    n = len(data)
    sample = data[: max(o.search_sample, 3 * o.frame_rows * max(o.width, 1))]
    widths = [o.width] if o.width else [kernels.default_width(n), *kernels.detect_widths(data)]
    widths = [w for w in dict.fromkeys(widths) if 0 < w <= len(sample)]
    if not widths and o.width:
        widths, sample = [min(max(o.width, 1), n)], data
    found = []
    for w in widths:
        for chain in CATALOGUE + frame_chains(o.frame_rows):
            steps = tuple((s.kind, s.k) for s in chain)
            if (shaped := kernels.chain_forward(sample, w, steps)) is not None:
                found.append((len(kernels.deflate(shaped, 1)), w, steps))
    return sorted(found, key=lambda c: (c[0], len(c[2]), c[1]))


def incompressible(data: bytes, o: Options) -> bool:
    """Quick reject: nearly uniform bytes that fast DEFLATE doesn't shorten and that have no period."""
    return (
        not o.no_quick_reject
        and len(data) >= 4096
        and kernels.entropy(data) >= 7.9
        and len(kernels.deflate(data, 1)) >= 0.99 * len(data)
        and not kernels.detect_widths(data)
    )


def encode(data: bytes, o: Options) -> tuple[str, bytes, dict[str, int]]:
    """The smallest encoding, its payload, and the sizes of what was tried."""
    sizes, best = {"stored": len(data)}, ("stored", data)
    if not data or incompressible(data, o):
        return *best, sizes
    flat = kernels.deflate(data, o.level)
    sizes["flate"] = len(flat)
    if len(flat) < len(best[1]):
        best = ("flate", flat)
    if not o.no_prep and len(data) >= 64:
        ranked = search(data, o)
        if ranked:
            _, w, chain = ranked[0]
            head = w.to_bytes(4, "little") + bytes([len(chain)]) + b"".join(bytes([KINDS[s]]) + k.to_bytes(2, "little") for s, k in chain)
            body = head + kernels.deflate(kernels.chain_forward(data, w, chain), o.level)
            sizes["prep"] = len(body)
            if len(body) < len(best[1]):
                best = ("prep", body)
    return *best, sizes


_NAMES = {n: k for k, n in KINDS.items()}


def decode(mode: str, payload: bytes, n: int) -> bytes:
    """The blob back; damaged payloads raise."""
    if mode == "stored":
        if len(payload) != n:
            raise ValueError("the payload is damaged")
        return payload
    if mode == "flate":
        return kernels.inflate(payload, n)
    w, steps = int.from_bytes(payload[:4], "little"), payload[4]
    chain = tuple((_NAMES[payload[5 + 3 * i]], int.from_bytes(payload[6 + 3 * i : 8 + 3 * i], "little")) for i in range(steps))
    return kernels.chain_inverse(kernels.inflate(payload[5 + 3 * steps :], -(-n // w) * w), w, n, chain)


def encoded(blobs: DataFrame, o: Options | None = None, *keys: str) -> DataFrame:
    """``blob_id, keys, mode, n, crc, payload, flate, prep`` for each row; every payload is decoded and compared first."""
    o = o or Options()
    keys = ("blob_id", *keys)
    spec = ", ".join(f"`{k}` {blobs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            rows = []
            for data in b.column(b.num_columns - 1).to_pylist():
                data = data or b""
                mode, payload, sizes = encode(data, o)
                if decode(mode, payload, len(data)) != data:
                    raise ValueError("an encoding doesn't give the blob back")
                rows.append((mode, len(data), zlib.crc32(data), payload, sizes.get("flate"), sizes.get("prep")))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*b.schema.names[:-1], "mode", "n", "crc", "payload", "flate", "prep"]
            )

    return blobs.select(*keys, "content").mapInArrow(run, f"{spec}, mode string, n long, crc long, payload binary, flate long, prep long")


def decoded(rows: DataFrame, *keys: str) -> DataFrame:
    """``blob_id, keys, content``: the inverse of ``encoded``; a wrong checksum raises."""
    keys = ("blob_id", *keys)
    spec = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            out = []
            for mode, n, crc, payload in zip(*(b.column(len(keys) + i).to_pylist() for i in range(4)), strict=True):
                data = decode(mode, payload, n)
                if zlib.crc32(data) != crc:
                    raise ValueError("the checksum is wrong")
                out.append(data)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(out, pa.binary())], [*keys, "content"])

    return rows.select(*keys, "mode", "n", "crc", "payload").mapInArrow(run, f"{spec}, content binary")


def report(blobs: DataFrame, o: Options | None = None) -> DataFrame:
    """``blob_id, orig_len, flate, prep, segmented, chosen, out, ratio``; null: not tried.

    Segments are encoded as rows of their own, and their sizes are summed for the blob; they are
    chosen only where they are strictly smaller than the whole.
    """
    o = o or Options()
    whole = encoded(blobs, o).select("blob_id", "n", "flate", "prep", "mode", F.octet_length("payload").cast("long").alias("size"))
    if not o.segment_size:
        cut = whole.select(F.col("blob_id").alias("b"), F.lit(None).cast("long").alias("segmented"))
    else:
        long = blobs.where(F.octet_length("content") > o.segment_size)
        each = encoded(segments(long, o.segment_size), o, "segment")
        cut = each.groupBy(F.col("blob_id").alias("b")).agg(F.sum(F.octet_length("payload") + 5).cast("long").alias("segmented"))
    both = whole.join(cut, F.col("blob_id").eqNullSafe(F.col("b")), "left")
    better = F.coalesce(F.col("segmented") < F.col("size"), F.lit(False))
    out = F.when(better, F.col("segmented")).otherwise(F.col("size"))
    return both.select(
        "blob_id",
        F.col("n").alias("orig_len"),
        "flate",
        "prep",
        "segmented",
        F.when(better, "segmented").otherwise(F.col("mode")).alias("chosen"),
        out.alias("out"),
        F.round(out / F.greatest(F.col("n"), F.lit(1)), 6).alias("ratio"),
    )
