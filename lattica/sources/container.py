"""A byte container for one blob: header, one payload, or segments, or super-segments; and files that hold one.

``LTCA``, version, mode, length and CRC-32 of the blob, payload.  Numbers are groups of seven bits.  A reader checks
every bound, refuses a blob that is longer than a limit or takes more memory than a budget before it makes room for
it, and takes no trailing bytes.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import kernels
from lattica.operators.reshape import KINDS, MOST_STEPS, Step
from lattica.plans import advisor, sizing

MAGIC, VERSION = b"LTCA", 1
#: A container's modes, and how many bytes a packed byte may stand for.
MODES = {"stored": 0, "flate": 1, "prep": 2, "segmented": 4, "big": 6}
_MODE = {n: m for m, n in MODES.items()}
MOST_RATIO = 1 << 14


class Corrupt(ValueError):
    """The container is damaged."""


class TooLarge(ValueError):
    """The blob is longer than the limit."""


class OutOfMemory(ValueError):
    """Decoding would take more memory than the budget."""


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


class Reader:
    """Bytes that are read once, with every bound checked."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Corrupt("the container ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            if b < 0x80:
                if (shift and not b) or n >= 1 << 63:
                    raise Corrupt("a number is written wrongly")
                return n
            shift += 7
            if shift > 63:
                raise Corrupt("a number is too long")

    def rest(self) -> bytes:
        return self.take(len(self.data) - self.at)

    def done(self) -> None:
        if self.at != len(self.data):
            raise Corrupt("bytes follow the end")


def chain_bytes(chain: tuple[Step, ...]) -> bytes:
    return bytes([len(chain)]) + b"".join(bytes([KINDS[s.kind]]) + (uvarint(s.k) if s.k else b"") for s in chain)


def read_chain(r: Reader) -> tuple[Step, ...]:
    """A chain as ``chain_bytes`` writes it; unknown steps and numbers out of range are damage."""
    n, names, out = r.take(1)[0], {k: s for s, k in KINDS.items()}, []
    if n > MOST_STEPS:
        raise Corrupt("a chain has too many steps")
    for _ in range(n):
        kind = names.get(r.take(1)[0])
        if kind is None:
            raise Corrupt("no such step")
        try:
            out.append(Step(kind, r.number() if kind in ("deint", "frame-sub", "frame-xor") else 0))
        except ValueError as e:
            raise Corrupt(str(e)) from e
    return tuple(out)


def packed(data: bytes) -> bytes:
    """The smaller of the bytes as they are and their DEFLATE, with a mark and both lengths; ties stay as they are."""
    flat = kernels.deflate(data)
    mark, body = (1, flat) if len(flat) < len(data) else (0, data)
    return bytes([mark]) + uvarint(len(data)) + uvarint(len(body)) + body


def unpacked(r: Reader) -> bytes:
    mark, n, size = r.take(1)[0], r.number(), r.number()
    body = r.take(size)
    if mark > 1 or (mark == 0 and n != size) or n > max(1, size) * MOST_RATIO:
        raise Corrupt("a packed part is damaged")
    try:
        return kernels.inflate(body, n) if mark else body
    except (ValueError, zlib.error) as e:
        raise Corrupt(str(e)) from e


def _payload(data: bytes, o: advisor.Options) -> tuple[str, bytes]:
    mode, body, _ = advisor.encode(data, o)
    size = sizing.segment_size(o.segment_size)
    if size and len(data) > size:
        parts = [advisor.encode(data[at : at + size], o)[:2] for at in range(0, len(data), size)]
        cut = uvarint(size) + b"".join(bytes([MODES[m]]) + uvarint(len(p)) + p for m, p in parts)
        if len(cut) < len(body):
            return "segmented", cut
    return mode, body


def pack(data: bytes, o: advisor.Options | None = None, big: int = 0) -> bytes:
    """A blob as a container; with ``big`` in pieces of that many bytes, each checked as it is written."""
    o = o or advisor.Options()
    head = lambda m: MAGIC + bytes([VERSION, MODES[m]]) + uvarint(len(data)) + zlib.crc32(data).to_bytes(4, "little")
    if big and len(data) > big:
        out = [head("big"), uvarint(big)]
        for at in range(0, len(data), big):
            piece = data[at : at + big]
            mode, body = _payload(piece, o)
            if _decoded(mode, body, len(piece), 0) != piece:
                raise ValueError("an encoding doesn't give the blob back")
            out += [bytes([MODES[mode]]), uvarint(len(body)), body]
        return b"".join(out)
    mode, body = _payload(data, o)
    made = head(mode) + body
    if unpack(made) != data:
        raise ValueError("an encoding doesn't give the blob back")
    return made


def _pieces(body: bytes, n: int, memory: int, inner: tuple[str, ...]) -> bytes:
    r = Reader(body)
    size = r.number()
    if size < 1:
        raise Corrupt("a segment has no bytes")
    out = []
    for at in range(0, n, size):
        mode = _MODE.get(r.take(1)[0])
        if mode not in inner:
            raise Corrupt("a segment has a wrong mode")
        out.append(_decoded(mode, r.take(r.number()), min(size, n - at), memory))
    r.done()
    return b"".join(out)


def _decoded(mode: str, body: bytes, n: int, memory: int) -> bytes:
    if memory and sizing.decode_need(mode, n if mode != "big" else min(n, 1 << 20)) > memory:
        raise OutOfMemory(f"a {mode} piece of {n} bytes takes more than {memory} bytes to decode")
    if mode == "big":
        return _pieces(body, n, memory, ("stored", "flate", "prep", "segmented"))
    if mode == "segmented":
        return _pieces(body, n, memory, ("stored", "flate", "prep"))
    try:
        return advisor.decode(mode, body, n)
    except (ValueError, KeyError, IndexError, ZeroDivisionError, zlib.error) as e:
        raise Corrupt(str(e)) from e


def unpack(blob: bytes, most: int = 0, memory: int = 0) -> bytes:
    """The blob of a container.  ``most`` limits its length, ``memory`` what decoding may take; 0 is no limit."""
    r = Reader(blob)
    if r.take(4) != MAGIC or r.take(1)[0] != VERSION:
        raise Corrupt("no container of this kind")
    mode = _MODE.get(r.take(1)[0])
    n, crc = r.number(), int.from_bytes(r.take(4), "little")
    if mode is None:
        raise Corrupt("no such mode")
    if most and n > most:
        raise TooLarge(f"the blob has {n} bytes, the limit is {most}")
    data = _decoded(mode, r.rest(), n, memory)
    if len(data) != n or zlib.crc32(data) != crc:
        raise Corrupt("the checksum is wrong")
    return data


def containers(blobs: DataFrame, o: advisor.Options | None = None, big: int = 0) -> DataFrame:
    """``blob_id, container`` for each blob."""
    return _each(blobs.select("blob_id", F.coalesce("content", F.lit(b"")).alias("content")), "container", lambda x: pack(x, o, big))


def contents(rows: DataFrame, most: int = 0, memory: int = 0) -> DataFrame:
    """``blob_id, content``: the inverse of ``containers``."""
    return _each(rows.select("blob_id", "container"), "content", lambda x: unpack(x, most, memory))


def _each(df: DataFrame, name: str, f) -> DataFrame:
    kind = df.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f(x) for x in b.column(1).to_pylist()], pa.binary())], ["blob_id", name])

    return df.mapInArrow(run, f"blob_id {kind}, {name} binary")


def reassembled(segments: DataFrame) -> DataFrame:
    """``blob_id, content`` from ``blob_id, segment, content``, in the order of the segments; a missing one raises."""
    parts = segments.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("segment", F.hex("content").alias("h")))).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = F.when(F.element_at("s", -1)["segment"] == F.col("n") - 1, F.unhex(F.array_join(F.transform("s", lambda s: s["h"]), "")))
    return parts.select("blob_id", F.coalesce(whole, F.raise_error(F.lit("a segment is missing")).cast("binary")).alias("content"))


def read_at(f, at: int, n: int) -> bytes:
    """Exactly ``n`` bytes of a file from ``at``."""
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise EOFError(f"{n} bytes at {at} are not there")
    return data


def write_whole(path: str, data: bytes, source: str | None = None) -> None:
    """Write a file under another name and rename it, so that it is there whole or not at all; never over its own source."""
    if source and os.path.exists(path) and os.path.samefile(path, source):
        raise ValueError("input and output are the same file")
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".part-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.unlink(part)
        raise
