"""SimHash near-duplicates by exact tiled comparison.

Distinct fingerprints are sorted by population count and cut into tiles.  Two
fingerprints within the radius have population counts within the radius, so
only tiles whose ranges of counts come that close are compared, by numpy exclusive-or and
bit counts.  A task emits a spanning forest of the links it finds, never
all pairs; components are then joined by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from lattica.llm.common import connected_components, owned, small_batches, stored, tile_count

SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit fingerprint, unsigned; zero for a null text or one without words.

    A-Z are lower-cased; words are runs of other bytes than space and 0x09-0x0D, which is what
    ``bytes.split`` takes.  Every shingle counts as often as it occurs.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if n <= shingle:
        return hashed(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        h = np.array(
            [hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)],
            "<u8",
        )
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Links between the members of two tiles, kept as one label for each member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        labels = np.unique(self.label[members])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.arange(len(self.label))
        moved = np.flatnonzero(self.label != own)
        return moved, self.label[moved]


def link_tiles(a: np.ndarray, b: np.ndarray, same: bool, radius: int, rows: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two tiles, as indexes into ``a`` followed by ``b``.

    Both are sorted by population count; each strip of ``a`` meets only the part of ``b`` whose
    counts lie within the radius of its own.
    """
    forest, base = Forest(len(a) if same else len(a) + len(b)), 0 if same else len(a)
    pa_, pb = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    for s in range(0, len(a), rows):
        e = min(len(a), s + rows)
        lo, hi = np.searchsorted(pb, pa_[s] - radius), np.searchsorted(pb, pa_[e - 1] + radius, "right")
        lo = max(lo, s) if same else lo
        if lo >= hi:
            continue
        near = np.bitwise_count(a[s:e, None] ^ b[None, lo:hi]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            found = np.flatnonzero(near[i]) + lo + base
            if len(found) > 1 or found[0] != s + i:
                forest.join(np.append(found, s + i))
    return forest.edges()


def near_links(groups: DataFrame, radius: int = 4, tile: int = 8192, largest: int = 262_144) -> DataFrame:
    """``src, dst``: ids of ``groups`` (``fp, id``; one row for each fingerprint) that links connect.

    Not every link, but enough of them to connect what all links connect.  ``tile`` is the least, ``largest`` the most
    rows of a tile: see ``tile_count``.
    """
    spark = groups.sparkSession
    n = groups.count()
    parts = tile_count(spark, n, tile, largest)
    tile = -(-2 * n // parts)
    ordered = (
        groups.where("id is not null")
        .withColumn("pop", F.bit_count("fp").cast("int"))
        .repartitionByRange(parts, "pop", "fp")
        .sortWithinPartitions("pop", "fp")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, fp, ids, pop = TaskContext.get().partitionId(), 0, [], [], []

        def out() -> pa.RecordBatch:
            f, i, p = (np.concatenate(x) for x in (fp, ids, pop))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part * 1048576 + k], pa.int64()),
                    pa.array([int(p[0])], pa.int32()),
                    pa.array([int(p[-1])], pa.int32()),
                    pa.array([f.tobytes()], pa.binary()),
                    pa.array([i.tobytes()], pa.binary()),
                ],
                ["tile", "low", "high", "fps", "ids"],
            )

        held = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                take = b.slice(at, min(b.num_rows - at, tile - held))
                for store, c in ((fp, 0), (ids, 1), (pop, 2)):
                    store.append(take.column(c).to_numpy(zero_copy_only=False))
                at, held = at + take.num_rows, held + take.num_rows
                if held == tile:
                    yield out()
                    k, held, fp, ids, pop = k + 1, 0, [], [], []
        if held:
            yield out()

    tiles = stored(
        ordered.select("fp", "id", "pop").mapInArrow(cut, "tile long, low int, high int, fps binary, ids binary"), "tiles"
    )
    spans = tiles.select("tile", "low", "high")
    left = spans.select(F.col("tile").alias("a"), F.explode(F.sequence(F.col("low") - radius, F.col("high") + radius)).alias("pop"))
    right = spans.select(F.col("tile").alias("b"), F.explode(F.sequence("low", "high")).alias("pop"))
    pairs = left.join(right, "pop").where("a <= b").select("a", "b").distinct()
    work = (
        pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fa"), F.col("ids").alias("ia")), "a")
        .join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fb"), F.col("ids").alias("ib")), "b")
        .repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts * (parts + 1) // 2), "a", "b")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["a"] == r["b"]
                x, y = (np.frombuffer(r[c], np.uint64) for c in ("fa", "fb"))
                ids = np.frombuffer(r["ia"] if same else r["ia"] + r["ib"], np.int64)
                u, v = link_tiles(x, y, same, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["src", "dst"])

    return work.mapInArrow(compare, "src long, dst long")


@owned
def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, tile: int = 8192) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs`` (``doc_id, text``; other columns are ignored).

    ``component_id`` is the smallest doc_id that links reach.  Null and empty texts have
    fingerprint zero and are linked like any other.  Rows that repeat a doc_id are kept.  A row
    without doc_id takes part by its fingerprint alone: it has the component of the
    rows of the same fingerprint, null if there are none, and connects nothing.
    """
    fps = stored(fingerprints(docs, shingle), "fps")
    groups = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "groups")
    comps = connected_components(near_links(groups, radius, tile))
    known = stored(
        groups.join(comps, groups.id == comps.node, "left").select("fp", F.coalesce("component", "id").alias("component_id")),
        "components",
    )
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> Column:
    """The fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


@owned
def _later(docs: DataFrame, radius: int, shingle: int) -> DataFrame:
    """The ids that have a smaller one in their component."""
    return near_duplicates(docs, radius, shingle).where("doc_id > component_id").select("doc_id").distinct()


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; rows without doc_id stay.

    Repeated rows of the kept doc_id all stay: a doc_id stands for one document.
    """
    drop = _later(docs.select("doc_id", "text"), radius, shingle)
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)
