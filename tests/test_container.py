"""Containers, sizes, records and matrices: round trips, damage, brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import cli
from lattica.functions import kernels
from lattica.operators import matrices, records, reshape
from lattica.operators.reshape import CATALOGUE, Step
from lattica.plans import advisor, sizing
from lattica.sources import blobs, container

FAST = advisor.options("fast", segment_size=4096)
DATA = [b"", b"x", b"abc" * 1000, np.random.default_rng(1).bytes(5000), bytes((i * 7) % 23 for i in range(30_000)), b"text, and more text; " * 700 + bytes(9000)]


@pytest.mark.parametrize("big", [0, 5000])
@pytest.mark.parametrize("data", DATA, ids=range(len(DATA)))
def test_container_round_trip_and_damage(data, big):
    made = container.pack(data, FAST, big)
    assert container.unpack(made) == data and len(made) < len(data) + 200
    for cut in {0, 3, 5, 6, len(made) // 2, len(made) - 1}:
        with pytest.raises(container.Corrupt):
            container.unpack(made[:cut])
    with pytest.raises(container.Corrupt):
        container.unpack(made + b"\0")
    rng = np.random.default_rng(len(data))
    for at in rng.integers(0, len(made), 40):
        bad = bytearray(made)
        bad[at] ^= 1 << int(rng.integers(0, 8))
        try:
            assert container.unpack(bytes(bad)) == data
        except container.Corrupt:
            pass


def test_limits_come_before_room_is_made():
    made = container.pack(b"abc" * 1000, FAST)
    with pytest.raises(container.TooLarge):
        container.unpack(made, most=2999)
    with pytest.raises(container.OutOfMemory):
        container.unpack(made, memory=100)
    huge = container.MAGIC + bytes([1, 1]) + container.uvarint(1 << 40) + bytes(4)
    with pytest.raises(container.TooLarge):
        container.unpack(huge, most=1 << 20)


def test_packed_parts_and_chains():
    for data in DATA:
        r = container.Reader(container.packed(data))
        assert container.unpacked(r) == data
        r.done()
    bomb = bytes([1]) + container.uvarint(1 << 30) + container.uvarint(2) + b"ab"
    with pytest.raises(container.Corrupt):
        container.unpacked(container.Reader(bomb))
    for chain in CATALOGUE + reshape.frame_chains(300):
        r = container.Reader(container.chain_bytes(chain))
        assert container.read_chain(r) == chain
        r.done()
    for bad in (b"", b"\x09", b"\x01\x63", b"\x01\x06\x01", b"\x01\x06\x80\x00", b"\x01\x07\x00"):
        with pytest.raises(container.Corrupt):
            container.read_chain(container.Reader(bad))


def test_sizes():
    assert [sizing.segment_size(n) for n in (-1, 0, 1, 4096, 1 << 30)] == [0, 65536, 1024, 4096, 1 << 26]
    assert sizing.segment_size(0, 960, 180) == 8 * 960 * 180 and sizing.segment_size(0, 9600, 1800) == 2 * 9600 * 1800
    assert sizing.big_segment_size(1 << 30) == 8 << 20 and sizing.big_segment_size(0) == 1 << 20 and sizing.big_segment_size(0, 100) == 4096
    assert sizing.decode_need("stored", 10) == 20 and sizing.decode_need("fractal", 10) == 120 and sizing.decode_need("cm", 1) == 2 + (40 << 12) + (8 << 20)
    sub, fr = (("left-sub", 0),), (("frame-sub", 9),)
    ranked = [(1, 24, sub), (2, 24, fr), (3, 24, ()), (4, 64, ()), (5, 64, sub)]
    assert sizing.fractal_attempts(ranked, 64) == [ranked[0], ranked[3]] and sizing.fractal_attempts(ranked, 8) == [ranked[0], ranked[2]]
    assert sizing.fractal_attempts(ranked[2:], 8) == [ranked[2]] and sizing.fractal_attempts([], 8) == []
    plain = (0, 0, ())
    assert sizing.cm_attempts(ranked, 100) == [ranked[0], plain, ranked[2]] and sizing.cm_attempts(ranked, 2 << 20) == [ranked[0], plain]
    assert sizing.cm_attempts(ranked, 8 << 20) == [ranked[0]] and sizing.cm_attempts(ranked, 8 << 20, video=True) == [ranked[1], ranked[0], plain]
    assert sizing.cm_attempts(ranked[2:], 100, most=9) == [ranked[2], plain, ranked[3]]


def test_command_line(tmp_path, capsys):
    a, b, c = (str(tmp_path / x) for x in "abc")
    with open(a, "wb") as f:
        f.write(DATA[4])
    assert cli.main(["compress", a, b, "--preset", "fast"]) == 0 and cli.main(["decompress", b, c]) == 0
    assert open(c, "rb").read() == DATA[4] and sorted(x.name for x in tmp_path.iterdir()) == ["a", "b", "c"]
    assert cli.main(["decompress", b, b]) == 1 and cli.main(["decompress", b, c, "--max-size", "1K"]) == 1 and cli.main(["decompress", a, c]) == 1
    assert cli.main(["bench", a, "--head", "1K"]) == 0 and "\t1024\t" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        cli.main(["nothing"])
    assert e.value.code == 2
    with open(a, "rb") as f:
        assert container.read_at(f, 5, 10) == DATA[4][5:15]
        with pytest.raises(EOFError):
            container.read_at(f, len(DATA[4]) - 3, 4)


def frame(spark, data):
    return spark.createDataFrame([(i, x) for i, x in enumerate(data)], "blob_id long, content binary")


def test_containers_and_checksums_as_tables(spark):
    df = frame(spark, DATA)
    assert {r.blob_id: bytes(r.content) for r in container.contents(container.containers(df, FAST, 5000)).collect()} == dict(enumerate(DATA))
    parts = blobs.segments(df, 700)
    assert {r.blob_id: bytes(r.content) for r in container.reassembled(parts).collect()} == dict(enumerate(DATA))
    with pytest.raises(Exception, match="a segment is missing"):
        container.reassembled(parts.where("segment <> 1")).collect()
    assert {r.blob_id: (r.n, r.crc) for r in records.crc_of_segments(parts).collect()} == {i: (len(x), zlib.crc32(x)) for i, x in enumerate(DATA)}


def test_matrices_are_what_cells_are(spark):
    df = frame(spark, [x for x in DATA if x])
    cells = blobs.fold(df, 16).select("blob_id", "y", "x", "v")
    for chain in [*CATALOGUE, (Step("frame-sub", 3), Step("left-sub"))]:
        got = matrices.forward(matrices.matrices(df, 16), *chain)
        want = {(r.blob_id, r.y): (r.t, r.c) for r in reshape.chain_forward(cells, chain).groupBy("blob_id", "y").agg(F.sum("v").alias("t"), F.sum(F.expr("v * (x + 1)")).alias("c")).collect()}
        assert {(r.blob_id, r.y): (r.total, r.by_column) for r in matrices.row_sums(got).collect()} == want
        assert matrices.inverse(got, *chain).exceptAll(matrices.matrices(df, 16)).isEmpty()
    with pytest.raises(Exception, match="needs a width that 8 divides"):
        matrices.forward(matrices.matrices(df, 10), Step("bitplanes")).collect()
    with pytest.raises(Exception, match="needs a width that 8 divides"):
        reshape.forward(blobs.fold(df, 10), Step("bitplanes")).collect()
    with pytest.raises(IndexError):
        matrices.window(np.zeros((4, 4), np.uint8), 1, 1, 4, 2)
    with pytest.raises(ValueError, match="only squares"):
        matrices.fused(np.zeros((4, 2), np.uint8), False, 1, 0, 0)
    with pytest.raises(ValueError, match="no value map"):
        matrices.valued(np.zeros((4, 4), np.uint8), 0, 1)


def test_symmetries():
    m = np.array([[1, 2], [3, 4]], np.uint8)
    want = [[[1, 2], [3, 4]], [[3, 1], [4, 2]], [[4, 3], [2, 1]], [[2, 4], [1, 3]], [[2, 1], [4, 3]], [[3, 4], [1, 2]], [[1, 3], [2, 4]], [[4, 2], [3, 1]]]
    assert [f(m).tolist() for f in matrices.ORIENTED] == want


def test_recipes(spark):
    rows = [(1, 0, 0, 4), (1, 2, 2, 4), (1, 8, 0, 4), (2, 0, 0, 8)]
    df = spark.createDataFrame(rows, "tile_id int, rx int, ry int, size int")
    assert sorted((r.tile_id, r.y, r.x, r.n) for r in records.shared_cells(df).collect()) == [(1, y, x, 2) for y in (2, 3) for x in (2, 3)]
    both = df.alias("a").crossJoin(df.alias("b")).select(records.overlaps(*(F.col(f"a.{c}") for c in ("rx", "ry", "size")), *(F.col(f"b.{c}") for c in ("rx", "ry", "size"))).alias("o"))
    assert both.where("o").count() == sum(a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[3] and b[2] < a[2] + a[3] for a in rows for b in rows)
    worst = spark.createDataFrame([(1, 5, 3), (1, 2, 7), (1, 4, 7), (2, 0, 0)], "tile_id int, ord int, mis int")
    assert sorted((r.tile_id, r.ord, r.mis) for r in records.worst_failing(worst).collect()) == [(1, 2, 7), (2, 0, 0)]
    parts = spark.createDataFrame([(1, True, b"abcd"), (1, False, None)], "tile_id int, raw boolean, data binary")
    assert records.estimated_size(parts).collect()[0].size == 16 + 7 + 5 + 4
    causal = spark.range(1).select(*(records.is_causal(F.lit(x), F.lit(y), F.lit(8), F.lit(8), F.lit(4)).alias(f"c{k}") for k, (x, y) in enumerate([(0, 4), (4, 8), (5, 8), (8, 5)])))
    assert list(causal.first()) == [True, True, False, False]
    assert kernels.crc_joined(0, 5, 0) == 5 and list(spark.range(1).select(records.is_dense(F.lit(4), F.lit(16)), records.is_dense(F.lit(5), F.lit(16))).first()) == [False, True]
