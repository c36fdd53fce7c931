"""Worked examples, round trips and brute force for the byte-matrix operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import kernels, scalars
from lattica.operators import geometry, match, stats
from lattica.operators.reshape import CATALOGUE, KINDS, Step, chain_forward, chain_inverse, forward, frame_chains
from lattica.plans import advisor, quadtree
from lattica.sources import blobs


def cells(spark, rows):
    return spark.createDataFrame([("m", y, x, int(v)) for y, r in enumerate(rows) for x, v in enumerate(r)], "blob_id string, y int, x int, v int")


def grid(df):
    rows = df.select("y", "x", "v").collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), int)
    for r in rows:
        out[r.y, r.x] = r.v
    return out.tolist()


@pytest.mark.parametrize(
    ("step", "before", "after"),
    [
        (Step("up-sub"), [[50, 60, 70, 80], [50, 60, 71, 80], [50, 61, 71, 80]], [[50, 60, 70, 80], [0, 0, 1, 0], [0, 1, 0, 0]]),
        (Step("left-sub"), [[250, 3, 10]], [[250, 9, 7]]),
        (Step("bitplanes"), [[1] * 8], [[255]] + [[0]] * 7),
        (Step("deint", 2), [[1, 9, 2, 9, 3, 9, 4, 9]], [[1, 2, 3, 4], [9, 9, 9, 9]]),
    ],
)
def test_steps(spark, step, before, after):
    assert grid(forward(cells(spark, before), step)) == after
    assert kernels.forward(np.array(before, np.uint8), step.kind, step.k).tolist() == after


def test_chains_round_trip(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(0, 256, (5, 16)).tolist()
    for chain in CATALOGUE + frame_chains(2):
        made = chain_forward(cells(spark, m), chain)
        assert grid(chain_inverse(made, chain)) == m
        want = np.array(m, np.uint8)
        for s in chain:
            want = kernels.forward(want, s.kind, s.k)
        assert grid(made) == want.tolist()


@pytest.mark.parametrize(("w", "n"), [(1, 1), (8, 1), (8, 64), (16, 80), (48, 336), (24, 70), (96, 1248), (5, 45)])
def test_kernels_round_trip(w, n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    for chain in CATALOGUE + frame_chains(3):
        steps = [(s.kind, s.k) for s in chain]
        if (made := kernels.chain_forward(data, w, steps)) is not None:
            assert kernels.chain_inverse(made, w, n, steps) == data


def test_invalid_steps():
    for kind, k in (("deint", 1), ("deint", 17), ("up-sub", 3), ("nothing", 0), ("frame-sub", 0)):
        with pytest.raises(ValueError):
            Step(kind, k)
    for step in (Step("bitplanes"), Step("deint", 4)):
        with pytest.raises(ValueError):
            step.shape(10, 1)
    assert len(KINDS) == 8


def test_geometry(spark):
    m = cells(spark, [[1, 2], [3, 4]])
    assert ["".join(str(v) for r in grid(geometry.isometry(m, i, 2)) for v in r) for i in range(8)] == ["1234", "3142", "4321", "2413", "2143", "3412", "1324", "4231"]
    for i in range(8):
        assert grid(geometry.isometry(geometry.isometry(m, i, 2), geometry.INVERSE[i], 2)) == [[1, 2], [3, 4]]
        assert match._orient(np.array([[[1, 2], [3, 4]]]))[i][0].tolist() == grid(geometry.isometry(m, i, 2))
    assert grid(geometry.decimate(cells(spark, [[10, 99, 20, 99], [99] * 4, [30, 99, 40, 99], [99] * 4]))) == [[10, 20], [30, 40]]
    one = cells(spark, [[253, 15]])
    assert grid(one.withColumn("v", geometry.value_map(F.col("v"), 1, 5))) == [[2, 20]]
    assert grid(one.withColumn("v", geometry.value_map(F.col("v"), 2, 255))) == [[2, 240]]
    assert grid(geometry.residual(cells(spark, [[25, 15, 45, 36]]), cells(spark, [[25, 15, 45, 35]]))) == [[0, 0, 0, 7]]
    assert geometry.unequal_cells(m, m).count() == 0
    assert grid(geometry.padded(m, 3, 7)) == [[1, 2, 7], [3, 4, 7], [7, 7, 7]]


def test_blobs(spark):
    data = [(1, b"hello"), (2, b""), (3, bytes(range(256)) * 3), (4, None)]
    b = blobs.from_column(spark.createDataFrame(data, "i int, c binary"), "i", "c")
    assert blobs.unfold(b).groupBy("blob_id").count().count() == 2
    back = blobs.flatten(blobs.fold(b), b.select("blob_id", F.octet_length("content").alias("n")))
    assert {r.blob_id: bytes(r.content) for r in back.collect()} == {1: b"hello", 3: data[2][1]}
    assert [len(r.content) for r in blobs.segments(b, 500).where("blob_id = 3").orderBy("segment").collect()] == [500, 268]


def test_scalars(spark):
    for n, w in ((1, 8), (64, 8), (100, 8), (4096, 64), (65536, 256), (70000, 256), (1 << 20, 1024)):
        assert kernels.default_width(n) == w
        assert spark.range(1).select(scalars.default_width(F.lit(n))).first()[0] == w
    assert scalars.parse_size("1.5G") == 3 << 29
    assert scalars.video_rows("4x6:yuv420p") == (4, 9)
    for bad in ("4x5:yuv420", "0x3", "4x4:nope", "4"):
        with pytest.raises(ValueError):
            scalars.video_rows(bad)
    r = spark.range(-3, 4).select("id", scalars.unzigzag(scalars.zigzag(F.col("id"))).alias("again")).collect()
    assert all(x.id == x.again for x in r)


def test_widths(spark):
    rng = np.random.default_rng(5)
    made = []
    for size in (48, 100, 37, 256):
        record = rng.integers(0, 256, size, dtype=np.uint8)
        rows = np.tile(record, (300, 1))
        rows[:, 0] = np.arange(300)
        made.append((size, rows.tobytes()))
    made.append((0, rng.integers(0, 256, 20000, dtype=np.uint8).tobytes()))
    got = {(r.blob_id, r.rank): r.width for r in stats.detect_widths(spark.createDataFrame(made, "blob_id int, content binary")).collect()}
    assert all(got[size, 0] == size for size in (48, 100, 37, 256)) and not any(k[0] == 0 for k in got)
    for size, data in made:
        assert kernels.detect_widths(data)[:1] == ([size] if size else [])


def test_advisor(spark):
    n = 1 << 12
    data = [(1, bytes((3 * x + y) % 256 for y in range(80) for x in range(100))), (2, np.random.default_rng(0).integers(0, 256, n, dtype=np.uint8).tobytes()), (3, b""), (4, b"the quick brown fox " * 90)]
    b = spark.createDataFrame(data, "blob_id int, content binary")
    for o in (advisor.options(), advisor.options("fast"), advisor.options("fastest", segment_size=256)):
        assert {r.blob_id: bytes(r.content) for r in advisor.decoded(advisor.encoded(b, o)).collect()} == dict(data)
    rep = {r.blob_id: r for r in advisor.report(b).collect()}
    assert rep[1].chosen == "prep" and rep[1].prep < rep[1].flate and rep[2].chosen == "stored" and rep[3].out == 0
    assert advisor.search(data[0][1], advisor.options())[0][1] == 100
    rows = advisor.encoded(b).where("blob_id = 4").withColumn("payload", F.expr("substring(payload, 1, octet_length(payload) - 1)"))
    with pytest.raises(Exception, match="damaged|incomplete|invalid"):
        advisor.decoded(rows).collect()


def brute(m, size, stride):
    """The recipe of each node, by trying every domain."""
    out, h, w = {}, *m.shape
    for ry in range(0, h, size):
        for rx in range(0, w, size):
            node = m[ry : ry + size, rx : rx + size].astype(int)
            best = None
            for kind, scale in ((0, 2), (1, 1)):
                span, d = size * scale, 0
                for dy in range(0, h - span + 1, stride):
                    for dx in range(0, w - span + 1, stride):
                        dom = m[dy : dy + span : scale, dx : dx + span : scale].astype(int)
                        apart = dx + span <= rx or rx + size <= dx or dy + span <= ry or ry + size <= dy
                        last = dy + size - 1
                        if apart and (kind == 0 or last < ry or (last == ry and dx + size - 1 < rx)):
                            for iso, o in enumerate(match._orient(dom[None])):
                                for code in (1, 2):
                                    v = (node - o[0]) % 256 if code == 1 else node ^ o[0]
                                    if (v == v[0, 0]).all():
                                        cand = (code, (kind << 29) + (d << 3) + iso, kind, dx, dy, iso, int(v[0, 0]))
                                        best = min(best, cand) if best else cand
                        d += 1
            if best:
                out[rx, ry] = (*best[2:6], best[0] if best[6] else 0, best[6])
    return out


def test_match_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    tile = rng.integers(0, 3, (32, 32), dtype=np.uint8) * 40
    tile[16:, 16:] = tile[:16, :16] + 7
    t = spark.createDataFrame([("t", 32, tile.tobytes(), 1)], "tile_id string, w int, content binary, start int")
    for size in (8, 4):
        nodes, domains = match.blocks(t, size, size // 2)
        got = {(r.rx, r.ry): (r.kind, r.dx, r.dy, r.iso, r.code, r.c) for r in match.match(nodes, domains, size, None).collect()}
        assert got == brute(tile, size, size // 2)


def test_quadtree_rebuilds(spark):
    x, y = np.meshgrid(np.arange(32), np.arange(32))
    m = np.where(x & y == 0, 255, 0).astype(np.uint8)
    t = spark.createDataFrame([("s", 32, m.tobytes(), 0, 32, 32)], "tile_id string, w int, content binary, start int, real_w int, real_h int")
    recipes, rebuilt, _ = quadtree.refine(t)
    got = np.frombuffer(bytes(rebuilt.first().content), np.uint8).reshape(32, 32)
    wrong = int((got != m).sum())
    residual = got ^ m
    assert ((got ^ residual) == m).all() and wrong <= 32 * 32 // 4
    assert recipes.where("not raw").count() > 0


def test_streaming(spark, tmp_path):
    from lattica import streaming

    (tmp_path / "in").mkdir()
    data = {"a": b"abc" * 1000, "b": bytes(range(256)) * 20}
    for k, v in data.items():
        (tmp_path / "in" / k).write_bytes(v)
    q = streaming.encode_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), segment=1024)
    q.awaitTermination(120)
    got = {}
    for r in streaming.decode_folder(spark, str(tmp_path / "out")).orderBy("segment").collect():
        got[r.blob_id[-1]] = got.get(r.blob_id[-1], b"") + bytes(r.content)
    assert got == data


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 250
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_skip_counts_leave_bytes_where_they_are(spark, tmp_path):
    """No row of a byte is shuffled; repeated and missing ids as in the SQL."""
    import duckdb

    from lattica.plans import queries

    rng = np.random.default_rng(6)
    rows = [(k, "".join(rng.choice(list("ab é"), n))) for k, n in enumerate([1, 63, 64, 65, 1024, 1025, 5000])]
    rows += [(2, "x " * 700), (None, "no id"), (None, "y " * 900), (9, ""), (10, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.a6_skip_count(spark, str(tmp_path))
    sql = queries.oracle_sql()["a6_skip_count"]
    documents = duckdb.read_parquet(f"{tmp_path}/documents.parquet/*.parquet")  # noqa: F841
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, duckdb.sql(sql).fetchall()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
