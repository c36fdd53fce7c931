"""The registered queries of the byte-matrix operators, and the SQL they are held against.

Matrices of whole tables have a row for each byte; the queries give two sums for each row of a matrix (of the
values, and of the values by their column), which tell a wrong or misplaced value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import kernels
from lattica.functions.scalars import bit_length, default_width, round_up, uvarint_size, zigzag
from lattica.operators import coding, geometry, match, matrices, records, stats
from lattica.operators.reshape import CATALOGUE, Step
from lattica.plans import advisor, quadtree
from lattica.sources import blobs as src
from lattica.sources import container


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.from_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.from_column(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")


def row_sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy("blob_id", "y").agg(
        F.sum("v").cast("long").alias("total"), F.sum(F.col("v") * (F.col("x") + 1)).cast("long").alias("by_column")
    ).select(F.col("blob_id").alias("doc_id"), F.col("y").cast("int").alias("y"), "total", "by_column")


def named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("blob_id", "doc_id")


def folded(spark, d, width: int = 64) -> DataFrame:
    return matrices.matrices(documents(spark, d), width)


def s6_unfold(spark, d):
    b = src.unfold(documents(spark, d))
    return b.groupBy(F.col("blob_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").cast("long").alias("total"), F.sum(F.col("v") * (F.col("pos") + 1)).cast("long").alias("by_place")
    )


def s7_fold(spark, d):
    return named(matrices.row_sums(matrices.matrices(documents(spark, d))))


def s8_flatten(spark, d):
    blobs = documents(spark, d).where("octet_length(content) > 0")
    back = src.flatten(src.fold(blobs), blobs.select("blob_id", F.octet_length("content").alias("n")))
    return back.select(F.col("blob_id").alias("doc_id"), F.octet_length("content").alias("n"), F.md5("content").alias("digest"))


def s13_segments(spark, d):
    parts = src.segments(documents(spark, d), 1024)
    return parts.select(F.col("blob_id").alias("doc_id"), "segment", F.octet_length("content").alias("n"))


def a1_byte_histogram(spark, d):
    return matrices.histogram(documents(spark, d)).groupBy("v").agg(F.sum("n").alias("n"))


def a2_entropy(spark, d):
    return stats.entropy(matrices.histogram(documents(spark, d)), "blob_id").withColumnRenamed("blob_id", "doc_id")


def a3_most_frequent(spark, d):
    return stats.most_frequent(matrices.histogram(documents(spark, d)), "blob_id").withColumnRenamed("blob_id", "doc_id")


def a13_crc32(spark, d):
    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), F.crc32("content").alias("crc"))


def q18_default_width(spark, d):
    return documents(spark, d).select(F.col("blob_id").alias("doc_id"), default_width(F.octet_length("content")).alias("width"))


#: Folded at a width that all steps fit.
STEPS = {
    "r1_up_sub": Step("up-sub"),
    "r2_up_xor": Step("up-xor"),
    "r3_left_sub": Step("left-sub"),
    "r4_left_xor": Step("left-xor"),
    "r5_bitplanes": Step("bitplanes"),
    "r6_deinterleave": Step("deint", 4),
    "r7_frame_sub": Step("frame-sub", 3),
    "r8_frame_xor": Step("frame-xor", 3),
}


def reshaped(step: Step, spark, d):
    return named(matrices.row_sums(matrices.forward(folded(spark, d), step)))


def r9_chain_roundtrip(spark, d):
    """What every chain makes of all documents, by row sums, and how many of its matrices don't come back."""
    before = folded(spark, d)
    out = None
    for k, chain in enumerate(CATALOGUE):
        made = matrices.forward(before, *chain)
        sums = matrices.row_sums(made).agg(F.sum("total").alias("total"), F.sum("by_column").alias("by_column"))
        bad = matrices.mapped(before, partial(_lost, chain)).agg(F.count_if(F.expr("content <> X'00'")).alias("unequal"))
        one = sums.crossJoin(bad).select(F.lit(k).alias("chain"), "unequal", "total", "by_column")
        out = one if out is None else out.union(one)
    return out


def _lost(chain, m):
    """One byte: 1 if the chain doesn't give the matrix back."""
    steps = [(x.kind, x.k) for x in chain]
    made = kernels.chain_forward(m.tobytes(), m.shape[1], steps)
    return np.array([[kernels.chain_inverse(made, m.shape[1], m.size, steps) != m.tobytes()]], np.uint8)


def p1_view(spark, d):
    return row_sums(geometry.view(src.fold(documents(spark, d), 64), 8, 2, 16, 1 << 30))


def p2_decimate(spark, d):
    return named(matrices.row_sums(matrices.decimate(folded(spark, d))))


def p3_isometry(spark, d):
    out = None
    for iso in range(8):
        one = geometry.isometry(src.shifted_rows(spark, 64, 64), iso, 64).select(F.lit(iso).alias("iso"), "y", "x", "v")
        out = one if out is None else out.union(one)
    return out


def p6_value_map(spark, d):
    return named(matrices.row_sums(matrices.mapped(folded(spark, d), lambda m: matrices.valued(matrices.valued(m, 1, 77), 2, 0x5A))))


def p8_residual(spark, d):
    return named(matrices.row_sums(matrices.residual(folded(spark, d), lambda m: kernels.forward(m, "up-sub", 0))))


def p12_pad(spark, d):
    return named(matrices.row_sums(matrices.padded(folded(spark, d, 72), 16, 9)))


def a6_skip_count(spark, d):
    """Blobs of one id are laid over each other and add up; those without an id count nothing, as in the SQL."""
    part = named(matrices.skip_counts(folded(spark, d), 16, 32)).groupBy("doc_id", "ny", "nx").agg(F.sum("skip").alias("n"))
    return part.select("doc_id", "ny", "nx", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("n")).alias("skip"))


def a4_lag_score(spark, d):
    return stats.lag_scores(pages(spark, d)).select(F.col("blob_id").alias("page_id"), "lag", F.round("score", 9).alias("score"))


def q16_detect_widths(spark, d):
    return stats.detect_widths(pages(spark, d)).withColumnRenamed("blob_id", "page_id")


def tiles(spark) -> DataFrame:
    """Three grids of 64 x 64 as tiles, with their commonest value as the start."""
    cells = src.sierpinski(spark, 64).union(src.shifted_rows(spark, 64, 64)).union(src.gradient(spark, 64, 64))
    start = stats.most_frequent(stats.histogram(cells, "blob_id"), "blob_id").select("blob_id", F.col("v").alias("start"))
    full = src.flatten(cells).join(start, "blob_id")
    return full.select(F.col("blob_id").alias("tile_id"), F.lit(64).alias("w"), "content", "start", F.lit(64).alias("real_w"), F.lit(64).alias("real_h"))


def j1_block_match(spark, d):
    out = None
    for size in (16, 8, 4):
        nodes, domains = match.blocks(tiles(spark), size, size // 2)
        one = match.match(nodes, domains, size).select("tile_id", F.lit(size).alias("size"), "rx", "ry", "kind", "dx", "dy", "iso", "code", "c")
        out = one if out is None else out.union(one)
    return out


def q10_probe(spark, d):
    return match.probe(tiles(spark))


def q1_quadtree(spark, d):
    o = quadtree.Options()
    top = quadtree.costs(quadtree.levels(tiles(spark), o), o)[-1]
    return top.select("tile_id", "ry", "rx", "choice", "cost")


def q6_refine(spark, d):
    t = tiles(spark)
    recipes, rebuilt, _ = quadtree.refine(t)
    left = quadtree.unequal(t.select("tile_id", F.lit(0).alias("rx"), F.lit(0).alias("ry"), F.col("w").alias("size")), t, rebuilt)
    count = recipes.groupBy("tile_id").agg(F.count_if(~F.col("raw")).alias("copies"), F.count_if("raw").alias("anchors"))
    return left.join(count, "tile_id", "left").select("tile_id", "copies", "anchors", F.col("mis").alias("residual_cells"))


def q13_advisor_report(spark, d):
    docs = documents(spark, d).select(F.concat(F.lit("document "), F.col("blob_id")).alias("blob_id"), "content")
    web = pages(spark, d).select(F.concat(F.lit("page "), F.col("blob_id")).alias("blob_id"), "content")
    return advisor.report(docs.union(web))


def q17_layout_search(spark, d):
    return advisor.encoded(pages(spark, d), advisor.options("default", no_quick_reject=True)).select(
        F.col("blob_id").alias("page_id"), "n", "flate", "prep", "mode"
    )


def a11_segment_modes(spark, d):
    rows = advisor.encoded(src.segments(pages(spark, d), 4096), advisor.options("fastest"), "segment")
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def s11_container_roundtrip(spark, d):
    blobs = documents(spark, d)
    again = advisor.decoded(advisor.encoded(blobs, advisor.options("fast")))
    return again.select(F.col("blob_id").alias("doc_id"), F.md5("content").alias("digest"))


def s12_container_bytes(spark, d):
    """Containers of bytes, the larger blobs in super-segments of 16 KiB, and back."""
    made = container.containers(documents(spark, d), advisor.options("fastest"), 16384)
    return container.contents(made).select(F.col("blob_id").alias("doc_id"), F.octet_length("content").alias("n"), F.md5("content").alias("digest"))


def j12_exhaustive(spark, d):
    """Documents in tiles of 32 x 32, the last filled up with zeros, nodes of 8: the best agreement of each."""
    parts = src.segments(documents(spark, d), 1024).where("octet_length(content) > 0")
    tiles = parts.select(
        F.concat_ws("/", "blob_id", "segment").alias("tile_id"), F.lit(32).alias("w"), F.expr("rpad(content, 1024, X'00')").alias("content"),
        F.lit(32).alias("real_w"), F.expr("cast((octet_length(content) + 31) div 32 as int)").alias("real_h"),
    )
    own = F.split("tile_id", "/")
    return match.exhaustive(tiles, 8, 4).select(own[0].cast("long").alias("doc_id"), own[1].cast("int").alias("segment"), "rx", "ry", "dx", "dy", "iso", "code", "c", "misses")


def u5_mixing_roundtrip(spark, d):
    """Documents through the context-mixing coder and back."""
    blobs = documents(spark, d)
    slots = spark.sparkContext.defaultParallelism
    few = len(blobs.inputFiles()) < slots
    rows = coding.mixed(blobs.repartition(slots) if few else blobs, 2048)
    whole = container.reassembled(coding.unmixed(rows).select("blob_id", "segment", "content"))
    return whole.select(F.col("blob_id").alias("doc_id"), F.octet_length("content").alias("n"), F.md5("content").alias("digest"))


def s13_reassemble(spark, d):
    whole = container.reassembled(src.segments(documents(spark, d), 1024))
    return whole.select(F.col("blob_id").alias("doc_id"), F.octet_length("content").alias("n"), F.md5("content").alias("digest"))


def s21_comparators(spark, d):
    return records.comparators(pages(spark, d)).withColumnRenamed("blob_id", "page_id")


def f1_integers(spark, d):
    n = F.octet_length("content").cast("long")
    return documents(spark, d).select(
        F.col("blob_id").alias("doc_id"), n.alias("n"), bit_length(n).cast("int").alias("bits"), uvarint_size(n).cast("int").alias("bytes"),
        round_up(n, 64).cast("long").alias("rounded"), zigzag(n - 1000).alias("zig"),
    )


COLUMNS = ["l_partkey", "l_suppkey"]


def w5_delta_columns(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", *COLUMNS)
    return records.delta_columns(lines, ["l_orderkey"], ["l_linenumber", *COLUMNS], COLUMNS)


def w5_undelta_columns(spark, d):
    return records.undelta_columns(w5_delta_columns(spark, d), ["l_orderkey"], COLUMNS)


def w6_rolling_hash(spark, d):
    return named(records.rolling_hashes(documents(spark, d)))


def w7_split_offsets(spark, d):
    return records.split_offsets(spark.read.parquet(f"{d}/documents.parquet"), "source")


def j8_spot_lag(spark, d):
    return named(records.repeats_at(documents(spark, d), 16))


def a13_segment_crc(spark, d):
    """The checksum of each document from those of its segments, and whether it is the document's own."""
    blobs = documents(spark, d)
    joined = records.crc_of_segments(src.segments(blobs, 512))
    own = blobs.select("blob_id", F.crc32("content").alias("own"))
    return joined.join(own, "blob_id").select(F.col("blob_id").alias("doc_id"), "n", (F.col("crc") == F.col("own")).alias("same"))


def a10_tile_stats(spark, d):
    tiles = matrices.tiles(matrices.matrices(pages(spark, d), 128), 64)
    return records.tile_stats(advisor.encoded(tiles, advisor.options("fastest"), "x0", "y0"))


def p7_fused(spark, d):
    """Whole tiles of 16 x 16, decimated, turned by a quarter and raised by 5."""
    tiles = matrices.tiles(matrices.padded(folded(spark, d), 16, 0), 16)
    made = matrices.oriented(tiles.select(F.struct("blob_id", "x0", "y0").alias("blob_id"), "w", "h", "content"), 1, True, 1, 5)
    sums = matrices.row_sums(made)
    return sums.select(F.col("blob_id.blob_id").alias("doc_id"), F.col("blob_id.x0").alias("x0"), F.col("blob_id.y0").alias("y0"), "y", "total", "by_column")


def p9_flat_blocks(spark, d):
    return named(records.flat_blocks(src.fold(documents(spark, d), 64).select("blob_id", "y", "x", "v"), 4))


def p11_tiles(spark, d):
    tiles = matrices.tiles(folded(spark, d), 24)
    return tiles.select(F.col("blob_id").alias("doc_id"), "x0", "y0", "w", "h", F.md5("content").alias("digest")).drop("digest")


def j11_shared_cells(spark, d):
    """Squares of 8 that start at every fourth column of a document's first 64, one for each KiB: neighbours share 4 columns."""
    n = F.expr("cast(octet_length(content) div 1024 as int)")
    ranges = documents(spark, d).select("blob_id", F.explode(F.sequence(F.lit(0), n)).alias("k")).where("k > 0")
    squares = ranges.select(F.col("blob_id").alias("tile_id"), F.expr("(k * 4) % 64").alias("rx"), F.lit(0).alias("ry"), F.lit(8).alias("size"))
    return records.shared_cells(squares).withColumnRenamed("tile_id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        s6_unfold, s7_fold, s8_flatten, s13_segments, a1_byte_histogram, a2_entropy, a3_most_frequent, a13_crc32, q18_default_width,
        r9_chain_roundtrip, p1_view, p2_decimate, p3_isometry, p6_value_map, p8_residual, p12_pad, a6_skip_count, a4_lag_score, q16_detect_widths,
        j1_block_match, j12_exhaustive, q10_probe, q1_quadtree, q6_refine, q13_advisor_report, q17_layout_search, a11_segment_modes, s11_container_roundtrip,
        s12_container_bytes, s13_reassemble, u5_mixing_roundtrip, s21_comparators, f1_integers, w5_delta_columns, w5_undelta_columns, w6_rolling_hash, w7_split_offsets, j8_spot_lag,
        a13_segment_crc, a10_tile_stats, p7_fused, p9_flat_blocks, p11_tiles, j11_shared_cells,
    )
    return {f.__name__: f for f in own} | {name: partial(reshaped, step) for name, step in STEPS.items()}


_BYTES = """WITH hexed AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents),
bytes AS (SELECT doc_id, p AS pos, ('0x' || l[p + 1])::INT AS v FROM hexed, unnest(range(len(l))) AS r(p)) """


def _cells(width: str) -> str:
    return f"""WITH hexed AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents),
sized AS (SELECT doc_id, l, len(l) AS n, ({width})::INT AS w FROM hexed WHERE len(l) > 0),
cells AS (SELECT doc_id, (p // w)::INT AS y, (p % w)::INT AS x, CASE WHEN p < n THEN ('0x' || l[p + 1])::INT ELSE 0 END AS v
  FROM sized, unnest(range(((n + w - 1) // w) * w)) AS r(p)), high AS (SELECT *, max(y) OVER (PARTITION BY doc_id) + 1 AS h FROM cells) """


_WIDTH = "greatest(8, pow(2, floor(log2(greatest(floor(sqrt({0})), 1)))))"
_SUMS = " SELECT doc_id, y::INT AS y, sum(v)::BIGINT AS total, sum(v * (x + 1))::BIGINT AS by_column FROM {0} GROUP BY ALL"


def _lag(part: str, order: str, k: int, op: str) -> str:
    before = f"coalesce(lag(v, {k}) OVER (PARTITION BY doc_id, {part} ORDER BY {order}), 0)"
    v = f"(v - {before} + 256) % 256" if op == "sub" else f"xor(v, {before})"
    return _cells("64") + f", made AS (SELECT doc_id, y, x, {v} AS v FROM cells)" + _SUMS.format("made")


def _chains() -> str:
    """Row sums of every chain of the catalogue: each step is SQL over the one before."""
    parts, ctes = [], [_cells("64").rstrip().removeprefix("WITH ")]
    for k, chain in enumerate(CATALOGUE):
        at = "high"
        for i, step in enumerate(chain):
            own = f"c{k}_{i}"
            if step.kind == "bitplanes":
                made = f"SELECT doc_id, p * h + y AS y, x // 8 AS x, bit_or(((v >> p::INT) & 1) << (x % 8)) AS v FROM {at}, range(8) AS r(p) GROUP BY doc_id, p * h + y, x // 8"
            elif step.kind == "deint":
                made = f"SELECT doc_id, (x % {step.k}) * h + y AS y, x // {step.k} AS x, v FROM {at}"
            else:
                part, order = ("y", "x") if step.kind.startswith("left") else ("x", "y")
                before = f"coalesce(lag(v) OVER (PARTITION BY doc_id, {part} ORDER BY {order}), 0)"
                made = f"SELECT doc_id, y, x, {f'(v - {before} + 256) % 256' if step.kind.endswith('sub') else f'xor(v, {before})'} AS v FROM {at}"
            ctes.append(f"{own} AS (SELECT *, max(y) OVER (PARTITION BY doc_id) + 1 AS h FROM ({made}))")
            at = own
        parts.append(f"SELECT {k} AS chain, 0::BIGINT AS unequal, sum(v)::BIGINT AS total, sum(v * (x + 1))::BIGINT AS by_column FROM {at}")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(parts)


_ISO = ["(x, y)", "(y, 63 - x)", "(63 - x, 63 - y)", "(63 - y, x)", "(63 - x, y)", "(x, 63 - y)", "(y, x)", "(63 - y, 63 - x)"]


def _isometries() -> str:
    grid = "SELECT i % 64 AS x, i // 64 AS y FROM range(4096) AS t(i)"
    value = "((5 * {0}) % 11 + ({1} // 8) * 3)::INT"
    parts = []
    for k, s in enumerate(_ISO):
        sx, sy = s[1:-1].split(", ")
        parts.append(f"SELECT {k} AS iso, y::INT AS y, x::INT AS x, {value.format('(' + sx + ')', '(' + sy + ')')} AS v FROM grid")
    return f"WITH grid AS ({grid}) " + " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    out = {
        "s6_unfold": _BYTES + "SELECT doc_id, count(*) AS n, sum(v)::BIGINT AS total, sum(v * (pos + 1))::BIGINT AS by_place FROM bytes GROUP BY doc_id",
        "s7_fold": _cells(_WIDTH.format("len(l)")) + _SUMS.format("cells"),
        "s8_flatten": "SELECT doc_id, strlen(text)::INT AS n, md5(text) AS digest FROM documents WHERE length(text) > 0",
        "s13_segments": """SELECT doc_id, s::INT AS segment, (least(n, (s + 1) * 1024) - s * 1024)::INT AS n
FROM (SELECT doc_id, coalesce(strlen(text), 0) AS n FROM documents), unnest(range(greatest(n - 1, 0) // 1024 + 1)) AS r(s)""",
        "a1_byte_histogram": _BYTES + "SELECT v, count(*) AS n FROM bytes GROUP BY v",
        "a2_entropy": _BYTES + """, c AS (SELECT doc_id, v, count(*) AS n FROM bytes GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id)
SELECT doc_id, greatest(round(-sum((n / t) * log2(n / t)), 6), 0.0) AS entropy FROM c JOIN t USING (doc_id) GROUP BY doc_id""",
        "a3_most_frequent": _BYTES + """, c AS (SELECT doc_id, v, count(*) AS n FROM bytes GROUP BY ALL)
SELECT doc_id, v FROM (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, v) AS r FROM c) WHERE r = 1""",
        "q18_default_width": f"SELECT doc_id, ({_WIDTH.format('coalesce(strlen(text), 0)')})::INT AS width FROM documents",
        "r1_up_sub": _lag("x", "y", 1, "sub"),
        "r2_up_xor": _lag("x", "y", 1, "xor"),
        "r3_left_sub": _lag("y", "x", 1, "sub"),
        "r4_left_xor": _lag("y", "x", 1, "xor"),
        "r7_frame_sub": _lag("x", "y", 3, "sub"),
        "r8_frame_xor": _lag("x", "y", 3, "xor"),
        "r5_bitplanes": _cells("64") + """, made AS (SELECT doc_id, p * h + y AS y, (x // 8) AS x, bit_or(((v >> p::INT) & 1) << (x % 8)) AS v
  FROM high, range(8) AS r(p) GROUP BY doc_id, p * h + y, x // 8)""" + _SUMS.format("made"),
        "r6_deinterleave": _cells("64") + ", made AS (SELECT doc_id, (x % 4) * h + y AS y, x // 4 AS x, v FROM high)" + _SUMS.format("made"),
        "r9_chain_roundtrip": _chains(),
        "p1_view": _cells("64") + ", made AS (SELECT doc_id, y - 2 AS y, x - 8 AS x, v FROM cells WHERE x BETWEEN 8 AND 23 AND y >= 2)" + _SUMS.format("made"),
        "p2_decimate": _cells("64") + ", made AS (SELECT doc_id, y // 2 AS y, x // 2 AS x, v FROM cells WHERE x % 2 = 0 AND y % 2 = 0)" + _SUMS.format("made"),
        "p3_isometry": _isometries(),
        "p6_value_map": _cells("64") + ", made AS (SELECT doc_id, y, x, xor((v + 77) % 256, 90) AS v FROM cells)" + _SUMS.format("made"),
        "p8_residual": _cells("64") + """, made AS (SELECT doc_id, y, x, xor(v, (v - coalesce(lag(v) OVER (PARTITION BY doc_id, x ORDER BY y), 0) + 256) % 256) AS v FROM cells)"""
        + _SUMS.format("made"),
        "p12_pad": _cells("72") + """, grid AS (SELECT doc_id, yy AS y, xx AS x FROM (SELECT DISTINCT doc_id, h FROM high), unnest(range((h + 15) // 16 * 16)) AS r(yy), range(80) AS s(xx)),
made AS (SELECT g.doc_id, g.y, g.x, coalesce(c.v, 9) AS v FROM grid g LEFT JOIN cells c USING (doc_id, y, x))""" + _SUMS.format("made"),
        "a6_skip_count": _cells("64") + """, nodes AS (SELECT doc_id, ny, nx FROM (SELECT DISTINCT doc_id, h FROM high), unnest(range((h + 15) // 16)) AS r(ny), range(4) AS s(nx)),
got AS (SELECT doc_id, y // 16 AS ny, x // 16 AS nx, count(*) AS n FROM cells WHERE v <> 32 GROUP BY ALL)
SELECT doc_id, ny::INT AS ny, nx::INT AS nx, coalesce(n, 0)::BIGINT AS skip FROM nodes LEFT JOIN got USING (doc_id, ny, nx)""",
        "s11_container_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
        "s12_container_bytes": "SELECT doc_id, coalesce(strlen(text), 0)::INT AS n, md5(coalesce(text, '')) AS digest FROM documents",
        "u5_mixing_roundtrip": "SELECT doc_id, coalesce(strlen(text), 0)::INT AS n, md5(coalesce(text, '')) AS digest FROM documents",
        "s13_reassemble": "SELECT doc_id, coalesce(strlen(text), 0)::INT AS n, md5(coalesce(text, '')) AS digest FROM documents",
        "f1_integers": """WITH s AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n FROM documents), t AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE length(bin(n)) END::INT AS bits FROM s)
SELECT doc_id, n, bits, greatest(1, ceil(bits / 7))::INT AS bytes, ((n + 63) // 64 * 64)::BIGINT AS rounded, CASE WHEN n >= 1000 THEN 2 * (n - 1000) ELSE 2 * (1000 - n) - 1 END::BIGINT AS zig FROM t""",
        "w5_delta_columns": """WITH t AS (SELECT l_orderkey, row_number() OVER w AS ord, l_partkey - coalesce(lag(l_partkey) OVER w, 0) AS p, l_suppkey - coalesce(lag(l_suppkey) OVER w, 0) AS s
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, ord::INT AS ord, CASE WHEN p >= 0 THEN 2 * p ELSE -2 * p - 1 END::BIGINT AS l_partkey, CASE WHEN s >= 0 THEN 2 * s ELSE -2 * s - 1 END::BIGINT AS l_suppkey FROM t""",
        "w5_undelta_columns": "SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::INT AS ord, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey FROM lineitem",
        "w6_rolling_hash": """WITH hexed AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents),
ends AS (SELECT doc_id, l, p AS pos FROM hexed, unnest(range(63, len(l), 64)) AS r(p))
SELECT doc_id, pos, list_reduce(list_prepend(0::BIGINT, list_transform(l[pos - 62:pos + 1], lambda x: ('0x' || x)::BIGINT)), lambda h, v: (h * 263 + v + 1) % 2147483647) AS hash FROM ends""",
        "w7_split_offsets": """WITH c AS (SELECT source AS shard, count(*) AS n FROM documents GROUP BY source)
SELECT shard, n, (sum(n) OVER (ORDER BY shard NULLS FIRST) - n)::BIGINT AS first FROM c""",
        "j8_spot_lag": _BYTES + """, t AS (SELECT doc_id, pos, v, lag(v, 16) OVER (PARTITION BY doc_id ORDER BY pos) AS b, greatest(1, (count(*) OVER (PARTITION BY doc_id) - 16) // 65536) AS step FROM bytes),
c AS (SELECT doc_id, count(*) FILTER (v = b) AS same, count(*) AS total FROM t WHERE pos >= 16 AND (pos - 16) % step = 0 GROUP BY doc_id)
SELECT d.doc_id, coalesce(same, 0)::BIGINT AS same, coalesce(total, 0)::BIGINT AS total, coalesce(same, 0) * 20 > coalesce(total, 0) AS repeats FROM documents d LEFT JOIN c USING (doc_id)""",
        "a13_segment_crc": "SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n, true AS same FROM documents",
        "p7_fused": _cells("64") + """, pad AS (SELECT doc_id, yy AS y, xx AS x FROM (SELECT DISTINCT doc_id, h FROM high), unnest(range((h + 15) // 16 * 16)) AS r(yy), range(64) AS s(xx)),
kept AS (SELECT p.doc_id, p.x // 16 * 16 AS x0, p.y // 16 * 16 AS y0, (p.x % 16) // 2 AS sx, (p.y % 16) // 2 AS sy, (coalesce(v, 0) + 5) % 256 AS v
  FROM pad p LEFT JOIN cells c USING (doc_id, y, x) WHERE p.x % 2 = 0 AND p.y % 2 = 0)
SELECT doc_id, x0::INT AS x0, y0::INT AS y0, sx::INT AS y, sum(v)::BIGINT AS total, sum(v * (8 - sy))::BIGINT AS by_column FROM kept GROUP BY ALL""",
        "p9_flat_blocks": _cells("64") + "SELECT doc_id, (y // 4)::INT AS ny, (x // 4)::INT AS nx, min(v) = max(v) AS flat FROM cells GROUP BY ALL",
        "p11_tiles": _cells("64") + """SELECT doc_id, xx::INT AS x0, yy::INT AS y0, least(24, 64 - xx)::INT AS w, least(24, h - yy)::INT AS h
FROM (SELECT DISTINCT doc_id, h FROM high), unnest(range(0, h, 24)) AS r(yy), range(0, 64, 24) AS s(xx)""",
        "j11_shared_cells": """WITH k AS (SELECT doc_id, i FROM (SELECT doc_id, coalesce(strlen(text), 0) // 1024 AS n FROM documents), unnest(range(1, n + 1)) AS r(i)),
c AS (SELECT doc_id, (i * 4) % 64 + xx AS x, yy AS y FROM k, range(8) AS a(xx), range(8) AS b(yy))
SELECT doc_id, y::INT AS y, x::INT AS x, count(*) AS n FROM c GROUP BY ALL HAVING count(*) > 1""",
    }
    return out
