"""Views, decimation, the eight symmetries of a square, value maps, residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a cell (x, y) of the result comes from, for a side of ``last + 1``.
ISOMETRIES = (
    ("x", "y"),
    ("y", "last - x"),
    ("last - x", "last - y"),
    ("last - y", "x"),
    ("last - x", "y"),
    ("x", "last - y"),
    ("y", "x"),
    ("last - y", "last - x"),
)
#: The quarter turns undo each other; the others undo themselves.
INVERSE = (0, 3, 2, 1, 4, 5, 6, 7)


def view(cells: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return cells.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def decimate(cells: DataFrame) -> DataFrame:
    """The upper left one of each two by two cells."""
    return cells.where("x % 2 = 0 and y % 2 = 0").withColumns({"x": F.expr("cast(x div 2 as int)"), "y": F.expr("cast(y div 2 as int)")})


def isometry(cells: DataFrame, iso: int, side: int) -> DataFrame:
    """A square turned or mirrored: each cell moves to where the inverse symmetry takes it from."""
    fx, fy = (F.expr(e.replace("last", str(side - 1))) for e in ISOMETRIES[INVERSE[iso]])
    return cells.withColumns({"x": fx.cast("int"), "y": fy.cast("int")})


def value_map(v: Column, kind: int, c: int) -> Column:
    """0: as it is (``c`` is 0); 1: plus ``c`` modulo 256; 2: exclusive or with ``c``."""
    if kind == 0:
        if c:
            raise ValueError("the identity takes no constant")
        return v
    return F.pmod(v + c, F.lit(256)).cast("int") if kind == 1 else v.bitwiseXOR(F.lit(c))


def residual(original: DataFrame, approximation: DataFrame) -> DataFrame:
    """Exclusive or, cell by cell; applied again it restores the original."""
    a = approximation.select("blob_id", "y", "x", F.col("v").alias("va"))
    return original.join(a, ["blob_id", "y", "x"]).select("blob_id", "y", "x", F.col("v").bitwiseXOR(F.col("va")).alias("v"))


def unequal_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that differ or that one side lacks; none if the matrices are equal."""
    b = b.select("blob_id", "y", "x", F.col("v").alias("vb"))
    return a.select("blob_id", "y", "x", F.col("v").alias("va")).join(b, ["blob_id", "y", "x"], "full").where(~F.col("va").eqNullSafe(F.col("vb")))


def padded(cells: DataFrame, block: int, fill: Column | int = 0) -> DataFrame:
    """Grown to multiples of ``block`` with a value; ``real`` tells the cells that were there."""
    size = cells.groupBy("blob_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    up = lambda c: F.expr(f"cast(({c} + {block} - 1) div {block} * {block} - 1 as int)")
    grid = size.select("blob_id", F.explode(F.sequence(F.lit(0), up("h"))).alias("y"), "w").select(
        "blob_id", "y", F.explode(F.sequence(F.lit(0), up("w"))).alias("x")
    )
    fill = F.lit(fill) if isinstance(fill, int) else fill
    return grid.join(cells.select("blob_id", "y", "x", "v"), ["blob_id", "y", "x"], "left").select(
        "blob_id", "y", "x", F.coalesce("v", fill).cast("int").alias("v"), F.col("v").isNotNull().alias("real")
    )
