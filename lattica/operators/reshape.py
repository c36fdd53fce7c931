"""Reversible reshaping of cells: differences, bit planes, deinterleaving, chains of them.

Every step has an inverse: ``inverse(forward(cells)) == cells``.  A step is ``(kind, k)``; all of
them are window functions, projections and groupings of ``cells``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds by their number in a stream.
KINDS = {"up-sub": 1, "up-xor": 2, "left-sub": 3, "left-xor": 4, "bitplanes": 5, "deint": 6, "frame-sub": 7, "frame-xor": 8}
MOST_STEPS = 8


@dataclass(frozen=True)
class Step:
    kind: str
    k: int = 0

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no such step: {self.kind}")
        low, high = {"deint": (2, 16), "frame-sub": (1, 65535), "frame-xor": (1, 65535)}.get(self.kind, (0, 0))
        if not low <= self.k <= high:
            raise ValueError(f"{self.kind} takes a number from {low} to {high}, not {self.k}")

    def shape(self, w: int, h: int) -> tuple[int, int]:
        """Width and height of what it makes of ``w`` x ``h``."""
        n = {"bitplanes": 8, "deint": self.k}.get(self.kind, 1)
        if w % n:
            raise ValueError(f"{self.kind} needs a width that {n} divides, not {w}")
        return w // n, h * n


#: The chains that are always tried, in the order that breaks ties.
CATALOGUE = (
    (),
    (Step("up-sub"),),
    (Step("up-xor"),),
    (Step("left-sub"),),
    (Step("left-xor"),),
    (Step("left-sub"), Step("up-sub")),
    (Step("bitplanes"),),
    (Step("bitplanes"), Step("up-xor")),
    (Step("deint", 2),),
    (Step("deint", 2), Step("left-sub")),
    (Step("deint", 4),),
    (Step("deint", 2), Step("up-sub")),
)


def frame_chains(rows: int) -> tuple[tuple[Step, ...], ...]:
    """Chains that are tried besides when a frame has that many rows."""
    if rows <= 0:
        return ()
    return ((Step("frame-sub", rows),), (Step("frame-xor", rows),), (Step("frame-sub", rows), Step("left-sub")))


def _axis(step: Step):
    """Partition, order and distance of a difference."""
    if step.kind.startswith("left"):
        return ["blob_id", "y"], "x", 1
    return ["blob_id", "x"], "y", step.k or 1


def forward(cells: DataFrame, step: Step) -> DataFrame:
    """``blob_id, y, x, v`` after one step.  Height and width are taken from the cells of each blob."""
    cells = cells.select("blob_id", "y", "x", "v")
    n = {"bitplanes": 8, "deint": step.k}.get(step.kind, 1)
    if n > 1:
        whole = W.partitionBy("blob_id")
        wide = F.max("x").over(whole) + 1
        fits = F.when(wide % n == 0, F.max("y").over(whole) + 1).otherwise(F.raise_error(F.lit(f"{step.kind} needs a width that {n} divides")).cast("int"))
    if step.kind == "bitplanes":
        high = cells.withColumn("h", fits)
        planes = high.select("blob_id", "y", "x", "h", "v", F.explode(F.array(*map(F.lit, range(8)))).alias("p"))
        bit = F.expr("shiftleft(shiftright(v, p) & 1, x % 8)")
        return planes.groupBy("blob_id", (F.col("p") * F.col("h") + F.col("y")).alias("y"), F.expr("cast(x div 8 as int)").alias("x")).agg(F.bit_or(bit).alias("v"))
    if step.kind == "deint":
        high = cells.withColumn("h", fits)
        return high.select("blob_id", F.expr(f"(x % {step.k}) * h + y").alias("y"), F.expr(f"cast(x div {step.k} as int)").alias("x"), "v")
    part, order, k = _axis(step)
    before = F.coalesce(F.lag("v", k).over(W.partitionBy(*part).orderBy(order)), F.lit(0))
    v = F.pmod(F.col("v") - before, F.lit(256)) if step.kind.endswith("sub") else F.col("v").bitwiseXOR(before)
    return cells.select("blob_id", "y", "x", v.cast("int").alias("v"))


def inverse(cells: DataFrame, step: Step) -> DataFrame:
    """What ``forward`` was given."""
    cells = cells.select("blob_id", "y", "x", "v")
    n = {"bitplanes": 8, "deint": step.k}.get(step.kind)
    if n:
        high = cells.withColumn("h", F.expr("cast((max(y) over (partition by blob_id) + 1) as int)")).withColumn("h", F.expr(f"cast(h div {n} as int)"))
        if step.kind == "deint":
            return high.select("blob_id", F.expr("y % h").alias("y"), F.expr(f"cast(x * {n} + y div h as int)").alias("x"), "v")
        bits = high.select("blob_id", "y", "x", "h", "v", F.explode(F.array(*map(F.lit, range(8)))).alias("j"))
        return bits.groupBy("blob_id", F.expr("y % h").alias("y"), F.expr("x * 8 + j").alias("x")).agg(
            F.bit_or(F.expr("shiftleft(shiftright(v, j) & 1, cast(y div h as int))")).alias("v")
        )
    part, order, k = _axis(step)
    if step.kind.startswith("frame"):
        part = [*part, F.col("y") % k]
    w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    v = F.pmod(F.sum("v").over(w), F.lit(256)) if step.kind.endswith("sub") else F.bit_xor("v").over(w)
    return cells.select("blob_id", "y", "x", v.cast("int").alias("v"))


def chain_forward(cells: DataFrame, chain: tuple[Step, ...]) -> DataFrame:
    if len(chain) > MOST_STEPS:
        raise ValueError(f"a chain has at most {MOST_STEPS} steps")
    for step in chain:
        cells = forward(cells, step)
    return cells.select("blob_id", "y", "x", "v")


def chain_inverse(cells: DataFrame, chain: tuple[Step, ...]) -> DataFrame:
    for step in reversed(chain):
        cells = inverse(cells, step)
    return cells.select("blob_id", "y", "x", "v")
