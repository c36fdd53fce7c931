"""The cheapest block-copy description of a tile, and rebuilding the tile from it.

A node costs nothing if it equals the start value; otherwise the least of a recipe (a copy), an anchor (its
bytes, if it is dense) or what is left to the residual, and of its four quarters together.
Costs go up the levels by grouping, choices come down by joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import match as m

#: Cost of an anchor besides its bytes.
ANCHOR = 5


@dataclass(frozen=True)
class Options:
    block: int = 16
    min_block: int = 4
    iterations: int = 12
    stride: int = 8
    recipe_cost: int = 4
    max_refine: int = 32
    anchor_percent: int = 25
    no_same_scale: bool = False
    no_decimated: bool = False
    copy_min_size: int = 4
    candidates: int | None = m.CANDIDATES

    def sizes(self) -> list[int]:
        out, s = [], self.block
        while s >= self.min_block:
            out.append(s)
            s //= 2
        return out


def levels(tiles: DataFrame, o: Options) -> DataFrame:
    """``tile_id, size, rx, ry, skip, real, kind, dx, dy, iso, code, c, block``: every node, and its recipe if it has one.

    ``tiles``: ``tile_id, w, content, start, real_w, real_h``, filled up with ``start`` to multiples of the block.
    """
    kinds = tuple(k for k, off in ((0, o.no_decimated), (1, o.no_same_scale)) if not off)
    out = []
    for s in o.sizes():
        nodes, domains = m.blocks(tiles, s, max(1, o.stride * s // o.block), kinds)
        got = m.match(nodes, domains, s, o.candidates)
        seen = tiles.select("tile_id", "real_w", "real_h")
        clip = lambda real, at, s=s: F.greatest(F.lit(0), F.least(F.lit(s), F.col(real) - F.col(at)))
        one = nodes.join(got, ["tile_id", "rx", "ry"], "left").join(seen, "tile_id")
        out.append(
            one.select("tile_id", F.lit(s).alias("size"), "rx", "ry", "skip", (clip("real_w", "rx") * clip("real_h", "ry")).alias("real"), "kind", "dx", "dy", "iso", "code", "c", "block")
        )
    return reduce(DataFrame.union, out)


def costs(nodes: DataFrame, o: Options) -> list[DataFrame]:
    """By level from the smallest: ``nodes`` with ``choice`` (skip, recipe, anchor, rest, split) and ``cost``."""
    dense = F.col("skip") * 100 > F.lit(o.anchor_percent) * F.col("real")
    usable = F.col("kind").isNotNull() & ((F.col("kind") == 0) | ((F.col("size") >= o.copy_min_size) & dense))
    big = F.lit(1 << 30)
    recipe = F.when(usable, F.lit(o.recipe_cost)).otherwise(big)
    other = F.when(dense, F.col("real") + ANCHOR).otherwise(F.col("skip"))
    out, below = [], None
    for s in sorted(o.sizes()):
        own = nodes.where(F.col("size") == s).select("*", recipe.alias("recipe"), other.alias("other"), dense.alias("dense"))
        if below is None:
            own = own.withColumn("quarters", big)
        else:
            up = below.groupBy("tile_id", F.expr(f"cast(rx div {s} * {s} as int)").alias("rx"), F.expr(f"cast(ry div {s} * {s} as int)").alias("ry")).agg(F.sum("cost").cast("int").alias("quarters"))
            own = own.join(up, ["tile_id", "rx", "ry"])
        leaf = F.least("recipe", "other")
        choice = (
            F.when(F.col("skip") == 0, "skip")
            .when(F.col("quarters") < leaf, "split")
            .when(F.col("recipe") <= F.col("other"), "recipe")
            .when(F.col("dense"), "anchor")
            .otherwise("rest")
        )
        below = own.select("*", choice.alias("choice")).withColumn("cost", F.when(F.col("choice") == "skip", 0).otherwise(F.least(leaf, "quarters")))
        out.append(below)
    return out


def plan(tiles: DataFrame, o: Options | None = None) -> DataFrame:
    """The recipes and anchors chosen: ``tile_id, rx, ry, size, raw, kind, dx, dy, iso, code, c, block, skip``."""
    o = o or Options()
    by_level = costs(levels(tiles, o), o)
    cols = ["tile_id", "rx", "ry", "size", F.col("choice").isin("anchor").alias("raw"), "kind", "dx", "dy", "iso", "code", "c", "block", "skip"]
    out, open_ = [], None
    for level in reversed(by_level):
        if open_ is not None:
            up = open_.select("tile_id", F.col("rx").alias("px"), F.col("ry").alias("py"))
            level = level.withColumns({"px": F.expr("cast(rx div (2 * size) * 2 * size as int)"), "py": F.expr("cast(ry div (2 * size) * 2 * size as int)")})
            level = level.join(up, ["tile_id", "px", "py"], "left_semi").drop("px", "py")
        out.append(level.where("choice in ('recipe', 'anchor')").select(*cols))
        open_ = level.where("choice = 'split'")
    return reduce(DataFrame.union, out)


def rebuild(tiles: DataFrame, recipes: DataFrame, iterations: int = 12) -> DataFrame:
    """``tile_id, w, content``: each round reads the grid before it; what no recipe covers keeps the start value.

    A tile's recipes are at most one for each of its blocks, so a task holds one tile and its recipes.
    """
    import numpy as np
    import pyarrow as pa

    fields = ["rx", "ry", "size", "raw", "kind", "dx", "dy", "iso", "code", "c", "block"]
    packed = recipes.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("recipes"))
    kind_of = tiles.schema["tile_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            made = []
            for r in b.to_pylist():
                h = len(r["content"]) // r["w"]
                grid = np.full((h, r["w"]), r["start"], np.uint8)
                for _ in range(iterations):
                    new = np.full_like(grid, r["start"])
                    for t in r["recipes"] or []:
                        s, place = t["size"], (slice(t["ry"], t["ry"] + t["size"]), slice(t["rx"], t["rx"] + t["size"]))
                        if t["raw"]:
                            new[place] = np.frombuffer(t["block"], np.uint8).reshape(s, s)
                            continue
                        scale = 2 - t["kind"]
                        d = grid[t["dy"] : t["dy"] + s * scale : scale, t["dx"] : t["dx"] + s * scale : scale]
                        d = m._orient(d[None])[t["iso"]][0]
                        new[place] = d + np.uint8(t["c"]) if t["code"] == 1 else d ^ np.uint8(t["c"]) if t["code"] == 2 else d
                    if np.array_equal(new, grid):
                        break
                    grid = new
                made.append(grid.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["tile_id", "w", "content"])

    joined = tiles.join(packed, "tile_id", "left").select("tile_id", "w", "content", "start", "recipes")
    return joined.mapInArrow(run, f"tile_id {kind_of}, w int, content binary")


def unequal(recipes: DataFrame, tiles: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``recipes`` with ``mis``: cells of each copy that the rebuilt tile has wrong."""
    import numpy as np
    import pyarrow as pa

    both = recipes.join(tiles.select("tile_id", F.col("w").alias("tw"), F.col("content").alias("want")), "tile_id").join(
        rebuilt.select("tile_id", F.col("content").alias("got")), "tile_id"
    )
    names = recipes.columns
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in recipes.schema)

    def run(batches):
        for b in batches:
            mis = []
            for r in b.select(["rx", "ry", "size", "tw", "want", "got"]).to_pylist():
                a, c = (np.frombuffer(r[k], np.uint8).reshape(-1, r["tw"]) for k in ("want", "got"))
                place = (slice(r["ry"], r["ry"] + r["size"]), slice(r["rx"], r["rx"] + r["size"]))
                mis.append(int((a[place] != c[place]).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(mis, pa.int32())], [*names, "mis"])

    return both.mapInArrow(run, f"{spec}, mis int")


def refine(tiles: DataFrame, o: Options | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Recipes that pay, what they rebuild, and the rounds taken.

    A copy fails if its wrong cells and its cost come to what leaving it out would cost.  Of the failing ones,
    those go that read from no failing block, or the worst of a tile if all do; a dense block
    becomes an anchor instead.
    """
    o = o or Options()
    cols = ["tile_id", "rx", "ry", "size", "raw", "kind", "dx", "dy", "iso", "code", "c", "block", "skip"]
    now = _durable(plan(tiles, o))
    for rounds in range(o.max_refine + 1):
        rebuilt = _durable(rebuild(tiles, now, o.iterations))
        if rounds == o.max_refine:
            break
        bad = _durable(unequal(now.where("not raw"), tiles, rebuilt).where(f"mis + {o.recipe_cost} >= skip"))
        if not bad.limit(1).count():
            break
        a = bad.select("tile_id", "rx", "ry", "size", "dx", "dy", "mis").alias("a")
        b = bad.select(F.col("tile_id").alias("bt"), F.col("rx").alias("bx"), F.col("ry").alias("by"), F.col("size").alias("bs")).alias("b")
        meets = (F.col("dx") < F.col("bx") + F.col("bs")) & (F.col("bx") < F.col("dx") + 2 * F.col("size")) & (F.col("dy") < F.col("by") + F.col("bs")) & (F.col("by") < F.col("dy") + 2 * F.col("size"))
        clean = _durable(a.join(b, (F.col("tile_id") == F.col("bt")) & meets, "left_anti").select("tile_id", "rx", "ry"))
        worst = a.join(clean.select("tile_id").distinct(), "tile_id", "left_anti").groupBy("tile_id").agg(F.max(F.struct("mis", (-F.col("ry")).alias("y"), (-F.col("rx")).alias("x"))).alias("m"))
        gone = clean.union(worst.select("tile_id", (-F.col("m.x")).alias("rx"), (-F.col("m.y")).alias("ry"))).withColumn("gone", F.lit(True))
        marked = now.join(gone, ["tile_id", "rx", "ry"], "left")
        dense = F.col("skip") * 100 > F.lit(o.anchor_percent) * F.col("size") * F.col("size")
        kept = marked.where(F.col("gone").isNull() | F.col("raw") | dense)
        now = _durable(kept.withColumn("raw", F.col("raw") | F.col("gone").isNotNull()).select(*cols))
    return now, rebuilt, rounds


def _durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that the cluster names; a local one where it names none."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        import os
        import tempfile

        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            os.makedirs("/tmp/checkpoints", exist_ok=True)
            folder = tempfile.mkdtemp(prefix="lattica-", dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
