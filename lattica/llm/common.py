"""What the operators share: durable tables and who owns them, bounded batches, components."""

from __future__ import annotations

import functools
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders stored within each open scope, the innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master, where all is one
    machine, may leave it unset: a folder is made then and remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
        os.makedirs(root, exist_ok=True)
        path = tempfile.mkdtemp(prefix="lattica-", dir=root)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of one action."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation of what came
    before), fixes nondeterministic columns and forgets the partitioning, so that
    a join on the result shuffles both sides and adaptive execution may split
    a hot key.  What was shuffled for it is deleted once it is written.  The table belongs to
    the scope that is open (``owned``); outside of one it stays.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{tag}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    with _set(spark, _CLEAN, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stored while it is open are deleted at its end, but for those taken out of the list."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        discard(spark, _SCOPES.pop())


def owned(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f`` with its result stored, and every table that it stored on the way deleted.

    The result belongs to the scope around, if there is one.
    """

    @functools.wraps(f)
    def run(first: DataFrame, *args, **kw) -> DataFrame:
        spark = first.sparkSession
        with scope(spark) as own:
            out = stored(f(first, *args, **kw), f.__name__)
            kept = own.pop()
        if _SCOPES:
            _SCOPES[-1].append(kept)
        return out

    return run


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Lower the rows of an Arrow batch, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def tile_count(spark: SparkSession, n: int, least: int, largest: int) -> int:
    """Tiles to cut ``n`` rows into when all pairs of tiles are compared.

    A tile travels once for each partner, so what is shuffled grows with rows times tiles: no more tiles than make eight
    tasks for each slot, unless they would be larger than ``largest``, nor so many that they are smaller than ``least``.
    """
    enough = math.ceil(math.sqrt(16 * spark.sparkContext.defaultParallelism))
    return max(1, -(-n // largest), min(-(-n // least), enough))


def signature(df: DataFrame, *cols: str) -> tuple[int, int]:
    """Row count and an order-free hash of the rows."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(cols)}))").alias("h")
    ).first()
    return row["n"], row["h"] or 0


@owned
def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node of an undirected graph.

    The component is the smallest node that can be reached.  Large-star and
    small-star rounds alternate until the edges stay as they are; each round is
    written to the shared folder, and the round before it deleted.  The minimum per node is combined before its
    shuffle, and the join back to the edges is between two stored tables, so
    that adaptive execution may split the edges of a hub.  No part of the graph is
    gathered on the driver.  Null ends and loops are left out; no edge gives no row.
    """
    spark = edges.sparkSession
    u, v = F.col("u"), F.col("v")
    graph = stored(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (u != v))
        .distinct(),
        "edges",
    )
    before = signature(graph, "u", "v")
    while before[0]:
        with scope(spark) as own:
            both = graph.union(graph.select(v.alias("u"), u.alias("v")))
            least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
            large = stored(
                both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct(), "large"
            )
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = (
                large.join(low, "u")
                .select(v.alias("u"), F.col("m").alias("v"))
                .where(u != v)
                .union(low.select("u", F.col("m").alias("v")))
                .distinct()
            )
            graph = stored(small, "edges")
            latest = own.pop()
        discard(spark, [_SCOPES[-1].pop()])
        _SCOPES[-1].append(latest)
        after = signature(graph, "u", "v")
        if after == before:
            break
        before = after
    stars = graph.select(u.alias("node"), v.alias("component"))
    return stars.union(graph.select(v.alias("node"), v.alias("component")).distinct())


def split_lines(text: Column) -> Column:
    """Array of a text's lines; a null text has none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))
