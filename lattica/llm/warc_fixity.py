"""Merkle fixity audit of WARC replicas.

A replica's records, in the order of their ids, are the leaves of a tree; a node covers ``fanout`` ordered
children, their bytes, and so an offset range of the archive, and holds the hash of its children's
hashes.  Two replicas are compared from the root down, and only the children of nodes that
differ are looked at.  Offsets are summed on the way down, from the byte counts of the
siblings before a node, so no task has to run over a whole archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import owned, stored


#: Nodes that differ (24 bytes each) up to which they are broadcast to the level below.
BROADCAST_ROWS = 1_000_000


def record(url: Column, payload: Column) -> Column:
    """A page as a WARC response record; null parts are empty."""
    body = F.coalesce(payload.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """``node, bytes, n, digest``, one row for each id, of records ``id, record``.

    Records that share an id are one leaf: with one of them its hash is the record's SHA-256, with
    more it is the hash of their number and of sums over theirs, which do not depend
    on an order and are combined before the shuffle.
    """
    digest = F.sha2(F.col("record"), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)"))
    return (
        records.select(F.col("id").alias("node"), F.octet_length("record").cast("long").alias("size"), digest.alias("h"))
        .groupBy("node")
        .agg(
            F.sum("size").alias("bytes"),
            F.count(F.lit(1)).alias("n"),
            *(part(k).alias(f"s{k}") for k in range(4)),
            F.min("h").alias("one"),
        )
        .select(
            "node",
            "bytes",
            "n",
            F.when(F.col("n") == 1, F.col("one"))
            .otherwise(F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.col(f"s{k}").cast("string") for k in range(4))), 256))
            .alias("digest"),
        )
    )


def _parent(fanout: int) -> Column:
    """Whole division that rounds down, exact for every id."""
    return F.expr(f"(node - pmod(node, {fanout})) div {fanout}")


def above(level: DataFrame, fanout: int) -> DataFrame:
    """The next level: each node gathers at most ``fanout`` children, in order."""
    child = F.struct("node", "digest", "bytes")
    text = F.transform(
        F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"], c["bytes"].cast("string"))
    )
    return level.groupBy(_parent(fanout).alias("node")).agg(
        F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.sha2(F.concat_ws(",", text), 256).alias("digest")
    )


def tree(records: DataFrame, fanout: int = 16) -> list[DataFrame]:
    """The levels of a replica's tree, leaves first, each stored; the last has one node, or two if ids have both signs."""
    levels = [stored(leaves(records), "leaves")]
    while levels[-1].where("node not in (0, -1)").limit(1).count():
        levels.append(stored(above(levels[-1], fanout), "level"))
    return levels


@owned
def audit(replica_a: DataFrame, replica_b: DataFrame, fanout: int = 16) -> DataFrame:
    """Ids whose records differ: ``id, status, offset_a, length_a, digest_a, offset_b, length_b, digest_b``.

    Both replicas have ``id`` (a whole number) and ``record``; records without an id are left out: they have
    no place to be compared at.  ``status`` is altered, missing (in b) or extra (in b).  An
    offset is where the record starts when the replica is written in the order of its ids; it
    is null, as is the digest, on the side that lacks the record.  Equal or empty replicas give no row.
    """
    sides = []
    for replica in (replica_a, replica_b):
        own = replica.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("record").cast("string"), F.lit("")).alias("record"))
        sides.append(tree(own.where("id is not null"), fanout))
    height = max(map(len, sides))
    for levels in sides:
        while len(levels) < height:
            levels.append(stored(above(levels[-1], fanout), "level"))

    def both(k: int, parents: DataFrame | None = None) -> DataFrame:
        """Level ``k`` of the two replicas side by side; only children of ``parents`` are joined."""
        ends = []
        for s, x in zip(sides, "ab", strict=True):
            level = s[k].select("node", _parent(fanout).alias("up"), *(F.col(c).alias(f"{c}_{x}") for c in ("bytes", "digest")))
            ends.append(level if parents is None else level.join(parents.select("up"), "up", "left_semi"))
        return ends[0].drop("up").join(ends[1].drop("up"), "node", "full")

    differs = ~F.col("digest_a").eqNullSafe(F.col("digest_b"))
    start = lambda x: F.coalesce(F.sum(f"bytes_{x}").over(W.partitionBy("up").orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = both(height - 1).withColumn("up", F.lit(0)).select("*", start("a").alias("offset_a"), start("b").alias("offset_b"))
    bad = stored(top.where(differs), "differ")
    for k in range(height - 2, -1, -1):
        differing = bad.limit(BROADCAST_ROWS + 1).count()
        if not differing:
            return _told(bad)
        parents = bad.select(F.col("node").alias("up"), F.col("offset_a").alias("base_a"), F.col("offset_b").alias("base_b"))
        parents = F.broadcast(parents) if differing <= BROADCAST_ROWS else parents
        below = both(k, parents).withColumn("up", _parent(fanout)).join(parents, "up")
        placed = below.select(
            "*", (F.col("base_a") + start("a")).alias("offset_a"), (F.col("base_b") + start("b")).alias("offset_b")
        ).drop("base_a", "base_b")
        bad = stored(placed.where(differs), "differ")
    return _told(bad)


def _told(bad: DataFrame) -> DataFrame:
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("altered")
    return bad.select(
        F.col("node").alias("id"),
        status.alias("status"),
        *(
            c
            for x in "ab"
            for c in (
                F.when(F.col(f"digest_{x}").isNotNull(), F.col(f"offset_{x}")).alias(f"offset_{x}"),
                F.col(f"bytes_{x}").alias(f"length_{x}"),
                F.col(f"digest_{x}"),
            )
        ),
    )
