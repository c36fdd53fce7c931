"""Benchmark decontamination with spaced-seed hashes.

A mask over nine tokens ignores three of them.  Items and documents are hashed at every token, under as many masks as it
takes for each way of substituting tokens that the comparison accepts to leave a hash in common: one of nine tokens, two of ten to
``MIN_TOKENS``.  An item under nine tokens has a mask over all of it for each of its tokens.  A hit
gives a document, an item and a shift between them; around it the tokens are compared one by one, with
substitutions allowed.  Everything runs as DataFrame functions.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import owned, stored

SPAN = 9
#: Tokens that a mask ignores.
IGNORED = 3
#: Items under this are no evidence.
LEAST = 5
MIN_TOKENS = 13
SIMILARITY = 0.8
#: Rows of the benchmark's index up to which it is broadcast (about 40 bytes each).
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


@cache
def masks(span: int, sizes: frozenset[int]) -> tuple[tuple[int, ...], ...]:
    """Tokens that each mask over ``span`` ignores, so that every accepted substitution in that many tokens leaves one."""
    if span < SPAN:
        return tuple((i,) for i in range(span))
    left = {(n, c) for n in sizes for c in combinations(range(n), n - ceil(n * SIMILARITY - 1e-9))}
    covers = {
        m: {(n, c) for n, c in left if any(all(not o <= x < o + span or x - o in m for x in c) for o in range(n - span + 1))}
        for m in combinations(range(span), IGNORED)
    }
    out = []
    while left:
        best = max(covers, key=lambda m: len(covers[m] & left))
        out.append(best)
        left -= covers[best]
    return tuple(out)


def window_hashes(words: Column, span: int, skips: tuple[tuple[int, ...], ...]) -> Column:
    """Array with a hash for each window and mask: window at ``i // len(skips)``, mask ``i % len(skips)``.

    The words are bound to a variable, so they are made once for a row.
    """

    def at(ws: Column) -> Column:
        def one(i: Column) -> Column:
            return F.array(
                *(F.xxhash64(F.lit(m), *(F.get(ws, i + o) for o in range(span) if o not in skip)) for m, skip in enumerate(skips))
            )

        return F.when(F.size(ws) >= span, F.flatten(F.transform(F.sequence(F.lit(0), F.size(ws) - span), one)))

    return F.get(F.transform(F.array(words), at), F.lit(0))


@owned
def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, doc_start, item_start, tokens, equal``: items that a document holds, each once.

    A document holds an item if at one shift ``MIN_TOKENS`` tokens in a row (all of a shorter item's)
    agree in at least ``SIMILARITY`` of their places.  The row tells of the shift with the most equal
    tokens (then the earliest): the first places compared, how many, how many are equal.  Items
    under ``LEAST`` tokens, null or empty ones among them, are no evidence and are held by nothing; null
    and empty documents hold nothing.  Rows without doc_id are left out; rows that repeat a doc_id
    are one document, which holds what any of them holds; the same holds for item_id.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("body")).where("doc_id is not null and body is not null")
    items = stored(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col(item_text)).alias("item")).where(
            F.col("item_id").isNotNull() & (F.size("item") >= LEAST)
        ),
        "items",
    )
    sizes = [r.n for r in items.select(F.least(F.size("item"), F.lit(MIN_TOKENS)).alias("n")).distinct().collect()]
    hits = None
    for span in sorted({min(n, SPAN) for n in sizes}) or [SPAN]:
        skips = masks(span, frozenset(n for n in sizes if n >= SPAN) if span == SPAN else frozenset({span})) or ((),)
        fit = items.where(F.size("item") >= SPAN if span == SPAN else F.size("item") == span)
        index = stored(
            fit.select("item_id", F.size("item").alias("size"), F.posexplode(window_hashes(F.col("item"), span, skips)).alias("i", "hash")).select(
                "item_id", "size", F.expr(f"i div {len(skips)}").cast("int").alias("item_at"), "hash"
            ),
            "index",
        )
        windows = own.select("doc_id", F.posexplode(window_hashes(tokens(F.col("body")), span, skips)).alias("i", "hash"))
        small = index.count() <= BROADCAST_ROWS
        found = windows.join(F.broadcast(index) if small else index, "hash")
        shift = F.expr(f"i div {len(skips)} - item_at").cast("int")
        found = found.select("doc_id", F.struct("item_id", "size", shift.alias("shift")).alias("c"))
        hits = found if hits is None else hits.union(found)
    small = items.count() <= BROADCAST_ROWS // 50
    shifts = hits.distinct()
    wanted = stored(shifts.groupBy("doc_id").agg(F.collect_list("c").alias("cs")), "shifts")

    def cut(ws: Column) -> Column:
        # Only the tokens across from the item go on.
        def one(c: Column) -> Column:
            first = F.greatest(c["shift"], F.lit(0))
            last = F.least(c["shift"] + c["size"], F.size(ws))
            return F.struct(c["item_id"].alias("item_id"), first.alias("doc_start"), (first - c["shift"]).alias("item_start"), F.slice(ws, first + 1, last - first).alias("part"))

        return F.transform("cs", one)

    parts = own.join(wanted, "doc_id").select(
        "doc_id", F.explode(F.get(F.transform(F.array(tokens(F.col("body"))), cut), F.lit(0))).alias("p")
    ).select("doc_id", "p.*")
    least = F.least(F.lit(MIN_TOKENS), F.size("item"))
    same = F.zip_with(
        "part", F.slice("item", F.col("item_start") + 1, F.greatest(F.size("part"), F.lit(0))), lambda a, b: (a == b).cast("int")
    )
    compared = parts.join(F.broadcast(items) if small else items, "item_id").select(
        "doc_id", "item_id", "doc_start", "item_start", same.alias("same"), least.alias("least")
    )
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def enough(ss: Column) -> Column:
        return F.exists(
            F.sequence(F.lit(1), F.size(ss) - F.col("least") + 1),
            lambda i: total(F.slice(ss, i, F.col("least"))) >= F.ceil(F.col("least") * SIMILARITY - 1e-9),
        )

    held = compared.where(
        (F.size("same") >= F.col("least")) & F.get(F.transform(F.array("same"), lambda ss: F.when(F.size(ss) >= F.col("least"), enough(ss))), F.lit(0))
    )
    best = F.max(F.struct(total(F.col("same")).alias("equal"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"), F.size("same").alias("tokens")))
    return held.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"), F.col("b.tokens").alias("tokens"), F.col("b.equal").alias("equal")
    )


@owned
def _contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return overlaps(docs, benchmark).select("doc_id").distinct()


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without doc_id stay."""
    found = _contaminated(docs.select("doc_id", "text"), benchmark)
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
