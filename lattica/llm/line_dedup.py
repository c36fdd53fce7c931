"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups.

Lines are normalised; equal ones form a class by their 128-bit digest.  Each class has a 64-bit SimHash of
its words.  Two hashes within ``RADIUS`` bits agree in two of five blocks, so classes meet
on the ten pairs of blocks.  Edit similarity of 0.8 leaves most similar lines further apart than that (a changed word
in ten moves about eight bits), and a wider radius has no blocks that tell lines apart, so classes also meet
where four of sixteen minima over their words' hashes are equal.  Two that met are compared if their hashes are at most
``RADIUS`` bits apart, in a band ``FAR`` bits with half of the minima equal, and their lengths allow the similarity; the edit distance decides.

Classes that meet in a block of more than two are first compared with the block's smallest; what
those links connect is one group, and the others are compared only across groups: first of each line the pair
that is nearest by hash, then sixteen pairs of each, then all that are left.  Pairs whose groups have
become one meanwhile are left out, so a block of thousands of like lines gives thousands of comparisons, not all pairs,
and no group is split that all pairs would join.  Everything runs as DataFrame functions.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import connected_components, owned, split_lines, stored

RADIUS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Bits that the hashes of two lines that met in a band may be apart.
FAR = 18
#: Of the sixteen minima, those that two lines that met in a band have in common at least.
COMMON = 8
MIN_WORDS = 5
SIMILARITY = 0.8
#: Digests of lines (24 bytes each) up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Pairs of each line that are compared in a round across groups, before all others are.
SHARES = (1, 16)
#: Minima of a line's word hashes that make a key together: rows, columns and diagonals both ways of a square of sixteen.
BANDS = (
    *(tuple(range(4 * k, 4 * k + 4)) for k in range(4)),
    *(tuple(range(k, 16, 4)) for k in range(4)),
    *(tuple(4 * i + (k + i) % 4 for i in range(4)) for k in range(4)),
    *(tuple(4 * i + (k - i) % 4 for i in range(4)) for k in range(4)),
)

#: Each minimum turns the words' hashes by four bits more and mixes its own constant in.
_MIXED = tuple(int.from_bytes(hashlib.sha256(b"%d" % k).digest()[:8], "big", signed=True) for k in range(16))
#: Keys of bands are at least this, those of blocks less.
_BAND = 1 << 62
#: Keys are counted in so many turns, so that half of them are on disk at a time.
_TURNS = 2
#: A length's step in an id: lengths of which one is at most this many times the other are in one step or the next.
_STEP = 1.3
#: Where the number of a line and the step of its length are in an id; the count of set bits is at the end.
_AT_ROW, _AT_STEP = 14, 7
#: Two lanes of 32 bits; a lane counts up to 2**30 letters.
_LANES = 0x0000000100000001


def normalised(line: Column) -> Column:
    """Lower-cased words of letters, marks and digits with a space between them."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}\p{N}]+", " "))


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, digest, n_words, norm`` of every line, stored."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(split_lines(F.col("text").cast("string"))).alias("line_no", "line"))
    norm = raw.select("doc_id", "line_no", normalised(F.col("line")).alias("norm"))
    spaces = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit("")))
    own = norm.select("doc_id", "line_no", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("digest"), F.when(F.col("norm") == "", 0).otherwise(spaces + 1).alias("n_words"), "norm")
    return stored(own, "lines")


def simhash_classes(every: DataFrame, min_words: int) -> DataFrame:
    """``id, digest, copies, len, h, sk0, sk1``: a row for each digest of ``min_words`` words or more, stored.

    A bit of ``h`` is set if words with more than half of the line's letters have it in their hashes: edits count
    letters too, and short words, which all lines have, would make unlike lines near.  Equal lines are combined before the shuffle;
    after it, the words of a class are counted where the class is, without another one.  32 sums of
    two lanes each count the 64 bits; adding what is missing to half of 2**31 makes a lane's top bit tell a
    majority; they are folded one by one, as all at once make a method that the JVM doesn't compile.  ``sk0`` and ``sk1`` have a byte of each minimum.  ``id`` is unique, as the rows are numbered when they are stored; below the
    number it has the step of the length and the count of set bits, so that most pairs that can't be near go before anything is
    joined.  Beyond 65,536 partitions there is no room for the number, which raises.
    """
    own = every.where(F.col("n_words") >= min_words).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("norm").alias("norm"))
    words = own.select("digest", "copies", F.length("norm").alias("len"), F.explode(F.split("norm", " ", -1)).alias("word"))
    words = words.select("digest", "copies", "len", F.xxhash64("word").alias("w"), F.length("word").cast("long").alias("c"))
    turned = lambda k: F.shiftleft("w", 4 * k).bitwiseOR(F.shiftrightunsigned("w", 64 - 4 * k)) if k else F.col("w")
    mins = [F.min(F.shiftright(turned(k).bitwiseXOR(F.lit(_MIXED[k])), 32).cast("int")).alias(f"m{k}") for k in range(16)]
    sums = [F.sum(F.shiftrightunsigned("w", k).bitwiseAND(F.lit(_LANES)) * F.col("c")).alias(f"s{k}") for k in range(32)]
    counted = words.groupBy("digest").agg(
        F.sum("c").alias("n"), F.max("copies").alias("copies"), F.max("len").alias("len"), *sums, *mins
    )
    bump = (F.lit(2**30 - 1).cast("long") - F.expr("n div 2")) * F.lit(_LANES)
    tops = F.array(*(F.shiftrightunsigned(F.col(f"s{k}") + bump, 30).bitwiseAND(F.lit(_LANES)) for k in reversed(range(32))))
    bits = F.aggregate(tops, F.lit(0).cast("long"), lambda b, top: F.shiftleft(b, 1).bitwiseOR(top))
    sketch = [F.lit(0).cast("long"), F.lit(0).cast("long")]
    for k in range(16):
        sketch[k // 8] = sketch[k // 8].bitwiseOR(F.shiftleft(F.col(f"m{k}").bitwiseAND(F.lit(255)).cast("long"), 8 * (k % 8)))
    row = F.monotonically_increasing_id()
    row = F.when(row < F.lit(1 << 63 - _AT_ROW), row).otherwise(F.raise_error(F.lit("too many partitions to number the lines")).cast("long"))
    step = F.floor(F.log("len") / math.log(_STEP)).cast("long")
    own_id = F.shiftleft(row, _AT_ROW).bitwiseOR(F.shiftleft(step, _AT_STEP)).bitwiseOR(F.bit_count("h").cast("long"))
    counted = counted.withColumn("h", bits)
    return stored(
        counted.select(own_id.alias("id"), "digest", "copies", "len", "h", sketch[0].alias("sk0"), sketch[1].alias("sk1")),
        "classes",
    )


def _block_keys(h: Column) -> list[Column]:
    """The ten pairs of blocks, each with its number, as one long."""
    out = []
    for k, (x, y) in enumerate(combinations(range(len(BLOCKS)), 2)):
        (a, na), (b, nb) = BLOCKS[x], BLOCKS[y]
        left = F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << na) - 1))
        right = F.shiftrightunsigned(h, b).bitwiseAND(F.lit((1 << nb) - 1))
        out.append(F.lit(k << 32).bitwiseOR(F.shiftleft(left, 13)).bitwiseOR(right))
    return out


def _band_keys(bands: tuple[tuple[int, ...], ...]) -> list[Column]:
    """The bytes of the minima of each band, up to four, with its number, as one long."""
    out = []
    for k, band in enumerate(bands):
        key = F.lit(_BAND | k << 32)
        for i, j in enumerate(band):
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"sk{j // 8}"), 8 * (j % 8)).bitwiseAND(F.lit(255)), 8 * i))
        out.append(key)
    return out


def _met_first(radius: int, bands: tuple[tuple[int, ...], ...]) -> Column:
    """Whether ``key_a`` is the one of the keys that two lines share at which they are compared: the first block if that near, else the first band."""
    differ = F.struct(
        F.col("h_a").bitwiseXOR(F.col("h_b")).alias("z"), *(_unequal(F.col(f"sk{x}_a"), F.col(f"sk{x}_b")).alias(f"u{x}") for x in range(2)), F.shiftright("key_a", 32).alias("number")
    )

    def first(d: Column) -> Column:
        block, band = F.lit(None).cast("long"), F.lit(None).cast("long")
        for k, pair in reversed(list(enumerate(combinations(BLOCKS, 2)))):
            mask = sum((1 << n) - 1 << at for at, n in pair)
            block = F.when(d["z"].bitwiseAND(F.lit(mask - (mask >> 63 << 64))) == 0, F.lit(k).cast("long")).otherwise(block)
        for k, of in reversed(list(enumerate(bands))):
            met = [d[f"u{x}"].bitwiseAND(F.lit(sum(1 << 8 * (j % 8) for j in of if j // 8 == x))) == 0 for x in sorted({j // 8 for j in of})]
            band = F.when(met[0] & met[1] if len(met) > 1 else met[0], F.lit((_BAND >> 32) + k)).otherwise(band)
        return F.coalesce(F.when(F.bit_count(d["z"]) <= radius, block), band) == d["number"]

    # In a lambda what differs is made once; as plain columns it would be made for each key, in a method that the JVM doesn't compile.
    return F.exists(F.array(differ), first)


def _near(pairs: DataFrame, classes: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Of ``src, dst, within`` those that ``_alike`` holds near enough."""
    side = lambda at, x: classes.select(F.col("id").alias(at), *(F.col(c).alias(f"{c}_{x}") for c in _SIGNS))
    return pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst").where(_alike(similarity, radius, F.col("within"))).select("src", "dst", F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b"))).alias("apart"))


_SIGNS = ("h", "len", "sk0", "sk1")


def _may_be_near(similarity: float) -> Column:
    """What ids alone tell of ``src, dst, within``: steps of the lengths and counts of set bits; rules out no pair that ``_alike`` holds near."""
    steps = math.ceil(math.log(1 / similarity) / math.log(_STEP) + 1e-6) if similarity > 0 else 128
    step, bits = ((lambda c, at=at: F.shiftright(c, at).bitwiseAND(F.lit(127))) for at in (_AT_STEP, 0))
    return (F.abs(step("src") - step("dst")) <= steps) & (F.abs(bits("src") - bits("dst")) <= F.col("within"))


def _unequal(x: Column, y: Column) -> Column:
    """The lowest bit of each byte in which the two differ."""
    # What is above a byte's lowest bit is halved three times; no bit of the byte above gets there.
    z = x.bitwiseXOR(y)
    for k in (4, 2, 1):
        z = z.bitwiseOR(F.shiftrightunsigned(z, k))
    return z.bitwiseAND(F.lit(0x0101010101010101))


def _unequal_bytes(x: Column, y: Column) -> Column:
    return F.bit_count(_unequal(x, y))


def _alike(similarity: float, radius: int, within: Column) -> Column:
    """Hashes near enough, minima for those that are further apart, and lengths, which rule out no similar pair."""
    apart = F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b")))
    unequal = _unequal_bytes(F.col("sk0_a"), F.col("sk0_b")) + _unequal_bytes(F.col("sk1_a"), F.col("sk1_b"))
    near = (apart <= radius) | ((apart <= within) & (unequal <= 16 - COMMON))
    return F.expr(f"abs(len_a - len_b) <= greatest(len_a, len_b) * {1 - similarity:.9f} + 1e-6") & near


def _verified(pairs: DataFrame, classes: DataFrame, every: DataFrame, similarity: float, broadcast_rows: int) -> DataFrame:
    """Pairs ``src, dst`` of classes whose lines are that similar: 1 - edit distance / longer length.  Stored."""
    pairs = stored(pairs, "candidates")
    ends = pairs.select(F.col("src").alias("id")).union(pairs.select(F.col("dst").alias("id"))).distinct()
    wanted = stored(classes.select("id", "digest").join(ends, "id"), "wanted")
    small = wanted.count() <= broadcast_rows
    texts = every.select("digest", "norm").join(F.broadcast(wanted) if small else wanted, "digest")
    texts = stored(texts.groupBy("id").agg(F.first("norm").alias("norm")), "texts")
    a = texts.select(F.col("id").alias("src"), F.split("norm", " ", -1).alias("a"))
    b = texts.select(F.col("id").alias("dst"), F.split("norm", " ", -1).alias("b"))
    met = pairs.join(a, "src").join(b, "dst")
    # Equal words at both ends change no edit distance; what is between them is compared.
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False) - 1
    met = met.select("src", "dst", "a", "b", same(F.col("a"), F.col("b")).cast("int").alias("head"), same(F.reverse("a"), F.reverse("b")).cast("int").alias("tail"))
    met = met.withColumn("tail", F.least("tail", F.least(F.size("a"), F.size("b")) - F.col("head")))
    long = lambda c: F.aggregate(c, F.lit(-1), lambda n, w: n + F.length(w) + 1)
    inner = lambda c: F.slice(c, F.col("head") + 1, F.size(c) - F.col("head") - F.col("tail"))
    met = met.select("src", "dst", long("a").alias("la"), long("b").alias("lb"), inner("a").alias("a"), inner("b").alias("b"))
    met = met.withColumn("most", F.floor(F.greatest("la", "lb") * (1 - similarity) + 1e-9).cast("int"))
    # Replacing word by word takes at least as many edits, and so does replacing everything; if that is few enough, the count can be left out.
    changed = "aggregate(zip_with(a, b, (p, q) -> if(p <=> q, 0, greatest(length(p), length(q)))), 0, (n, e) -> n + e)"
    few = f"(size(a) = size(b) and {changed} <= most)"
    # Edits of whole words, each word as one character: so many words, and one for words that share a character, change no more letters than their lengths.
    sign = lambda c: f"decode(unhex(array_join(transform({c}, w -> hex(4096 + pmod(xxhash64(w), 49152))), '')), 'UTF-16BE')"
    widest = "(1 + aggregate(concat(a, b), 0, (n, w) -> greatest(n, length(w))))"
    met = met.select(
        "src", "dst", "most", F.expr("abs(la - lb) <= most").alias("may"), F.expr(few).alias("few"), F.expr(f"most div {widest} - 1").alias("most_words"),
        F.expr(sign("a")).alias("wa"), F.expr(sign("b")).alias("wb"), F.array_join("a", " ").alias("x"), F.array_join("b", " ").alias("y"),
    )
    # With a limit, levenshtein() counts only that far from the diagonal and gives -1 beyond it; most similar lines are found by a small one.
    steps = " or ".join(f"levenshtein(x, y, {m}) >= 0" for m in ("most div 3", "most"))
    similar = f"may and (few or greatest(length(x), length(y)) <= most or (most_words > 0 and levenshtein(wa, wb, most_words) >= 0) or {steps})"
    # A filter here would be moved below the columns and make each anew wherever it is named; as a column it is made once.
    return stored(met.select("src", "dst", F.expr(similar).alias("similar")), "links").where("similar").select("src", "dst")


def _linked(left: DataFrame, shares: tuple[int, ...], classes: DataFrame, every: DataFrame, similarity: float, broadcast_rows: int) -> DataFrame:
    """Links ``src, dst`` that join the groups of ``left``: ``src, dst, g_a, g_b, apart``, as its whole would join them.

    Every pair is compared unless its groups are one by the links of an earlier round; of each line so many pairs as
    ``shares`` has for a round, the nearest of each share, and in the end all that are left.
    """
    links = left.select("src", "dst").limit(0)
    for share in (*shares, None):
        if left.isEmpty():
            break
        turn = F.pmod(F.xxhash64("dst"), F.lit(share)) if share else F.col("dst")
        picked = stored(left.groupBy("src", turn.alias("turn")).agg(F.min(F.struct("apart", "dst")).alias("best")).select("src", F.col("best.dst").alias("dst")), "picked")
        found = _verified(picked, classes, every, similarity, broadcast_rows)
        links = links.union(found)
        if not share:
            break
        joined = left.join(found, ["src", "dst"]).select(F.col("g_a").alias("src"), F.col("g_b").alias("dst")).distinct()
        new = connected_components(joined)
        of = lambda g: new.select(F.col("node").alias(g), F.col("component").alias(f"new_{g}"))
        rest = left.join(picked, ["src", "dst"], "left_anti").join(of("g_a"), "g_a", "left").join(of("g_b"), "g_b", "left")
        rest = rest.select("src", "dst", F.coalesce("new_g_a", "g_a").alias("g_a"), F.coalesce("new_g_b", "g_b").alias("g_b"), "apart")
        left = stored(rest.where("g_a <> g_b"), "left")
    return links


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Of ``members`` those in blocks that more than one group of ``links`` is in, with the group ``g``.  Stored."""
    groups = connected_components(links).withColumnRenamed("node", "id")
    named = members.select("key", "id", *_SIGNS).join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("g"), *_SIGNS)
    named = stored(named, "named")
    split = stored(named.groupBy("key").agg(F.min("g").alias("least"), F.max("g").alias("last")).where("least < last").select("key"), "split")
    return stored(named.join(split, "key"), "open")


def _side(df: DataFrame, at: str, x: str, *keys: str) -> DataFrame:
    return df.select(F.col("id").alias(at), F.col("g").alias(f"g_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in (*keys, *_SIGNS)))


def _to_shortest(open_: DataFrame, similarity: float, radius: int, far: int) -> DataFrame:
    """``src, dst``: members of blocks and the shortest one that is about as long, if that is of another group; as many as members.

    Two ways to cut lengths into steps are used, so lengths that are near are in one step in either.
    """
    base = max(1.01, min(2.0, 1 / similarity)) if similarity > 0 else 2.0
    pairs = None
    for shift in (0.0, 0.5):
        dealt = open_.withColumn("step", F.floor(F.log("len") / math.log(base) + shift))
        least = dealt.groupBy("key", "step").agg(F.min(F.struct("len", "id", "g", "h", "sk0", "sk1")).alias("least")).select("key", "step", "least.*")
        within = F.when(F.col("key_a") >= F.lit(_BAND), far).otherwise(radius)
        on = (F.col("key_a") == F.col("key_b")) & (F.col("step_a") == F.col("step_b")) & (F.col("g_a") != F.col("g_b")) & _alike(similarity, radius, within)
        met = _side(dealt, "src", "a", "key", "step").join(_side(least, "dst", "b", "key", "step"), on).select("src", "dst", "g_b", F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b"))).alias("apart"))
        pairs = met if pairs is None else pairs.union(met)
    return pairs.groupBy("src", "g_b").agg(F.min(F.struct("apart", "dst")).alias("best")).select("src", F.col("best.dst").alias("dst"))


def line_groups(
    docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, far: int = FAR, bands: tuple[tuple[int, ...], ...] = BANDS, broadcast_rows: int = BROADCAST_ROWS
) -> tuple[DataFrame, DataFrame]:
    """The occurrences ``doc_id, line_no, digest`` and, by digest, the groups ``digest, group, copies`` of more than one line."""
    every = lines(docs)
    classes = simhash_classes(every, min_words)
    keys = [*_block_keys(F.col("h")), *_band_keys(bands)]
    keyed = lambda keys, *more: classes.select("id", F.explode(F.array(*keys)).alias("key"), *more)
    blocks = None
    for k in range(_TURNS):
        counted = keyed(keys[k::_TURNS]).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
        some = stored(counted.where("n > 1"), "blocks")
        blocks = some if blocks is None else blocks.union(some)
    many = blocks.where("n > 2").select("key", "lo")
    small = many.count() <= broadcast_rows
    # What is broadcast moves no row, so the members can have their signs at once.
    members = keyed(keys, *_SIGNS).join(F.broadcast(many), "key") if small else keyed(keys).join(many, "key").join(classes.select("id", *_SIGNS), "id")
    members = stored(members, "members")
    # Hashes that met in blocks are within the radius, those that met in a band may be further apart.
    within = F.when(F.col("key") >= F.lit(_BAND), far).otherwise(radius).alias("within")
    met = blocks.where("n = 2").select(F.col("hi").alias("src"), F.col("lo").alias("dst"), within)
    met = met.union(members.where("id <> lo").select(F.col("id").alias("src"), F.col("lo").alias("dst"), within))
    met = met.where(_may_be_near(similarity)).groupBy("src", "dst").agg(F.max("within").alias("within"))
    near = _near(met, classes, similarity, radius).select("src", "dst", F.col("src").alias("g_a"), F.col("dst").alias("g_b"), "apart")
    check = (classes, every, similarity, broadcast_rows)
    links = _linked(stored(near, "near"), (1,), *check)
    links = links.union(_verified(_to_shortest(_open(members, links), similarity, radius, far), *check))

    open_ = _open(members, links)
    within = F.when(F.col("key_a") >= F.lit(_BAND), far).otherwise(radius)
    # Both ends are the same rows under other names, so they are shuffled once.
    on = (F.col("key_a") == F.col("key_b")) & (F.col("g_a") < F.col("g_b")) & _alike(similarity, radius, within) & _met_first(radius, bands)
    across = _side(open_, "src", "a", "key").join(_side(open_, "dst", "b", "key"), on)
    across = across.select("src", "dst", "g_a", "g_b", F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b"))).alias("apart"))
    more = _linked(stored(across, "across"), SHARES, *check)
    comps = connected_components(links.union(more)).withColumnRenamed("node", "id")
    grouped = classes.select("id", "digest", "copies").join(comps, "id", "left").where("component is not null or copies > 1")
    grouped = grouped.select("digest", F.coalesce("component", "id").alias("group"), "copies")
    few = every.where((F.col("n_words") > 0) & (F.col("n_words") < min_words)).groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    few = few.select("digest", (-1 - F.monotonically_increasing_id()).alias("group"), "copies")
    return every.select("doc_id", "line_no", "digest"), stored(grouped.union(few), "groups")


@owned
def repeated_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, far: int = FAR, bands: tuple[tuple[int, ...], ...] = BANDS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The lines to remove: ``doc_id, line_no, keep_doc_id, keep_line_no, group_lines``.

    In each group of equal and similar lines the one of the smallest (doc_id, line_no) stays.  Lines of
    fewer than ``min_words`` words are grouped by equality only.  Lines without a letter or digit are left alone, and so are
    empty ones; a null or empty text has no lines, and an empty table gives no row.  A line may have any length up to 2**30 letters; the edit
    distance of a pair takes time by the product of its length and its distance.  Rows that
    repeat a doc_id are one document: equal lines at the same line_no of it stay together.  Lines
    of rows without doc_id rank last; if a group has no others, all of its lines stay.  Only ``doc_id`` and ``text`` are
    read, so other columns may have any name.
    """
    occurrences, groups = line_groups(docs.select("doc_id", "text"), min_words, similarity, radius, far, bands, broadcast_rows)
    sizes = groups.groupBy("group").agg(F.sum("copies").alias("group_lines")).where("group_lines > 1")
    named = stored(groups.join(sizes, "group").select("digest", "group", "group_lines"), "repeated")
    found = stored(occurrences.join(named, "digest").select("doc_id", "line_no", "group", "group_lines"), "found")
    first = found.groupBy("group").agg(F.min("doc_id").alias("keep_doc_id"))
    per_doc = found.groupBy("group", "doc_id").agg(F.min("line_no").alias("keep_line_no"))
    keep = stored(
        per_doc.join(first, "group").where("doc_id = keep_doc_id").select("group", "keep_doc_id", "keep_line_no"), "keep"
    )
    return found.join(keep, "group").where("not (doc_id <=> keep_doc_id and line_no = keep_line_no)").select(
        "doc_id", "line_no", "keep_doc_id", "keep_line_no", "group_lines"
    )


@owned
def _gone(docs: DataFrame, **options) -> DataFrame:
    gone = repeated_lines(docs, **options)
    return gone.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the lines that ``repeated_lines`` names; ``n_chars``, if there, is counted anew where a line went.

    A document of which no line is left stays with an empty text; rows without doc_id keep their lines.
    """
    gone = _gone(docs, **options)
    names = docs.columns
    gone = gone.select(F.col("doc_id").alias("of_doc"), F.col("gone").alias("gone_lines"))
    own = docs.select(F.struct(*names).alias("row"))
    # One plan at any size: a broadcast on small inputs only would make what is shuffled jump as inputs grow.
    joined = own.join(gone.hint("merge"), F.col("row.doc_id") == F.col("of_doc"), "left")
    kept = F.array_join(
        F.filter(split_lines(F.col("row.text")), lambda line, i: ~F.array_contains("gone_lines", i)), "\n"
    )
    text = F.when(F.col("gone_lines").isNull(), F.col("row.text")).otherwise(kept)
    return joined.select(text.alias("new"), "row", "gone_lines").select(
        *(
            F.col("new").alias(c)
            if c == "text"
            else F.when(F.col("gone_lines").isNull(), F.col("row.n_chars")).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType).alias(c)
            if c == "n_chars"
            else F.col(f"row.`{c}`").alias(c)
            for c in names
        )
    )
