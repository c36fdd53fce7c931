"""Secret scans with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over the trigrams that every
match must hold.  Postings (trigram, document) of the queries' trigrams are intersected
for each document, and only the documents that a query leaves are searched with its expression; a
rule without mandatory trigrams searches all of them.  Everything runs as DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A query: one of these sets of trigrams must be there as a whole; None: anything may match.
Query = frozenset[frozenset[str]] | None

_MOST = 48


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The three base kinds, in the order in which ties are listed.  The
#: lower bounds on characters are in the pattern where a shorter run could hold no longer one.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
#: Kinds that are found besides.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abp]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any(options: set[frozenset[str]]) -> Query:
    if any(not o for o in options):
        return None
    return frozenset(o for o in options if not any(x < o for x in options))


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _any({x | y for x in a for y in b})


def _read(nodes) -> tuple[set[str] | None, Query]:
    """The lower-cased strings that a part matches, if they are few, or else its query."""
    run, query, exact = {""}, None, True
    for op, arg in nodes:
        strings, more = _one(op, arg)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        query, exact = _and(query, _any({_grams(s) for s in run})), False
        run = strings if strings is not None else {""}
        query = _and(query, more)
    if exact:
        return run, None
    return None, _and(query, _any({_grams(s) for s in run}))


def _one(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, None
    if op is C.IN:
        if all(o is C.LITERAL for o, _ in arg) and len(arg) <= 6:
            return {chr(a).lower() for _, a in arg}, None
        return None, None
    if op is C.SUBPATTERN:
        return _read(arg[3])
    if op is C.BRANCH:
        parts = [_read(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), None
        queries = [_any({_grams(x) for x in s}) if s is not None else q for s, q in parts]
        return None, None if any(q is None for q in queries) else _any({x for q in queries for x in q})
    if op is C.AT:
        return {""}, None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, part = arg
        strings, query = _read(part)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, None
        if low == 0:
            return None, None
        return None, query if strings is None else _any({_grams(s) for s in strings})
    return None, None


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams, one of which every text with a match holds; None if there are none."""
    strings, query = _read(_parser.parse(pattern))
    return _any({_grams(s) for s in strings}) if strings is not None else query


def postings(docs: DataFrame, trigrams: set[str]) -> DataFrame:
    """The inverted index of the given trigrams: ``trigram, doc_id``, once for each row that has it."""
    quoted = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in t) for t in sorted(trigrams))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?=({quoted}))"), F.lit(1)))
    return docs.select("doc_id", F.explode(found).alias("trigram")).select("trigram", "doc_id")


def _spans(rule: Rule, at: int) -> Column:
    """``(start, order, end, kind)`` of a rule's matches.

    The pieces between the matches and the matches themselves are walked together, so each place is
    a sum of lengths; the arrays are made once for a row.
    """
    text = F.col("text")
    walked = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(start.alias("start"), F.lit(at).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        ok = x["hit"].isNotNull() & (F.length(x["part"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(walked, zero, step)["out"]).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``doc_id, text, findings`` for every row; findings are ``(start, ord, end, kind)`` in order.

    A rule's matches are its leftmost ones that don't overlap, in code points, ``end`` exclusive; ties
    come in the order of the rules.  Null texts are empty; rows without doc_id and rows that repeat one
    are searched like any other; other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = {t for q in queries.values() if q for conj in q for t in conj}
    candidates = docs
    if wanted:
        held = postings(docs, wanted).groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))

        def holds(query: Query) -> Column:
            test = F.lit(False)
            for conj in sorted(map(sorted, query)):
                test = test | (F.size(F.array_intersect("held", F.array(*map(F.lit, conj)))) == len(conj))
            return test

        chosen = F.array_compact(F.array(*(F.when(holds(q), F.lit(k)) for k, q in queries.items() if q)))
        chosen = held.select(F.col("doc_id").alias("id"), chosen.alias("rules")).where(F.size("rules") > 0)
        candidates = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    found = []
    for k, r in enumerate(rules):
        spans = _spans(r, k)
        if queries[r.kind]:
            may = F.coalesce(F.array_contains("rules", r.kind), F.lit(False))
            spans = F.when(may, spans).otherwise(F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>"))
        found.append(spans)
    return candidates.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("findings"))


def as_text(findings: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
