"""Substring deduplication by hashing lines and their sentences.

A text is cut into lines, and a line into sentences, because passages are also
copied into the middle of a line.  Units are the sentences of enough words, around each shorter one the
shortest runs of sentences of its line that have enough, and whole lines of any number of words.  Units are normalised and hashed to 128 bits; digests are
grouped over all documents; the occurrence of the smallest (doc_id, position) stays and the
others are removed, with their places in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import owned, small_batches, stored

#: A unit: up to the end of a sentence or of the line; line ends are in no unit.
#: Marks before a letter are in none either; nothing is read twice, so that a run of a million marks takes no longer than words.
_UNIT = re.compile(r"[^\n.!?]*+[.!?]++(?=[ \t\n]|$)|[^\n.!?]++(?:[.!?]++[^\s.!?][^\n.!?]*+)*+[.!?]*+|(?P<marks>[.!?]++)")


def units(text: str | None) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of the units of a text, in code points, without white space at their ends."""
    for m in _UNIT.finditer(text or ""):
        raw = "" if m.lastgroup else m.group()
        lead = len(raw) - len(raw.lstrip())
        if end := len(raw.rstrip()):
            yield m.start() + lead, m.start() + end


def normalised(unit: str) -> list[str]:
    """Words of a unit: lower case, white space dropped."""
    return unit.lower().split()


def spans(text: str | None, min_words: int) -> Iterator[tuple[int, int, int, list[str]]]:
    """``(unit, start, end, words)`` of what is hashed, ``unit`` being the number of its first sentence.

    A line all of whose sentences have ``min_words`` words repeats only if they do, so it is no unit of its own.
    """
    line: list[tuple[int, int, int, int]] = []

    def of_line() -> Iterator[tuple[int, int, int, list[str]]]:
        found, n = set(), len(line)
        for i, (_, _, _, count) in enumerate(line):
            if count >= min_words:
                found.add((i, i))
                continue
            found.add((0, n - 1))
            for step in (1, -1):
                j, total = i, count
                while total < min_words and 0 <= j + step < n:
                    j += step
                    total += line[j][3]
                if total >= min_words:
                    found.add((min(i, j), max(i, j)))
        for i, j in sorted(found):
            start, end = line[i][1], line[j][2]
            yield line[i][0], start, end, normalised(text[start:end])

    for k, (start, end) in enumerate(units(text)):
        if line and "\n" in text[line[-1][2] : start]:
            yield from of_line()
            line = []
        line.append((k, start, end, len(normalised(text[start:end]))))
    if line:
        yield from of_line()


def hashed_units(docs: DataFrame, min_words: int) -> DataFrame:
    """``uid, doc_id, unit, start, end, n_words, d1, d2, again`` for the units of each row, which ``uid`` names.

    ``again`` says that the same row has the unit before; one that overlaps its own last copy is left out.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for uid, doc, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                seen: dict[int, int] = {}
                for k, start, end, w in spans(text, min_words):
                    d = xxhash.xxh3_128_intdigest(" ".join(w).encode("utf-8", "surrogatepass"))
                    if seen.get(d, 0) > start:
                        continue
                    row = (uid, doc, k, start, end, len(w), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), d in seen)
                    seen[d] = end
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _COLUMNS)

    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "uid long, doc_id long, unit int, start int, `end` int, n_words int, d1 long, d2 long, again boolean"
    )


_COLUMNS = ["uid", "doc_id", "unit", "start", "end", "n_words", "d1", "d2", "again"]


@owned
def repeated_units(docs: DataFrame, min_words: int = 7) -> DataFrame:
    """The units to remove: ``doc_id, unit, start, end, n_words, first_doc_id, copies``.

    ``docs`` has ``doc_id, text``; other columns are ignored.  Sentences of fewer than ``min_words`` words
    go only with their neighbours or with their whole line: words as common as "and so on" recur by chance.  No unit
    to remove lies within another one; two may overlap in part.  Null and empty texts have no units.
    Rows that repeat a doc_id are one document, so none of them loses to another of them; rows
    without doc_id rank last, and among themselves all stay.
    """
    all_units = stored(hashed_units(docs, min_words), "units")
    groups = (
        all_units.groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    # Stored, so that the join shuffles both sides itself and the rows of a common line can be split.
    groups = stored(groups, "repeated")
    found = all_units.join(groups, ["d1", "d2"])
    gone = stored(found.where("again or (first_doc_id is not null and not doc_id <=> first_doc_id)"), "gone")
    before = F.max("end").over(W.partitionBy("uid").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1))
    return gone.withColumn("before", before).where("before is null or `end` > before").select(
        "doc_id", "unit", "start", "end", "n_words", "first_doc_id", "copies"
    )


def without_repeats(docs: DataFrame, min_words: int = 7) -> DataFrame:
    """``docs`` with the repeated units cut out of ``text`` and ``removed``, the spans cut, with original offsets.

    A document loses only its own spans, which a row holds; rows without doc_id keep their text.
    """
    cut = repeated_units(docs, min_words).where("doc_id is not null").groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed")
    )
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "removed"]
    with_cut = docs.select(names).join(stored(cut, "cut"), "doc_id", "left").select(*names, "removed")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if text is not None and spans:
                    kept, last = [], 0
                    for s in spans:
                        kept.append(text[last : s["start"]])
                        last = max(last, s["end"])
                    text = "".join([*kept, text[last:]])
                texts.append(text)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return with_cut.mapInArrow(run, with_cut.schema)
