"""Mixture-controlled packing of documents into sequences of fixed length.

Each source is a queue of tokens.  Deficit round-robin serves the queues so that every window
(one sequence) holds the target proportions: after ``w`` windows a queue has been given its share of the
tokens so far, and the fraction of a token that it is short of is its deficit, carried to
the next window.  The deficits have a closed form (a difference of two integer
divisions), so a task lays out its own documents at any window without playing back the ones
before it, and windows run across partitions without a gap.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import small_batches, stored

#: Id put after every document.
END = 1
#: How the byte-level BPE cuts a text into pieces.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Controls that regular expression libraries don't agree on as white space.
_ODD = re.compile("[\x1c-\x1f\x85]")


class Encoder:
    """Ids of the byte-level BPE in a tokenizer file, as its own library gives them.

    With ``ranks``, the same vocabulary as a file of ranks, a faster library gives the same ids; texts that name a
    special token or hold the controls above still go to the first.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or _ODD.search(text):
            return self.model.encode(text, add_special_tokens=False).ids
        return self.fast(text)


def tokenised(docs: DataFrame, tokenizer: str, ranks: str | None = None, end: int = END) -> DataFrame:
    """``doc_id, source, part, start, n, ids``: one row for each row of ``docs``, stored.

    ``part`` numbers the task that read the row and ``start`` is the place in what that task has
    of the row's source.  Nothing is shuffled.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, at = Encoder(tokenizer, ranks), TaskContext.get().partitionId(), {}
        for b in batches:
            starts, lengths, blobs = [], [], []
            for text, source in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.array([*encoder.ids(text or ""), end], "<u4")
                starts.append(at.get(source, 0))
                lengths.append(len(ids))
                blobs.append(ids.tobytes())
                at[source] = starts[-1] + len(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([part] * b.num_rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())],
                ["doc_id", "source", "part", "start", "n", "ids"],
            )

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return stored(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), source.alias("source")).mapInArrow(
            run, "doc_id long, source string, part long, start long, n long, ids binary"
        ),
        "tokens",
    )


def phases(totals: dict, weights: dict | None = None) -> list[list[tuple[object, int]]]:
    """Tokens that each source gives to each phase: ``[[(source, tokens), ...], ...]``.

    Without weights there is one phase, in the proportion of the sources' own sizes.  With weights a
    phase ends when a source runs out, and the next goes on with the rest; sources
    without a positive weight come last, in the proportion of their sizes.
    """
    order = sorted((s for s in totals if totals[s] > 0), key=lambda s: (s is None, s or ""))
    if weights is None:
        return [[(s, totals[s]) for s in order]] if order else []
    left, out = {s: totals[s] for s in order}, []
    while live := [s for s in order if left[s] > 0 and weights.get(s, 0) > 0]:
        scale = min(left[s] / weights[s] for s in live)
        given = {s: min(left[s], int(scale * weights[s])) for s in live}
        first = min(live, key=lambda s: left[s] / weights[s])
        given[first] = left[first]
        out.append([(s, given[s]) for s in live if given[s]])
        for s in live:
            left[s] -= given[s]
    rest = [(s, left[s]) for s in order if left[s] > 0]
    return out + ([rest] if rest else [])


class Layout:
    """Where the tokens of each source's queue go."""

    def __init__(self, plan: list[list[tuple[object, int]]], window: int):
        self.window, self.queues, base = window, {}, 0
        for phase in plan:
            total, below = sum(n for _, n in phase), 0
            for source, n in phase:
                q = self.queues.setdefault(source, [])
                q.append((sum(x[1] for x in q), n, below, below + n, total, base))
                below += n
            base += -(-total // window)

    def pieces(self, source: object, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """``(place in the queue, length, sequence, offset)`` of the queue's tokens from ``start``."""
        size, end = self.window, start + n
        for first, count, below, above, total, base in self.queues[source]:
            at, stop = max(start, first) - first, min(end, first + count) - first
            if at >= stop:
                continue

            def served(w: int, below: int = below, above: int = above, total: int = total) -> tuple[int, int]:
                """Tokens that the queues up to this one, without and with it, have given before window ``w``."""
                t = min(w * size, total)
                return t * below // total, t * above // total

            w = min(at * total // (count * size), (total - 1) // size)
            lo, hi = served(w)
            while hi - lo > at:
                w -= 1
                lo, hi = served(w)
            while True:
                lo2, hi2 = served(w + 1)
                if hi2 - lo2 <= at:
                    w, lo, hi = w + 1, lo2, hi2
                    continue
                take = min(stop, hi2 - lo2) - at
                # Before this queue's part of the window come the parts of the queues below it.
                yield first + at, take, base + w, lo2 - lo + at - (hi - lo)
                at += take
                if at >= stop:
                    break
                w, lo, hi = w + 1, lo2, hi2


def spread(phase: list[tuple[object, int]], window: int) -> list[list[tuple[object, int]]]:
    """Split a phase, so that in each part every queue is due at least one token a window.

    With less than that, rounding could take back a token that was given.  Sources that small
    share phases of their own after the others.
    """
    total = sum(n for _, n in phase)
    large = [x for x in phase if x[1] * window >= total]
    small = [x for x in phase if x[1] * window < total]
    return [large] + (spread(small, window) if small else [])


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = 2048, weights: dict | None = None, end: int = END) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids``.

    ``docs`` has ``doc_id, text`` and may have ``source``; other columns are ignored.  A null or
    empty text is its end id alone; a null source is a queue of its own; rows that repeat a
    doc_id are documents of their own; an empty table gives no row.  A sequence takes its parts
    in the order of the sources' names, so its padding, if any, is at its end; only
    the last sequence of a phase is short (one phase without ``weights``).
    ``padded`` is the sequence's length once padded: ``window``, or a power of two that it has as it is.
    """
    spark = docs.sparkSession
    tokens = tokenised(docs, tokenizer, ranks, end)
    by_task = stored(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "by-task")
    totals = {r["source"]: r["n"] for r in by_task.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    plan = [part for phase in phases(totals, weights) for part in spread(phase, window)]
    layout = Layout(plan, window)
    fill: dict[int, int] = {}
    base = 0
    for p in plan:
        total = sum(n for _, n in p)
        if total % window:
            fill[base + total // window] = total % window
        base += -(-total // window)
    # One row for each task and source: a running sum over tasks, not over documents.
    before = by_task.select(
        "source", "part", (F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")).alias("before")
    )
    placed = tokens.join(
        before.select(F.col("source").alias("s"), F.col("part").alias("p"), "before"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")),
    ).select("doc_id", "source", (F.col("start") + F.col("before")).alias("at"), "n", "ids")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(10)]
            for doc, source, at, n, blob in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                for place, length, seq, offset in layout.pieces(source, at, n):
                    s = place - at
                    part = blob[4 * s : 4 * (s + length)]
                    full = fill.get(seq, window)
                    for c, x in zip(cols, (doc, s, length, zlib.crc32(part), n, seq, offset, source, full if full & (full - 1) == 0 else window, part), strict=True):
                        c.append(x)
            kinds = [pa.int64()] * 7 + [pa.string(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _NAMES)

    return placed.mapInArrow(
        lay, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, padded int, ids binary"
    )


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "padded", "ids"]
