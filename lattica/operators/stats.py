"""Histograms, entropy, lag scores, record widths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import kernels


def histogram(values: DataFrame, *by: str) -> DataFrame:
    """``by, v, n``: how often each value occurs."""
    return values.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame, *by: str) -> DataFrame:
    """Bits a byte, from a histogram."""
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("nl"))
    bits = F.log2("total") - F.col("nl") / F.col("total")
    return total.select(*by, F.greatest(F.round(bits, 6), F.lit(0.0)).alias("entropy"))


def most_frequent(counts: DataFrame, *by: str) -> DataFrame:
    """The most frequent value; the smallest of several."""
    best = F.max(F.struct("n", (-F.col("v")).alias("neg")))
    return counts.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.neg")).alias("v"))


def lag_scores(blobs: DataFrame, sample: int = 16384, low: int = 4, high: int = 1024) -> DataFrame:
    """``blob_id, lag, score``: how even the difference between a byte and the one ``lag`` before it is.

    The score is the share of the pairs that have the commonest difference modulo 256.  Record widths
    are looked for in the first ``sample`` bytes, which is what this detector is defined on.
    Lags go up to half of that, and to ``high``.  A blob is scored where it is read.
    """
    kind = blobs.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data in enumerate(b.column(1).to_pylist()):
                scores = kernels.lag_scores(data, sample, low, high)
                if len(scores):
                    ids = b.column(0).slice(k, 1).take(pa.array(np.zeros(len(scores), np.int64)))
                    lags = np.arange(low, low + len(scores), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(lags), pa.array(scores)], ["blob_id", "lag", "score"])

    return blobs.select("blob_id", "content").mapInArrow(run, f"blob_id {kind}, lag int, score double")


def peaks(scores: DataFrame) -> DataFrame:
    """Lags whose score is a local maximum and stands out: 0.05, and 0.02 above the upper median, at least."""
    middle = F.element_at(F.array_sort(F.collect_list("score")), F.expr("cast(count(1) div 2 + 1 as int)"))
    limit = scores.groupBy("blob_id").agg(F.greatest(F.lit(0.05), middle + 0.02).alias("limit"))
    w = W.partitionBy("blob_id").orderBy("lag")
    near = scores.select("*", F.coalesce(F.lag("score").over(w), F.lit(0.0)).alias("left"), F.coalesce(F.lead("score").over(w), F.lit(0.0)).alias("right"))
    return near.join(limit, "blob_id").where("score >= limit and score > left and score >= right").select("blob_id", "lag", "score")


def detect_widths(blobs: DataFrame, most: int = 3, sample: int = 16384) -> DataFrame:
    """``blob_id, rank, width``: the best lags, none a multiple of a better one; blobs without a period have no row."""
    ranked = peaks(lag_scores(blobs, sample)).groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "lag"))).alias("p"))
    pick = F.aggregate(
        F.transform("p", lambda s: s["lag"]),
        F.array().cast("array<int>"),
        lambda acc, lag: F.when((F.size(acc) >= most) | F.exists(acc, lambda k: lag % k == 0), acc).otherwise(F.concat(acc, F.array(lag))),
    )
    return ranked.select("blob_id", F.posexplode(pick).alias("rank", "width"))
