"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other; the model of each takes the words of a text and
the probabilities of the categories before it.  In training those probabilities are
out-of-fold predictions, so that a later model learns from what it will see on new texts
and not from fitted answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from lattica.llm.common import small_batches

_WORDS = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORDS((text or "").lower())


def features(text: str | None) -> set[str]:
    """Words, and the first three to five letters of longer ones: insults also come with other endings."""
    own = set(words(text))
    return own | {f"{w[:k]}*" for w in own for k in (3, 4, 5) if len(w) > k}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Sparse binary rows: the indexes of row i are ``index[start[i]:start[i + 1]]``."""

    index: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, sets: list[list[int]]) -> Rows:
        start = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
        return cls(np.array([i for s in sets for i in s], np.int64), start)

    def __len__(self) -> int:
        return len(self.start) - 1

    def times(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(w[self.index])))
        return total[self.start[1:]] - total[self.start[:-1]]

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, np.repeat(r, np.diff(self.start)), size)

    def take(self, rows: np.ndarray) -> Rows:
        lengths = np.diff(self.start)[rows]
        start = np.concatenate(([0], np.cumsum(lengths)))
        index = self.index[np.repeat(self.start[rows] - start[:-1], lengths) + np.arange(start[-1])]
        return Rows(index, start)

    def only(self, keep: np.ndarray) -> Rows:
        mask = keep[self.index]
        return Rows(self.index[mask], np.concatenate(([0], np.cumsum(mask)))[self.start])


def telling(x: Rows, y: np.ndarray, size: int, least: float = 15.0, most: int = 4000) -> np.ndarray:
    """Mask of the features that lean to positive or negative rows: chi-square of at least ``least``, the ``most`` largest."""
    n, pos = len(y), y.sum()
    has = np.bincount(x.index, minlength=size).astype(float)
    both = np.bincount(x.index, np.repeat(y, np.diff(x.start)), size)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (both * n - has * pos) ** 2 / (has * (n - has) * pos * (n - pos))
    chi = np.nan_to_num(chi, nan=0.0, posinf=0.0)
    keep = chi >= least
    if keep.sum() > most:
        keep &= chi >= np.sort(chi)[-most]
    return keep


def fit(x: Rows, dense: np.ndarray, y: np.ndarray, size: int, l2: float = 1.0, steps: int = 200) -> np.ndarray:
    """Logistic regression over telling features, earlier probabilities and a constant; full-batch Adam, so it repeats exactly."""
    x = x.only(telling(x, y, size)) if len(y) else x
    w, m, v = (np.zeros(size + dense.shape[1] + 1) for _ in range(3))
    n, rate = max(len(y), 1), 0.1
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    for t in range(1, steps + 1):
        r = (_sigmoid(score(w, x, dense)) - y) / n
        g = np.concatenate((x.back(r, size), dense.T @ r, [r.sum()])) + l2 / n * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def score(w: np.ndarray, x: Rows, dense: np.ndarray) -> np.ndarray:
    size = len(w) - dense.shape[1] - 1
    return x.times(w[:size]) + dense @ w[size:-1] + w[-1]


@dataclass
class Chain:
    """A fitted chain: a word's index, and for each category its weights and cut."""

    vocabulary: dict[str, int]
    categories: list[str]
    weights: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)
    #: Out-of-fold probabilities, by category, of the rows it was fitted on.
    held_out: dict[str, np.ndarray] = field(default_factory=dict)

    def rows(self, texts: list[str | None]) -> Rows:
        get = self.vocabulary.get
        return Rows.of([[i for w in features(t) if (i := get(w)) is not None] for t in texts])

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        x = self.rows(texts)
        dense = np.zeros((len(x), 0))
        for w in self.weights:
            dense = np.column_stack((dense, _sigmoid(score(w, x, dense))))
        return dense


def best_cut(p: np.ndarray, y: np.ndarray, beta: float = 0.5) -> float:
    """Probability from which F-beta on held-out rows is best, in the middle of its gap; a beta under 1 favours precision."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    b2 = beta * beta
    f = (1 + b2) * hits / (b2 * max(y.sum(), 1) + np.arange(1, len(y) + 1))
    f[:-1][p[order][:-1] == p[order][1:]] = -1
    k = int(np.argmax(f))
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0)) / 2)


def train(texts: list[str | None] | _Texts, labels: np.ndarray, folds: np.ndarray, categories: list[str], min_docs: int = 4, max_words: int = 200_000) -> Chain:
    """Fit a chain; ``labels`` has a 0/1 column for each category, ``folds`` the fold of each row.

    The vocabulary is the features in at least ``min_docs`` of the texts, at most ``max_words`` of them;
    the fitted chain keeps those that have a weight.
    """
    own = texts if isinstance(texts, _Texts) else _Texts(texts)
    number, found = own.number, own.found
    rows = len(found)
    start = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int64)
    every = np.concatenate(found) if found else np.array([], np.int32)
    del found, own
    seen = np.bincount(every, minlength=len(number))
    kept = sorted((w for w, i in number.items() if seen[i] >= min_docs), key=lambda w: (-seen[number[w]], w))[:max_words]
    chain, size = Chain({w: i for i, w in enumerate(kept)}, categories), len(kept)
    to = np.full(len(number), -1)
    to[np.array([number[w] for w in kept], np.int64)] = np.arange(size)
    del number
    x = Rows(to[every] if len(every) else every.astype(np.int64), start)
    x = Rows(x.index[x.index >= 0], np.concatenate(([0], np.cumsum(x.index >= 0)))[x.start])
    dense = np.zeros((rows, 0))
    for k, name in enumerate(categories):
        y, out = labels[:, k].astype(float), np.zeros(rows)
        for fold in np.unique(folds):
            inside, outside = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
            if not len(outside):
                outside = inside
            w = fit(x.take(outside), dense[outside], y[outside], size)
            out[inside] = _sigmoid(score(w, x.take(inside), dense[inside]))
        chain.weights.append(fit(x, dense, y, size))
        chain.cuts.append(best_cut(out, y) if y.any() and not y.all() else (0.0 if y.any() else 2.0))
        chain.held_out[name] = out
        dense = np.column_stack((dense, out))
    used = np.flatnonzero(np.any([w[:size] != 0 for w in chain.weights], axis=0)) if chain.weights else np.array([], int)
    chain.vocabulary = {kept[i]: j for j, i in enumerate(used)}
    chain.weights = [np.concatenate((w[:size][used], w[size:])) for w in chain.weights]
    return chain


def train_on(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = 5_000, n_folds: int = 4) -> Chain:
    """Fit a chain on labelled rows, at most ``sample`` of them, chosen by a hash of doc_id.

    ``categories`` maps a name to a Boolean expression over the columns of ``labels``, in the order
    of the chain.  A null label counts as false.  Rows with the same text share a fold.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(c.cast("int"), F.lit(0)).alias(f"y{k}") for k, c in enumerate(categories.values())))
    told = told.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(told), "doc_id")
    texts = _Texts()
    labels, folds = [], []
    for r in rows.orderBy("doc_id", "text").limit(sample).toLocalIterator():
        texts.add(r["text"])
        labels.append([r[f"y{k}"] for k in range(len(categories))])
        folds.append(_fold(r["text"], n_folds))
    return train(texts, np.array(labels, int).reshape(len(labels), len(categories)), np.array(folds, int), list(categories))


class _Texts:
    """The features of texts as numbers, so that the driver holds no more than one text."""

    def __init__(self, texts: Iterable[str | None] = ()):
        self.number: dict[str, int] = {}
        self.found: list[np.ndarray] = []
        for t in texts:
            self.add(t)

    def add(self, text: str | None) -> None:
        number = self.number
        self.found.append(np.fromiter((number.setdefault(w, len(number)) for w in features(text)), np.int32))


def _fold(text: str | None, n: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) % n


def scored(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` (double) and ``is_<category>`` (boolean) for every category.

    A null or empty text is scored as a text without words.  Columns of those names are replaced.
    The model is sent with the task; its size is bounded by the vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [f"p_{c}" for c in chain.categories] + [f"is_{c}" for c in chain.categories]
    docs = docs.drop(*names)
    sent = spark.sparkContext.broadcast((chain.vocabulary, chain.categories, [w.astype(np.float64) for w in chain.weights], chain.cuts))
    at = docs.columns.index(text)
    cuts = list(chain.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(*sent.value)
        for b in batches:
            p = model.probabilities(b.column(at).to_pylist())
            extra = [pa.array(p[:, k]) for k in range(p.shape[1])] + [pa.array(p[:, k] >= cuts[k]) for k in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, *names])

    kinds = [DoubleType()] * len(chain.categories) + [BooleanType()] * len(chain.categories)
    added = [StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))
