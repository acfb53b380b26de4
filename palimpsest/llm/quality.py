"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 8).

Statistics of a text are binned by quantiles; trees are grown level by level from gradient
histograms of the logistic loss and flattened into arrays, complete binary trees that numpy
walks for all rows at once. Only the text is an input.

Trees are learned on the driver from at most ``sample`` labelled rows, chosen by a hash of
doc_id: the one bounded step. Every document is scored. Null and empty texts are scored as
texts of length 0; without labelled rows every score is 0.5. Null ids are never learned from;
``held_out`` is null for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._base import ROWS_AT_ONCE, table, text_of

NAME = "op8_quality"
#: Most labelled rows that are learned from.
SAMPLE = 20_000
CUTOFF = 0.3
FOLDS = 5

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "upper_letters", "upper_words", "digits", "bangs", "pipes",
    "symbols", "stops", "beyond_ascii", "blanks", "new_words", "repeats", "words_per_line", "new_lines", "letters",
)


def statistics(text: str) -> list[float]:
    """One value per name in FEATURES."""
    data = text.encode()
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda chars: float(count[list(chars)].sum()) / n
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    upper, lower = float(count[65:91].sum()), float(count[97:123].sum())
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), n / w, upper / max(1.0, upper + lower), sum(map(str.isupper, words)) / w,
        float(count[48:58].sum()) / n, share(b"!"), share(b"|"), share(b"#$%&*<>{}[]=+~^@\\"), share(b".,;:?"), float(count[128:].sum()) / n, share(b" \n\t\r"),
        len(set(words)) / w, sum(map(eq, words, words[1:])) / w, w / len(lines), len(set(lines)) / len(lines), (upper + lower) / n,
    ]


class Trees:
    """Boosted trees in arrays: node i has the children 2i+1 and 2i+2; the last level are leaves."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, prior: float, depth: int):
        self.feature, self.threshold, self.leaf, self.prior, self.depth = feature, threshold, leaf, prior, depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (2**self.depth - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Grow ``trees`` trees. ``least`` is the smallest hessian sum of a child."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(p / (1 - p))), depth)
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    prior = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), prior)
    feature, threshold, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    lift = np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (width * bins) + lift + binned).ravel()
            hist = [np.bincount(slot, np.repeat(v, width), n * width * bins).reshape(n, width, bins).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gt, ht) = hist, (v[:, :1, -1:] for v in hist)
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (hr < least)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            for i, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                if gain[i, f, cut] > 1e-9 and cut < len(edges[f]):
                    feature[t, first + i], threshold[t, first + i] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        node -= inner
        leaf[t] = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
        raw += leaf[t, node]
    return Trees(feature, threshold, leaf, prior, depth)


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return (F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % folds) == 0


def _statistics_udf():
    @F.pandas_udf("array<double>")
    def f(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([statistics(t) for t in s])

    return f


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> Trees:
    """Trees from the labelled rows outside the held-out fold, ``sample`` of them at most."""
    rows = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull())
        .where(~held_out("id"))
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    # At most ``sample`` pairs of numbers: small enough to broadcast, whatever the input.
    found = (
        docs.select(F.col(id_col).cast("long").alias("id"), text_of())
        .join(F.broadcast(rows), "id")
        .select("id", "label", _statistics_udf()("text").alias("x"))
        .groupBy("id", "label").agg(F.min("x").alias("x"))
        .orderBy("id")
        .collect()
    )
    return fit(np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.label for r in found]))


def score(model: Trees, text_col: str = "text") -> Column:
    """A column: the score of each text."""

    @F.pandas_udf("double")
    def f(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            x = np.array([statistics(t) for t in s]).reshape(-1, len(FEATURES))
            yield pd.Series([v for at in range(0, len(x), ROWS_AT_ONCE) for v in model.score(x[at : at + ROWS_AT_ONCE])], dtype="float64")

    return f(text_of(text_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score(model).alias("score"))
        .withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
    )
