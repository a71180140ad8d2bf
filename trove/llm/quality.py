"""Operator 6, quality classifier: histogram gradient-boosted trees.

Statistics of the whole text (character classes, word lengths, repetition,
line shape) are the only inputs; labels, language, source and id never are.
The trees are grown on quantile histograms with a logistic loss, then
flattened into arrays, and scoring walks all rows of a batch down a tree with
numpy, one level per step. Scoring is row-local: no shuffle.

The fit uses at most ``max_train`` labelled rows (the smallest hashes of their
ids, so the sample does not depend on the order of the table); everything
else covers every row.

Defined results: null text counts as empty and is scored like any text; rows
with a null id are held out (they have no remainder) and scored; repeated
labels of one id count once, the smaller one if they differ; without labels,
or with labels of one class only, all rows score the smoothed share of label 1.
Extra columns pass through ``score`` untouched if they are asked for.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_slices, map_batches, texts_of

MAX_TRAIN = 20_000
BINS, TREES, DEPTH, RATE, L2 = 64, 60, 4, 0.2, 1.0

_MARKS = "!|#$%&*.,;:?\"'-_/\\()[]{}<>=+@~^`"


def statistics(text: str) -> list[float]:
    """The document statistics of one whole text."""
    raw = text.encode("utf-8")
    if not raw:
        return [0.0] * N_STATISTICS
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = len(raw)
    upper, lower, digit = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    blank, high = hist[32] + hist[9:14].sum(), hist[128:].sum()
    words = text.split()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    count = Counter(words)
    n_words = max(1, len(words))
    most = max(count.values(), default=0)
    lines = text.split("\n")
    full = [x for x in lines if x]
    line_len = np.fromiter(map(len, full), dtype=np.int64, count=len(full))
    share = hist[hist > 0] / n
    out = [np.log1p(n), np.log1p(len(words)), upper / n, lower / n, digit / n, blank / n, high / n,
           upper / max(1, upper + lower), (n - upper - lower - digit - blank - high) / n,
           lengths.mean() if len(words) else 0.0, lengths.std() if len(words) else 0.0, lengths.max(initial=0),
           len(count) / n_words, most / n_words, sum(c for c in count.values() if c > 1) / n_words,
           float((lengths == 1).sum()) / n_words, float((lengths <= 3).sum()) / n_words,
           np.log1p(len(lines)), line_len.mean() if len(full) else 0.0, line_len.std() if len(full) else 0.0,
           len(set(full)) / max(1, len(full)), sum(x[-1] in ".!?" for x in full) / max(1, len(full)),
           sum(w[:1].isupper() for w in words) / n_words, sum(w[-1:] in ".,;:!?" for w in words) / n_words,
           float(-(share * np.log(share)).sum())]
    return [float(x) for x in out] + [float(hist[ord(c)]) / n_words for c in _MARKS]


N_STATISTICS = 25 + len(_MARKS)


@dataclass
class Forest:
    """Trees flattened into arrays: node i of tree t goes left when its feature
    is at most its threshold; leaves point at themselves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray          # (nodes, 2)
    value: np.ndarray
    root: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for r in self.root:
            node = np.full(len(x), r)
            for _ in range(self.depth):
                node = self.child[node, (x[rows, self.feature[node]] > self.threshold[node]).astype(np.int64)]
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
         bins: int = BINS) -> Forest:
    """Boosted trees on quantile histograms, logistic loss, level by level."""
    n, width = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(share / (1.0 - share)))
    feature, threshold, child, value, root = [0], [np.inf], [[0, 0]], [0.0], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
        total = np.full(n, base)
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-total))
            grad, hess = p - y, p * (1.0 - p)
            top = len(feature)
            feature.append(0), threshold.append(np.inf), child.append([top, top]), value.append(0.0)
            root.append(top)
            node = np.full(n, top)
            frontier = [top]
            for _ in range(depth):
                if not frontier:
                    break
                place = np.full(len(feature), -1)
                place[frontier] = np.arange(len(frontier))
                own = place[node]
                used = own >= 0
                slot = own[used] * bins
                best = [(1e-6, -1, -1)] * len(frontier)
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    at = slot + binned[used, f]
                    g = np.bincount(at, grad[used], len(frontier) * bins).reshape(-1, bins)
                    h = np.bincount(at, hess[used], len(frontier) * bins).reshape(-1, bins)
                    gl, hl = g.cumsum(1), h.cumsum(1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl ** 2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt ** 2 / (ht + L2)
                    gain[(hl < 1.0) | (ht - hl < 1.0)] = 0.0
                    gain = gain[:, :len(edges[f])]
                    top_bin = gain.argmax(1)
                    for k, b in enumerate(top_bin):
                        if gain[k, b] > best[k][0]:
                            best[k] = (gain[k, b], f, int(b))
                following = []
                for k, (_, f, b) in enumerate(best):
                    if f < 0:
                        continue
                    at = frontier[k]
                    left = len(feature)
                    for c in (left, left + 1):
                        feature.append(0), threshold.append(np.inf), child.append([c, c]), value.append(0.0)
                        following.append(c)
                    feature[at], threshold[at], child[at] = f, float(edges[f][b]), [left, left + 1]
                    mine = node == at
                    node[mine] = np.where(binned[mine, f] <= b, left, left + 1)
                frontier = following
            size = len(feature)
            g, h = np.bincount(node, grad, size), np.bincount(node, hess, size)
            for i in np.unique(node):
                value[i] = float(-rate * g[i] / (h[i] + L2))
            total += np.array(value)[node]
    return Forest(base, np.array(feature), np.array(threshold), np.array(child), np.array(value), np.array(root, dtype=np.int64), depth)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(id as text) mod 5 is 0 (and rows without an id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        max_train: int = MAX_TRAIN) -> Forest:
    """A forest from at most ``max_train`` labelled ids that are not held out,
    with one row each: of rows that share an id the one with the least
    statistics.

    The sample of ids is bounded by ``max_train`` and therefore broadcast; the
    statistics are computed on the executors, and max_train rows of numbers
    come back."""
    known = (labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("label").alias("label")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")

    def run(batches):
        for b in batches:
            stats = [statistics(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(stats, pa.list_(pa.float64()))],
                                             names=["doc_id", "label", "x"])

    one = map_batches(rows, run, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x"))
    got = one.toPandas().sort_values("doc_id")                       # max_train rows at most, however often an id repeats
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, N_STATISTICS)
    return grow(x, (got["label"].to_numpy() == 1).astype(np.float64))


def score(docs: DataFrame, forest: Forest, text_col: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) of every whole text."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(forest)                     # a few thousand numbers, fixed by TREES and DEPTH
    if column in docs.columns:
        raise ValueError(f"the documents have a column {column} already")
    at = docs.columns.index(text_col)

    def run(batches):
        for b, texts in (x for b in batches for x in batch_slices(b, at)):
            x = (np.array([statistics(t) for t in texts[k:k + 2048]]) for k in range(0, len(texts), 2048))
            out = np.concatenate([model.value.score(rows) for rows in x])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, column])

    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return map_batches(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    forest = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = score(texts_of(docs, id_col, text_col), forest)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
