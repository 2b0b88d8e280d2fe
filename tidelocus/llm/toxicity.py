"""Toxicity severity: cumulative-link ordinal regression on sparse text features.

Features of a text are digests of its words and of their first bytes (so that new words on a known stem
count).  Those that tell the labels apart (likelihood ratio of their document frequencies, at most
``SIZE``) make the sparse vector: the log-scaled share of the text's words that have each.  Severity has
grades 0 to 3: P(grade <= k) = sigmoid(threshold_k - w x), one weight vector for all thresholds,
which rise.

Labels are 0 or 1.  Grade 0 is label 0; the others are split into grades 1 to 3 at the thirds of the sum
of the features that speak for label 1.

The model is fitted on at most ``per_class`` rows of each label (those with the smallest digests of
doc_id, whatever the size of the input), weighted back to the labels' shares among all labelled rows.
Features are counted by a Spark aggregation, the sparse vectors written once; each step of the fit
is a Spark job in which tasks sum the gradients of their rows.  Scoring is a pass without a shuffle.

Outputs: ``severity`` (the expected grade), ``toxic`` (P(grade >= 1) >= ``LEAST``) and ``grade`` (the likeliest of 1 to 3 where toxic, else 0).
Edge cases: null and empty texts have no features, and the thresholds alone decide; null labels are
ignored; without both labels everything has the grade of the only one (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import _summed
from .shared import add_columns, keeps_columns, written
from .textbytes import ALNUM, LOWER, flat, prefix_sums, slices, span_hash, word_spans

GRADES, PER_CLASS = 4, 6000
SIZE, LEAST_RATIO, LEAST_ROWS = 2048, 9.0, 3
STEMS = (4, 5, 6)
STEPS, PENALTY, LEAST = 25, 1e-4, 0.4


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of words and stems of all texts, the text of each, and each text's number of words."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = word_spans(ALNUM[data], offsets)
    sums, doc = prefix_sums(data), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    keys, of = [span_hash(sums, starts, ends)], [doc]
    for size in STEMS:
        long = ends - starts > size
        keys.append(span_hash(sums, starts[long], starts[long] + size))
        of.append(doc[long])
    return np.concatenate(keys), np.concatenate(of), np.diff(first)


def features(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: places in the sorted vocabulary and values, one after another, and n + 1 offsets."""
    key, doc, words = tokens(column)
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(len(words) + 1, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, key), len(vocabulary) - 1)
    known = vocabulary[at] == key
    both, count = np.unique(doc[known] * len(vocabulary) + at[known], return_counts=True)
    row = both // len(vocabulary)
    return both % len(vocabulary), np.log1p(100 * count / words[row]), np.searchsorted(row, np.arange(len(words) + 1))


@dataclass
class Model:
    """The features' digests (sorted), their weights, shared by all grades, and the rising thresholds."""

    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 30.0))

    def above(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - linear[:, None], -60, 60)))

    def probabilities(self, linear: np.ndarray) -> np.ndarray:
        steps = np.concatenate([np.ones((len(linear), 1)), self.above(linear), np.zeros((len(linear), 1))], axis=1)
        return steps[:, :-1] - steps[:, 1:]


def _linear(weights: np.ndarray, bucket: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(weights[bucket] * value))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("bucket")
    bounds = np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
    return np.asarray(lists.flatten()), np.asarray(batch.column("value").flatten(), np.float64), bounds, np.asarray(batch.column("y"))


def _thresholds(raw: np.ndarray) -> np.ndarray:
    """A first threshold and positive steps to the others."""
    return raw[0] + np.append(0, np.cumsum(np.exp(raw[1:])))


def _loss(parameters: np.ndarray, balance: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Negative log likelihood of the rows and its gradient."""
    bucket, value, bounds, y = _rows(batch)
    size = len(parameters) - GRADES + 1
    raw = parameters[size:]
    edges = np.concatenate([[-60.0], _thresholds(raw), [60.0]])
    linear = _linear(parameters, bucket, value, bounds)
    low, high = (1 / (1 + np.exp(-np.clip(edges[y + k] - linear, -60, 60))) for k in (0, 1))
    p = np.maximum(high - low, 1e-12)
    weight = balance[y]
    d_high, d_low = weight * high * (1 - high) / p, weight * low * (1 - low) / p
    gradient = np.zeros(len(parameters) + 1)
    gradient[:size] = np.bincount(bucket, np.repeat(d_high - d_low, np.diff(bounds)) * value, size)
    of_edge = np.zeros(GRADES - 1)
    np.add.at(of_edge, y[y < GRADES - 1], -d_high[y < GRADES - 1])
    np.add.at(of_edge, y[y > 0] - 1, d_low[y > 0])
    gradient[size] = of_edge.sum()
    gradient[size + 1 : -1] = [of_edge[k:].sum() * np.exp(raw[k]) for k in range(1, GRADES - 1)]
    gradient[-1] = -(weight * np.log(p)).sum()
    return gradient


def _descend(value, start: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS with halving steps; ``value(x)`` gives the loss and its gradient."""
    x = start
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way = g.copy()
        kept = []
        for s, y in reversed(pairs):
            a = s @ way / (y @ s)
            kept.append(a)
            way -= a * y
        way *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            way += (a - y @ way / (y @ s)) * s
        size = 1.0
        for _ in range(6):
            new_f, new_g = value(x - size * way)
            if new_f <= f - 1e-4 * size * (g @ way):
                break
            size /= 2
        else:
            break
        s, y = -size * way, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[-7:], (s, y)]
        done = f - new_f < 1e-5 * max(abs(f), 1e-9)
        x, f, g = x + s, new_f, new_g
        if done:
            break
    return x


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of label y with each feature, summed over a slice of rows."""
    for batch in slices(batches):
        key, doc, _ = tokens(batch.column("text"))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, y = key[once], np.asarray(batch.column("y"))[doc[once]]
        keys, begin = np.unique(key, return_index=True)
        toxic = np.add.reduceat(y, begin) if len(begin) else begin
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.diff(np.append(begin, len(key)))), pa.array(toxic.astype(np.int64))], names=["key", "n", "toxic"])


def _vocabulary(texts: DataFrame, clean: int, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted digests of the features that tell most, at most ``SIZE``, and their log odds."""
    counts = texts.mapInArrow(_document_counts, "key long, n long, toxic long").groupBy("key").agg(F.sum("n").cast("double").alias("n"), F.sum("toxic").cast("double").alias("t"))
    term = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0)
    n, t, rows = F.col("n"), F.col("t"), clean + toxic
    c = n - t
    ratio = 2 * (term(t, n * toxic / rows) + term(c, n * clean / rows) + term(toxic - t, (rows - n) * toxic / rows) + term(clean - c, (rows - n) * clean / rows))
    best = counts.where(n >= LEAST_ROWS).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "key").limit(SIZE)
    found = sorted((np.uint64(r["key"] % (1 << 64)), np.log((r["t"] + 0.5) / (toxic + 1)) - np.log((r["n"] - r["t"] + 0.5) / (clean + 1))) for r in best.collect())
    return np.array([k for k, _ in found], np.uint64), np.array([o for _, o in found])


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, steps: int = STEPS) -> Model:
    """Learn ``label`` (0 or 1, of ``labels``: doc_id) from at most ``per_class`` rows of each of its values."""
    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    shares = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [marked.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    # at most twice per_class ids: a size that the input doesn't change
    chosen = F.broadcast(written(some[0].unionByName(some[1]), "toxicity-sample"))
    texts = written(documents.select("doc_id", "text").join(chosen, "doc_id").select("text", "y"), "toxicity-texts")
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model(thresholds=np.array([-30.0, 30.0, 30.0])) if 1 in n else Model()
    vocabulary, odds = _vocabulary(texts, n[0], n[1])

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bucket, value, bounds = features(batch.column("text"), vocabulary)
        bounds = pa.array(bounds, pa.int32())
        evidence = _linear((odds > 0).astype(float), bucket, value, np.asarray(bounds))
        return [pa.ListArray.from_arrays(bounds, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(value, pa.float32())), pa.array(evidence)]

    graded = written(add_columns(texts, "bucket array<int>, value array<float>, evidence double", make).drop("text"), "toxicity-features")
    thirds = graded.where("y = 1").agg(F.percentile_approx("evidence", [1 / 3, 2 / 3], 1000)).first()[0]
    grade = F.when(F.col("y") == 0, 0).when(F.col("evidence") <= thirds[0], 1).when(F.col("evidence") <= thirds[1], 2).otherwise(3)
    rows = written(graded.select("bucket", "value", grade.alias("y")), "toxicity-graded")
    total = n[0] + n[1]
    natural = sum(shares.values())
    balance = np.array([shares[k] / natural * total / n[k] for k in (0, 1, 1, 1)])
    size = len(vocabulary)

    def value(parameters: np.ndarray) -> tuple[float, np.ndarray]:
        sums = _summed(rows, len(parameters) + 1, lambda batch: _loss(parameters, balance, batch)) / total
        gradient = sums[:-1]
        gradient[:size] += PENALTY * parameters[:size]
        return sums[-1] + PENALTY / 2 * float(parameters[:size] @ parameters[:size]), gradient

    found = _descend(value, np.concatenate([np.clip(odds, -2, 2), [1.5, 0.0, 0.0]]), steps)
    return Model(vocabulary, found[:size], _thresholds(found[size:]))


@keeps_columns("text", new=("severity", "grade", "toxic"))
def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` (``text``) with severity, grade and toxic."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        linear = _linear(model.weights, *features(batch.column("text"), model.vocabulary))
        p = model.probabilities(linear)
        toxic = 1 - p[:, 0] >= LEAST
        grade = np.where(toxic, 1 + p[:, 1:].argmax(1), 0)
        return [pa.array(p @ np.arange(GRADES, dtype=float)), pa.array(grade, pa.int32()), pa.array(toxic)]

    return add_columns(documents, "severity double, grade int, toxic boolean", make)
