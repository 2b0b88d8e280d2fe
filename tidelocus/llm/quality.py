"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

1. One pass turns each whole text into ``len(STATISTICS)`` numbers (a thin table, written once), whose
   means and deviations over all documents standardise them.
2. The statistics of labelled rows become random Fourier features (an approximation of a Gaussian
   kernel) beside the statistics themselves.  Each task sums its rows' normal equations, a square
   matrix of fixed size; sums of at most ``PARTS`` tasks reach the driver, whatever the number of rows.
3. The ridge solution scores other labelled rows, whose counts in ``BINS`` bins give the isotonic
   calibration (pool adjacent violators).
4. Scoring is a pass over the documents, or over their statistics, without a shuffle.

No sample is taken: all labelled rows that ``learn`` allows count.  ``fit`` learns the ridge from
two thirds of them and the calibration from the others (by a digest of doc_id).

Edge cases: null and empty texts have the statistics of an empty text and get a score; rows without a
label or with a null one aren't learnt from; repeated labels count repeatedly; with no label or
only one kind of label all scores are its smoothed share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import add_columns, forget, keeps_columns, tidy, written
from .textbytes import NOT_BLANK, _mix, flat, prefix_sums, span_hash, word_hash, word_spans

#: What of a text is measured.
STATISTICS = (
    "log bytes", "log words", "mean word bytes", "deviation of word bytes", "upper-case share", "digit share", "blank share", "sentence sign share", "exclamation share",
    "bar share", "symbol share", "wide byte share", "distinct word share", "words like the one before", "capital word share", "words without a lower-case letter", "words ending in a sign",
    "long word share", "distinct pair share", "log lines", "distinct line share", "log bytes a line",
)
FEATURES, PARTS, BINS, RIDGE, SEED = 192, 8, 512, 1e-3, 17


def _set(signs: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in signs]] = True
    return out


_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), np.arange(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
_WIDE = np.arange(256) >= 0x80
_SIGNS, _BAR, _SYMBOLS = _set(".,;:?'\"()-"), _set("|>"), _set("#$%&*+/<=@[\\]^_`{}~")


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    data, offsets = flat(column)
    starts, ends, first = word_spans(NOT_BLANK[data], offsets)
    docs, n_bytes, n_words = len(offsets) - 1, np.diff(offsets), np.diff(first)
    doc = np.repeat(np.arange(docs), n_words)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n_bytes, 1)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, docs) / np.maximum(n_words, 1)

    def distinct(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        keys, lead = np.unique(hashes + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
        return np.bincount(of[lead], minlength=docs) / np.maximum(np.bincount(of, minlength=docs), 1)

    sums = prefix_sums(data)
    hashes, size = word_hash(data, starts, ends), (ends - starts).astype(float)
    lower = np.append(0, np.cumsum(_LOWER[data] | _WIDE[data]))
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))[: len(hashes)]
    pair = _mix(hashes[:-1] * np.uint64(3) + hashes[1:])[doc[1:] == doc[:-1]] if len(hashes) else hashes
    of_pair = doc[1:][doc[1:] == doc[:-1]]
    average = mean(size)
    l_starts, l_ends, l_first = word_spans(data != 0x0A, offsets)
    lines = np.diff(l_first)
    return np.stack(
        [
            np.log1p(n_bytes), np.log1p(n_words), average, np.sqrt(np.maximum(mean(size**2) - average**2, 0)), share(_UPPER[data]), share(_DIGIT[data]), share(~NOT_BLANK[data]), share(_SIGNS[data]), share(data == 0x21),
            share(_BAR[data]), share(_SYMBOLS[data]), share(_WIDE[data]), distinct(hashes, doc), mean(same), mean(_UPPER[data[starts]]), mean(lower[ends] == lower[starts]), mean(~(_UPPER | _LOWER | _DIGIT | _WIDE)[data[ends - 1]]),
            mean(size >= 20), distinct(pair, of_pair), np.log1p(lines), distinct(span_hash(sums, l_starts, l_ends), np.repeat(np.arange(docs), lines)), np.log1p(n_bytes / np.maximum(lines, 1)),
        ],
        axis=1,
    )


@dataclass
class Model:
    """What scoring needs: arrays of a fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # of the calibration: raw scores and their probabilities
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability; within its flat steps a hundredth of the raw score keeps the order."""
        raw = self.raw(x)
        if len(self.steps) == 1:
            return np.full(len(raw), self.levels[0])
        return 0.99 * np.interp(raw, self.steps, self.levels) + 0.01 * np.clip(raw, 0, 1)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), np.float64).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, size: int, terms) -> np.ndarray:
    """The sum of ``terms(batch)``, arrays of ``size`` doubles, over all rows: within tasks, then of few tasks."""

    def total(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                out += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

    def unpack(batch: pa.RecordBatch) -> np.ndarray:
        return sum(np.frombuffer(x.as_buffer()) for x in batch.column(0))

    parts = rows.mapInArrow(tidy(lambda b: total(b, terms)), "part binary").repartition(PARTS).mapInArrow(tidy(lambda b: total(b, unpack)), "part binary")
    return sum((np.frombuffer(bytes(r["part"])) for r in parts.collect()), np.zeros(size))


def _isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising means of y / n."""
    pools: list[list[float]] = []
    for a, b in zip(y.tolist(), n.tolist(), strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, k = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + k]
    return np.repeat([a / b for a, b, _ in pools], [k for _, _, k in pools])


def add_statistics(documents: DataFrame) -> DataFrame:
    """``documents`` (``text``) with ``x``, its statistics, in place of the text."""
    k = len(STATISTICS)
    make = lambda b: [pa.FixedSizeListArray.from_arrays(pa.array(statistics(b.column("text")).ravel()), k).cast(pa.list_(pa.float64()))]
    return add_columns(documents, "x array<double>", make).drop("text")


def fit(documents: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", seed: int = SEED) -> Model:
    """Learn ``label`` (0 or 1, of ``labels``: doc_id) of ``documents`` (doc_id, text) from rows where ``learn`` holds."""
    thin = written(add_statistics(documents.select("doc_id", "text")), "quality-statistics")
    model = _learnt(thin, labels, learn, label, seed)
    forget(thin)
    return model


def _learnt(thin: DataFrame, labels: DataFrame, learn: Column | None, label: str = "quality", seed: int = SEED) -> Model:
    """``fit`` on statistics (doc_id, x)."""
    k = len(STATISTICS)
    moments = _summed(thin.select("x"), 2 * k + 1, lambda b: np.concatenate([[b.num_rows], (m := _matrix(b)).sum(0), (m**2).sum(0)]))
    n = max(moments[0], 1)
    mean = moments[1 : k + 1] / n
    scale = np.sqrt(np.maximum(moments[k + 1 :] / n - mean**2, 0))
    rng = np.random.default_rng(seed)
    waves, phases = rng.normal(size=(k, FEATURES)) / np.sqrt(2 * k), rng.uniform(0, 2 * np.pi, FEATURES)
    d = 1 + k + FEATURES
    model = Model(mean, np.where(scale > 1e-9, scale, 1), waves, phases, np.zeros(d), np.zeros(1), np.full(1, 0.5))
    known = thin.join(labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("double").alias("y")), "doc_id")
    known = known.where(learn if learn is not None else F.lit(True)).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(3)))
    known = written(known.select("x", "y", "part"), "quality-labelled")

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        f, y = model.features(_matrix(batch)), np.asarray(batch.column("y"))
        return np.concatenate([(f.T @ f).ravel(), f.T @ y, [len(y), y.sum()]])

    sums = _summed(known.where("part < 2"), d * d + d + 2, equations)
    count, ones = sums[-2:]
    if not 0 < ones < count:
        model.levels = np.full(1, (ones + 0.5) / (count + 1))
        return model
    ridge = np.diag(np.append(0, np.full(d - 1, RIDGE * count)))
    model.weights = np.linalg.solve(sums[: d * d].reshape(d, d) + ridge + 1e-9 * np.eye(d), sums[d * d : -2])

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        raw, y = model.raw(_matrix(batch)), np.asarray(batch.column("y"))
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)])

    rows, good, raw = _summed(known.where("part = 2"), 3 * BINS, binned).reshape(3, BINS)
    some = rows > 0
    if some.any():
        model.steps = raw[some] / rows[some]
        model.levels = _isotonic(good[some], rows[some])
    else:
        model.steps, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


@keeps_columns("text", new=("score",))
def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` (``text``) with ``score``: the calibrated probability of label 1."""
    return add_columns(documents, "score double", lambda batch: [pa.array(model.score(statistics(batch.column("text"))))])


@keeps_columns("doc_id", "text", new=("score",))
def fit_and_score(documents: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """``documents`` (doc_id, text) with ``score`` by a model learnt from them, and null for text: their statistics are taken once for both."""
    thin = written(add_statistics(documents), "quality-statistics")
    model = _learnt(thin.select("doc_id", "x"), labels, learn)
    scored = add_columns(thin, "score double", lambda batch: [pa.array(model.score(_matrix(batch)))], text=None)
    return scored.withColumn("text", F.lit(None).cast("string"))


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves 1 by 3 (null: not)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


@keeps_columns("doc_id", "text")
def keep_good(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score is at least ``least``, with their own columns."""
    model = fit(documents, labels, ~held_out())
    return score(documents, model).where(F.col("score") >= least)
