"""Benchmark decontamination: a prefix-filtered set join with exact verification.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one
window).  A document contains a window only if it contains every word of it, so by the prefix
filter for containment ``t`` the join has to look at the ``len - ceil(t * len) + 1`` rarest words of a
window alone: at exact containment, at its rarest one.  Rarity is measured once, over all documents.

1. One pass counts, over all documents, the words that the benchmark uses (found by a table of bits of fixed size).
2. Each distinct window gets its rarest word as prefix.
3. Each document's words are joined with the windows' prefixes; the window has to fit into the document around that place
   (positional and length bounds), and its words have to be the document's, by their bytes.

A benchmark of at most ``max_windows`` distinct windows and ``max_bytes`` of them, both counted before, goes to the tasks as an
index, and documents aren't shuffled.  A larger one stays a Spark table: documents send the places whose word may be a prefix
(by a table of bits of fixed size) with the words around them, and Spark joins them by the word.  So there are two passes
over the documents, whatever the benchmark's size; Spark splits the join where a word is frequent.

Edge cases: null or empty texts have no words; null texts or ids among the items take no part;
repeated items count once; an empty benchmark hits nothing; repeated documents are judged each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import add_columns, keeps_columns, tidy, written
from .textbytes import ALNUM, LOWER, flat, prefix_sums, slices, span_hash, word_hash, word_spans

WINDOW = 10
MAX_WINDOWS, MAX_BYTES = 50_000, 16 << 20
FILTER_BITS = 24
#: Places around prefix words that are hashed at once.
PLACES = 500_000


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, ends, each text's first word (n + 1) and the words' hashes."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = word_spans(ALNUM[data], offsets)
    return data, starts, ends, first, word_hash(data, starts, ends)


def _text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, stop: int) -> bytes:
    """Words joined by one space."""
    return b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(first, stop))


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(win, size, words, items): the distinct windows as words joined by one space, the words' hashes, and the sorted names of their items."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("text")).where("name is not null and text is not null").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts, ends, first, hashes = words_of(batch.column("text"))
            n = np.diff(first)
            size = np.minimum(window, n)
            many = np.where(size > 0, n - size + 1, 0)
            item = np.repeat(np.arange(len(n)), many)
            step = np.append(0, np.cumsum(many))
            for lo in range(0, len(item), 4096):  # a long item gives many rows
                some = np.arange(lo, min(lo + 4096, len(item)))
                of = item[some]
                at, long = first[of] + some - step[of], size[of]
                text = [_text(data, starts, ends, a, a + s).decode() for a, s in zip(at.tolist(), long.tolist(), strict=True)]
                bounds = np.append(0, np.cumsum(long))
                place = np.arange(bounds[-1]) + np.repeat(at - bounds[:-1], long)
                words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes[place].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(of)), pa.array(text), pa.array(long), words], names=["name", "win", "size", "words"])

    found = rows.mapInArrow(tidy(cut), "name string, win string, size long, words array<long>")
    return found.groupBy("win", "size", "words").agg(F.array_sort(F.collect_set("name")).alias("items"))


def _bits(words: DataFrame) -> np.ndarray:
    """A table of bits of fixed size: that of each word hash of the first column is set."""
    mask = (1 << FILTER_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy() & mask] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for row in words.coalesce(8).mapInArrow(tidy(run), "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    return bits


def _may_be(packed_bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return packed_bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def _count(documents: DataFrame, bits: np.ndarray) -> DataFrame:
    """(word, n): how often words of the benchmark (and a few others) stand in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in slices(batches):
            hashes = words_of(batch.column("text"))[4]
            word, n = np.unique(hashes[_may_be(bits, hashes)], return_counts=True)
            held.append(word)
            counts.append(n)
            if sum(map(len, held)) > 1 << 18:
                word, of = np.unique(np.concatenate(held), return_inverse=True)
                held, counts = [word], [np.bincount(of, np.concatenate(counts)).astype(np.int64)]
                if len(word) > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(counts[0])], names=["word", "n"])
                    held, counts = [], []
        if held:
            word, of = np.unique(np.concatenate(held), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(of, np.concatenate(counts)).astype(np.int64))], names=["word", "n"])

    return documents.select("text").mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _with_prefix(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``windows`` with ``shift`` and ``prefix``: place and hash of each window's rarest word (ties: the smaller hash, then the first place)."""
    each = windows.select("win", F.posexplode("words").alias("shift", "word")).join(counts, "word", "left")
    rarest = each.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "shift")).alias("r"))
    return windows.join(rarest.select("win", F.col("r.shift").cast("long").alias("shift"), F.col("r.word").alias("prefix")), "win")


class Index:
    """All windows of a bounded benchmark."""

    def __init__(self, rows: list):
        self.texts = [r["win"].encode() for r in rows]
        self.items = [r["items"] for r in rows]
        self.sizes = np.array([r["size"] for r in rows], np.int64)
        self.shift = np.array([r["shift"] for r in rows], np.int64)
        words = np.array([w for r in rows for w in r["words"]], np.int64).view(np.uint64)
        at = np.append(0, np.cumsum(self.sizes))
        self.hashes = span_hash(prefix_sums(words), at[:-1], at[1:])
        rare = words[at[:-1] + self.shift] if len(rows) else words
        self.by_hash = np.argsort(self.hashes, kind="stable")
        # for each prefix the places and sizes that its windows have around it, ten times ten at most however many they are
        shapes = np.unique(np.column_stack([rare, self.shift.astype(np.uint64), self.sizes.astype(np.uint64)]), axis=0) if len(rows) else np.zeros((0, 3), np.uint64)
        self.prefixes, self.begin = np.unique(shapes[:, 0], return_index=True)
        self.begin = np.append(self.begin, len(shapes))
        self.shape_shift, self.shape_size = shapes[:, 1].astype(np.int64), shapes[:, 2].astype(np.int64)

    def windows_at(self, sums: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first word, window, document) where a window's hash stands around its prefix word, a bounded number of places at once."""
        at = np.minimum(np.searchsorted(self.prefixes, hashes), len(self.prefixes) - 1)
        places = np.flatnonzero(self.prefixes[at] == hashes)
        of = at[places]
        many = self.begin[of + 1] - self.begin[of]
        doc = np.searchsorted(first, places, "right") - 1
        total, lo = np.cumsum(many), 0
        ordered = self.hashes[self.by_hash]
        while lo < len(places):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PLACES, "right")))
            steps = np.append(0, np.cumsum(many[lo:hi]))
            shape = np.arange(steps[-1]) + np.repeat(self.begin[of[lo:hi]] - steps[:-1], many[lo:hi])
            begin = np.repeat(places[lo:hi], many[lo:hi]) - self.shape_shift[shape]
            size, own = self.shape_size[shape], np.repeat(doc[lo:hi], many[lo:hi])
            fits = (begin >= first[own]) & (begin + size <= first[own + 1])
            begin, size, shape, own = begin[fits], size[fits], shape[fits], own[fits]
            found = span_hash(sums, begin, begin + size)
            k = np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)
            # windows of one hash stand together; nearly always there is one
            live = np.flatnonzero(ordered[k] == found)
            while len(live):
                window = self.by_hash[k[live]]
                same = (self.shift[window] == self.shape_shift[shape[live]]) & (self.sizes[window] == size[live])
                yield begin[live[same]], window[same], own[live[same]]
                k[live] += 1
                live = live[k[live] < len(ordered)]
                live = live[ordered[k[live]] == found[live]]
            lo = hi


def _spans(hit: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """n_words, n_hit and the hit spans of each document, from changes of the number of windows over a word."""
    covered = np.append(False, np.cumsum(hit[:-1]) > 0)
    runs, stops, run_of = word_spans(covered[1:], first)
    totals = np.append(0, np.cumsum(covered[1:]))
    base = np.repeat(first[:-1], np.diff(run_of))
    spans = pa.ListArray.from_arrays(pa.array(run_of, pa.int32()), pa.StructArray.from_arrays([pa.array(runs - base), pa.array(stops - 1 - base)], ["first", "last"]))
    return [pa.array(np.diff(first)), pa.array(totals[first[1:]] - totals[first[:-1]]), spans]


def _meet(index: Index) -> Callable[[pa.RecordBatch], list[pa.Array]]:
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        data, starts, ends, first, hashes = words_of(batch.column("text"))
        n, docs = len(hashes), batch.num_rows
        hit = np.zeros(n + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(docs)]
        if n and len(index.prefixes):
            for begin, window, doc in index.windows_at(prefix_sums(hashes), hashes, first):
                for b, w, d in zip(begin.tolist(), window.tolist(), doc.tolist(), strict=True):
                    size = int(index.sizes[w])
                    if _text(data, starts, ends, b, b + size) == index.texts[w]:
                        hit[b] += 1
                        hit[b + size] -= 1
                        items[d].update(index.items[w])
        return [*_spans(hit, first), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

    return make


RESULT = "n_words long, n_hit long, hit_spans array<struct<first:long,last:long>>, item_ids array<string>"


def _joined(documents: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """(content, first, size, items): windows that occur in texts with this digest, by a join on the prefix word."""
    bits = _bits(windows.select("prefix"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts, ends, first, hashes = words_of(batch.column("text"))
            at = np.flatnonzero(_may_be(bits, hashes))
            doc = np.searchsorted(first, at, "right") - 1
            lo, hi = np.maximum(at - window + 1, first[doc]), np.minimum(at + window, first[doc + 1])
            around = [_text(data, starts, ends, a, b).decode() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("content").take(pa.array(doc)), pa.array(hashes[at].view(np.int64)), pa.array(at - first[doc]), pa.array(at - lo), pa.array(hi - lo), pa.array(around, pa.string())], names=["content", "prefix", "at", "before", "held", "around"])

    texts = documents.select("text", F.unhex(F.sha2("text", 256)).alias("content"))
    found = texts.mapInArrow(tidy(places), "content binary, prefix long, at long, before long, held long, around string").join(windows, "prefix")
    fits = (F.col("shift") <= F.col("before")) & (F.col("before") - F.col("shift") + F.col("size") <= F.col("held"))
    own = F.array_join(F.slice(F.split("around", " "), (F.col("before") - F.col("shift") + 1).cast("int"), F.col("size").cast("int")), " ")
    return found.where(fits).where(own == F.col("win")).select("content", (F.col("at") - F.col("shift")).alias("first"), "size", "items").distinct()


@keeps_columns("text", new=("n_words", "n_hit", "hit_spans", "item_ids"))
def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``documents`` (``text``) with n_words, n_hit, hit_spans and item_ids (of ``benchmark``: item_id, text).

    ``hit_spans`` are the runs of words (first and last, from 0) inside occurrences of windows;
    ``item_ids`` the sorted names of the items with such windows.
    """
    windows = written(windows_of(benchmark, window), "decontamination-windows")
    many, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("win") + F.octet_length(F.array_join("items", ","))), F.lit(0))).first()
    counts = _count(documents, _bits(windows.select(F.explode("words")))) if many else documents.sparkSession.createDataFrame([], "word long, n long")
    windows = _with_prefix(windows, counts)
    if many <= max_windows and size <= max_bytes:
        return add_columns(documents, RESULT, _meet(Index(windows.select("win", "size", "words", "items", "shift").collect())))
    found = _joined(documents, written(windows, "decontamination-prefixes"), window)
    spans = F.collect_set(F.struct("first", "size")).alias("spans")
    by_text = written(found.groupBy("content").agg(spans, F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids")), "decontamination-found")
    out = documents.withColumn("content", F.unhex(F.sha2("text", 256))).join(by_text, "content", "left").withColumn("item_ids", F.coalesce("item_ids", F.expr("cast(array() as array<string>)")))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        first = words_of(batch.column("text"))[3]
        hit = np.zeros(first[-1] + 1, np.int64)
        for doc, held in enumerate(batch.column("spans").to_pylist()):
            for span in held or ():
                hit[first[doc] + span["first"]] += 1
                hit[first[doc] + span["first"] + span["size"]] -= 1
        return _spans(hit, first)

    return add_columns(out, "n_words long, n_hit long, hit_spans array<struct<first:long,last:long>>", make)


@keeps_columns("text")
def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, with their own columns."""
    return find_contamination(documents, benchmark, window).where("n_hit = 0")
