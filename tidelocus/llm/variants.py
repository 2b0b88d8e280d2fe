"""Spelling variants: words one edit apart, from a positional q-gram index with a count filter.

1. Each task counts its words in a table of distinct words; Spark adds the counts up.
2. Two words of lengths L and L or L + 1 that are one edit apart have their first h = L // 2 code points in common, or the other
   L - h at their ends.  So every word goes to the groups of its begin and its end, as a shorter and as a longer word.
3. Within a group a positional index of bigrams holds, for each bigram and place, the words that have it there.  The
   postings of a word's bigrams, at the same place and for longer words the next, are merged by sorting; a pair that the merge meets often
   enough for one edit (an edit spoils two bigrams at most) is a candidate and verified.  The bigrams that all of a group share count without a look.
4. A pair is found in one group only (of its begin, where both begin alike).  Tasks return a row for each word, not for each pair: how many near words, and the best.
5. Forms point to much more frequent words, so chains are short; roots come by doubling steps.

A group of more than ``HOT`` words is dealt into parts, and every two of them are a block with an index of its own.

Edge cases: null texts have no words; null ids count as empty before the colon; a word that loses its last letter is empty and too short;
empty tables give empty results; words of any length are whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, crc
from .shared import forget, tidy, written
from .textbytes import LOWER, flat, slices, word_spans

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Largest group that one task indexes, rows processed at once, postings merged at once, letters compared at once.
HOT, ROWS, MERGED, COMPARED = 20_000, 30_000, 2_000_000, 8_000_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True


class _Words(bpe.WordTable):
    """Distinct words of a task with their checksums, code points and counts; full tables are kept as rows to hand on."""

    def __init__(self):
        self.words: list[bytes] = []
        self.full: list[tuple[list[bytes], np.ndarray]] = []
        super().__init__(self._learn)

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        self.words += new
        self.sums = np.append(self.sums, np.array([zlib.crc32(w) for w in new], np.uint32))
        self.points = np.append(self.points, [len(w) - w.count(0xC3) for w in new])
        self.tally = np.append(self.tally, np.zeros(len(new), np.int64))
        return np.zeros(0, np.int32), np.zeros(len(new), np.int64)

    def clear(self) -> None:
        if self.words:
            some = np.flatnonzero((self.points >= LEAST_LENGTH) & (self.tally > 0))
            self.full.append(([self.words[i] for i in some.tolist()], self.tally[some]))
        super().clear()
        self.words, self.sums, self.points, self.tally = [], np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    table, odd = _Words(), Counter()

    def rows(words: list[bytes], counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    for batch in slices(batches):
        data, offsets = flat(batch.column("text"))
        inside = _LETTER[data]
        inside[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
        low = LOWER[data]
        starts, ends, first = word_spans(inside, offsets)
        index = table.look_up(low, starts, ends)
        ids = batch.column("doc_id").to_pylist()
        lead = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        hashes = crc.shift(np.repeat(lead, np.diff(first)), ends - starts) ^ table.sums[index]
        hit = hashes % every == 0
        table.tally += np.bincount(index[~hit], minlength=len(table.tally))
        for k in np.flatnonzero(hit).tolist():
            word = table.words[index[k]].decode()
            at = int(hashes[k]) % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) >= LEAST_LENGTH:
                odd[word.encode()] += 1
        if len(odd) > 100_000:
            yield rows(list(odd), list(odd.values()))
            odd.clear()
        while table.full:
            yield rows(*table.full.pop())
    table.clear()
    while table.full:
        yield rows(*table.full.pop())
    if odd:
        yield rows(list(odd), list(odd.values()))


def count_words(documents: DataFrame, every: int = 199) -> DataFrame:
    """(word, n): the words of at least ``LEAST_LENGTH`` code points that occur ``LEAST_COUNT`` times or more, after one in ``every`` has lost a letter."""
    shards = documents.select(F.col("doc_id"), "text").mapInArrow(tidy(lambda b: _count(b, every)), "word string, n long")
    return shards.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _routes(words: DataFrame) -> DataFrame:
    """(key, block, word, n, size, short, begin, held, asks): rows of the groups in which a word meets its near ones.

    ``short`` is L of the group, ``begin`` whether words begin or end alike in it.  A group of b parts has b * b blocks, one for each two parts:
    the index of the block ``held`` the rows of one, the rows of the other ask.
    """
    shorts = F.explode(F.filter(F.array(F.col("size"), F.col("size") - 1), lambda s: s >= LEAST_LENGTH)).alias("short")
    both = words.withColumn("size", F.length("word")).select("word", "n", "size", shorts).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("begin"))
    half = F.floor(F.col("short") / 2).cast("int")
    part = F.when(F.col("begin"), F.left("word", half)).otherwise(F.right("word", F.col("short") - half))
    keyed = both.withColumn("key", F.concat_ws(":", F.col("short").cast("string"), F.col("begin").cast("string"), part))
    many = keyed.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > HOT)
    parts = F.coalesce(F.ceil(F.col("many") / HOT), F.lit(1)).cast("int")
    own = keyed.join(many, "key", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    all_ = F.sequence(F.lit(0), F.col("parts") - 1)
    blocks = F.array_union(F.transform(all_, lambda x: F.col("own") * F.col("parts") + x), F.transform(all_, lambda x: x * F.col("parts") + F.col("own")))
    dealt = own.select("*", F.explode(blocks).alias("block"))
    held, asks = F.expr("block div parts = own"), F.expr("block % parts = own")
    return dealt.select("key", "block", "word", "n", "size", "short", "begin", held.alias("held"), asks.alias("asks"))


def _merge(probes: tuple[np.ndarray, np.ndarray], postings: tuple[np.ndarray, np.ndarray], n: int, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (probe's row, index row) that meet at least ``need`` times (by the probe's row); rows are below ``n``.

    Postings are the index's (keys, rows) in order of keys; probes come in order of rows.
    """
    keys, rows = probes
    left, right = np.searchsorted(postings[0], keys, "left"), np.searchsorted(postings[0], keys, "right")
    many = right - left
    some = np.flatnonzero(many)
    rows, left, many = rows[some], left[some], many[some]
    if not len(rows):
        return
    total = np.cumsum(many)
    edges = np.flatnonzero(np.diff(rows, append=-1)) + 1  # a row's probes stay together
    at = 0
    while at < len(rows):
        base = total[at - 1] if at else 0
        end = int(edges[max(np.searchsorted(total[edges - 1], base + MERGED, "right") - 1, np.searchsorted(edges, at, "right"))])
        size = many[at:end]
        where = np.arange(size.sum()) + np.repeat(left[at:end] - (np.cumsum(size) - size), size)
        pair = np.sort(np.repeat(rows[at:end], size) * n + postings[1][where])
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        met = np.diff(np.append(first, len(pair)))
        a, b = pair[first] // n, pair[first] % n
        good = met >= need[a]
        yield a[good], b[good]
        at = end


class _Group:
    """Rows of whole groups, and their near pairs."""

    def __init__(self, batch: pa.Table):
        words = batch.column("word").to_pylist()
        raw = [w.encode("latin-1") for w in words]  # all its letters are below U+0100
        self.words, self.n = words, batch.column("n").to_numpy()
        self.size = np.array([len(x) for x in raw], np.int64)
        self.data = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self.short = batch.column("short").to_numpy().astype(np.int64)
        self.begin = batch.column("begin").to_numpy(zero_copy_only=False)
        self.held = batch.column("held").to_numpy(zero_copy_only=False)
        self.asks = batch.column("asks").to_numpy(zero_copy_only=False)
        own = list(zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), strict=True))
        self.group = np.cumsum([a != b for a, b in zip(own, own[:1] + own[:-1], strict=True)])
        self.half = self.short // 2
        self.shared = np.where(self.begin, self.half, self.short - self.half) - 1

    def grams(self, rows: np.ndarray, step: int = 0, room: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(key, row) of the rows' bigrams outside what their group shares, at their place plus ``step``."""
        size = self.size[rows]
        first = np.where(self.begin[rows], self.half[rows] - 1, 0)
        many = np.maximum(size - 1 - self.shared[rows], 0)
        row = np.repeat(rows, many)
        place = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        at = self.start[row] + place
        gram = self.data[at].astype(np.int64) << 8 | self.data[at + 1]
        return (self.group[row] * room + place + step) << 16 | gram, row

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near pairs, each once."""
        n, room = len(self.words), int(self.size.max()) + 2
        longer = self.size > self.short
        probes = np.flatnonzero(self.asks & ~longer)
        for long in (False, True):
            index = self.grams(np.flatnonzero(self.held & (longer == long)), 0, room)
            order = np.argsort(index[0], kind="stable")
            postings = index[0][order], index[1][order]
            found = [self.grams(probes, step, room) for step in ((0, 1) if long else (0,))]
            keys, rows = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(rows, kind="stable")
            # of the longer word's bigrams all but two are left, less those that the whole group shares
            need = np.maximum(self.short + long - 3 - self.shared, 1)
            for a, b in _merge((keys[order], rows[order]), postings, n, need):
                if not long:
                    a, b = a[b > a], b[b > a]
                step = max(1, COMPARED // room)
                for k in range(0, len(a), step):
                    yield self._near(a[k : k + step], b[k : k + step], long)

    def _near(self, a: np.ndarray, b: np.ndarray, long: bool) -> tuple[np.ndarray, np.ndarray]:
        keep_a, keep_b = [], []
        for size in np.unique(self.short[a]).tolist():
            some = self.short[a] == size
            x, y = a[some], b[some]
            places = np.arange(size)
            one, same = self.data[self.start[x][:, None] + places], self.data[self.start[y][:, None] + places]
            equal = one == same
            if long:
                moved = one == self.data[self.start[y][:, None] + places + 1]
                good = np.logical_and.accumulate(equal, 1).sum(1) + np.logical_and.accumulate(moved[:, ::-1], 1).sum(1) >= size
            else:
                good = equal.sum(1) == size - 1
            # those that begin alike as well are found there
            good &= self.begin[x] | ~equal[:, : size // 2].all(1)
            keep_a.append(x[good])
            keep_b.append(y[good])
        return np.concatenate([np.zeros(0, np.int64), *keep_a]), np.concatenate([np.zeros(0, np.int64), *keep_b])

    def summary(self) -> pa.RecordBatch:
        """(word, n_near, best_n, best) of the words with near ones."""
        n = len(self.words)
        many, best = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for a, b in self.pairs():
            row, other = np.append(a, b), np.append(b, a)
            many += np.bincount(row, minlength=n)
            had = np.flatnonzero(best >= 0)
            row, other = np.append(row, had), np.append(other, best[had])
            order = np.lexsort((other, -self.n[other], row))  # rows of a group are in order of their words
            row, other = row[order], other[order]
            lead = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
            best[row[lead]] = other[lead]
        some = np.flatnonzero(many).tolist()
        columns = [[self.words[i] for i in some], many[some], self.n[best[some]], [self.words[i] for i in best[some].tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.slice(rows - 1)
            # the last group may go on
            tail = int(np.searchsorted(pc.and_(pc.equal(table["key"], last["key"][0]), pc.equal(table["block"], last["block"][0])).to_numpy(), True))
            if tail:
                yield _Group(table.slice(0, tail)).summary()
            held, rows = table.slice(tail).to_batches(), rows - tail
    if rows:
        yield _Group(pa.Table.from_batches(held).combine_chunks()).summary()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of ``words`` (word, n) with words one edit away: how many, and the most frequent (ties: the smallest)."""
    dealt = _routes(words).repartition("key", "block").sortWithinPartitions("key", "block", "word")
    found = dealt.mapInArrow(tidy(_search), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form; no null): the end of each chain.  Every step doubles how far words see."""
    now, more = written(forms.select("word", F.col("form").alias("root")), "variant-roots"), True
    while more:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved"))
        after = written(step, "variant-roots")
        more = after.where("__moved").limit(1).count() > 0
        forget(now)
        now = after
    return now.drop("__moved")


def group_variants(documents: DataFrame, every: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``documents`` (doc_id, text)."""
    words = written(count_words(documents, every), "variant-words")
    near = near_words(words)
    is_form = F.col("best_n") >= RATIO * F.col("n")
    shown = words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    table = written(shown, "variant-forms")
    ends = roots(table.where("form is not null").select("word", "form"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
