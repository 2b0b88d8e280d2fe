"""Phrase collocations: depth-limited count tries for each shard, merged by ranges of prefixes.

A phrase is frequent if it occurs ``least`` times, and then so are its parts.  Tables of bits keep what can't be frequent out of
the tries; they have a fixed size, and a bit set by chance only makes more rows.

1. A scan counts words by hash; the hashes of frequent words set bits.  Further ones do the same for pairs, and up to phrases of
   ``depth`` - 1 words, whose parts all have their bits.
2. A last scan grows a trie for each shard of a task: level 1 the words of a language, below them phrases that have their bits.
   It is serialised in sorted order, a row a node with its count, and written.
3. The shards' tries are dealt by ranges of whole paths, so that a frequent prefix may span many tasks, and merged in order.
   A walk down the merged trie gives each node its prefixes' counts (left parts).
4. Right parts come by suffix links, a join of each phrase's rest with the merged table.  So do left parts whose node an earlier task holds.

Words are told apart by their letters, scores are exact in decimals.

Edge cases: null texts are empty, a null language is ``und``; words of any length are whole; empty tables give empty results; columns
beside lang and text don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .shared import tidy, written
from .textbytes import LOWER, flat, slices, word_hash, word_spans

#: Bits of a filter at most (16 MB packed), hashes counted before a task hands them on, words of a shard.
FILTER_BITS, HASHES, SHARD = 27, 1_000_000, 1_000_000
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 0x09, *range(0x0A, 0x0E), *b".,;:!?"]] = False
_ENDS = np.zeros(256, bool)
_ENDS[[*range(0x0A, 0x0E), *b".,;:!?"]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words:
    """The words of a batch: bytes, spans, language of each, and whether it goes on the piece of the word before it."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = flat(batch.column("text"))
        self.data = LOWER[data]
        self.starts, self.ends, first = word_spans(_INSIDE[data], offsets)
        self.doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        codes, self.langs = pa_codes(batch.column("lang"))
        self.lang = codes[self.doc]
        breaks = np.append(0, np.cumsum(_ENDS[data]))
        self.follows = np.zeros(len(self.starts), bool)
        self.follows[1:] = (self.doc[1:] == self.doc[:-1]) & (breaks[self.starts[1:]] == breaks[self.ends[:-1]])

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words in their languages."""
        own = word_hash(self.data, self.starts, self.ends)
        seeds = np.array([hash_of(x) for x in self.langs], np.uint64)
        return mixed(own, seeds[self.lang]) if len(own) else own


def pa_codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A number for each row's string, and the strings; null is ``und``."""
    coded = column.fill_null("und").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def hash_of(text: str) -> int:
    """The hash of one word."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(word_hash(raw, np.array([0]), np.array([len(raw)]))[0])


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    out = a * _MIX + b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def _bit(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bits set in a packed table."""
    at = hashes & np.uint64(8 * len(table) - 1)
    return table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def _grown(words: _Words, filters: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of phrase, one more than there are filters, its hash at each word and whether its parts (with a filter: it too) have their bits."""
    keys = words.hashes()
    good = _bit(filters[0].value, keys) if filters else np.ones(len(keys), bool)
    out, own = [(keys, good)], keys
    for k in range(1, len(filters) + 1):
        both = np.flatnonzero(words.follows[1:] & good[1:] & good[:-1])
        last, own, good = own, np.zeros(len(keys), np.uint64), np.zeros(len(keys), bool)
        own[both] = mixed(last[both], keys[both + k])
        good[both] = _bit(filters[k].value, own[both]) if k < len(filters) else True
        out.append((own, good))
    return out


def _counted(documents: DataFrame, filters: list) -> DataFrame:
    """(lang, hash, n) of words, with all words of each lang in rows without a hash; or of phrases of one word more than there are filters."""
    filters = list(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        totals: Counter[str] = Counter()

        def shown(langs: list, keys, many) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(many, pa.int64())], names=["lang", "hash", "n"])

        def hand_on() -> pa.RecordBatch:
            keys, many = np.unique(np.concatenate(held), return_counts=True)
            return shown([None] * len(keys), keys.view(np.int64), many)

        for batch in slices(batches):
            words = _Words(batch)
            if not filters:
                totals.update(dict(zip(words.langs, np.bincount(words.lang, minlength=len(words.langs)).tolist(), strict=True)))
            keys, good = _grown(words, filters)[-1]
            held.append(keys[good])
            rows += len(held[-1])
            if rows > HASHES:
                yield hand_on()
                held, rows = [], 0
        if rows:
            yield hand_on()
        if totals:
            yield shown(list(totals), [None] * len(totals), list(totals.values()))

    return documents.mapInArrow(tidy(run), "lang string, hash long, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n"))


def _filter(frequent: DataFrame):
    """The hashes as a packed table of bits, broadcast; 16 bits for each, and at most 2 ** ``FILTER_BITS``."""
    spark = frequent.sparkSession
    bits = min(FILTER_BITS, max(10, (16 * frequent.count()).bit_length()))
    size = min(bits, 20)  # bits of a chunk of the table, which one task makes

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in rows:
            places = batch.column("place").to_numpy()
            for chunk in np.unique(places >> size).tolist():
                own = places[places >> size == chunk] & (1 << size) - 1
                chunks.setdefault(chunk, np.zeros(1 << size, bool))[own] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in chunks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array(packed, pa.binary())], names=["chunk", "bits"])

    place = F.col("hash").bitwiseAND((1 << bits) - 1)
    dealt = frequent.select(place.alias("place")).repartition(max(1, (1 << bits - size) // 4), F.shiftright("place", size))
    table = np.zeros(1 << bits - 3, np.uint8)
    each = 1 << size - 3
    for row in dealt.mapInArrow(tidy(run), "chunk long, bits binary").toLocalIterator():
        table[row["chunk"] * each : (row["chunk"] + 1) * each] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(table)


class _Trie:
    """Counts of the phrases of a shard.  Words are numbers of a task's table, languages the first level's parents."""

    def __init__(self, depth: int):
        self.depth = depth
        self.table = bpe.WordTable(self._learn)
        self.words: list[bytes] = []
        self.langs: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        self.words += new
        return np.zeros(0, np.int32), np.zeros(len(new), np.int64)

    def add(self, words: _Words, good: list[np.ndarray]) -> None:
        """Words whose bit is set, and for each length whether the phrase that begins there has its bits."""
        some = np.flatnonzero(good[0])
        number = self.table.look_up(words.data, words.starts[some], words.ends[some])
        langs = np.array([self.langs.setdefault(x, len(self.langs)) for x in words.langs], np.int64)
        self.held.append((langs[words.lang[some]], number, *(x[some] for x in good[1:])))
        self.rows += len(some)

    def full(self) -> bool:
        return self.rows > SHARD or self.table.count > bpe.MAX_WORDS or self.table.bytes > bpe.MAX_BYTES

    def serialise(self) -> Iterator[pa.RecordBatch]:
        """(lang, w1 to w``depth``, n) of all nodes in order of words within each language, and an empty trie."""
        lang, word, *grows = (np.concatenate(x) for x in zip(*self.held, strict=True))
        # numbers in the order of the words' bytes, so that order of numbers is order of words
        order = sorted(range(len(self.words)), key=self.words.__getitem__)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        word, names = rank[word], pa.array([self.words[i].decode() for i in order], pa.string())
        own_langs = pa.array(list(self.langs), pa.string())
        parent, at = lang, np.arange(len(word))
        path: list[np.ndarray] = []
        for level in range(1, self.depth + 1):
            # a node is its parent's number and its word
            key, node, many = np.unique(parent << 32 | word[at + level - 1], return_inverse=True, return_counts=True)
            up = key >> 32
            path = [*(x[up] for x in path or [np.arange(len(self.langs))]), key & 0xFFFFFFFF]
            columns = [own_langs.take(pa.array(path[0])), *(names.take(pa.array(x)) for x in path[1:])]
            columns += [pa.nulls(len(key), pa.string())] * (self.depth - level)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(many)], names=["lang", *(f"w{k}" for k in range(1, self.depth + 1)), "n"])
            if level < self.depth:
                on = grows[level - 1][at]
                parent, at = node[on], at[on]
        self.held, self.rows, self.langs = [], 0, {}
        self.table.clear()
        self.words = []


def shard_tries(documents: DataFrame, filters: list) -> DataFrame:
    """(lang, w1, w2, ..., n): the nodes of every shard's trie, one level deeper than there are filters."""
    depth, filters = len(filters) + 1, list(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _Trie(depth)
        for batch in slices(batches):
            words = _Words(batch)
            trie.add(words, [good for _, good in _grown(words, filters)])
            if trie.full():
                yield from trie.serialise()
        if trie.rows:
            yield from trie.serialise()

    names = ", ".join(f"w{k} string" for k in range(1, depth + 1))
    return documents.mapInArrow(tidy(run), f"lang string, {names}, n long")


def merge_tries(shards: DataFrame, least: int, depth: int) -> DataFrame:
    """(lang, words, f, lefts): frequent phrases with their counts, and the counts of their proper prefixes, shortest first.

    A prefix whose node isn't in the same range of paths has a null count.
    """
    path = ["lang", *(f"w{k}" for k in range(1, depth + 1))]
    dealt = shards.repartitionByRange(*path).sortWithinPartitions(*path)
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("lefts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: list[tuple[str, int]] = []  # the path's last node of each level that was met, with its count
        now: tuple | None = None
        total = 0
        out: list[tuple] = []

        def visit() -> None:
            words = [w for w in now[1:] if w]
            # the walk keeps the nodes above this one
            keep = 0
            while keep < min(len(walk), len(words)) and walk[keep][0] == (now[0], *words[: keep + 1]):
                keep += 1
            del walk[keep:]
            lefts = [n for _, n in walk] + [None] * (len(words) - 1 - len(walk))
            if len(walk) == len(words) - 1:
                walk.append(((now[0], *words), total))
            if total >= least:
                out.append((now[0], words, total, lefts[: len(words) - 1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            # a node's rows from all shards follow each other; words are never empty
            columns = [batch.column(c).fill_null("") for c in path]
            other = np.zeros(batch.num_rows, bool)
            for c in columns:
                other[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            other[0] = True
            first = np.flatnonzero(other)
            sums = np.add.reduceat(batch.column("n").to_numpy(), first).tolist()
            for row, many in zip(zip(*(c.take(pa.array(first)).to_pylist() for c in columns), strict=True), sums, strict=True):
                if row != now:
                    if now is not None:
                        visit()
                    now, total = row, 0
                total += many
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out.clear()
        if now is not None:
            visit()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return dealt.mapInArrow(tidy(run), "lang string, words array<string>, f long, lefts array<long>")


def frequent_phrases(documents: DataFrame, least: int = 30, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f, lefts) of all phrases of up to ``depth`` words that occur ``least`` times (see ``merge_tries``), and (lang, n)."""
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    filters, counted = [], None
    for k in range(1, depth):
        found = _counted(docs, filters).where((F.col("n") >= least) | F.col("hash").isNull())
        table = written(found, f"collocation-hashes-{k}")
        counted = counted or table
        filters.append(_filter(table.where("hash is not null").select("hash")))
    shards = written(shard_tries(docs, filters), "collocation-tries")
    found = written(merge_tries(shards, least, depth), "collocation-phrases")
    for x in filters:
        x.destroy()
    return found, counted.where("hash is null").select("lang", "n")


def collocations(documents: DataFrame, least: int = 30, depth: int = 4, first: int = 2000, covered: int = 80, scale: int = 2_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``documents`` (lang, text): each language's best ``first`` phrases of 2 to ``depth`` words.

    A phrase of count a is cut where ``scale`` * a / (l + r) is least, l and r being its parts' counts; phrases inside a longer one that has
    ``covered`` hundredths of their count are left out; n is the number of the language's words.
    """
    phrases, totals = frequent_phrases(documents, least, depth)
    many = F.size("words")
    candidates = phrases.where(many >= 2).select("lang", "words", F.col("f").alias("a"), "lefts")
    # right parts by suffix links, left parts by the walk or, beyond a task's range, by a link as well
    cuts = candidates.select("lang", "words", "a", F.posexplode("lefts").alias("at", "l"))
    cuts = cuts.select("lang", "words", "a", (F.col("at") + 1).alias("k"), "l", F.expr("slice(words, at + 2, size(words))").alias("rest"), F.expr("if(l is null, slice(words, 1, at + 1), null)").alias("start"))
    known = phrases.where(many < depth)
    right = known.select("lang", F.col("words").alias("rest"), F.col("f").alias("r"))
    left = known.select("lang", F.col("words").alias("start"), F.col("f").alias("l_far"))
    cuts = cuts.join(right, ["lang", "rest"]).join(left, ["lang", "start"], "left").withColumn("l", F.coalesce("l", "l_far"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("score", F.expr(f"cast({scale} * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"))
    scored = cuts.groupBy("lang", "words").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # phrases inside longer ones
    size = F.size("words")
    inner = F.expr("flatten(transform(sequence(2, greatest(size(words) - 1, 2)), s -> transform(sequence(1, size(words) - s + 1), i -> slice(words, i, s))))")
    inside = candidates.where(size > 2).select("lang", F.explode(F.array_distinct(inner)).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "words"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < covered * wide("a")))
    shown = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    ranked = shown.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

