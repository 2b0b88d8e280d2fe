"""Removal of repeated passages by recompression: shared symbols reveal them, digests of whole passages verify them.

A window is ``window`` consecutive words.  Every word under a window that also starts in a document
with a smaller doc_id goes; windows are judged on the input.

Recompression names words, then runs and pairs, in rounds.  In a round a run of one symbol becomes one symbol; then
symbols fall into two classes by their names, and one of the first class with one of the second after it becomes
one symbol.  Names are digests of what they stand for, so all tasks of all rounds give equal strings equal names
without exchanging a dictionary.

* Long repeats: rounds go on until symbols stand for ``2 * window`` words or more.  Equal symbols of that height are equal
  passages, so all windows inside one are settled by one name.
* The rest: whether a symbol of two rounds ends at a place depends on three words on either side, so
  two equal windows have the same symbols from their fourth word to their fourth last; seven words hold a whole one (a
  symbol of two rounds has four words at most).  A window goes by its longest such symbol, together with
  the three words on either side that fixed it.  Here words inside runs are named without the run's length, which a window may cut.

0. Of equal texts only the one with the smallest doc_id takes part below: the others repeat it as a
   whole.  They are found from digests alone.
1. Documents are dealt into blocks by their digest (this shuffle is reused by all steps).
2. Round of long symbols: a block sends each once, with the smallest doc_id that has it, into buckets; a bucket tells a
   block which of them stand in a smaller doc_id elsewhere.  All windows inside those are settled.
3. Round of short symbols: a block sends the names of its other windows, each once; a bucket tells which of them other blocks
   or other documents share.
4. Round of windows: a block sends those windows whose name is shared, each once with the smallest doc_id
   that has it; a bucket tells a block which of them start in a smaller doc_id elsewhere.
5. Blocks apply this, and what they know of their own documents.

What decides is the 64-bit digest (XXH3) of the words' bytes beside the 64-bit name, both with a random seed of the job; names
alone decide nothing.

Blocks and buckets have a bounded size that doesn't grow with the input, only their number does.  A passage that a third of all
documents share is one entry of a block.  Beyond ``fan`` blocks such an entry would still make a long bucket: then groups
of ``fan`` blocks settle it among themselves first, and one entry a group goes on.

Edge cases: null or empty texts have no words; texts below ``window`` words stay whole; rows of one
doc_id never remove each other; null ids count as larger than all; ties have no effect.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import keeps_columns, written
from .textbytes import NOT_BLANK, _mix, flat, gather, prefix_sums, slices, span_hash, strings, word_hash, word_spans

WINDOW, MARGIN, SYMBOL, ROUNDS = 13, 3, 4, 16
BLOCK_BYTES = 4 << 20
BUCKET_ENTRIES = 1 << 17
FAN = 1 << 14
LAST_ID = np.iinfo(np.int64).max
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _pair(name: np.ndarray, joins: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A round of pairs: the names after it, and which symbols still begin one; ``joins``: those that may take the next one in."""
    # names are digests, so the top bit of an odd multiple deals them evenly
    second = (name * (salt | np.uint64(1))).view(np.int64) < 0
    pair = np.flatnonzero((second[1:] > second[:-1]) & joins[:-1])
    name = name.copy()
    name[pair] = _mix(name[pair] * _A + name[pair + 1] + salt)
    stays = np.ones(len(name), bool)
    stays[pair + 1] = False
    return name, stays


class Words:
    """The words of one slice of documents and what is derived from them."""

    def __init__(self, batch: pa.RecordBatch, window: int, seed: int):
        self.data, offsets = flat(batch.column("text"))
        self.starts, self.ends, self.first = word_spans(NOT_BLANK[self.data], offsets)
        self.hashes = word_hash(self.data, self.starts, self.ends, seed)
        ids = batch.column("doc_id").cast(pa.int64())
        self.ids = np.asarray(ids.fill_null(LAST_ID))
        n = len(self.hashes)
        self.doc = np.repeat(np.arange(batch.num_rows), np.diff(self.first))
        at = np.arange(max(0, n - window + 1))
        self.windows = at[self.doc[at] == self.doc[at + window - 1]] if n else at
        self.window, self.seed = window, seed
        self.sums = prefix_sums(self.hashes)
        self.joined: tuple[bytes, np.ndarray] | None = None

    def names(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """64-bit names of spans of words."""
        return span_hash(self.sums, first, stop)

    def digests(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """XXH3 of the bytes of spans of words, joined by one space."""
        if self.joined is None:
            text, at = gather(np.append(self.data, np.uint8(0x20)), self.starts, self.ends - self.starts + 1)
            text[at[1:] - 1] = 0x20
            self.joined = text.tobytes(), at
        text, at = memoryview(self.joined[0]), self.joined[1]
        digest, seed = xxhash.xxh3_64_intdigest, self.seed
        return np.array([digest(text[a:b], seed) for a, b in zip(at[first].tolist(), (at[stop] - 1).tolist(), strict=True)], np.uint64)

    def long_symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and stop of the lowest symbols of ``2 * window`` words or more."""
        n = len(self.hashes)
        name, at, doc = self.hashes, np.arange(n), self.doc
        least = 2 * self.window
        for turn in range(ROUNDS):
            # only neighbours of one document that are both short go on
            open_ = np.diff(at, append=n) < least
            joins = np.append((doc[:-1] == doc[1:]) & open_[1:] & open_[:-1], False)[: len(at)]
            if not joins.any():
                break
            # runs: a symbol and how often it stands there
            same = joins[:-1] & (name[1:] == name[:-1])
            if same.any():
                begin = np.flatnonzero(np.append(True, ~same))
                times = np.diff(begin, append=len(name)).astype(np.uint64)
                name, at, doc = np.where(times > 1, _mix(name[begin] * _B + times), name[begin]), at[begin], doc[begin]
                open_ = np.diff(at, append=n) < least
                joins = np.append((doc[:-1] == doc[1:]) & open_[1:] & open_[:-1], False)
            name, stays = _pair(name, joins, np.uint64((int(_C) + turn * int(_A)) % (1 << 64)))
            name, at, doc = name[stays], at[stays], doc[stays]
        size = np.diff(np.append(at, n))
        found = size >= least
        return at[found], at[found] + size[found]

    def symbols(self, of: np.ndarray) -> np.ndarray:
        """For each of these windows the name of its symbol with what stands around it."""
        n = len(self.hashes)
        name, at = self.hashes, np.arange(n)
        for salt in (_B, _C):
            joins = np.append(self.doc[at[:-1]] == self.doc[at[1:]], False)[: len(at)]
            name, stays = _pair(name, joins, salt)
            name, at = name[stays], at[stays]
        size = np.diff(np.append(at, n))
        if n:
            same = (self.hashes[1:] == self.hashes[:-1]) & (self.doc[1:] == self.doc[:-1])
            run = np.append(same, False) | np.append(False, same)
            runs = (size == 1) & run[at]
            name[runs] = _mix(name[runs] + np.uint64(0x2545F4914F6CDD1D))
        # longest first, then the smallest name, then the first place
        key, end = np.full(n, NONE), np.zeros(n, np.int64)
        key[at] = ((SYMBOL - size).astype(np.uint64) << np.uint64(62)) | (name >> np.uint64(2))
        end[at] = at + size
        best, place = np.full(len(of), NONE), np.zeros(len(of), np.int64)
        for k in range(MARGIN, self.window - MARGIN):
            p = of + k
            better = (key[p] < best) & (end[p] <= of + self.window - MARGIN)
            best, place = np.where(better, key[p], best), np.where(better, p, place)
        return self.names(place - MARGIN, end[place] + MARGIN)

    def inside(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which windows lie in one of these spans (which don't overlap)."""
        if not len(first):
            return np.zeros(len(self.windows), bool)
        last = np.searchsorted(first, self.windows, "right") - 1
        return (last >= 0) & (self.windows + self.window <= stop[np.maximum(last, 0)])


def _split(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted digests: the buckets that have some, and where each begins (and the last ends)."""
    bits = buckets.bit_length() - 1
    bucket = (value >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(value), np.int64)
    some, begin = np.unique(bucket, return_index=True)
    return some, np.append(begin, len(value))


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid)])


def _sizes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.array([len(x.as_buffer()) // width if x.is_valid else 0 for x in column], np.int64)


def _is_copy(batch: pa.RecordBatch, copies: pa.Table) -> np.ndarray:
    """Which rows are listed as copies, by digest and doc_id."""
    listed = set(zip(copies.column("digest").to_pylist(), copies.column("copy_id").to_pylist(), strict=True))
    return np.array([x in listed for x in zip(batch.column("digest").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)], bool)


class Block:
    """A block's documents and what came for it: copies, and what buckets sent."""

    def __init__(self, block: pa.Table, sent: pa.Table, window: int, seed: int):
        self.table, self.window, self.seed = block, window, seed
        kind = sent.column("kind")
        of = lambda k: sent.filter(pc.equal(kind, k))
        self.copies = of("copy")
        one, two = (_joined(of("long").column(c), np.uint64) for c in ("one", "two"))
        order = np.lexsort((two, one))
        self.long = one[order], two[order]
        self.shared = np.sort(_joined(of("name").column("one"), np.uint64))
        self.late = _joined(of("window").column("one"), np.uint64), _joined(of("window").column("two"), np.uint64)
        self.number = block.column("block")[0].as_py() if block.num_rows else -1

    def parts(self) -> Iterator[Words]:
        """The words of the documents that aren't copies."""
        for batch in slices(iter(self.table.select(["doc_id", "text", "digest"]).to_batches())):
            yield Words(batch.filter(pa.array(~_is_copy(batch, self.copies))), self.window, self.seed)

    def settled(self, part: Words) -> np.ndarray:
        """Which windows lie inside long symbols that stand in a smaller doc_id elsewhere."""
        one, two = self.long
        if not len(one):
            return np.zeros(len(part.windows), bool)
        first, stop = part.long_symbols()
        name = part.names(first, stop)
        some = np.flatnonzero(one[np.minimum(np.searchsorted(one, name), len(one) - 1)] == name)
        first, stop = first[some], stop[some]
        fits = _among(name[some], part.digests(first, stop), one, two)
        return part.inside(first[fits], stop[fits])


def _among(name: np.ndarray, digest: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs (name, digest) are among the pairs (one, two)."""
    every_one, every_two = np.concatenate([name, one]), np.concatenate([digest, two])
    order = np.lexsort((every_two, every_one))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(_first_of(every_one[order], every_two[order]))
    listed = np.zeros(len(order) + 1, bool)
    listed[group[len(name) :]] = True
    return listed[group[: len(name)]]


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _cut(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)], pa.binary())


def _sent(number: int, one: np.ndarray, two: np.ndarray, doc: np.ndarray, buckets: int) -> pa.Table:
    """Entries (one, two), each once with its smallest doc_id, by bucket: doc_ids as distances from the smallest, in four bytes where they fit."""
    order = np.lexsort((doc, two, one))
    one, two, doc = one[order], two[order], doc[order]
    new = _first_of(one, two)
    one, two, doc = one[new], two[new], doc[new]
    some, begin = _split(one, buckets)
    spans = list(zip(begin, begin[1:], strict=False))
    base = np.array([doc[a:b].min() for a, b in spans], np.int64)
    gaps = [doc[a:b] - m for (a, b), m in zip(spans, base, strict=True)]
    ids = pa.array([(g.astype(np.uint32) if g.max() < 1 << 32 and g.min() >= 0 else doc[a:b]).tobytes() for g, (a, b) in zip(gaps, spans, strict=True)], pa.binary())
    return pa.table({"bucket": pa.array(some), "block": pa.array([number] * len(some), pa.int64()), "one": _cut(one, begin), "two": _cut(two, begin), "base": pa.array(base), "ids": ids})


ENTRIES = "bucket long, block long, one binary, two binary, base long, ids binary"
REPLY = "block long, kind string, one binary, two binary"


def _long(block: Block, buckets: int) -> pa.Table:
    """The long symbols of a block."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
    for part in block.parts():
        first, stop = part.long_symbols()
        for all_, new in zip(found, (part.names(first, stop), part.digests(first, stop), part.ids[part.doc[first]]), strict=True):
            all_.append(new)
    return _sent(block.number, *map(np.concatenate, found), buckets)


def _names(block: Block, buckets: int) -> pa.Table:
    """The names of a block's windows that aren't settled, and whether several of its documents have each."""
    names, docs, base = [], [], 0
    for part in block.parts():
        of = part.windows[~block.settled(part)]
        name, doc = part.symbols(of), part.doc[of] + base
        new = _first_of(name, doc)
        names.append(name[new])
        docs.append(doc[new])
        base += len(part.ids)
    name, doc = np.concatenate([np.zeros(0, np.uint64), *names]), np.concatenate([np.zeros(0, np.int64), *docs])
    order = np.lexsort((doc, name))
    name, doc = name[order], doc[order]
    new = _first_of(name)
    group = np.cumsum(new) - 1
    several = np.zeros(int(new.sum()), np.uint8)
    several[group[1:][~new[1:] & (doc[1:] != doc[:-1])]] = 1
    name = name[new]
    some, begin = _split(name, buckets)
    flags = pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(begin, begin[1:], strict=False)], pa.binary())
    return pa.table({"bucket": pa.array(some), "block": pa.array([block.number] * len(some), pa.int64()), "one": _cut(name, begin), "several": flags})


def _windows(block: Block, buckets: int) -> pa.Table:
    """The windows whose name is shared."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
    known = block.shared
    for part in block.parts() if len(known) else ():
        of = part.windows[~block.settled(part)]
        name = part.symbols(of)
        of = of[known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name]
        for all_, new in zip(found, (part.names(of, of + part.window), part.digests(of, of + part.window), part.ids[part.doc[of]]), strict=True):
            all_.append(new)
    return _sent(block.number, *map(np.concatenate, found), buckets)


def _reply(kind: str, blocks: np.ndarray, row: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """What a bucket sends back: entries by the row of the bucket that they came in."""
    back = np.argsort(row, kind="stable")
    some, begin = np.unique(row[back], return_index=True)
    begin = np.append(begin, len(row))
    one, two = [_cut(c[back], begin) for c in columns] if len(columns) == 2 else [_cut(columns[0][back], begin), pa.nulls(len(some), pa.binary())]
    return pa.table({"block": pa.array(blocks[some], pa.int64()), "kind": pa.array([kind] * len(some), pa.string()), "one": one, "two": two})


def _shared(bucket: pa.Table, onward: bool) -> pa.Table:
    """Names that several blocks, or several documents of one, have; ``onward``: those that only one block here has."""
    size = _sizes(bucket.column("one"), 8)
    name = _joined(bucket.column("one"), np.uint64)
    several = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=int(k)) for x, k in zip(bucket.column("several"), size, strict=True))])
    row = np.repeat(np.arange(len(size)), size)
    order = np.argsort(name, kind="stable")
    group = np.cumsum(_first_of(name[order])) - 1
    wanted = (np.bincount(group) > 1) | (np.bincount(group, several[order]) > 0) if len(order) else np.zeros(0, bool)
    blocks = np.asarray(bucket.column("block"))
    if not onward:
        return _reply("name", blocks, row[order][wanted[group]], name[order][wanted[group]])
    # one block stands for the group where the name is settled here: the others of other groups learn from it
    lead = _first_of(name[order])
    row, name, flag = row[order][lead], name[order][lead], wanted[group[lead]].astype(np.uint8)
    back = np.lexsort((name, row))
    row, name, flag = row[back], name[back], flag[back]
    some, begin = np.unique(row, return_index=True)
    begin = np.append(begin, len(row))
    flags = pa.array([np.packbits(flag[a:b]).tobytes() for a, b in zip(begin, begin[1:], strict=False)], pa.binary())
    return pa.table({"bucket": bucket.column("bucket").combine_chunks().take(pa.array(some)), "block": pa.array(blocks[some], pa.int64()), "one": _cut(name, begin), "several": flags})


def _earlier(bucket: pa.Table, kind: str, onward: bool) -> pa.Table:
    """Entries that have a smaller doc_id in another row of the bucket; ``onward``: the entries that have the smallest."""
    size = _sizes(bucket.column("one"), 8)
    one, two = _joined(bucket.column("one"), np.uint64), _joined(bucket.column("two"), np.uint64)
    doc = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) + b.as_py() if len(x.as_buffer()) == 4 * k else np.frombuffer(x.as_buffer(), np.int64) for x, b, k in zip(bucket.column("ids"), bucket.column("base"), size, strict=True)]
    doc = np.concatenate([np.zeros(0, np.int64), *doc])
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((doc, two, one))
    new = _first_of(one[order], two[order])
    least = doc[order][new][np.cumsum(new) - 1] if len(order) else order
    blocks = np.asarray(bucket.column("block"))
    if onward:
        lead = order[doc[order] == least]
        sent = [_sent(int(blocks[r]), one[x], two[x], doc[x], 1) for r, x in _by_row(row[lead], lead)]
        out = pa.concat_tables([_sent(-1, one[:0], two[:0], doc[:0], 1), *sent])
        return out.set_column(0, "bucket", pa.array([bucket.column("bucket")[0].as_py()] * out.num_rows, pa.int64()))
    late = order[doc[order] > least]
    return _reply(kind, blocks, row[late], one[late], two[late])


def _by_row(row: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(row, kind="stable")
    some, begin = np.unique(row[order], return_index=True)
    for r, a, b in zip(some.tolist(), begin, np.append(begin, len(row))[1:], strict=True):
        yield r, values[order[a:b]]


def _apply(block: Block, names: list[str]) -> pa.Table:
    """The block's documents with what stays of them."""
    window, out, found = block.window, [], []
    late_one, late_two = block.late
    batches = list(slices(iter(block.table.combine_chunks().to_batches())))
    parts = [Words(batch, window, block.seed) for batch in batches]
    own: list[np.ndarray] = []
    for batch, part in zip(batches, parts, strict=True):
        copy = _is_copy(batch, block.copies)[part.doc[part.windows]]
        gone = copy | block.settled(part)
        found.append((part.windows[gone], part.windows[~gone]))
        own.append(part.names(found[-1][1], found[-1][1] + window))
    # digests only of windows that stand in the block twice, or in what came
    every = np.concatenate([np.zeros(0, np.uint64), *own])
    values, count = np.unique(every, return_counts=True)
    several = np.union1d(values[count > 1], late_one)
    tested = []
    for part, (_, of), name in zip(parts, found, own, strict=True):
        some = np.flatnonzero(several[np.minimum(np.searchsorted(several, name), len(several) - 1)] == name) if len(several) else np.zeros(0, np.int64)
        tested.append((of[some], name[some], part.digests(of[some], of[some] + window), part.ids[part.doc[of[some]]]))
    one, two, doc = (np.concatenate([z, *(t[k] for t in tested)]) for k, z in ((1, late_one), (2, late_two), (3, np.full(len(late_one), np.iinfo(np.int64).min))))
    # what starts earlier elsewhere stands before the block's own windows with an id below all
    order = np.lexsort((doc, two, one))
    new = _first_of(one[order], two[order])
    hit = np.zeros(len(order), bool)
    if len(order):
        hit[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
    at = len(late_one)
    for batch, part, (gone, _), (of, *_) in zip(batches, parts, found, tested, strict=True):
        hits = np.concatenate([gone, of[hit[at : at + len(of)]]])
        at += len(of)
        n = len(part.hashes)
        change = np.bincount(hits, minlength=n + 1)[: n + 1] - np.bincount(hits + window, minlength=n + 1)[: n + 1]
        stays = np.cumsum(change)[:n] == 0
        total = np.append(0, np.cumsum(stays))
        kept = total[part.first[1:]] - total[part.first[:-1]]
        text, ends = gather(np.append(part.data, np.uint8(0x20)), part.starts[stays], (part.ends - part.starts)[stays] + 1)
        text[ends[1:] - 1] = 0x20
        # each text without the blank after its last word
        bounds = ends[total[part.first]]
        text = np.delete(text, bounds[1:][kept > 0] - 1)
        bounds = bounds - np.append(0, np.cumsum(kept > 0))
        words = np.diff(part.first)
        out.append(pa.Table.from_batches([batch]).select(names).append_column("n_words", pa.array(words)).append_column("n_removed", pa.array(words - kept)).append_column("kept_text", strings(text, bounds)))
    return pa.concat_tables(out)


def _settle(entries: DataFrame, decide: Callable[[pa.Table, bool], pa.Table], blocks: int, fan: int, parts: int) -> DataFrame:
    """What buckets reply.  Beyond ``fan`` blocks each group of them settles what it has, and passes each entry on once."""
    by_bucket = lambda df: df.repartition(parts, "bucket").groupBy("bucket")
    if blocks <= fan:
        return by_bucket(entries).applyInArrow(lambda t: decide(t, False), REPLY)
    grouped = entries.withColumn("bucket", F.col("bucket") * F.lit(-(-blocks // fan)) + F.floor(F.col("block") / fan))
    grouped = written(grouped, "substring-entries")
    within = by_bucket(grouped).applyInArrow(lambda t: decide(t, False), REPLY)
    onward = by_bucket(grouped).applyInArrow(lambda t: decide(t, True), entries.schema)
    onward = onward.withColumn("bucket", F.floor(F.col("bucket") / F.lit(-(-blocks // fan))))
    across = by_bucket(onward).applyInArrow(lambda t: decide(t, False), REPLY)
    return within.unionByName(across)


@keeps_columns("doc_id", "text", new=("n_words", "n_removed", "kept_text"))
def remove_repeats(documents: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES, fan: int = FAN) -> DataFrame:
    """``documents`` (doc_id, text) with n_words, n_removed and kept_text (kept words, joined by one space)."""
    if window < 2 * MARGIN + 2 * SYMBOL - 1:
        raise ValueError(f"windows of {window} words may have no whole symbol inside")
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(total / block_bytes) + 1
    # a word has 5 bytes or more in most texts, every fourth word or so names a window
    buckets = 1 << max(0, math.ceil(math.log2(max(1, total / 20 / bucket_entries))))
    spark, seed = documents.sparkSession, secrets.randbits(62)
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, bucket_parts = max(session, math.ceil(blocks / 16)), max(session, math.ceil(buckets / 16))
    keyed = documents.withColumns({"block": F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)), "digest": F.xxhash64("text")})
    thin = keyed.select(F.unhex(F.sha2("text", 256)).alias("content"), F.col("doc_id").alias("copy_id"), "block", "digest")
    least = thin.groupBy("content").agg(F.min("copy_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("content", "least")
    # as a table of its own, so that Spark can split the join where one content is frequent
    least = written(least, "substring-least")
    copies = thin.join(least, "content").where("copy_id > least or (copy_id is null and least is not null)").select("block", "digest", "copy_id").distinct()
    sent = written(copies.select("block", F.lit("copy").alias("kind"), "digest", "copy_id"), "substring-copies")
    dealt = keyed.repartition(parts, "block")

    def blockwise(make: Callable, schema) -> DataFrame:
        both = dealt.groupBy("block").cogroup(sent.groupBy("block"))
        return both.applyInArrow(lambda a, b: make(Block(a, b, window, seed)), schema)

    def told(replies: DataFrame) -> DataFrame:
        return sent.unionByName(replies, allowMissingColumns=True)

    sent = told(spark.createDataFrame([], REPLY))
    long = blockwise(lambda b: _long(b, buckets), ENTRIES)
    sent = written(told(_settle(long, lambda t, onward: _earlier(t, "long", onward), blocks, fan, bucket_parts)), "substring-long")
    names = blockwise(lambda b: _names(b, buckets), "bucket long, block long, one binary, several binary")
    settled = sent
    sent = told(_settle(names, _shared, blocks, fan, bucket_parts))
    windows = blockwise(lambda b: _windows(b, buckets), ENTRIES)
    sent = settled
    sent = told(_settle(windows, lambda t, onward: _earlier(t, "window", onward), blocks, fan, bucket_parts))
    own = documents.columns
    schema = StructType([*documents.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    return blockwise(lambda b: _apply(b, own), schema)
