"""SimHash near-duplicates: 64-bit fingerprints, BK-trees for the search, connected components.

1. Each document's fingerprint is the bitwise majority over the XXH64 hashes of its shingles.
2. Distinct fingerprints are dealt into shards: if two of them differ in at most ``radius`` bits, then of
   ``b`` blocks of bits at least ``b - radius`` are equal, so each fingerprint goes, for every choice of
   ``b - radius`` blocks, to the shard of all that agree with it there.  ``b`` grows with the number of
   fingerprints, so a shard of random ones holds a few.  A shard that is still large is
   divided by the same argument over its other bits.
3. In each shard a BK-tree (children keyed by their integer Hamming distance to the parent) is built,
   and every member follows only edges within ``radius`` of its own distance to a node.  The trees
   together are as large as the corpus, so a tree isn't broadcast to all executors: the shuffle
   sends each to the one task that holds all its queries.  A task returns a spanning
   star of what it linked, never all pairs.
4. Connected components by alternating large and small stars, each round a written table.

Edge cases: a text of no words (or null) has fingerprint 0 and links like others; shorter texts are one
shingle; equal texts share a fingerprint, so copies add rows only to the first and last step; null ids
are ignored when the smallest is sought, and a component of nothing else has a null id; a doc_id that
repeats with other texts has a row for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import add_columns, forget, keeps_columns, tidy, written
from .textbytes import LOWER, NOT_BLANK, flat, gather, word_spans

SHINGLE, RADIUS, SEED = 3, 3, 42
CHUNK_ROWS = 1 << 17
HOT_SHARD = 20_000
FRONTIER = 1 << 20


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The uint64 fingerprint of each text of a string column."""
    data, offsets = flat(column)
    starts, ends, first = word_spans(NOT_BLANK[data], offsets)
    joined, at = gather(np.append(LOWER[data], np.uint8(0x20)), starts, ends - starts + 1)
    joined[at[1:] - 1] = 0x20
    words = np.diff(first)
    many = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    steps = np.append(0, np.cumsum(many))
    begin = np.arange(steps[-1]) + np.repeat(first[:-1] - steps[:-1], many)
    stop = np.minimum(begin + shingle, np.repeat(first[1:], many))
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], seed) for a, b in zip(at[begin].tolist(), (at[stop] - 1).tolist(), strict=True)], np.uint64)
    out = np.zeros(len(words), np.uint64)
    some = np.flatnonzero(many)
    bounds = steps[:-1][some]
    # the documents in pieces, so that 64 counters for each shingle stay small
    edges = [0, *(np.searchsorted(bounds, np.arange(1 << 16, steps[-1], 1 << 16)).tolist()), len(some)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if lo < hi:
            a, b = bounds[lo], steps[some[hi - 1] + 1]
            total = np.zeros((hi - lo, 64), np.int64)
            if hi - lo == 1:
                for c in range(a, b, 1 << 16):
                    total[0] += np.unpackbits(hashes[c : min(b, c + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            else:
                bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total = np.add.reduceat(bits, bounds[lo:hi] - a, axis=0, dtype=np.int32)
            major = (2 * total > many[some[lo:hi]][:, None]).astype(np.uint8)
            out[some[lo:hi]] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def add_fingerprint(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``documents`` (``text``) with a long column ``fingerprint`` (its 64 bits)."""
    return add_columns(documents, "fingerprint long", lambda batch: [pa.array(fingerprints(batch.column("text"), shingle, seed).view(np.int64))])


class Forest:
    """BK-trees over ``values``, one for each run of equal ``shards`` (sorted), built level by level."""

    def __init__(self, values: np.ndarray, shards: np.ndarray):
        n = len(values)
        self.values = values
        new = np.append(True, shards[1:] != shards[:-1])
        self.root = np.flatnonzero(new)[np.cumsum(new) - 1]
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rest = np.flatnonzero(~new)
        at = self.root[rest]
        while len(rest):
            distance = np.bitwise_count(values[rest] ^ values[at]).astype(np.int64)
            _, lead, group = np.unique(at * 128 + distance, return_index=True, return_inverse=True)
            parent[rest[lead]], edge[rest[lead]] = at[lead], distance[lead]
            stays = np.ones(len(rest), bool)
            stays[lead] = False
            rest, at = rest[stays], rest[lead][group[stays]]
        self.order = np.argsort(parent * 128 + edge, kind="stable")
        self.keys = (parent * 128 + edge)[self.order]

    def links(self, radius: int, asks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, in pieces: of members that ask (None: all) and members of smaller value."""
        ask = np.arange(len(self.values)) if asks is None else np.flatnonzero(asks)
        stack = [(ask, self.root[ask])]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            near = (distance <= radius) & (self.values[node] < self.values[query])
            if near.any():
                yield query[near], node[near]
            lo = np.searchsorted(self.keys, node * 128 + np.maximum(distance - radius, 0))
            hi = np.searchsorted(self.keys, node * 128 + distance + radius, "right")
            many = hi - lo
            some = many > 0
            if some.any():
                many, lo, query = many[some], lo[some], query[some]
                steps = np.append(0, np.cumsum(many))
                stack.append((np.repeat(query, many), self.order[np.arange(steps[-1]) + np.repeat(lo - steps[:-1], many)]))


def _stars(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of a and b: labels are the smallest member's index."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _link(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (choice, shard, fingerprint, asks), sorted by the first two: a star of links for each shard's components."""

    def search(choice: np.ndarray, shard: np.ndarray, value: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
        tag = np.cumsum(np.append(True, (choice[1:] != choice[:-1]) | (shard[1:] != shard[:-1])))
        label = np.arange(len(value))
        for a, b in Forest(value, tag).links(radius, asks != 0):
            label = _stars(label, a, b)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(value[moved].view(np.int64)), pa.array(value[label[moved]].view(np.int64))], names=["a", "b"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
        held = [np.concatenate([h, x.view(h.dtype)]) for h, x in zip(held, new, strict=True)]
        if len(held[0]) >= CHUNK_ROWS:
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield search(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
    if len(held[0]):
        yield search(*held)


def _masks(bits: list[int], blocks: int, equal: int) -> list[int]:
    """For each choice of ``equal`` of ``blocks`` blocks of these bits, the mask of the chosen bits (signed)."""
    parts = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), blocks)]
    whole = [sum(c) for c in combinations(parts, equal)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in whole]


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, hot_shard: int = HOT_SHARD) -> DataFrame:
    """Links (a, b) between distinct ``fingerprint`` values that have the components of all near pairs."""
    n = distinct.count()
    blocks = radius + 1
    while 64 * (blocks - radius) / blocks < math.log2(max(n, 1)) - 3:
        blocks += 1
    masks = _masks(list(range(64)), blocks, blocks - radius)
    dealt = distinct.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "shard"))
    large = dealt.groupBy("choice", "shard").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > hot_shard).select("choice", "shard")
    large = written(large, "simhash-large")
    if not large.isEmpty():
        finer = []
        for i, m in enumerate(masks):
            rest = [b for b in range(64) if not m >> b & 1]
            finer.append(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(x)) for x in _masks(rest, radius + 1, 1)]))
        hot = dealt.join(large, ["choice", "shard"], "left_semi")
        pick = finer[0]
        for i, each in enumerate(finer[1:], 1):
            pick = F.when(F.col("choice") == i, each).otherwise(pick)
        hot = hot.select("fingerprint", "choice", "shard", F.posexplode(pick).alias("part", "value"))
        hot = hot.select("fingerprint", (F.lit(len(masks)) + F.col("choice") * 64 + F.col("part")).alias("choice"), F.col("shard").bitwiseOR(F.col("value")).alias("shard"))
        # what is still large is asked in several tasks: each gets the whole tree and its share of the queries
        hot = written(hot, "simhash-hot")
        still = hot.groupBy("choice", "shard").agg(F.ceil(F.count(F.lit(1)) / hot_shard).alias("pieces")).where("pieces > 1")
        hot = hot.join(written(still, "simhash-pieces"), ["choice", "shard"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        hot = hot.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        hot = hot.select("fingerprint", "choice", "shard", "piece", (F.pmod(F.xxhash64("fingerprint"), F.col("pieces")) == F.col("piece")).cast("long").alias("asks"))
        rest = dealt.join(large, ["choice", "shard"], "left_anti").select("fingerprint", "choice", "shard", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("asks"))
        dealt = rest.unionByName(hot)
    else:
        dealt = dealt.select("fingerprint", "choice", "shard", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("asks"))
    group = (F.col("choice").cast("long") * (1 << 40) + F.col("piece")).alias("group")
    parts = dealt.select(group, "shard", "fingerprint", "asks").repartition("group", "shard").sortWithinPartitions("group", "shard")
    return parts.mapInArrow(tidy(lambda batches: _link(batches, radius)), "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that it reaches.

    Alternating large-star and small-star rounds; each is a written table of at most one row a link.
    Smallest neighbours come from partial aggregation, so a node with very many links is no hot spot.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        before, edges = edges, written(small.where("a <> b").distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.col("b") % 1_000_003)).first()
        # equal sums may be chance: then the edges themselves are compared
        settled = now == mark and edges.join(before, ["a", "b"], "left_anti").isEmpty()
        forget(before)
        if settled:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _components_of(marked: DataFrame, radius: int, hot_shard: int) -> tuple[DataFrame, DataFrame]:
    """Classes (fingerprint, smallest) of rows (doc_id, fingerprint), and (fingerprint, root) of each."""
    classes = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")), "simhash-classes")
    roots = components(link_fingerprints(classes.select("fingerprint"), radius, hot_shard))
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fingerprint")
    return classes, classes.join(nodes, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, hot_shard: int = HOT_SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``documents`` (doc_id, text)."""
    marked = written(add_fingerprint(documents.select("doc_id", "text"), shingle).select("doc_id", "fingerprint"), "simhash")
    _, placed = _components_of(marked, radius, hot_shard)
    ids = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    table = placed.join(ids, "root").select("fingerprint", "component_id")
    return marked.join(table, "fingerprint").select("doc_id", "fingerprint", "component_id")


def row_digest(documents: DataFrame) -> Column:
    """64 bits of all columns that can be hashed, to tell rows of one doc_id apart."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in documents.schema.fields if "map<" not in f.dataType.simpleString()])


def first_rows(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Of ``documents`` (doc_id) one row for each root of ``found`` (doc_id, digest, root): that with the smallest doc_id (null: last).

    Of rows that share it the one with the smallest digest stays; rows that are equal throughout count as one.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest"))
    stays = found.groupBy("root").agg(first.alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.digest").alias("__stays"))
    kept = documents.withColumn("__digest", row_digest(documents)).join(stays, F.expr("__digest = __stays and doc_id <=> __id"), "left_semi")
    again = found.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__digest"])
    return kept.drop("__digest")


@keeps_columns("doc_id", "text")
def keep_one(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, by ``first_rows``, with its own columns."""
    rows = documents.withColumn("digest", row_digest(documents)).select("doc_id", "text", "digest")
    marked = written(add_fingerprint(rows, shingle).select("doc_id", "digest", "fingerprint"), "simhash")
    _, placed = _components_of(marked, radius, HOT_SHARD)
    return first_rows(documents, written(marked.join(placed.select("fingerprint", "root"), "fingerprint"), "simhash-found"))
