"""Approximate nearest neighbours: p-stable hashing with multiprobe, then exact reranking.

Largest inner product is nearest distance once each vector x gets one more component,
sqrt(M^2 - |x|^2), with M the largest norm (queries get 0 there).  A table hashes a vector by ``projections``
Gaussian (2-stable) directions a as floor((a x + b) / width).  A query visits its own bucket and those
with some hashes one lower or higher, in order of estimated success: the sum of squared
distances to the boundaries crossed, smallest first, ``probes`` buckets in each table.

1. Equal vectors are one class, with its k + 1 smallest ids; copies cost nothing below.
2. Classes go to the buckets of all tables, queries to the buckets they visit.  Buckets are dealt into parts
   of a bounded number of rows; a bucket above ``CHUNK`` rows is split, and its queries visit every piece.
   A query's vector goes once to each part, with the list of buckets that it visits there.
3. A part compares each bucket's queries with its vectors as matrices and returns the best of each
   query: by score, then by id, whatever the number of ties.  A query visits at most ``tables * probes`` buckets and their pieces.
4. What was found is ranked by exact inner products in double precision (a window that limits each query before the
   shuffle), and classes give way to their ids.
5. Queries that met fewer than they should have are compared with all classes, in blocks.

``width`` is in units of the root mean square of the mean and the largest norm.  Directions come from a seed, so nothing is trained.

Edge cases: vectors that are null, zero, of a length other than the most frequent one, or hold null or
non-finite components take no part; rows with null ids neither; repeated rows count once; an id that has several
vectors takes part with each; ties go to smaller ids; fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

TABLES, PROJECTIONS, WIDTH, PROBES, SEED = 2, 5, 2.0, 100, 5
CHUNK, PART_ROWS = 8192, 1 << 16


class Hashes:
    """The directions and offsets of all tables, from a seed."""

    def __init__(self, size: int, tables: int, projections: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(size + 1, tables * projections))
        self.offsets = rng.uniform(0, 1, tables * projections)
        self.tables, self.projections, self.width = tables, projections, width
        self.moves = np.array(list(product((-1, 0, 1), repeat=projections)))

    def places(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(rows, tables, projections) places in units of the width."""
        raw = np.concatenate([x, last[:, None]], axis=1) @ self.directions / self.width + self.offsets
        return raw.reshape(len(x), self.tables, self.projections)

    def keys(self, buckets: np.ndarray) -> np.ndarray:
        """64-bit keys of (..., tables, projections) bucket coordinates."""
        key = np.broadcast_to(np.arange(self.tables, dtype=np.uint64), buckets.shape[:-1]).copy()
        for i in range(self.projections):
            key = key * np.uint64(0x9E3779B97F4A7C15) + buckets[..., i].astype(np.int64).view(np.uint64)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)

    def visited(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, tables, probes) keys of the buckets a query visits."""
        place = self.places(x, np.zeros(len(x)))
        bucket = np.floor(place)
        gap = place - bucket
        probes = min(probes, len(self.moves))
        cost = np.stack([gap**2, np.zeros_like(gap), (1 - gap) ** 2])  # of moves -1, 0, 1
        total = sum(cost[self.moves[:, i] + 1, :, :, i] for i in range(self.projections))
        best = np.argsort(total, axis=0, kind="stable")[:probes]
        moved = bucket[None] + self.moves[best]
        return np.moveaxis(self.keys(moved), 0, 2)


def _vectors(batch: pa.RecordBatch, name: str = "embedding") -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), np.float64).reshape(batch.num_rows, -1)


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part; floats stay floats, other components become doubles."""
    held = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(held).alias("embedding"))
    fine = fine.where("vec_id is not null and embedding is not null")
    return fine.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)")


def _search(index: pa.Table, queries: pa.Table, keep: int) -> pa.Table:
    """The ``keep`` best classes of one part for each query that visits it."""
    none = pa.table({"query": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "least": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not index.num_rows or not queries.num_rows:
        return none
    index, queries = index.combine_chunks().to_batches()[0], queries.combine_chunks().to_batches()[0]
    x, q = _vectors(index), _vectors(queries)
    classes, least_id, asked = (np.asarray(c) for c in (index.column("class"), index.column("least"), queries.column("query")))
    key, piece = np.asarray(index.column("key")), np.asarray(index.column("piece"))
    order = np.lexsort((piece, key))
    key, piece = key[order], piece[order]
    begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])))
    end = np.append(begin[1:], len(key))
    bucket = {(int(key[b]), int(piece[b])): order[b:e] for b, e in zip(begin, end, strict=True)}
    lists = queries.column("visits")
    visits = lists.flatten()
    row = np.repeat(np.arange(queries.num_rows), np.asarray(lists.value_lengths()))
    v_key, v_piece = np.asarray(visits.field("key")), np.asarray(visits.field("piece"))
    v_order = np.lexsort((v_piece, v_key))
    v_key, v_piece, row = v_key[v_order], v_piece[v_order], row[v_order]
    v_begin = np.flatnonzero(np.append(True, (v_key[1:] != v_key[:-1]) | (v_piece[1:] != v_piece[:-1])))
    found_q, found_x, found_s = [], [], []
    for b, e in zip(v_begin, np.append(v_begin[1:], len(v_key)), strict=True):
        members = bucket.get((int(v_key[b]), int(v_piece[b])))
        if members is None:
            continue
        for a in range(b, e, 512):
            asking = row[a : min(e, a + 512)]
            score = q[asking] @ x[members].T
            # products of matrices round otherwise than sums in order: all within the error of the last place stay
            if len(members) > keep:
                least = np.partition(score, len(members) - keep, axis=1)[:, len(members) - keep]
                error = 1e-12 * (np.abs(q[asking]).max(1) * np.abs(x[members]).max() * x.shape[1] + 1e-300)
                of, at = np.nonzero(score >= (least - error)[:, None])
            else:
                of, at = np.divmod(np.arange(score.size), len(members))
            of, at = asking[of], members[at]
            exact = _inner(q, of, x, at)
            order = np.lexsort((least_id[at], -exact, of))
            of, at, exact = of[order], at[order], exact[order]
            some = np.arange(len(of)) - np.searchsorted(of, of) < keep
            found_q.append(of[some])
            found_x.append(at[some])
            found_s.append(exact[some])
    if not found_q:
        return none
    of_q, of_x, score = np.concatenate(found_q), np.concatenate(found_x), np.concatenate(found_s)
    # a class may stand here for several tables
    _, once = np.unique(of_q * (classes.max() - classes.min() + 1) + classes[of_x] - classes.min(), return_index=True)
    of_q, of_x, score = of_q[once], of_x[once], score[once]
    order = np.lexsort((least_id[of_x], -score, of_q))
    of_q, of_x, score = of_q[order], of_x[order], score[order]
    some = np.arange(len(of_q)) - np.searchsorted(of_q, of_q) < keep
    return pa.table({"query": pa.array(asked[of_q[some]]), "class": pa.array(classes[of_x[some]]), "least": pa.array(least_id[of_x[some]]), "score": pa.array(score[some])})


def _inner(q: np.ndarray, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows of q and x, summed in the components' order, so equal vectors get equal sums."""
    out = np.zeros(len(i))
    for k in range(x.shape[1]):
        out += q[i, k] * x[j, k]
    return out


def nearest(vectors: DataFrame, asks: Column, k: int = 20, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows of ``vectors`` (vec_id, embedding) where ``asks`` holds, the k best others."""
    rows = _usable(vectors)
    common = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    spark = vectors.sparkSession
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = common["size"]
    rows = rows.where(F.size("embedding") == size)
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    # at most k + 1 rows of a class leave a task
    least = rows.dropDuplicates(["vec_id", "embedding"]).withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    classes = written(least.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("least", F.col("ids")[0]), "ann-classes")
    n, several, top, mean, ids = classes.agg(F.count(F.lit(1)), F.countDistinct("least"), F.max(norm2), F.avg(F.sqrt(norm2)), F.sum(F.size("ids"))).first()
    name = F.col("least")
    if several < n:  # ids that have several vectors: their classes are told apart by the vector too
        name = F.when(F.count(F.lit(1)).over(Window.partitionBy("least")) > 1, F.xxhash64("least", "embedding")).otherwise(name)
    classes = classes.withColumn("class", name) if several == n else written(classes.withColumn("class", name), "ann-classes")
    hashes = Hashes(size, tables, projections, width * math.sqrt((mean**2 + top) / 2), seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _vectors(part)
                last = np.sqrt(np.maximum(top - (x**2).sum(1), 0))
                keys = hashes.keys(np.floor(hashes.places(x, last)))
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, held], names=[*part.schema.names, "keys"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                keys = hashes.visited(_vectors(part), probes).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column("query"), pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))], names=["query", "keys"])

    kind = dict(rows.dtypes)["embedding"]
    parts = math.ceil(n * tables / PART_ROWS)
    thin = classes.select("class", "least", "embedding")
    placed = thin.mapInArrow(place, f"class long, least long, embedding {kind}, keys array<long>").withColumn("key", F.explode("keys")).drop("keys")
    heavy = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / CHUNK).alias("pieces"))
    heavy = written(heavy, "ann-heavy")  # as a table of known size, which Spark broadcasts if it is small
    part_of = F.pmod(F.xxhash64("key", "piece"), F.lit(parts)).alias("part")
    index = placed.join(heavy, "key", "left").withColumn("piece", F.pmod(F.xxhash64("class"), F.coalesce("pieces", F.lit(1)))).select(part_of, "key", "piece", "class", "least", "embedding")
    asking = rows.where(asks).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    ask_vectors = written(asking.groupBy("embedding").agg(F.min("query_id").alias("query")), "ann-vectors")
    asking = written(asking.join(ask_vectors, "embedding").select("query_id", "query", "embedding"), "ann-queries")
    if several < n:
        ask_vectors = ask_vectors.withColumn("query", F.xxhash64("query", "embedding"))
        asking = asking.withColumn("query", F.xxhash64("query", "embedding"))
    asking = asking.select("query_id", "query")
    visits = ask_vectors.mapInArrow(visit, "query long, keys array<long>").select("query", F.explode("keys").alias("key"))
    visits = visits.join(heavy, "key", "left").select("query", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))
    # at most tables * probes buckets, and pieces of them, for a query
    visits = visits.groupBy(part_of, "query").agg(F.collect_list(F.struct("key", "piece")).alias("visits"))
    visits = visits.join(ask_vectors, "query").select("part", "query", "visits", "embedding")

    def searched(index: DataFrame, visits: DataFrame) -> DataFrame:
        found = index.groupBy("part").cogroup(visits.groupBy("part")).applyInArrow(lambda a, b: _search(a, b, k + 1), "query long, class long, least long, score double")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "least", "class")
        return found.withColumn("place", F.dense_rank().over(best)).where(F.col("place") <= k + 1).select("query", "class", "score").distinct()

    found = written(searched(index, visits).join(classes.select("class", "ids"), "class").select("query", "score", "ids"), "ann-found")
    enough = found.groupBy("query").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") >= min(k + 1, ids))
    late = written(ask_vectors.join(enough, "query", "left_anti"), "ann-late")
    if not late.isEmpty():
        blocks = math.ceil(n / PART_ROWS)
        all_ = thin.select(F.pmod(F.xxhash64("class"), F.lit(blocks)).alias("part"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("piece"), "class", "least", "embedding")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        asked = late.select(each.alias("part"), "query", F.expr("array(struct(0L as key, 0L as piece)) as visits"), "embedding")
        more = searched(all_, asked).join(classes.select("class", "ids"), "class").select("query", "score", "ids")
        found = found.join(late.select("query"), "query", "left_anti").unionByName(more)
    own = asking.join(found, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
