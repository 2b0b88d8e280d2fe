"""K-means over dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import CHUNK, running


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def assign(vectors: DataFrame, centroids: list[list[float]], vector: str) -> DataFrame:
    """``vectors`` with ``cluster`` (the nearest centroid; ties: the lowest number) and ``distance``.

    Centroids are k arrays in the query itself; every row is compared with them in place.
    """
    v = F.col(vector).cast("array<double>")
    each = [F.struct(distance(v, F.array(*[F.lit(float(x)) for x in c])).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]
    best = F.array_min(F.array(*each))
    return vectors.withColumn("__b", best).withColumns({"cluster": F.col("__b.cluster"), "distance": F.col("__b.distance")}).drop("__b")


def centroids(assigned: DataFrame, vector: str) -> DataFrame:
    """(cluster, dim, mean) of assigned vectors; a cluster without members has no rows and keeps its centroid."""
    parts = assigned.select("cluster", F.posexplode(vector).alias("dim", "x"))
    return parts.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroid_rows(assigned: DataFrame, vector: str) -> dict[int, list[float]]:
    """The means of the clusters that have members; each task adds whole vectors up and hands on one row a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                own, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
                rows = np.column_stack([np.ones(len(own)), flat.reshape(len(own), -1)])
                for c in np.unique(own).tolist():
                    sums[c] = sums.get(c, 0) + rows[own == c].sum(0)
        for c, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["cluster", "sums"])

    parts = assigned.select("cluster", F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "cluster int, sums array<double>")
    added = parts.select("cluster", F.posexplode("sums").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("x").alias("x"))
    out: dict[int, dict[int, float]] = {}
    for r in added.collect():  # clusters times components
        out.setdefault(r["cluster"], {})[r["dim"]] = r["x"]
    return {c: [x[i] / x[0] for i in range(1, len(x))] for c, x in out.items()}


def running_centroid(vectors: DataFrame, by: str, order: str, vector: str, chunk: int = CHUNK) -> DataFrame:
    """(by, order, dim, mean): the mean of each component over a key's rows so far (``order``: integers, each once in a key)."""
    parts = vectors.select(by, order, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    sums = running(parts, [by, "dim"], order, {"__n": F.lit(1).cast("long"), "__sum": F.col("x")}, chunk)
    return sums.select(by, order, "dim", ((F.col("__sum") + F.col("x")) / (F.col("__n") + 1)).alias("mean"))


def spread_of_distances(assigned: DataFrame) -> DataFrame:
    """One row of assigned vectors: n, mean and (population) deviation of their distances."""
    return assigned.agg(F.count("distance").alias("n"), F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("deviation"))


def iterate(vectors: DataFrame, centres: list[list[float]], vector: str, rounds: int = 50) -> tuple[list[list[float]], list[dict]]:
    """Lloyd's rounds from given centres until none moves: the last centres, and n, mean and deviation of the distances of each round.

    A round is one pass over the vectors; only k * dim sums reach the driver.  A cluster without members keeps its centre.
    """
    told = []
    for _ in range(rounds):
        held = assign(vectors, centres, vector)
        told.append(spread_of_distances(held).first().asDict())
        following = [list(c) for c in centres]
        for cluster, centre in centroid_rows(held, vector).items():
            following[cluster] = centre
        if following == centres:
            break
        centres = following
    return centres, told


def seeds(vectors: DataFrame, index: str, vector: str, k: int, seed: int) -> list[list[float]]:
    """The vectors of ``k`` rows drawn by a seeded digest of the integer ``index`` (each once): the k smallest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(index).cast("string")).cast("binary"))
    rows = vectors.select(digest.alias("d"), index, F.col(vector).cast("array<double>").alias("v")).orderBy("d", index).limit(k).collect()
    return [list(r["v"]) for r in rows]


def fit(vectors: DataFrame, index: str, vector: str, k: int, seed: int = 1, rounds: int = 50) -> tuple[DataFrame, list[dict]]:
    """``vectors`` with cluster and distance after at most ``rounds`` rounds from drawn rows, and what each round's distances were."""
    centres, told = iterate(vectors, seeds(vectors, index, vector, k, seed), vector, rounds)
    return assign(vectors, centres, vector), told
