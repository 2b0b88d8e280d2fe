"""Peaks: islands of clip positions, with their highest position and weighted spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import CHUNK, islands_by_chunk

GAP = 100


def _moments(weight: str, place: str) -> list[Column]:
    """Weight, first and second moment of small integers, exact in bigint."""
    w, x = F.col(weight), F.col(place)
    return [F.sum(w).alias(f"{weight}_0"), F.sum(w * x).alias(f"{weight}_1"), F.sum(w * x * x).alias(f"{weight}_2")]


def _spread(weight: str) -> Column:
    """Population deviation of the moments' sums: -1 without weight."""
    w, x, xx = (F.sum(f"{weight}_{k}") for k in range(3))
    return F.when(w == 0, -1.0).otherwise(F.sqrt((xx * w - x * x).cast("double")) / w)


def call_peaks(clips: DataFrame, gap: int = GAP, chunk: int = CHUNK) -> DataFrame:
    """``schemas.PEAKS`` of ``schemas.CLIPS``: one row for each island of positions at most ``gap`` apart.

    ``pos`` is the first position with the most clips of both sides (0 if there are none), ``max_both`` their
    number.  An island of one row has spreads 0.  Null positions or chromosomes are left out; rows that repeat a position count each.

    Moments are summed within chunks of positions, from each chunk's begin, and shifted to the island's first chunk when chunks
    of an island meet, which keeps them exact and moves one row for each chunk of an island.
    """
    rows = clips.withColumn("both", F.col("left_count") + F.col("right_count"))
    weights = ("left_count", "right_count", "both")
    rows = islands_by_chunk(rows, "chrom", "pos", "pos", gap, chunk).withColumn("d", F.col("pos") - F.col("chunk") * chunk)
    parts = rows.groupBy("chrom", "chunk", "island").agg(F.max(F.struct("both", (-F.col("pos")).alias("back"))).alias("top"), F.count(F.lit(1)).alias("n"), *[m for w in weights for m in _moments(w, "d")])
    least = Window.partitionBy("chrom", "island")
    far = (F.col("chunk") - F.min("chunk").over(least)) * chunk
    shifted = parts.withColumn("k", far)
    for w in weights:
        w0, w1, w2 = (F.col(f"{w}_{i}") for i in range(3))
        shifted = shifted.withColumns({f"{w}_2": w2 + 2 * F.col("k") * w1 + F.col("k") * F.col("k") * w0, f"{w}_1": w1 + F.col("k") * w0})
    out = shifted.groupBy("chrom", "island").agg(F.max("top").alias("top"), F.sum("n").alias("n"), *[_spread(w).alias(f"{name}_sd") for name, w in zip(("left", "right", "both"), weights, strict=True)])
    one = lambda c: F.when(F.col("n") == 1, 0.0).otherwise(F.col(c)).alias(c)
    pos = F.when(F.col("top.both") > 0, -F.col("top.back")).otherwise(0).cast("long")
    return out.select("chrom", pos.alias("pos"), F.col("top.both").alias("max_both"), one("left_sd"), one("right_sd"), one("both_sd"))
