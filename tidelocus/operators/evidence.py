"""Discordant pairs around peaks: flank windows, an overlap join, and counts by the mate's place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import BIN, contained, overlap_join
from .reads import NEAR, discordant, good_quality, has_mate_place, mate_on_main

BASE_WIDTH = 150


def window_width(sd: str = "both_sd", base: int = BASE_WIDTH) -> Column:
    """``base`` and three deviations, cut to an integer; NaN, null or negative deviations count as 0."""
    x = F.col(sd)
    return base + F.when(x.isNull() | F.isnan(x) | (x < 0), 0).otherwise((3 * x).cast("long"))


def flanks(peaks: DataFrame, width: Column | None = None) -> DataFrame:
    """Two windows for each peak: side L [pos - w, pos] from 1 on, and R [pos + 1, pos + w]."""
    w = window_width() if width is None else width
    left = F.struct(F.lit("L").alias("side"), F.greatest(F.col("pos") - w, F.lit(1)).alias("w_first"), F.col("pos").alias("w_last"))
    right = F.struct(F.lit("R").alias("side"), (F.col("pos") + 1).alias("w_first"), (F.col("pos") + w).alias("w_last"))
    return peaks.select("chrom", F.format_string("%s:%d", "chrom", "pos").alias("locus"), F.explode(F.array(left, right)).alias("x")).select("chrom", "locus", "x.*")


def on_known(df: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """``df`` as it is; a row on a chromosome that the dictionary hasn't is an error."""
    known = df.join(chromosomes.select("chrom", F.lit(True).alias("__known")), "chrom", "left")
    missing = F.raise_error(F.concat(F.lit("unknown chromosome: "), F.coalesce("chrom", F.lit("null")))).cast("boolean")
    return known.where(F.coalesce("__known", missing)).select(*df.columns)


def discordant_pairs(peaks: DataFrame, reads: DataFrame, near: int = NEAR, least: int = 2, width: Column | None = None, regions: DataFrame | None = None, bin_width: int = BIN, chromosomes: DataFrame | None = None) -> DataFrame:
    """``schemas.DISCORDANT``: for peaks with at least ``least`` matched reads, counts by the mate's place.

    Peaks on chromosomes that the dictionary ``chromosomes`` hasn't are an error (None: they match nothing).

    A read over a peak's centre counts on both sides.  ``regions`` set mate_in_rep by the mate's place.
    """
    good = reads.where(good_quality() & has_mate_place() & mate_on_main() & discordant(near)).select("chrom", "pos", F.coalesce("end_pos", "pos").alias("end_pos"), "mate_chrom", "mate_pos")
    if regions is None:
        good = good.withColumn("inside", F.lit(False))
    else:
        good = contained(good, regions.withColumnRenamed("chrom", "mate_chrom"), "mate_chrom", "mate_pos")
    if chromosomes is not None:
        peaks = on_known(peaks, chromosomes)
    windows = flanks(peaks.where("chrom is not null and pos is not null").dropDuplicates(["chrom", "pos"]), width)
    met = overlap_join(good, windows, "chrom", ("pos", "end_pos"), ("w_first", "w_last"), bin_width)
    counts = met.groupBy("locus", "mate_chrom", "mate_pos").agg(F.count_if(F.col("side") == "L").alias("left_count"), F.count_if(F.col("side") == "R").alias("right_count"), F.count_if("inside").alias("mate_in_rep"))
    # the totals come from the counts, so a peak with very many reads is one row here
    enough = counts.groupBy("locus").agg(F.sum(F.col("left_count") + F.col("right_count")).alias("n")).where(F.col("n") >= least)
    return counts.join(enough.select("locus"), "locus", "left_semi")
