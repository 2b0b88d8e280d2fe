"""Sampled coverage: loci over the genome, statistics for each, and one summary row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import BIN, overlap_join
from .reads import countable

SAMPLES, LOCUS, LEAST_SCANNED, LONGEST_INSERT = 3000, 500, 10, 2000


def offsets(chromosomes: DataFrame) -> DataFrame:
    """Each chromosome's number of bases before it (``start``), in the order of chrom_id.

    One window over the reference's dictionary, a table of a few thousand rows at most.
    """
    before = Window.orderBy("chrom_id").rowsBetween(Window.unboundedPreceding, -1)
    return chromosomes.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))


def place_samples(samples: DataFrame, chromosomes: DataFrame, size: int = LOCUS) -> DataFrame:
    """(chrom, first, last = first + size) of genome offsets ``at`` (from 0); loci over a chromosome's end are dropped."""
    table = F.broadcast(offsets(chromosomes).where("length > 0"))
    held = samples.join(table, (F.col("start") <= F.col("at")) & (F.col("at") + size < F.col("start") + F.col("length")))
    first = F.col("at") - F.col("start") + 1
    return held.select("chrom", first.alias("first"), (first + size).alias("last"))


def draw(i: Column, total: Column, seed: int) -> Column:
    """A number from 0 to total - 1: 60 bits of an MD5 over seed and ``i``, so any SQL engine can repeat it."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), total)


def sample_loci(chromosomes: DataFrame, n: int = SAMPLES, size: int = LOCUS, seed: int = 0) -> DataFrame:
    """``n`` loci of ``size`` bases, uniform over all places where one fits, the same for a seed (none where it fits nowhere).

    Only places that fit are numbered, so every draw is a locus.
    """
    table = offsets(chromosomes.withColumn("length", F.greatest(F.col("length") - size, F.lit(0)))).where("length > 0")
    total = table.agg(F.coalesce(F.sum("length"), F.lit(0))).scalar()
    draws = chromosomes.sparkSession.range(0, n, 1, 4).withColumn("total", total).where("total > 0").select(draw(F.col("id"), F.col("total"), seed).alias("at"))
    # the dictionary has a few thousand rows
    held = draws.join(F.broadcast(table), (F.col("start") <= F.col("at")) & (F.col("at") < F.col("start") + F.col("length")))
    first = F.col("at") - F.col("start") + 1
    return held.select("chrom", first.alias("first"), (first + size).alias("last"))


def locus_coverage(loci: DataFrame, reads: DataFrame, least: int = LEAST_SCANNED, bin_width: int = BIN) -> DataFrame:
    """For each locus (chrom, first, last) met by at least ``least`` reads: cov, n_ins, sum_ins, sum2_ins, read_length.

    Reads are counted before any filter.  ``cov`` counts countable reads over the locus's middle; inserts are template
    lengths below 2000 of pairs on one chromosome.
    """
    wanted = loci.where("chrom is not null").distinct().withColumnsRenamed({"first": "l_first", "last": "l_last"})
    met = overlap_join(reads.withColumn("end_pos", F.coalesce("end_pos", "pos")), wanted, "chrom", ("pos", "end_pos"), ("l_first", "l_last"), bin_width)
    insert = F.when(countable() & (F.col("chrom") == F.col("mate_chrom")) & (F.abs("tlen") < LONGEST_INSERT), F.abs("tlen").cast("long"))
    out = met.groupBy("chrom", "l_first", "l_last").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(countable() & F.floor((F.col("l_first") + F.col("l_last")) / 2).between(F.col("pos"), F.col("end_pos"))).alias("cov"),
        F.count(insert).alias("n_ins"), F.coalesce(F.sum(insert), F.lit(0)).alias("sum_ins"), F.coalesce(F.sum(insert * insert), F.lit(0)).alias("sum2_ins"),
        F.coalesce(F.max(F.when(countable(), F.length("seq"))), F.lit(0)).cast("long").alias("read_length"),
    )
    return out.where(F.col("n") >= least).withColumnsRenamed({"l_first": "first", "l_last": "last"})


def summarise_coverage(per_locus: DataFrame, bam: str) -> DataFrame:
    """``schemas.INFO``, one row: the mean coverage of loci with inserts, merged insert moments, longest read.

    Without inserts the means are null and the deviation is -1.
    """
    with_inserts = F.col("n_ins") > 0
    n, x, xx = F.sum("n_ins"), F.sum("sum_ins"), F.sum("sum2_ins")
    sd = F.when(n > 0, F.sqrt((xx * n - x * x).cast("double")) / n).otherwise(-1.0)
    return per_locus.agg(
        F.lit(bam).alias("bam"), F.avg(F.when(with_inserts, F.col("cov"))).alias("cov"), F.coalesce(F.max("read_length"), F.lit(0).cast("long")).alias("read_length"),
        (x / F.nullif(n, F.lit(0))).alias("insert_size_mean"), sd.alias("insert_size_sd"),
    )
