"""Operators on alignment records (``schemas.ALIGNMENTS``): filters, CIGAR walk, clip events and pile-up.

Edge cases: null quality counts as good; null places are dropped where a place is needed; empty
CIGARs give no operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import written
from .intervals import contained, merge

UNMAPPED, FIRST_SEGMENT, SECONDARY, DUPLICATE = 0x4, 0x40, 0x100, 0x400
LEAST_MAPQ, NEAR, LEAST_READ, LEAST_SUPPORT = 12, 2500, 9, 2


def _without(bits: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bits)) == 0


def good_quality() -> Column:
    """Mapped, neither duplicate nor secondary, mapping quality null or above 12; supplementary stay."""
    return _without(UNMAPPED | DUPLICATE | SECONDARY) & (F.col("mapq").isNull() | (F.col("mapq") > LEAST_MAPQ))


def countable() -> Column:
    """As ``good_quality``, of any mapping quality."""
    return _without(UNMAPPED | DUPLICATE | SECONDARY)


def in_region_scan() -> Column:
    """Mapped, no duplicate, mapping quality null or at least 12; secondary stay."""
    return _without(UNMAPPED | DUPLICATE) & (F.col("mapq").isNull() | (F.col("mapq") >= LEAST_MAPQ))


def mapped() -> Column:
    """Neither unmapped nor duplicate."""
    return _without(UNMAPPED | DUPLICATE)


def has_place() -> Column:
    """On a chromosome, with a start."""
    return F.col("chrom").isNotNull() & F.col("pos").isNotNull()


def has_mate_place() -> Column:
    """Both ends have a place."""
    return has_place() & F.col("mate_chrom").isNotNull() & F.col("mate_pos").isNotNull()


def discordant(near: int = NEAR) -> Column:
    """The mate is on another chromosome or at least ``near`` away."""
    return ~((F.col("chrom") == F.col("mate_chrom")) & (F.abs(F.col("pos") - F.col("mate_pos")) < near))


def mate_on_main() -> Column:
    """The mate's chromosome name has no underscore."""
    return ~F.col("mate_chrom").contains("_")


def main_chromosomes(chromosomes: DataFrame, least: int = 4 * 1024 * 1024) -> DataFrame:
    """Chromosomes of at least ``least`` bases whose name has no underscore."""
    return chromosomes.where((F.col("length") >= least) & ~F.col("chrom").contains("_"))


def named(df: DataFrame, chromosomes: DataFrame, chrom_id: str = "chrom_id") -> DataFrame:
    """``df`` with chrom and length of each chrom_id: "" and 0 where the dictionary hasn't it."""
    own = chromosomes.select(F.col("chrom_id").alias(chrom_id), "chrom", "length")
    return df.join(own, chrom_id, "left").withColumns({"chrom": F.coalesce("chrom", F.lit("")), "length": F.coalesce("length", F.lit(0).cast("long"))})


def parse_cigar(text: Column) -> Column:
    """array<struct<op, len>> of a CIGAR string (null, empty or ``*``: empty)."""
    ops = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(ops, lambda x: F.struct(F.substring(x, F.length(x), F.lit(1)).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len")))


def cigar_operations(reads: DataFrame) -> DataFrame:
    """A row for each CIGAR operation: i, p (reference place), q (0-based read offset), op, len; none without a start.

    M, = and X move both places, I and S the read's, D and N the reference's, H and P neither.
    """
    moved = lambda x, ops: F.when(x["op"].isin(*ops), x["len"]).otherwise(0)

    def step(done: Column, x: Column) -> Column:
        here = F.struct(F.size(done["ops"]).alias("i"), done["p"].alias("p"), done["q"].alias("q"), x["op"].alias("op"), x["len"].alias("len"))
        return F.struct((done["p"] + moved(x, "M=XDN")).alias("p"), (done["q"] + moved(x, "M=XIS")).alias("q"), F.array_append(done["ops"], here).alias("ops"))

    none = F.expr("cast(array() as array<struct<i:int,p:bigint,q:bigint,op:string,len:int>>)")
    start = F.struct(F.col("pos").cast("long").alias("p"), F.lit(0).cast("long").alias("q"), none.alias("ops"))
    walked = F.aggregate("cigar", start, step, lambda done: done["ops"])
    return reads.where("pos is not null").withColumn("__op", F.explode(walked)).select("*", "__op.*").drop("__op")


def clip_events(reads: DataFrame, regions: DataFrame | None = None, left_key: str = "inner", mate_chrom_lookup: bool = False) -> DataFrame:
    """A row for each soft clip of a good read: chrom, clip_pos, side, segment, q, len and the mate's place.

    A clip at read offset 0 is on the left and counts at p + len (``left_key='start'``: at p), others at p.
    ``regions`` (merged or not) set mate_in_rep: whether one holds the mate's position, on the read's own
    chromosome (``mate_chrom_lookup``: the mate's).
    """
    clips = cigar_operations(reads.where(good_quality() & has_place())).where("op = 'S'")
    left = F.col("q") == 0
    at = F.col("p") + F.col("len") if left_key == "inner" else F.col("p")
    clips = clips.withColumns(
        {
            "side": F.when(left, "L").otherwise("R"),
            "clip_pos": F.when(left, at).otherwise(F.col("p")),
            "segment": F.when(F.col("flag").bitwiseAND(F.lit(FIRST_SEGMENT)) != 0, "1").otherwise("2"),
        }
    )
    if regions is None:
        clips = clips.withColumn("mate_in_rep", F.lit(False))
    else:
        own = "mate_chrom" if mate_chrom_lookup else "chrom"
        found = contained(clips.select(F.col(own).alias("__c"), F.col("mate_pos").alias("__p")).distinct(), regions.withColumnRenamed("chrom", "__c"), "__c", "__p")
        clips = clips.join(found, (F.col(own) == F.col("__c")) & (F.col("mate_pos") == F.col("__p")), "left").drop("__c", "__p")
        clips = clips.withColumn("mate_in_rep", F.coalesce("inside", F.lit(False))).drop("inside")
    return clips.withColumns({"mate_chrom": F.coalesce("mate_chrom", F.lit("*")), "mate_pos": F.coalesce("mate_pos", F.lit(0))})


def pileup(events: DataFrame, pos: str = "clip_pos", least: int = LEAST_SUPPORT) -> DataFrame:
    """``schemas.CLIPS`` of clip events (chrom, position, side, mate_in_rep): counts of at least ``least`` events."""
    counts = events.groupBy("chrom", F.col(pos).alias("pos")).agg(
        F.count_if(F.col("side") == "L").alias("left_count"), F.count_if(F.col("side") == "R").alias("right_count"), F.count_if("mate_in_rep").alias("mate_in_rep")
    )
    return counts.where(F.col("left_count") + F.col("right_count") >= least)


def _seams(events: DataFrame, pos: str) -> dict[str, np.ndarray]:
    """For each chromosome the ranges of positions, flat and ascending, in which events of several partitions can lie.

    One row for each partition and chromosome that it holds reaches the driver.
    """
    ranges = events.where(F.col(pos).isNotNull()).groupBy(F.spark_partition_id().alias("part"), "chrom").agg(F.min(pos).alias("first"), F.max(pos).alias("last"))
    before = Window.partitionBy("chrom").orderBy("first", "last", "part").rowsBetween(Window.unboundedPreceding, -1)
    # where a range begins inside what the ones before it reach, both meet up to the nearer end
    met = ranges.withColumn("reach", F.max("last").over(before)).where(F.col("first") <= F.col("reach"))
    shared = merge(met.select("chrom", "first", F.least("reach", "last").alias("last")))
    out: dict[str, list[int]] = {}
    for r in shared.orderBy("chrom", "first").collect():
        out.setdefault(r["chrom"], []).extend((r["first"], r["last"] + 1))
    return {k: np.array(v, np.int64) for k, v in out.items()}


def added(rows: np.ndarray) -> np.ndarray:
    """Rows (number, position, counts) in order of the first two, the counts of equal ones added up."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))) if len(rows) else np.zeros(0, np.int64)
    out = rows[first]
    if len(out):
        out[:, 2:] = np.add.reduceat(rows[:, 2:], first, axis=0)
    return out


_COUNTS = ["chrom", "pos", "left_count", "right_count", "mate_in_rep"]


def _scanned(batches: Iterator[pa.RecordBatch], seams: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition's sorted events (chrom, start, pos, left, right, mate_in_rep), with whether they lie in a seam.

    A batch is counted at once, whatever number of chromosomes it has.
    """

    def leave(rows: np.ndarray, own: list[str]) -> pa.RecordBatch:
        shared = np.zeros(len(rows), bool)
        for k, name in enumerate(own):
            if name in seams:
                a, b = np.searchsorted(rows[:, 0], (k, k + 1))
                shared[a:b] = np.searchsorted(seams[name], rows[a:b, 1], "right") % 2 == 1
        return pa.RecordBatch.from_arrays([pa.array(own, pa.string()).take(pa.array(rows[:, 0])), *(pa.array(rows[:, k]) for k in range(1, 5)), pa.array(shared)], names=[*_COUNTS, "shared"])

    chrom, reached, done = None, None, set()
    held = np.zeros((0, 5), np.int64)  # of the last chromosome: 0, position and counts
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode()
        index, dictionary = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
        starts = batch.column(1).to_numpy()
        change = np.append(True, index[1:] != index[:-1])
        own, run = [dictionary[i] for i in index[change].tolist()], np.cumsum(change) - 1
        goes_on = own[0] == chrom
        if len(held) and not goes_on:
            yield leave(held, [chrom])
            held = held[:0]
        for name in own[goes_on:]:
            if name in done:
                raise ValueError(f"events aren't sorted: chromosome {name} comes again")
            done.add(name)
        back = np.flatnonzero((starts[1:] < starts[:-1]) & ~change[1:])
        if len(back) or (goes_on and starts[0] < reached):
            raise ValueError(f"events aren't sorted: a start goes back on chromosome {own[run[back[0]]] if len(back) else chrom}")
        chrom, reached = own[-1], starts[-1]
        flags = [batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5)]
        rows = added(np.concatenate([held, np.column_stack([run, batch.column(2).to_numpy(), *flags]).astype(np.int64)]))
        final = (rows[:, 0] < len(own) - 1) | (rows[:, 1] < reached)
        if final.any():
            yield leave(rows[final], own)
        held = rows[~final]
        held[:, 0] = 0
    if len(held):
        yield leave(held, [chrom])


def sorted_pileup(events: DataFrame, start: str = "pos", pos: str = "clip_pos", least: int = LEAST_SUPPORT) -> DataFrame:
    """``pileup`` of events in order of chromosome and read start within each partition, without a shuffle of them.

    Each partition is scanned once.  Counts of positions before the current read's start are final in it and leave; an event
    never lies before its read's start.  Only positions where the ranges of several partitions overlap (the seams) are added
    up in a shuffle: thin rows of counts.  Rows out of order raise an error.
    """
    seams = _seams(events, pos)
    thin = events.where(F.col("chrom").isNotNull() & F.col(pos).isNotNull()).select("chrom", F.col(start).cast("long"), F.col(pos).cast("long"), F.col("side") == "L", F.col("side") == "R", F.coalesce("mate_in_rep", F.lit(False)))
    counted = written(thin.toDF("chrom", "start", "pos", "l", "r", "m").mapInArrow(lambda batches: _scanned(batches, seams), "chrom string, pos long, left_count long, right_count long, mate_in_rep long, shared boolean"), "pileup")
    seam = counted.where("shared").groupBy("chrom", "pos").agg(*[F.sum(c).alias(c) for c in _COUNTS[2:]])
    return counted.where("not shared").select(_COUNTS).unionByName(seam).where(F.col("left_count") + F.col("right_count") >= least)


def clip_reads(events: DataFrame) -> DataFrame:
    """``schemas.READS``: the clipped parts of reads of at least nine bases; null where a read has no bases or qualities."""
    name = F.concat_ws("~", "qname", "chrom", F.col("p").cast("string"), "mate_chrom", F.col("mate_pos").cast("string"), "side", "segment")
    part = lambda c: F.substring(F.col(c), F.col("q") + 1, F.col("len"))
    return events.where(F.length("seq") >= LEAST_READ).select(name.alias("id"), part("seq").alias("seq"), part("qual").alias("qual"))
