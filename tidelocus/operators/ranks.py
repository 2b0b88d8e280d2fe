"""Rank and select over sets of positions, bitmaps, neighbours, and coordinate compression.

Ranks are computed per key (``on``) with chunks of positions: a thin table of chunk counts gives what
lies before a chunk, so that no key's positions meet in one task's window unless they share a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1 << 16


def running(df: DataFrame, on: list[str], x: str, sums: dict[str, Column], chunk: int = CHUNK, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over the rows of the key that come before (by the integer x, then ``ties``)."""
    placed = df.withColumn("__chunk", F.floor(F.col(x) / chunk)).withColumns({f"__v_{n}": c for n, c in sums.items()})
    before = Window.partitionBy(*on).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*on, "__chunk").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    totals = totals.select(*on, "__chunk", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__t_{n}") for n in sums])
    inner = Window.partitionBy(*on, "__chunk").orderBy(x, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(totals, [*on, "__chunk"]).withColumns({n: F.col(f"__t_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inner), F.lit(0)) for n in sums})
    return rows.drop("__chunk", *[f"__{k}_{n}" for n in sums for k in "vt"])


def rank(members: DataFrame, probes: DataFrame, on: str, x: str, chunk: int = CHUNK) -> DataFrame:
    """``probes`` (on, x) with ``rank``: the number of distinct members of the key below x."""
    both = members.select(on, x).distinct().withColumn("__m", F.lit(1)).unionByName(probes.select(on, x).distinct().withColumn("__m", F.lit(0)))
    both = both.groupBy(on, x).agg(F.max("__m").alias("__m"))
    return probes.join(running(both, [on], x, {"rank": F.col("__m")}, chunk).select(on, x, "rank"), [on, x])


def rank_pair(members: DataFrame, probes: DataFrame, on: str, first: str, last: str) -> DataFrame:
    """``probes`` with rank_first and rank_last."""
    a = rank(members.withColumnRenamed("x", first), probes.select(on, first).distinct(), on, first).withColumnRenamed("rank", "rank_first")
    b = rank(members.withColumnRenamed("x", last), probes.select(on, last).distinct(), on, last).withColumnRenamed("rank", "rank_last")
    return probes.join(a, [on, first]).join(b, [on, last])


def numbered(members: DataFrame, on: str, x: str, chunk: int = CHUNK) -> DataFrame:
    """(on, x, i): the distinct members with their 0-based number, which is ``select`` read backwards."""
    own = members.select(on, x).distinct()
    return rank(own, own, on, x, chunk).withColumnRenamed("rank", "i")


def select(members: DataFrame, wanted: DataFrame, on: str, x: str, i: str = "i") -> DataFrame:
    """``wanted`` (on, i) with the i-th member; numbers beyond the set are left out."""
    return wanted.join(numbered(members, on, x).withColumnRenamed("i", i), [on, i])


def sizes(members: DataFrame, on: str, x: str) -> DataFrame:
    """(on, count, size): the number of distinct members and one more than the largest."""
    return members.groupBy(on).agg(F.countDistinct(x).alias("count"), (F.max(x) + 1).alias("size"))


def bitmap(members: DataFrame, on: str, x: str, bits: int = 32, chunk: int = CHUNK) -> DataFrame:
    """(on, word, bits, before): words of a bitmap with members, and the number of members in earlier words."""
    words = members.select(on, x).distinct().groupBy(on, F.floor(F.col(x) / bits).alias("word")).agg(F.sum(F.expr(f"shiftleft(1L, cast({x} % {bits} as int))")).alias("bits"))
    return running(words, [on], "word", {"before": F.bit_count("bits")}, chunk)


def neighbours(members: DataFrame, on: str, x: str, chunk: int = CHUNK) -> DataFrame:
    """(on, x, previous, next) of the distinct members.

    Within a chunk they are the rows beside; over its ends they come from a table of each chunk's first and last member.
    """
    own = members.select(on, x).distinct().withColumn("__chunk", F.floor(F.col(x) / chunk))
    by_chunk = Window.partitionBy(on).orderBy("__chunk")
    ends = own.groupBy(on, "__chunk").agg(F.min(x).alias("__a"), F.max(x).alias("__b"))
    ends = ends.select(on, "__chunk", F.lag("__b").over(by_chunk).alias("__before"), F.lead("__a").over(by_chunk).alias("__after"))
    w = Window.partitionBy(on, "__chunk").orderBy(x)
    rows = own.join(ends, [on, "__chunk"]).withColumns({"previous": F.coalesce(F.lag(x).over(w), F.col("__before")), "next": F.coalesce(F.lead(x).over(w), F.col("__after"))})
    return rows.select(on, x, "previous", "next")


def domain(intervals: DataFrame, on: str = "chrom") -> DataFrame:
    """(on, x): the distinct end positions of each key's intervals, and 0."""
    return intervals.select(on, F.explode(F.array("first", "last", F.lit(0).cast("long"))).alias("x")).distinct()


def compressed(members: DataFrame, probes: DataFrame, on: str, x: str) -> DataFrame:
    """``probes`` with ``place``: twice the rank of a member, one less than that of the next member otherwise."""
    own = members.select(on, x).distinct().withColumn("__is", F.lit(True))
    ranked = rank(members, probes, on, x).join(own, [on, x], "left")
    return ranked.withColumn("place", 2 * F.col("rank") - F.when(F.col("__is"), 0).otherwise(1)).drop("__is", "rank")


def expanded(members: DataFrame, places: DataFrame, on: str, x: str, place: str = "place") -> DataFrame:
    """``places`` with the member that each compressed place stands for: its own, or the one before it."""
    return select(members, places.withColumn("__i", F.floor(F.col(place) / 2)), on, x, "__i").drop("__i")
