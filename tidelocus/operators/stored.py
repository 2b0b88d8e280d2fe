"""Interval indexes that are stored once and joined many times.

An index is a Parquet table bucketed by (chromosome, level, bin), beside a row that says how it was made.  Joins read its buckets as
they lie: only what asks is shuffled, to as many partitions as there are buckets (where a chromosome is a constant of the query Spark
drops it from the keys, and shuffles both).  An index of few chromosomes lists them, so that what asks for others isn't shuffled.  An index is opened by its path, also by another session.

Edge cases: those of ``operators.intervals``; an empty index matches nothing; columns of both sides differ but for the chromosome.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from .intervals import BIN, asking, binned, levelled, levels_used, met_once

_MADE = "on string, first string, last string, width int, buckets int, used int, intervals long, longest long, columns string, names array<string>"
#: Up to so many chromosomes an index lists them, and what asks for others is dropped before it is shuffled.
NAMES = 4096


class IntervalIndex(NamedTuple):
    """An open index: its table in the session's catalog and how it was made."""

    table: str
    rows: DataFrame
    on: str
    bounds: tuple[str, str]
    width: int
    used: int
    intervals: int
    longest: int
    names: list[str] | None

    def close(self) -> None:
        """Take the table's name out of the catalog; the index stays."""
        self.rows.sparkSession.sql(f"drop table if exists {self.table}")


def _quoted(text: str) -> str:
    return "`" + text.replace("`", "``") + "`"


def store_index(intervals: DataFrame, path: str, on: str = "chrom", bounds: tuple[str, str] = ("r_first", "r_last"), width: int = BIN, buckets: int = 200) -> None:
    """Write the index of ``intervals`` to a new folder that driver and executors share.

    ``buckets`` should grow with the intervals (some 100 MB each); each is written by one task as one file.
    """
    spark = intervals.sparkSession
    rows = levelled(intervals.where(F.col(on).isNotNull()), bounds, width)
    keys = [on, "__level", "__bin"]
    name = f"tidelocus_index_{uuid.uuid4().hex}"
    dealt = binned(rows, bounds, width).repartition(buckets, *keys)
    try:
        dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{path}/rows").saveAsTable(name)
    finally:
        spark.sql(f"drop table if exists {name}")  # its files stay
    # an interval is counted in its first bin; a column store, so this reads the level, the bin and the bounds
    own = spark.read.schema(dealt.schema).parquet(f"{path}/rows").where(met_once(bounds, bounds, width))
    made = own.agg(levels_used().cast("int").alias("used"), F.count(F.lit(1)).alias("intervals"), F.coalesce(F.max(F.col(bounds[1]) - F.col(bounds[0]) + 1), F.lit(0)).cast("long").alias("longest"))
    # one more than are listed shows that there are too many
    some = own.select(F.col(on).cast("string").alias("name")).distinct().limit(NAMES + 1).agg(F.collect_list("name").alias("names"))
    listed = F.when(F.size("names") <= NAMES, F.col("names")) if own.schema[on].dataType in (StringType(), IntegerType(), LongType()) else F.lit(None).cast("array<string>")
    made = made.crossJoin(some.select(listed.alias("names")))  # one row each
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in dealt.schema)
    fixed = {"on": on, "first": bounds[0], "last": bounds[1], "width": width, "buckets": buckets, "columns": columns}
    made.withColumns({k: F.lit(v) for k, v in fixed.items()}).selectExpr(*_names(_MADE)).write.parquet(f"{path}/made")


def _names(schema: str) -> list[str]:
    return [_quoted(x.split()[0]) for x in schema.split(", ")]


def open_index(spark: SparkSession, path: str) -> IntervalIndex:
    """The index in ``path``, under a new name in the session's catalog until it is closed."""
    made = spark.read.parquet(f"{path}/made").first()
    name = f"tidelocus_index_{uuid.uuid4().hex}"
    keys = f"{_quoted(made['on'])}, `__level`, `__bin`"
    place = f"{path}/rows".replace("'", "\\'")
    spark.sql(f"create table {name} ({made['columns']}) using parquet clustered by ({keys}) sorted by ({keys}) into {made['buckets']} buckets location '{place}'")
    return IntervalIndex(name, spark.table(name), made["on"], (made["first"], made["last"]), made["width"], made["used"], made["intervals"], made["longest"], made["names"])


def indexed_overlap(left: DataFrame, index: IntervalIndex, left_range: tuple[str, str] = ("first", "last")) -> DataFrame:
    """All pairs of ``left`` ranges and indexed intervals that share a position, each once."""
    if index.names is not None:
        name = F.col(index.on).cast("string")
        # a single name as a comparison would become a constant, and the index be shuffled
        left = left.where(name.isin(index.names) if len(index.names) > 1 else F.array_contains(F.lit(index.names).cast("array<string>"), name))
    asks = asking(left, left_range, index.width, F.lit(index.used))
    pairs = asks.join(index.rows, [index.on, "__level", "__bin"])
    return pairs.where(met_once(left_range, index.bounds, index.width)).drop("__level", "__bin")


def indexed_stab(points: DataFrame, index: IntervalIndex, pos: str = "pos") -> DataFrame:
    """Every indexed interval that contains each point."""
    return indexed_overlap(points, index, (pos, pos))


def indexed_depth(points: DataFrame, index: IntervalIndex, pos: str = "pos") -> DataFrame:
    """(on, pos, n) of each distinct place that some indexed interval contains: how many do."""
    places = points.select(index.on, pos).distinct()
    return indexed_stab(places, index, pos).groupBy(index.on, pos).agg(F.count(F.lit(1)).alias("n"))
