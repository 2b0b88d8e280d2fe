"""Interval operators: range joins by levels of bins, islands by a chunked scan, and what rests on them.

Intervals are closed.  A range join on (chromosome, range) alone has a few dozen keys, each nearly
quadratic; bins of positions give many small ones.  Long intervals go to coarser levels, so none
is copied more than ``FAN + 1`` times.

Edge cases: null bounds or chromosomes match nothing; an interval that ends before it begins neither;
repeated intervals are kept, each with its own matches; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

BIN, FAN, CHUNK = 1024, 16, 1 << 20
#: Level i has bins of width * FAN^i; seven of them reach beyond any genome.
LEVELS = 7


def _at_level(width: int, level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(width * FAN**i) for i in range(LEVELS)]), level + 1)


def _level(length: Column, width: int) -> Column:
    """The lowest level at which a range of this length covers at most ``FAN`` + 1 bins."""
    out = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        out = F.when(length <= width * FAN ** (i + 1), i).otherwise(out)
    return out


def _fine(first: str, last: str) -> Column:
    return F.col(first).isNotNull() & F.col(last).isNotNull() & (F.col(first) <= F.col(last))


def _bins(first: str, last: str, width: Column | int) -> Column:
    return F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))


def levelled(intervals: DataFrame, bounds: tuple[str, str], width: int) -> DataFrame:
    """The intervals that aren't empty, with the ``__level`` of their length."""
    first, last = bounds
    return intervals.where(_fine(first, last)).withColumn("__level", _level(F.col(last) - F.col(first) + 1, width))


def levels_used() -> Column:
    """A bit for each level that ``levelled`` intervals have."""
    return F.coalesce(F.bit_or(F.expr("shiftleft(1, __level)")), F.lit(0))


def binned(levels: DataFrame, bounds: tuple[str, str], width: int) -> DataFrame:
    """A row for each ``__bin`` of its level that a ``levelled`` interval reaches."""
    return levels.withColumn("__bin", F.explode(_bins(*bounds, _at_level(width, F.col("__level")))))


def asking(ranges: DataFrame, bounds: tuple[str, str], width: int, used: Column) -> DataFrame:
    """A row for each (``__level``, ``__bin``) of the levels ``used`` that a range reaches."""
    at_level = lambda i: F.transform(_bins(*bounds, width * FAN**i), lambda x: F.struct(F.lit(i).alias("level"), x.alias("bin")))
    none = F.expr("cast(array() as array<struct<level:int,bin:bigint>>)")
    places = F.flatten(F.array(*[F.when(F.expr(f"__used & {1 << i}") != 0, at_level(i)).otherwise(none) for i in range(LEVELS)]))
    rows = ranges.where(_fine(*bounds)).withColumn("__used", used).withColumn("__at", F.explode(places))
    return rows.withColumns({"__level": F.col("__at.level"), "__bin": F.col("__at.bin")}).drop("__at", "__used")


def met_once(left_range: tuple[str, str], right_range: tuple[str, str], width: int) -> Column:
    """Whether two ranges of one bin share a position, and this is the bin in which what they share begins."""
    (a, b), (c, d) = left_range, right_range
    meets = (F.col(a) <= F.col(d)) & (F.col(b) >= F.col(c))
    return meets & (F.col("__bin") == F.floor(F.greatest(F.col(a), F.col(c)) / _at_level(width, F.col("__level"))))


def _paired(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: int, longest: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows with the ``__level`` and ``__bin`` in which they meet."""
    r = levelled(right, right_range, width)
    if longest is None:
        used = r.agg(levels_used()).scalar()
    else:
        top = next((i for i in range(LEVELS) if longest <= width * FAN ** (i + 1)), LEVELS - 1)
        used = F.lit((2 << top) - 1)
    return asking(left, left_range, width, used), binned(r, right_range, width)


def overlap_join(left: DataFrame, right: DataFrame, on: str = "chrom", left_range: tuple[str, str] = ("first", "last"), right_range: tuple[str, str] = ("r_first", "r_last"), width: int = BIN, longest: int | None = None) -> DataFrame:
    """All pairs with equal ``on`` whose ranges share a position; columns of both sides (names differ but for ``on``).

    A range of one position is (pos, pos).  Each pair comes once: from the bin in which it begins.  The left side goes to
    the levels that the right side uses: a scalar subquery finds them while the query runs (``longest``, a bound
    on the right ranges' length that the caller knows, replaces it).
    """
    l, r = _paired(left, right, left_range, right_range, width, longest)
    return l.join(r, [on, "__level", "__bin"]).where(met_once(left_range, right_range, width)).drop("__level", "__bin")


def _sweep(left_range: tuple[str, str], right_range: tuple[str, str], width: int, names: list[str], pieces: int) -> Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]:
    """Pairs of one part of a bin: right ranges in order of their begins, of which each left range meets a run.

    The run goes from the first range that can still be active, by the longest of the part, to the last that begins in time.
    """

    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        a, b = (l.column(x).to_numpy() for x in left_range)
        c, d = (r.column(x).to_numpy() for x in right_range)
        order = np.argsort(c, kind="stable")
        c, d = c[order], d[order]
        size = width * FAN ** int(l.column("__level")[0].as_py())
        own = int(l.column("__bin")[0].as_py())
        low = np.searchsorted(c, a - int((d - c).max(initial=0)), "left")
        many = np.maximum(np.searchsorted(c, b, "right") - low, 0)
        total = np.cumsum(many)
        out, at = [], 0
        while at < len(a):
            base = total[at - 1] if at else 0
            end = max(int(np.searchsorted(total, base + pieces, "right")), at + 1)
            x = np.repeat(np.arange(at, end), many[at:end])
            y = np.arange(len(x)) + np.repeat(low[at:end] - (total[at:end] - many[at:end] - base), many[at:end])
            keep = (d[y] >= a[x]) & (np.maximum(a[x], c[y]) // size == own)
            x, y = pa.array(x[keep]), pa.array(order[y[keep]])
            columns = {n: l.column(n).take(x) for n in l.column_names} | {n: r.column(n).take(y) for n in r.column_names if n not in l.column_names}
            out.append(pa.table([columns[n] for n in names], names=names))
            at = end
        return pa.concat_tables(out)

    return run


def deep_overlap_join(left: DataFrame, right: DataFrame, on: str = "chrom", left_range: tuple[str, str] = ("first", "last"), right_range: tuple[str, str] = ("r_first", "r_last"), width: int = BIN, deep: int = 100_000, pieces: int = 4_000_000, part: int = 100_000) -> DataFrame:
    """``overlap_join`` for data of very uneven depth.

    A histogram counts each bin's rows of both sides.  A bin with more than ``deep`` of either is swept in order of the begins in place of
    comparing all with all; the others take the plain way.  A swept bin of more than ``part`` rows of either (and ``deep``) is split: its left rows into parts
    by a digest of their columns, its right rows likewise, and every two parts meet in a task.  A row is copied once for each part of
    the other side, so parts are as large as a task's memory allows, however small ``deep`` is.  The histogram's hot rows are at most one for
    ``deep`` rows of input.  Range columns are longs.
    """
    keys = [on, "__level", "__bin"]
    l, r = _paired(left, right, left_range, right_range, width, None)
    count = lambda side, name: side.groupBy(keys).agg(F.count(F.lit(1)).alias(name))
    both = count(l, "__nl").join(count(r, "__nr"), keys)
    parts = lambda n: F.ceil(F.col(n) / max(deep, part)).cast("int")
    hot = both.where((F.col("__nl") > deep) | (F.col("__nr") > deep)).select(*keys, parts("__nl").alias("__pl"), parts("__nr").alias("__pr"))
    plain = l.join(hot, keys, "left_anti").join(r.join(hot, keys, "left_anti"), keys).where(met_once(left_range, right_range, width)).drop("__level", "__bin")
    own = lambda side, n: F.pmod(F.xxhash64(*side.columns), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hl = l.join(hot, keys).withColumn("__i", own(l, "__pl")).withColumn("__j", each("__pr")).drop("__pl", "__pr")
    hr = r.join(hot, keys).withColumn("__j", own(r, "__pr")).withColumn("__i", each("__pl")).drop("__pl", "__pr")
    part = [*keys, "__i", "__j"]
    swept = hl.groupBy(part).cogroup(hr.groupBy(part)).applyInArrow(_sweep(left_range, right_range, width, plain.columns, pieces), plain.schema)
    return plain.unionByName(swept)


def stab(points: DataFrame, intervals: DataFrame, on: str = "chrom", pos: str = "pos", width: int = BIN) -> DataFrame:
    """Every interval (first, last) that contains each point; order the result by (first, last) where order matters."""
    renamed = intervals.withColumnsRenamed({"first": "r_first", "last": "r_last"})
    return overlap_join(points, renamed, on, (pos, pos), width=width).withColumnsRenamed({"r_first": "first", "r_last": "last"})


def contained(points: DataFrame, intervals: DataFrame, on: str = "chrom", pos: str = "pos", width: int = BIN, merged: bool = False) -> DataFrame:
    """``points`` with ``inside``: whether any interval contains the point (unknown or null places: false).

    Intervals are merged first (``merged``: they already are), so a point meets one at most.
    """
    places = points.select(on, pos).where(F.col(on).isNotNull() & F.col(pos).isNotNull()).distinct()
    regions = intervals.select(on, "first", "last") if merged else merge(intervals, on)
    hits = stab(places, regions, on, pos, width).select(on, pos).withColumn("inside", F.lit(True))
    return points.join(hits, [on, pos], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def stabbed(points: DataFrame, intervals: DataFrame, on: str = "chrom", pos: str = "pos", width: int = BIN) -> DataFrame:
    """The points that some interval contains, each row once."""
    return contained(points, intervals, on, pos, width).where("inside").drop("inside")


def with_islands(df: DataFrame, on: str, first: str, last: str, gap: int, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``island``: where its island begins.  One does, within ``on``, where a row begins more than ``gap`` after all before it end.

    A row that ends before it begins, or has no end, counts as one position.  The scan is such that a chromosome with most of the rows
    isn't one task: rows are dealt into chunks of positions; a thin table of each chunk's furthest end and last
    begin of an island has running values that go back to the chunks.
    """
    return islands_by_chunk(df, on, first, last, gap, chunk).drop("chunk")


def islands_by_chunk(df: DataFrame, on: str, first: str, last: str, gap: int, chunk: int = CHUNK) -> DataFrame:
    """``with_islands`` with ``chunk``, by which (and ``on``) its rows are dealt."""
    inner = Window.partitionBy(on, "chunk").orderBy(first, last)
    before = Window.partitionBy(on).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = df.where(F.col(on).isNotNull() & F.col(first).isNotNull()).withColumns({"chunk": F.floor(F.col(first) / chunk), "__last": F.greatest(first, last)})
    # what would begin an island if nothing came before the chunk
    reach = F.max("__last").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    rows = placed.withColumn("__new", F.when(reach.isNull() | (F.col(first) > reach + gap), F.col(first)))
    ends = rows.groupBy(on, "chunk").agg(F.max("__last").alias("__reach"), F.max("__new").alias("__start"))
    begins = lambda c: F.when(F.col("__end").isNull() | (F.col(c) > F.col("__end") + gap), F.col(c))
    carried = ends.withColumn("__end", F.max("__reach").over(before)).withColumn("__from", F.max(begins("__start")).over(before)).drop("__reach", "__start")
    joined = rows.join(carried, [on, "chunk"])
    # begins rise, so the last one is the greatest; equal rows, whose order may differ by now, share theirs
    own = F.max(begins("__new")).over(inner.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.withColumn("island", F.coalesce(own, "__from")).drop("__last", "__new", "__end", "__from")


def merge(intervals: DataFrame, on: str = "chrom", chunk: int = CHUNK) -> DataFrame:
    """Intervals that overlap or share an end position become one; (1, 5) and (6, 9) stay apart."""
    rows = with_islands(intervals.select(on, "first", "last").where("first <= last"), on, "first", "last", 0, chunk)
    return rows.groupBy(on, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def subset(intervals: DataFrame, value: str, on: str = "chrom") -> DataFrame:
    """The intervals of one chromosome."""
    return intervals.where(F.col(on) == value)


def tile(chromosomes: DataFrame, size: int) -> DataFrame:
    """(chrom, first, last): pieces of at most ``size`` that cover each chromosome whole."""
    pieces = chromosomes.where("length > 0").withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length"), F.lit(size).cast("long"))))
    return pieces.select("chrom", "first", F.least("length", F.col("first") + size - 1).alias("last"))


def whole(chromosomes: DataFrame) -> DataFrame:
    """One range for each whole chromosome."""
    return chromosomes.select("chrom", F.lit(1).cast("long").alias("first"), F.col("length").alias("last"))


def annotations(features: DataFrame, on: str = "chrom") -> DataFrame:
    """(chrom, first, last, features): the sorted distinct labels of each distinct interval."""
    return features.groupBy(on, "first", "last").agg(F.array_sort(F.collect_set("label")).alias("features"))


def annotate(points: DataFrame, features: DataFrame, on: str = "chrom", pos: str = "pos", width: int = BIN) -> DataFrame:
    """One row for each point, interval that contains it and label of that interval."""
    return stab(points, annotations(features, on), on, pos, width).withColumn("label", F.explode("features")).drop("features")


def longest_by_start(intervals: DataFrame, on: str = "chrom") -> DataFrame:
    """(chrom, first, last, smaller): of the distinct intervals with one start the longest, and the sorted ends of the others."""
    distinct = intervals.select(on, "first", "last").distinct()
    return distinct.groupBy(on, "first").agg(F.max("last").alias("last"), F.array_sort(F.collect_set("last")).alias("all")).select(on, "first", "last", F.slice("all", F.lit(1), F.size("all") - 1).alias("smaller"))


def previous_at_least(values: np.ndarray, groups: np.ndarray, asked: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each place ``asked`` the last one before it, in its group, whose value is ``least`` or more (-1: none).

    Groups are numbers that never fall.  A search over levels: each level holds the maxima of pairs of the one below; all
    places climb together until the pair to their left holds such a value, then go down to its last.
    """
    levels = [values]
    while len(levels[-1]) > 1:
        top = levels[-1]
        top = np.append(top, np.iinfo(np.int64).min) if len(top) % 2 else top
        levels.append(np.maximum(top[::2], top[1::2]))
    start = np.searchsorted(groups, groups[asked], "left")
    node, level, found = asked.astype(np.int64), np.zeros(len(asked), np.int64), np.full(len(asked), -1, np.int64)
    live = np.arange(len(asked))
    for k in range(len(levels)):
        # a right child's left brother lies before the place
        odd = live[(node[live] & 1) == 1]
        good = odd[levels[k][node[odd] - 1] >= least[odd]]
        found[good], level[good] = node[good] - 1, k
        live = live[found[live] < 0]
        # what is left of the group's begin isn't asked for
        live = live[(node[live] << k) > start[live]]
        node[live] >>= 1
    for k in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero((found >= 0) & (level == k))
        right = 2 * found[down] + 1
        inside = right < len(levels[k - 1])
        take = np.zeros(len(down), bool)
        take[inside] = levels[k - 1][right[inside]] >= least[down][inside]
        found[down], level[down] = np.where(take, right, right - 1), k - 1
    return np.where(found >= start, found, -1)


def _nearest_outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (on, level, bin, first, last, outer), sorted by them with last falling: each row that isn't an outer one with the nearest that encloses it.

    What can enclose rows of the next batch goes on to it: of the last group the outer rows that end after all later ones.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        skip = held.num_rows if held is not None else 0
        table = pa.Table.from_batches([held, batch] if skip else [batch]).combine_chunks()
        names, columns = table.schema.names, [table.column(i).combine_chunks() for i in range(6)]
        keys = [columns[0].dictionary_encode().indices.to_numpy(zero_copy_only=False), *(c.to_numpy() for c in columns[1:3])]
        first, last, outer = columns[3].to_numpy(), columns[4].to_numpy(), columns[5].to_numpy(zero_copy_only=False)
        new = np.append(False, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        groups = np.cumsum(new)
        values = np.where(outer, last, np.iinfo(np.int64).min)
        asked = np.flatnonzero(~outer)
        at = previous_at_least(values, groups, asked, last[asked])
        none = at < 0
        parents = [pa.array(x[np.maximum(at, 0)], pa.int64(), mask=none) for x in (first, last)]
        yield pa.RecordBatch.from_arrays([columns[0].take(pa.array(asked)), pa.array(first[asked]), pa.array(last[asked]), *parents], names=[names[0], names[3], names[4], "parent_first", "parent_last"])
        begin = int(np.searchsorted(groups, groups[-1], "left"))
        own = values[begin:]
        later = np.append(np.maximum.accumulate(own[::-1])[::-1][1:], np.iinfo(np.int64).min)
        stays = begin + np.flatnonzero(outer[begin:] & (own > later))
        held = table.take(pa.array(stays)).combine_chunks().to_batches()
        held = held[0] if held else None


def enclosing(intervals: DataFrame, on: str = "chrom", width: int = BIN) -> DataFrame:
    """Each distinct interval with parent_first, parent_last: the nearest that encloses it (null: none).

    The nearest begins last, then ends first.  As a possible parent an interval goes to the bins of its level that it reaches, ``FAN`` + 1 at
    most; to find its own it asks, in every level, the bin in which it begins.  The nearest of all levels is its parent.
    """
    own = intervals.where("first <= last").select(on, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).distinct()
    tall = own.withColumn("level", _level(F.col("last") - F.col("first") + 1, width).cast("int"))
    size = _at_level(width, F.col("level"))
    outer = tall.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size)))).withColumn("outer", F.lit(True))
    # an interval that encloses another is no shorter, so its level is no lower
    asks = tall.withColumn("level", F.explode(F.sequence(F.col("level"), F.lit(LEVELS - 1)))).withColumn("bin", F.floor(F.col("first") / size)).withColumn("outer", F.lit(False))
    order = [on, "level", "bin", "first", "last", "outer"]
    both = outer.select(order).unionByName(asks.select(order)).repartition(on, "level", "bin")
    # an interval asks before its own row as a parent
    ordered = both.sortWithinPartitions(on, "level", "bin", "first", F.desc("last"), "outer")
    fields = [own.schema[on], *StructType.fromDDL("first long, last long, parent_first long, parent_last long").fields]
    found = ordered.mapInArrow(_nearest_outer, StructType(fields))
    best = F.max(F.when(F.col("parent_first").isNotNull(), F.struct("parent_first", (-F.col("parent_last")).alias("less")))).alias("p")
    return found.groupBy(on, "first", "last").agg(best).select(on, "first", "last", F.col("p.parent_first").alias("parent_first"), (-F.col("p.less")).alias("parent_last"))


def interval_text(first: str = "first", last: str = "last") -> Column:
    """``[first, last]``."""
    return F.format_string("[%d, %d]", F.col(first), F.col(last))


def region_text(chrom: str = "chrom", first: str = "first", last: str = "last") -> Column:
    """``chrom:first-last``."""
    return F.format_string("%s:%d-%d", F.col(chrom), F.col(first), F.col(last))


def parse_region(text: Column) -> Column:
    """A struct (chrom, first, last) of ``chrom:first-last``; fields are null where the text has another form."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^(.+):([0-9]+)-([0-9]+)$", i), F.lit(""))
    return F.struct(part(1).alias("chrom"), part(2).cast("long").alias("first"), part(3).cast("long").alias("last"))
