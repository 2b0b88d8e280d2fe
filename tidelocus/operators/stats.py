"""Mergeable statistics: moments, weighted moments, and the base-5 remedian."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import CHUNK, running

LEVELS, STEPS = 4, 4


def moments(df: DataFrame, by: list[str], value: str, weight: str | None = None, centre: float = 0.0) -> DataFrame:
    """(by, n, sx, sx2): count (or weight), sum and sum of squares; partial sums merge by addition.

    With a ``centre`` near the values the sums are those of distances from it, which keeps the variance of large
    values exact; add it to the mean.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    x = F.col(value) - centre if centre else F.col(value)
    known = F.when(x.isNotNull(), w)
    return df.groupBy(*by).agg(F.coalesce(F.sum(known), F.lit(0)).alias("n"), F.coalesce(F.sum(w * x), F.lit(0)).alias("sx"), F.coalesce(F.sum(w * x * x), F.lit(0)).alias("sx2"))


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """Moments of the union of parts."""
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sx2")])


def mean(n: str = "n", sx: str = "sx") -> Column:
    """NaN without values."""
    return F.when(F.col(n) == 0, F.lit(float("nan"))).otherwise(F.col(sx) / F.col(n))


def variance(n: str = "n", sx: str = "sx", sx2: str = "sx2") -> Column:
    """Population variance, never below 0; NaN without values."""
    m = F.col(sx) / F.col(n)
    return F.when(F.col(n) == 0, F.lit(float("nan"))).otherwise(F.greatest(F.col(sx2) / F.col(n) - m * m, F.lit(0.0)))


def deviation(n: str = "n", sx: str = "sx", sx2: str = "sx2") -> Column:
    """Root of the variance; -1 without values."""
    return F.when(F.col(n) == 0, F.lit(-1.0)).otherwise(F.sqrt(variance(n, sx, sx2)))


def indexed(df: DataFrame, by: list[str], order: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``index``, each row's 0-based place in its group by the integer ``order`` (rows of equal order: any way)."""
    return running(df, by, order, {"index": F.lit(1).cast("long")}, chunk)


def _reduced(values: Column) -> Column:
    """The upper median of the highest level of an array: medians of fives as long as there are five."""

    def fives(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / 5).cast("int") - 1), lambda k: F.get(F.array_sort(F.slice(x, k * 5 + 1, F.lit(5))), F.lit(2)))

    top = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), values, lambda x, _: F.when(F.size(x) >= 5, fives(x)).otherwise(x))
    return F.get(F.array_sort(top), F.floor(F.size(top) / 2).cast("int"))


def remedian(df: DataFrame, by: list[str], value: str, index: str = "index") -> DataFrame:
    """(by, median): medians of fives, then of those, and at last the upper median of the highest level.

    ``index`` numbers the rows of each group from 0.  A step is one aggregation over 5^``LEVELS`` rows, four levels at once, so
    ``STEPS`` steps suffice for any group of less than 5^16 rows; groups that are done pass through.  Only values that fill fives count
    above the lowest level.
    """
    span = 5**LEVELS
    rows = df.select(*by, F.col(index).alias("__i"), F.col(value).alias("__x"), F.lit(False).alias("__done"))
    for _ in range(STEPS):
        groups = rows.groupBy(*by, "__done", F.floor(F.col("__i") / span).alias("__i")).agg(F.array_sort(F.collect_list(F.struct("__i", "__x"))).alias("__v"))
        full = F.size("__v") == span
        # a group with a full part goes on with its full parts; one without is done
        groups = groups.where(F.col("__done") | full | (F.col("__i") == 0))
        rows = groups.select(*by, "__i", _reduced(F.transform("__v", lambda s: s["__x"])).alias("__x"), (F.col("__done") | ~full).alias("__done"))
    return rows.select(*by, F.col("__x").alias("median"))
