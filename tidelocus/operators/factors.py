"""Factors: names to numbers by first appearance, and fixed level tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import CHUNK, running


def levels(df: DataFrame, name: str, order: str, chunk: int = CHUNK) -> DataFrame:
    """(name, code): distinct names numbered from 0 by where they first appear (``order``: integers; ties by name)."""
    first = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("__first")).withColumn("__all", F.lit(0))
    return running(first, ["__all"], "__first", {"code": F.lit(1)}, chunk, (name,)).select(name, F.col("code").cast("int").alias("code"))


def encode(df: DataFrame, name: str, order: str) -> DataFrame:
    """``df`` with ``code`` (null names: null)."""
    return df.join(levels(df, name, order), name, "left")


def from_levels(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name, code) by place in the list."""
    return from_pairs(spark, list(zip(names, range(len(names)), strict=True)))


def from_pairs(spark: SparkSession, pairs: list[tuple[str, int]]) -> DataFrame:
    """(name, code) of given codes; codes between them get empty names."""
    given = {code: name for name, code in pairs}
    rows = [(given.get(code, ""), code) for code in range(max(given, default=-1) + 1)]
    return spark.createDataFrame(rows, "name string, code int")
