"""A deterministic permutation of 0..n-1: a balanced Feistel network with cycle walking.

The round function is the first 32 bits of an MD5 over the key and the half, so any SQL engine can
repeat it.  Only the bijection and its determinism are promised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import running

ROUNDS, WALKS = 4, 64


def _round(key: Column, half: Column, bits: int) -> Column:
    digest = F.substring(F.md5(F.concat_ws(":", key, half.cast("string")).cast("binary")), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(1 << bits))


def half_bits(n: int) -> int:
    """Bits of each half for a domain that holds n values."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def keys(seed: int) -> Column:
    """The round keys of a seed."""
    return F.array(*[F.lit(f"{i}:{seed}") for i in range(ROUNDS)])


def encode(x: Column, bits: int, round_keys: Column) -> Column:
    """One pass of the network over a value of 2 * bits bits."""
    start = F.struct(F.shiftrightunsigned(x, bits).alias("l"), x.bitwiseAND(F.lit((1 << bits) - 1)).alias("r"))
    step = lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_round(k, s["r"], bits)).alias("r"))
    return F.aggregate(round_keys, start, step, lambda s: F.shiftleft(s["l"], bits).bitwiseOR(s["r"]))


def decode(x: Column, bits: int, round_keys: Column) -> Column:
    """The value that ``encode`` turns into x."""
    start = F.struct(F.shiftrightunsigned(x, bits).alias("l"), x.bitwiseAND(F.lit((1 << bits) - 1)).alias("r"))
    step = lambda s, k: F.struct(s["r"].bitwiseXOR(_round(k, s["l"], bits)).alias("l"), s["l"].alias("r"))
    return F.aggregate(F.reverse(round_keys), start, step, lambda s: F.shiftleft(s["l"], bits).bitwiseOR(s["r"]))


def permuted(x: Column, n: int, seed: int) -> Column:
    """Where x of 0..n-1 goes; values that leave the range are encoded again."""
    bits = half_bits(n)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), encode(x.cast("long"), bits, keys(seed)), lambda a, _: F.when(a < n, a).otherwise(encode(a, bits, keys(seed))))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the permutation walked too long")).cast("long"))


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(i, value): a permutation of 0..n-1."""
    return spark.range(n).select(F.col("id").alias("i"), permuted(F.col("id"), n, seed).alias("value"))


def shuffled_sample(df: DataFrame, index: str, n: int, k: int, seed: int) -> DataFrame:
    """The k rows whose 0-based ``index`` of 0..n-1 goes to the k smallest places: a sample without replacement."""
    return df.withColumn("place", permuted(F.col(index), n, seed)).where(F.col("place") < k)


def shuffled(df: DataFrame, index: str, seed: int, chunks: int = 1 << 14) -> DataFrame:
    """``df`` with ``place``: its rows' numbers from 0 on in an order drawn by a seeded digest of the integer ``index`` (each once).

    Rows are dealt to ``chunks`` ranges of digests, ordered inside each, and numbered on from the counts of the ranges before.
    """
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(index).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    keyed = df.withColumns({"__all": F.lit(0), "__key": digest})
    return running(keyed, ["__all"], "__key", {"place": F.lit(1)}, (1 << 60) // chunks, (index,)).drop("__all", "__key")
