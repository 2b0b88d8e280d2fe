"""K-mers as column expressions: two bits a base (A 0, C 1, G 2, T or U 3), first base highest, k up to 32 (whose bigint is that of 64 bits with a sign).

Null sequences give null (or an empty array); other characters than ACGTU, in either case, are not bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of every pair of bits the lower one.
LOW_BITS = 0x5555555555555555


def is_bases(seq: Column) -> Column:
    """Whether all characters are bases."""
    return seq.rlike("^[ACGTUacgtu]*$")


def pack(seq: Column) -> Column:
    """The bigint of up to 32 bases; null for longer texts or other characters; 0 for none."""
    digits = F.translate(F.upper(seq), "ACGTU", "01233")
    # base 4 text: conv reads it in one call
    value = F.conv(digits, 4, -10).cast("long")
    return F.when(is_bases(seq) & (F.length(seq) <= 32), F.when(F.length(seq) == 0, F.lit(0).cast("long")).otherwise(value))


def render(kmer: Column, k: int) -> Column:
    """The k bases of a packed k-mer."""
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of a text of bases, in upper case with T."""
    return F.reverse(F.translate(F.upper(seq), "ACGTU", "TGCAA"))


def reverse(kmer: Column, k: int) -> Column:
    """The packed k-mer with its bases in reverse order."""
    return pack(F.reverse(render(kmer, k)))


def reverse_complement_packed(kmer: Column, k: int) -> Column:
    """The packed reverse complement."""
    return pack(reverse_complement(render(kmer, k)))


def hamming(x: Column, y: Column) -> Column:
    """Number of differing bases of two packed k-mers."""
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(LOW_BITS)))


def windows(seq: Column, k: int) -> Column:
    """Array of struct (at, kmer): every window of k bases with its 0-based place; other characters interrupt.

    Runs of at least k bases are found first, and each is cut into characters once, so that the work grows
    with the length and not with its square.
    """
    s = F.coalesce(seq, F.lit(""))
    pattern = f"[ACGTUacgtu]{{{k},}}+"
    runs = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    gaps = F.split(s, pattern, -1)
    none = F.expr("cast(array() as array<struct<first:int,text:string>>)")

    def place(state: Column, x: Column) -> Column:
        first = state["at"] + x["gap"]
        return F.struct((first + F.length(x["text"])).alias("at"), F.concat(state["done"], F.array(F.struct(first.alias("first"), x["text"].alias("text")))).alias("done"))

    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(runs)), runs, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("text")))
    placed = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("done")), place, lambda x: x["done"])

    def cut(run: Column) -> Column:
        signs = F.array(F.split(run["text"], ""))
        return F.flatten(F.transform(signs, lambda c: F.transform(F.sequence(F.lit(0), F.length(run["text"]) - k), lambda i: F.struct((run["first"] + i).alias("at"), pack(F.array_join(F.slice(c, i + 1, F.lit(k)), "")).alias("kmer")))))

    return F.flatten(F.transform(placed, cut))


def both_strands(seq: Column, k: int) -> Column:
    """Array of packed k-mers: each window's and its reverse complement's."""
    return F.flatten(F.transform(windows(seq, k), lambda w: F.array(w["kmer"], reverse_complement_packed(w["kmer"], k))))


def frequencies(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, kmer, n): windows of each k-mer, both strands, in long form: only those that occur."""
    return df.select(key, F.explode(both_strands(F.col(seq), k)).alias("kmer")).groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("n"))


def frequency_vectors(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, vector): the dense array of 4^k counts of each key with windows: its counts in order, with runs of zeros between."""
    found = frequencies(df, key, seq, k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kmer", "n"))).alias("__f"))
    last = F.element_at("__f", -1)["kmer"]
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
    before = lambda i: F.coalesce(F.get(F.col("__f"), i - 1)["kmer"], F.lit(-1))
    parts = F.transform("__f", lambda x, i: F.concat(zeros(x["kmer"] - before(i) - 1), F.array(x["n"])))
    return found.select(key, F.concat(F.flatten(parts), zeros(4**k - 1 - last)).alias("vector"))
