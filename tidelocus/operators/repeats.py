"""Repeat elements: annotated spans of a genome cut out, told apart by content, and padded.

Genomes come as ``schemas.SEQUENCES``, whole or in pieces (name, start, seq) from ``sequence_pieces``, so that a chromosome
is not one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE, WINDOW = 1 << 16, 50


def content_key(seq: Column) -> Column:
    """The first 64 bits of a sequence's SHA-256, as 16 hexadecimal digits."""
    return F.substring(F.sha2(seq, 256), 1, 16)


def padded(begin: Column, end: Column, length: Column, window: int) -> tuple[Column, Column]:
    """The span with ``window`` more on both sides, inside 1..length."""
    return F.greatest(F.lit(1), begin - window), F.least(length, end + window)


def cut(seq: Column, begin: Column, end: Column) -> Column:
    """Positions begin to end (1-based, closed); an error where they leave the sequence."""
    fine = (begin >= 1) & (begin <= end + 1) & (end <= F.length(seq))
    return F.when(fine, F.substring(seq, begin.cast("int"), (end - begin + 1).cast("int"))).otherwise(F.raise_error(F.lit("bad interval")))


def select_repeats(repeats: DataFrame, repeat_class: str | None = None, label: str | None = None) -> DataFrame:
    """Rows of one class whose label has a match of the regular expression (None: any)."""
    if repeat_class is not None:
        repeats = repeats.where(F.col("class") == repeat_class)
    return repeats.where(F.col("label").rlike(label)) if label is not None else repeats


def classes(repeats: DataFrame) -> DataFrame:
    """The distinct classes; order by ``class`` where order matters."""
    return repeats.select("class").distinct()


def label_counts(repeats: DataFrame) -> DataFrame:
    """(label, n): elements of each label."""
    return repeats.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def first_by_content(df: DataFrame, seq: str, *order: str) -> DataFrame:
    """Of rows with equal content keys the first by ``order``.

    The first row's order values come from a partial aggregation, so a content that very many rows share is
    no hot spot; a null sequence is a content of its own.
    """
    keyed = df.withColumn("__content", F.coalesce(content_key(F.col(seq)), F.lit("")))
    first = keyed.groupBy("__content").agg(F.min(F.struct(*order)).alias("__first"))
    rows = keyed.withColumn("__order", F.struct(*order)).join(first, "__content").where(F.col("__order") == F.col("__first"))
    return rows.drop("__content", "__first", "__order")


def sequence_pieces(genome: DataFrame, size: int = PIECE) -> DataFrame:
    """(name, order, piece, start, length, seq): each sequence in pieces of ``size``; order is the place in the file."""
    ordered = genome if "order" in genome.columns else genome.withColumn("order", F.monotonically_increasing_id())
    length = F.length("seq").cast("long")
    starts = F.sequence(F.lit(1).cast("long"), F.greatest(length, F.lit(1)), F.lit(size).cast("long"))
    rows = ordered.select("name", "order", length.alias("length"), F.explode(starts).alias("start"), "seq")
    return rows.select("name", "order", F.floor((F.col("start") - 1) / size).alias("piece"), "start", "length", F.substring("seq", F.col("start").cast("int"), F.lit(size)).alias("seq"))


def slices(spans: DataFrame, pieces: DataFrame, first: str, last: str, size: int = PIECE) -> DataFrame:
    """``spans`` (chrom, first, last, a unique ``row_no``) with ``slice``, put together from the pieces that hold it."""
    parts = spans.withColumn("piece", F.explode(F.sequence(F.floor((F.col(first) - 1) / size), F.floor((F.col(last) - 1) / size))))
    held = parts.join(pieces.select(F.col("name").alias("chrom"), "piece", "start", "seq"), ["chrom", "piece"])
    a, b = F.greatest(F.col(first), F.col("start")), F.least(F.col(last), F.col("start") + F.length("seq") - 1)
    held = held.withColumn("part", F.substring("seq", (a - F.col("start") + 1).cast("int"), (b - a + 1).cast("int")))
    whole = held.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("piece", "part"))).alias("parts"))
    return spans.join(whole.select("row_no", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("slice")), "row_no")


def prepare_repeats(repeats: DataFrame, genome: DataFrame, window: int = WINDOW, repeat_class: str | None = None, label: str | None = None, size: int = PIECE) -> DataFrame:
    """``schemas.SEQUENCES`` of ``schemas.REPEATS``: distinct contents, each padded by ``window``.

    Contents are compared unpadded and as they are written; the first by genome order, then row_no, stays.
    ``genome`` holds sequences (name, seq) or their pieces of ``size`` (``sequence_pieces``).
    Rows on other chromosomes are left out; spans that leave their chromosome raise an error.
    """
    pieces = genome if "piece" in genome.columns else sequence_pieces(genome, size)
    table = pieces.groupBy(F.col("name").alias("chrom")).agg(F.min("order").alias("order"), F.first("length").alias("length"))
    rows = select_repeats(repeats, repeat_class, label).join(table, "chrom")
    bad = (F.col("begin") < 1) | (F.col("end") > F.col("length")) | (F.col("begin") > F.col("end"))
    rows = rows.where(~F.when(bad, F.raise_error(F.lit("bad interval")).cast("boolean")).otherwise(F.lit(False)))
    own = first_by_content(slices(rows, pieces, "begin", "end", size), "slice", "order", "row_no").drop("slice")
    st, en = padded(F.col("begin"), F.col("end"), F.col("length"), window)
    wide = slices(own.withColumns({"st": st, "en": en}), pieces, "st", "en", size)
    name = F.format_string("%s:%d-%d~%d~%s~%s", "chrom", "begin", "end", F.lit(window), "class", "label")
    return wide.select(name.alias("name"), F.col("slice").alias("seq"))
