"""Text formats as DataFrames; ``.gz`` files are read through Spark's codecs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..operators.intervals import merge
from ..operators.repeats import PIECE
from ..scratch import written

#: Letters of a sequence that one row holds at most, and a line more.
FRAGMENT = 1 << 20


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, first, last, name) of a BED file with four columns: 0-based half-open there, 1-based closed here.

    Comment, ``track`` and ``browser`` lines are skipped.
    """
    lines = spark.read.text(path).where(r"value rlike '\\S' and not value rlike '^(#|track|browser)'")
    parts = F.split("value", "\t")
    return lines.select(parts[0].alias("chrom"), (parts[1].cast("long") + 1).alias("first"), parts[2].cast("long").alias("last"), F.get(parts, 3).alias("name"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """The merged regions of a BED file."""
    return merge(read_bed(spark, path))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, order) of a FASTA file; the name ends at the first blank, ``order`` rises through the file.

    A record begins with ``>`` at the begin of a line; one elsewhere in a header belongs to it.
    """
    records = spark.read.text(path, lineSep="\n>").where(r"value rlike '\\S'").select(F.regexp_replace("value", "^>", "").alias("value"), F.monotonically_increasing_id().alias("order"))
    header = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(header) + 1, F.length("value"))
    return records.select(F.regexp_extract(header, r"^\s*(\S*)", 1).alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"), "order")


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines (file, at, value) in file order: (file, at, no, head, part), with a new fragment at each header, range and ``FRAGMENT`` letters.

    ``head`` is the header's name, null where a fragment goes on with the record of the one before.
    """
    now, no, head, parts, size, some = None, 0, None, [], 0, False

    def told() -> pa.RecordBatch:
        columns = [[now[0]], [now[1]], [no], [head], ["".join(parts)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "at", "no", "head", "part"])

    for batch in batches:
        for file, at, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            title = line.startswith(">")
            if (file, at) != now or title or size >= FRAGMENT:
                if some:
                    yield told()
                no = no + 1 if (file, at) == now else 0
                now, head, parts, size, some = (file, at), None, [], 0, False
            if title:
                head, some = (line[1:].split() or [""])[0], True
            elif letters := "".join(line.split()):
                parts.append(letters)
                size, some = size + len(letters), True
    if some:
        yield told()


def read_fasta_pieces(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """(name, order, piece, start, length, seq) of FASTA files: sequences in pieces of ``size``, as ``repeats.sequence_pieces`` gives them.

    Spark splits the files into ranges of bytes (not ``.gz`` ones), and no sequence is ever a row: each range gives fragments, whose places in their records
    come from running sums over thin rows (one for a header or ``FRAGMENT`` letters).  Letters before the first header are left out.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    parts = written(lines.mapInArrow(_fragments, "file string, at long, no long, head string, part string"), "fasta-fragments")
    upto = Window.partitionBy("file").orderBy("at", "no")
    thin = parts.select("file", "at", "no", "head", F.length("part").cast("long").alias("n"))
    thin = thin.withColumns({"record": F.count("head").over(upto), "name": F.last("head", ignorenulls=True).over(upto), "before": F.sum("n").over(upto) - F.col("n")}).where("record > 0")
    own = Window.partitionBy("file", "record")
    thin = thin.withColumns({"offset": F.col("before") - F.min("before").over(own), "length": F.sum("n").over(own)}).where("n > 0 or length = 0")
    files = thin.select("file").distinct().withColumn("rank", F.row_number().over(Window.orderBy("file")).cast("long"))
    placed = thin.join(files, "file").withColumn("order", F.shiftleft("rank", 40) + F.col("record")).select("file", "at", "no", "name", "order", "offset", "length", "n")
    cut = parts.select("file", "at", "no", "part").join(placed, ["file", "at", "no"])
    cut = cut.withColumn("piece", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.greatest("n", F.lit(1)) - 1) / size))))
    first = F.greatest(F.col("piece") * size - F.col("offset"), F.lit(0))
    last = F.least((F.col("piece") + 1) * size - F.col("offset"), F.col("n"))
    held = cut.select("name", "order", "length", "piece", (F.col("offset") + first).alias("from"), F.substring("part", (first + 1).cast("int"), (last - first).cast("int")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", "text"))), lambda x: x["text"]), "")
    whole = held.groupBy("order", "piece").agg(F.first("name").alias("name"), F.first("length").alias("length"), joined.alias("seq"))
    return whole.select("name", "order", "piece", (F.col("piece") * size + 1).alias("start"), "length", "seq")


def read_repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    """``schemas.REPEATS`` of RepeatMasker tables: header lines (SW ..., score ..., empty), then rows of exactly 15 fields.

    Other rows are left out (``bad_rows`` counts them); a strand but + or C raises an error.
    """
    fields, lines = _repeat_lines(spark, path)
    strand = F.when(fields[8] == "+", "+").when(fields[8] == "C", "-").otherwise(F.raise_error(F.concat(F.lit("bad strand: "), fields[8])))
    good = lines.where(F.size(fields) == 15)
    return good.select("row_no", fields[4].alias("chrom"), fields[5].cast("long").alias("begin"), fields[6].cast("long").alias("end"), strand.alias("strand"), fields[9].alias("label"), fields[10].alias("class"))


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, value) of the rows that ``read_repeatmasker`` leaves out."""
    fields, lines = _repeat_lines(spark, path)
    return lines.where(F.size(fields) != 15)


def _repeat_lines(spark: SparkSession, path: str):
    # every file's header: two lines of titles and an empty one
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("row_no")).where(r"not value rlike '^\\s*((SW|score)\\b.*)?$'")
    return F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lines


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header and a fixed schema, such as ``schemas.CLIPS`` or ``schemas.PEAKS``."""
    return spark.read.csv(path, schema=schema, sep="\t", header=True, enforceSchema=True)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row, fields): untyped rows, split at blanks, without each file's header and empty lines; ``row`` rises through a file."""
    # the CSV reader leaves out the first line of every file; no line holds the separator
    lines = spark.read.csv(path, schema="v string", sep="\u0001", header=True, quote="", escape="", enforceSchema=True)
    return lines.select(F.monotonically_increasing_id().alias("row"), F.split(F.trim(F.regexp_replace("v", r"\s+", " ")), " ").alias("fields"))


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """``schemas.CLIPS``."""
    return read_tsv(spark, path, schemas.CLIPS)


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """``schemas.PEAKS``."""
    return read_tsv(spark, path, schemas.PEAKS)
