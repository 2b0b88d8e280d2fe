"""Text sinks: folders of parts, gzip where asked; one part only where ``single`` says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _write(df: DataFrame, line: Column, path: str, compression: str, single: bool) -> None:
    lines = df.select(line.alias("value"))
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path, compression=compression)


def write_fastq(reads: DataFrame, path: str, compression: str = "none", single: bool = False) -> None:
    """``schemas.READS`` as records of four lines; null qualities become ``*``."""
    _write(reads, F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), F.coalesce("qual", F.lit("*"))), path, compression, single)


def write_fasta(sequences: DataFrame, path: str, compression: str = "none", single: bool = False, line: int = 80) -> None:
    """``schemas.SEQUENCES``, with lines of ``line`` bases."""
    wrapped = F.regexp_replace("seq", f"(.{{{line}}})(?=.)", "$1\n")
    _write(sequences, F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped), path, compression, single)


def write_tsv(df: DataFrame, path: str, header: bool = True, compression: str = "none", single: bool = False) -> None:
    """Columns separated by tabs; deviations with two decimals."""
    shown = df.select(*[F.format_string("%.2f", c).alias(c) if c.endswith("_sd") else F.col(c) for c in df.columns])
    (shown.coalesce(1) if single else shown).write.mode("overwrite").csv(path, sep="\t", header=header, compression=compression)


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object with all its fields; NaN becomes null."""
    kinds = dict(df.dtypes)
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
    return clean.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, single: bool = True) -> None:
    """JSON objects, one a line."""
    lines = json_lines(df)
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)
