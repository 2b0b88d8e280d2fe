"""A data source writer for text in order: parts in the order of their names hold sorted lines, with one header in all.

Each task writes a file of its own under a name that no other attempt has; when all have ended, the commit gives the files of those
attempts that count their final names, so neither a lost task nor a second attempt leaves lines behind.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.window import Window


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    """A partition's number, the file that an attempt wrote, and its lines."""

    number: int
    file: str
    lines: int


class OrderedWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.header, self.zipped = options["path"].rstrip("/"), options.get("header"), options.get("compression") == "gzip"
        self.overwrite = overwrite
        system, place = _system(self.path)
        system.create_dir(f"{place}/_attempts", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, place = _system(self.path)
        number, lines = TaskContext.get().partitionId(), 0
        file = f"_attempts/{number}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{place}/{file}") as raw:
            out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.zipped else raw
            if self.header and number == 0:
                out.write(self.header.encode() + b"\n")
            for batch in iterator:
                if batch.num_rows:
                    out.write(("\n".join(batch.column(0).to_pylist()) + "\n").encode())
                    lines += batch.num_rows
            if self.zipped:
                out.close()
        return Part(number, file, lines)

    def commit(self, messages: list[Part | None]) -> None:
        system, place = _system(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(place)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.number):
            system.move(f"{place}/{m.file}", f"{place}/part-{m.number:08d}.txt{'.gz' * self.zipped}")
        system.delete_dir(f"{place}/_attempts")

    def abort(self, messages: list[Part | None]) -> None:
        system, place = _system(self.path)
        system.delete_dir(f"{place}/_attempts")


class OrderedText(DataSource):
    """``format("ordered_text")``: rows of one string column as lines; options header (a line) and compression (gzip)."""

    @classmethod
    def name(cls):
        return "ordered_text"

    def writer(self, schema, overwrite):
        return OrderedWriter(self.options, overwrite)


def write_ordered(df: DataFrame, line: Column, by: list[str], path: str, header: str | None = None, compression: str = "none") -> None:
    """``line`` of each row, sorted by ``by`` over all parts, under one header; an existing table gives way."""
    df.sparkSession.dataSource.register(OrderedText)
    lines = df.repartitionByRange(*by).sortWithinPartitions(*by).select(line.alias("value"))
    options = {"compression": compression} | ({"header": header} if header else {})
    lines.write.format("ordered_text").mode("overwrite").options(**options).save(path)


def write_sorted_tsv(df: DataFrame, by: list[str], path: str, header: bool = True, compression: str = "none") -> None:
    """Columns separated by tabs, deviations with two decimals, nulls empty, sorted by ``by``."""
    shown = [F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.2f", c)) if c.endswith("_sd") else F.col(c).cast("string"), F.lit("")) for c in df.columns]
    write_ordered(df, F.concat_ws("\t", *shown), by, path, "\t".join(df.columns) if header else None, compression)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """(number, value): the lines of all parts, numbered from 0 on in the order of the parts' names.

    Within a part lines are numbered by their own task; a thin table of the ranges' sizes tells what lies before each.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            places = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places.append(seen.get(key, 0))
                seen[key] = places[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["file", "at", "value", "own"])

    placed = lines.mapInArrow(run, "file string, at long, value string, own long")
    sizes = placed.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("file", "at", F.coalesce(F.sum("n").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(before, ["file", "at"]).select((F.col("own") + F.col("before")).alias("number"), "value")
