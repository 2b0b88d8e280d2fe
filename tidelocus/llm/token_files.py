"""Token ids as files of coded blocks, in ascending order of documents.

``write_ids`` deals the documents by ranges of doc_id into files, so that files in the order of their numbers, and blocks in the
order of theirs, hold the ids of all documents one after another.  A block has up to ``BLOCK`` ids, whatever documents they
belong to; ``mixing`` codes it by itself, with a checksum.  The files are Parquet, written and committed by Spark, one row a
block: the coded bytes, the number of ids before it in its file, and an index of the documents' pieces in it.

``read_blocks`` reads nothing but these files.  Places in the whole (``add_starts``) come from one thin row a file.

Edge cases: null and empty texts have the end id alone; an empty table gives files without rows; a doc_id that repeats, also null,
keeps each of its rows, in the order of their texts' hashes (its rows may be dealt to several files); documents of any length
run through as many blocks as they need; a damaged block raises an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from . import bpe, crc, mixing
from .shared import tidy
from .textbytes import slices

#: Blocks that are coded side by side: coding takes some 50 kB for each, reading 30 kB.
LANES = 2048
PIECES = "array<struct<doc:long,doc_id:long,start:long,at:long,size:int,after:long>>"
FILES = f"file int, block long, first long, n_ids int, coded binary, pieces {PIECES}"


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[list[np.ndarray], list[list[dict]], int]]:
    """Blocks of ids with the pieces of documents in them, up to ``LANES`` at once, and the place of the first in the file."""
    codec = bpe.load(path)
    ids: list[np.ndarray] = []
    docs: list[tuple[int | None, int, int]] = []  # doc_id, first place in the file, past its last
    held, place, number, full = 0, 0, 0, LANES * mixing.BLOCK

    def cut(last: bool):
        nonlocal ids, docs, held, place, number
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        whole = len(flat) if last else len(flat) // full * full
        starts = np.array([d[1] for d in docs], np.int64)
        ends = np.array([d[2] for d in docs], np.int64)
        for base in range(0, whole, full):
            blocks = [flat[a : min(a + mixing.BLOCK, base + full, whole)] for a in range(base, min(base + full, whole), mixing.BLOCK)]
            pieces, first = [], place + base
            for a, b in ((first + k * mixing.BLOCK, first + k * mixing.BLOCK + len(x)) for k, x in enumerate(blocks)):
                some = range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left")))
                pieces.append([
                    {"doc": number + i, "doc_id": docs[i][0], "start": docs[i][1], "at": max(a, docs[i][1]) - docs[i][1], "size": min(b, docs[i][2]) - max(a, docs[i][1]), "after": docs[i][2] - min(b, docs[i][2])}
                    for i in some
                ])
            yield blocks, pieces, first
        gone = int(np.searchsorted(ends, place + whole, "right"))
        number, docs, place, held = number + gone, docs[gone:], place + whole, len(flat) - whole
        ids = [flat[whole:]] if held else []

    for batch in slices(batches):
        tokens, bounds = codec.encode(batch.column("text"))
        tokens = np.insert(tokens, bounds[1:], end)
        bounds = bounds + np.arange(len(bounds)) + place + held
        docs += zip(batch.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False)
        ids.append(tokens)
        held += len(tokens)
        if held >= full:
            yield from cut(False)
    yield from cut(True)


def write_ids(documents: DataFrame, path: str, tokenizer: str, end: int, files: int | None = None) -> None:
    """``documents`` (doc_id, text) as files below ``path``; each document's ids end with ``end``.  ``files``: at most so many."""
    order = ["doc_id", F.xxhash64("text")]
    thin = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = thin.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    schema = pa.schema([
        ("file", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()), ("coded", pa.binary()),
        ("pieces", pa.list_(pa.struct([("doc", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("at", pa.int64()), ("size", pa.int32()), ("after", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # partitions hold ascending ranges, so their numbers order the files
        file, block = TaskContext.get().partitionId(), 0
        bits = mixing.bits_of(max(bpe.load(tokenizer).size, end + 1))
        for blocks, pieces, first in _blocks(batches, tokenizer, end):
            sizes = [len(b) for b in blocks]
            starts = first + np.cumsum([0, *sizes[:-1]])
            n = len(blocks)
            if n:
                rows = [np.full(n, file, np.int32), np.arange(block, block + n), starts, np.array(sizes, np.int32), mixing.encode_blocks(blocks, bits), pieces]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)
            block += n

    dealt.mapInArrow(tidy(run), FILES).write.parquet(path)


def read_blocks(spark: SparkSession, path: str, ddl: str, make: Callable) -> DataFrame:
    """A row for each piece of a document: file, doc (its number in the file), doc_id, start (ids before it in the file), at (ids of it
    in earlier pieces), size, after (ids of it in later pieces), and the columns ``ddl``, which ``make(ids, bounds, after) -> [arrays]``
    computes from the pieces' ids, one after another, with n + 1 bounds.
    """
    shown = "file int, doc long, doc_id long, start long, at long, size int, after long"
    names = [f.name for f in spark.createDataFrame([], f"{shown}, {ddl}").schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, LANES):
                some = batch.slice(k, LANES)
                ids = np.concatenate([np.zeros(0, np.uint32), *mixing.decode_blocks(some.column("coded").to_pylist())])
                pieces = some.column("pieces")
                flat = pieces.flatten()
                held = [flat.field(x) for x in ("doc", "doc_id", "start", "at", "size", "after")]
                files = np.repeat(some.column("file").to_numpy(), np.diff(pieces.offsets.to_numpy()))
                bounds = np.append(0, np.cumsum(held[4].to_numpy().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), *held, *make(ids, bounds, held[5].to_numpy())], names=names)

    return spark.read.schema(FILES).parquet(path).select("file", "coded", "pieces").mapInArrow(tidy(run), f"{shown}, {ddl}")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc, doc_id, start, ids): every document's whole ids."""

    def make(ids: np.ndarray, bounds: np.ndarray, after: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64)))]

    pieces = read_blocks(spark, path, "part array<long>", make)
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]))
    return pieces.groupBy("file", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), joined.alias("ids"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc, doc_id, start, n_tokens, ids_crc32): every document's number of ids, and the CRC-32 of them as 4-byte numbers."""

    def make(ids: np.ndarray, bounds: np.ndarray, after: np.ndarray) -> list[pa.Array]:
        raw, at = memoryview(ids.astype("<u4")).cast("B"), (4 * bounds).tolist()
        own = np.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], np.uint32)
        return [pa.array(crc.shift(own, 4 * after).astype(np.int64))]

    pieces = read_blocks(spark, path, "crc long", make)
    return pieces.groupBy("file", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sum("size").alias("n_tokens"), F.bit_xor("crc").cast(LongType()).alias("ids_crc32"))


def add_starts(documents: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Rows with ``file`` and ``start``, the latter now counted from the first file on."""
    sizes = spark.read.schema(FILES).parquet(path).groupBy("file").agg(F.sum("n_ids").alias("__size"))
    # one row for each file; a file holds some 64 MB of text
    before = sizes.select("file", F.coalesce(F.sum("__size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return documents.join(before, "file").withColumn("start", F.col("start") + F.col("__before")).drop("__before")
