"""Where operators put what all executors must see."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..scratch import delete, exists_now, folder
from .textbytes import SLICE_BYTES, slices

#: Most bytes of a batch that goes to a Python worker, unless the session says otherwise; Spark's own bound is many times that.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
_KEPT: list[Callable] = []


def bound_batches(spark: SparkSession) -> None:
    """Let this session's Python workers get texts in batches of bounded bytes: both they and the JVM hold a batch whole."""
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)


def kept(size: int) -> Callable:
    """``lru_cache`` for what a Python worker keeps between tasks; the first task of ``tidy`` that doesn't use it drops it."""

    def wrap(f: Callable) -> Callable:
        _KEPT.append(lru_cache(size)(f))
        return _KEPT[-1]

    return wrap


def _calls() -> list[tuple[int, int]]:
    """How often each function of ``kept`` has been called."""
    return [f.cache_info()[:2] for f in _KEPT]


def _drop_unused(before: list[tuple[int, int]]) -> None:
    """Drop what the functions of ``kept`` hold that haven't been called since."""
    for f, a, b in zip(_KEPT, before, _calls(), strict=False):
        if a == b:
            f.cache_clear()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what follows survives lost executors.

    The table goes by ``forget``, or with its session (see ``scratch``).
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    exists_now(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that nothing will read any more."""
    for table in tables:
        if table is not None:
            delete(table.written_to)


def tidy(run: Callable) -> Callable:
    """A task's function of batches that at its end gives the memory it has freed back to the system.

    Python workers live on between tasks, beside the executor's JVM, and the C library else keeps what numpy has freed.
    What earlier tasks have kept (see ``kept``) and this one hasn't used goes with it.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = _calls()
        try:
            yield from run(batches)
        finally:
            _drop_unused(before)
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def add_columns(df: DataFrame, ddl: str, make: Callable, text: str | None = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` with further columns that ``make(batch) -> [arrays]`` computes from slices of rows.

    No shuffle; rows and their order stay.  A column of ``df`` that has the name of a new one is
    replaced.  ``make`` sees whole texts and never more than about ``limit`` bytes of them at once (``text`` None:
    batches as they come).
    """
    spark = df.sparkSession
    bound_batches(spark)
    new = spark.createDataFrame([], ddl).schema.fields
    taken = {f.name for f in new}
    base = df.select(*[c for c in df.columns if c not in taken])
    schema = StructType([*base.schema.fields, *new])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, limit) if text else batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names=names)

    return base.mapInArrow(tidy(run), schema)


def shielded(df: DataFrame, *open_names: str, new: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but ``open_names`` under names of ours, and the way back.

    Names are compared as Spark does (without case, unless the session says so); of several that fit one the exact
    one is meant, or the first.  On the way back columns that fit one of ``new`` give way to it; ``new`` come last.
    """
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    same = (lambda c: c) if exact else str.lower
    names = df.columns
    places = {}
    for x in open_names:
        fits = [i for i, c in enumerate(names) if same(c) == same(x)]
        if fits:
            places[next((i for i in fits if names[i] == x), fits[0])] = x
    safe = [places.get(i, f"__own{i}") for i in range(len(names))]
    gone = {same(x) for x in new}
    stays = [i for i, c in enumerate(names) if same(c) not in gone]

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[safe[i] for i in stays], *new).toDF(*[names[i] for i in stays], *new)

    return df.toDF(*safe), back


def keeps_columns(*open_names: str, new: tuple[str, ...] = ()) -> Callable:
    """For functions of a DataFrame that return its columns and ``new`` ones: they see only ``open_names`` by name, so no column can clash."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(df: DataFrame, *args, **more) -> DataFrame:
            safe, back = shielded(df, *open_names, new=new)
            return back(f(safe, *args, **more))

        return run

    return wrap
