"""Folders for what a job writes and reads again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


class _Place(NamedTuple):
    """What deletes a folder, also after its session has stopped: the JVM's path and its file system's settings."""

    path: object
    settings: object
    context: SparkContext


_HELD: dict[str, _Place] = {}


def _hold(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    _HELD[path] = _Place(place, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext)


def exists_now(path: str) -> None:
    """The folder has been written: where Python is killed, the JVM deletes it when it ends."""
    held = _HELD[path]
    held.path.getFileSystem(held.settings).deleteOnExit(held.path)


def delete(path: str) -> None:
    """Delete a folder that nothing will read any more."""
    if held := _HELD.pop(path, None):
        held.path.getFileSystem(held.settings).delete(held.path, True)


def _delete_of(stopped: bool) -> None:
    for path, held in list(_HELD.items()):
        if not stopped or held.context._jsc is None:
            with contextlib.suppress(Exception):  # the JVM may be gone, and deletes them itself
                delete(path)


@atexit.register
def _delete_all() -> None:
    _delete_of(stopped=False)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which goes when the driver ends, or when a later session asks for a folder.

    Where that is unset, a session whose tasks all run on this machine (``local[...]``, tests) gets a temporary
    one; any other session gets an error.  The path isn't created: Spark's writers do that.
    """
    _delete_of(stopped=True)
    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"{tempfile.gettempdir()}/tidelocus-{spark.sparkContext.applicationId}"
        if top not in _HELD:
            _hold(spark, top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _hold(spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in such a folder: what follows survives lost executors and isn't computed again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    exists_now(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
