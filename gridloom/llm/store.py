"""Working folders on storage that the driver and every executor share, and workers that give memory back."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from gridloom.staging import shared_dir

#: Bytes of a batch that goes to a Python worker or comes back.
ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Spark's setting for shuffle files to be removed with their query.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go as it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def dropped(df: DataFrame) -> None:
    """Removes what ``written`` wrote for ``df``; nobody may read it afterwards."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop, so that any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a folder and the path in it; used by tasks that write files of their own."""
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a worker that gives its free memory back when the task ends, as it serves tasks of other stages too.

    The session's Arrow batches are bounded by bytes, where no bound is set: texts may be long.
    """
    spark = SparkSession.active()
    if spark.conf.get(ARROW, None) is None:
        spark.conf.set(ARROW, ARROW_BYTES)

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError, TypeError):  # another C library
                pass

    return wrapped


@atexit.register
def _clean() -> None:
    for path in _made:
        try:
            fs, p = filesystem(path)
            if fs.get_file_info(p).type != pafs.FileType.NotFound:
                fs.delete_dir(p)
        except OSError:
            continue
