"""Intermediate tables, kept where every executor can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_tables: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a temporary folder serves a local master, as in tests; any other master raises,
    as executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
    key = spark.sparkContext.applicationId
    if key not in _folders:
        _folders[key] = tempfile.mkdtemp(prefix="gridloom-")
    return _folders[key]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes all staged tables of this process; nothing may read them afterwards."""
    while _tables:
        spark, path = _tables.pop()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for folder in _folders.values():
        shutil.rmtree(folder, ignore_errors=True)
