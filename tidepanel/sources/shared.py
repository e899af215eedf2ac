"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a local folder if the master is local, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        path = tempfile.mkdtemp(prefix="tidepanel-")
        atexit.register(shutil.rmtree, path, True)
        _local[app] = f"file://{path}"
    return _local[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made[path] = spark
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """A step's rows, written as Parquet in the shared folder and read back: what follows reads them instead of making them
    again, also after an executor was lost."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, sorted."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))


def _remove_all() -> None:
    for path, spark in _made.items():
        try:
            fs, at = _at(spark, path)
            fs.delete(at, True)
        except Exception:  # noqa: BLE001, the session has been stopped before
            return
