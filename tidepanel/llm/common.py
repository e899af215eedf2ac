"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: ``[\x20\x09-\x0D]``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Java and RE2 spelling of the same class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Arrow text is worked on in runs of rows of about so many bytes, so that temporaries stay small.
CHUNK_BYTES = 1 << 20

_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``, or a local one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        path = tempfile.mkdtemp(prefix="tidepanel-")
        atexit.register(shutil.rmtree, path, True)
        _local_dirs[app] = f"file://{path}"
    return _local_dirs[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a step's rows as Parquet in the shared folder and read them back.

    This cuts the lineage and survives lost executors; later steps read only the columns they need. What a session has staged
    is removed when its driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    on_exit(spark, path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


_staged: dict[str, SparkSession] = {}


def on_exit(spark: SparkSession, path: str) -> None:
    """A folder that is removed when the driver ends."""
    if not _staged:
        atexit.register(_clean)
    _staged[path] = spark


def discard(df: DataFrame) -> None:
    """Remove a staged table that no later step reads."""
    path = getattr(df, "staged_path", None)
    if path in _staged:
        _remove(_staged.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for path, spark in _staged.items():
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001, the session has been stopped before
            return


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def row_runs(at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of rows with about ``most`` bytes each, one row at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * np.uint64(0x9E3779B97F4A7C15))


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
