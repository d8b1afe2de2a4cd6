"""Shared plumbing: tables in the cluster's shared folder, and Arrow batch helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once for each application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "statuta_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith((".py", ".json")):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.statuta.sharedDir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="statuta-shared-")
        spark.conf.set("spark.statuta.sharedDir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a frame that reads it.

    This cuts the lineage: a lost executor costs a re-read and no recomputation.  Files go when they are discarded or the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._statuta_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames from :func:`materialize` that nothing reads any more."""
    for frame in frames:
        path = getattr(frame, "_statuta_path", None)
        if path is not None:
            _delete(frame.sparkSession, path)
            _written.remove((frame.sparkSession, path))
            del frame._statuta_path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the context may be gone already; the folder is scratch space
            return


def slices(batch: pa.RecordBatch, column: int, rows: int = 250, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``most`` bytes of a string column; a longer text stands alone.

    All rows are given, in order: this bounds a worker's memory and nothing else.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and (i - lo >= rows or held + size > most):
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += size
    if lo < batch.num_rows:
        yield batch.slice(lo)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its own allocator decides
        return


def _frugal(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel on batches of bounded bytes, memory given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        give_back()

    return run


def limit_batches(spark: SparkSession, rows: int = 2000, most: int = 16 << 20) -> None:
    """Lower the session's rows and bytes in an Arrow batch to these, where they are higher; never raise them.

    Spark reads both settings when a plan runs, so they can't be set for one operator alone; they change no result.
    """
    for key, limit in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most)):
        digits = "".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-")
        if not 0 < int(digits or 0) <= limit:
            spark.conf.set(key, limit)


def map_batches(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df`` through an Arrow kernel, in batches of bounded rows and bytes."""
    ship(df.sparkSession)
    limit_batches(df.sparkSession)
    return df.mapInArrow(_frugal(kernel), schema)


def map_columns(
    df: DataFrame, columns: list[str], kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """Only ``columns`` of ``df`` through an Arrow kernel; other columns are pruned at the scan."""
    return map_batches(df.select(*columns), kernel, schema)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null: empty."""
    return ["" if x is None else x for x in column.to_pylist()]
