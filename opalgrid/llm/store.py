"""The folder that the driver and all executors share, and tables kept in it between jobs."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only in local mode, and only where the setting is absent, a temporary folder is made instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="opalgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def open_store(uri: str):
    """The file system of a shared folder for Python on any machine, and the path in it."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def files_of(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """Paths of a folder's files by name, listed through Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().toString() for s in found if s.getLen() and s.getPath().getName().endswith(suffix))


_made: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder; it is removed when the driver's Python ends with its session still running."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def clean() -> None:
    """Remove all places that were given out, results that still read them included."""
    while _made:
        remove(*_made.pop())


atexit.register(clean)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: its lineage ends there,
    and a lost executor costs at most the tasks that had not been committed."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, place: str) -> None:
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def finished(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What ``make`` returns, written; the tables that it made on the way are removed at once, not at the end of the session."""
    before = len(_made)
    out = materialize(make(), tag)
    place = _made.pop()
    for session, path in _made[before:]:
        remove(session, path)
    _made[before:] = [place]
    return out


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what a Python worker gets at once, in rows and in bytes: texts of documents may be very long.

    The settings of the session stay so, as results are lazy and read them when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def give_back() -> None:
    """Return what this process has freed to the machine, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for Python workers, which outlive their tasks and wait for others: what a task took goes back when it ends."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def column(name: str):
    """A column of a frame by its name as it stands, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
