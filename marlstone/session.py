"""Session helpers: table access, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: A side of a join is broadcast only when its row count times the bytes a row takes stays below this.
BROADCAST_BYTES = 64 << 20
#: Bytes of rows that go to a Python worker at a time while a table is written: on either side a task holds a few times as much.
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of a join or a de-duplication that one task sorts or hashes, where a table is spread by its size.
TASK_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the dataset folder, as a lazily read Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where none is named, a temporary folder is set once per session in local mode; on a cluster that is an error,
    since no other machine could read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before the process; the folder belongs to the cluster
        pass


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's path below the shared one; it is deleted when the process ends."""
    path = f"{shared_dir(spark)}/marlstone-{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes to Python workers in batches of ``ARROW_BYTES``."""
    before = spark.conf.get(_ARROW, None)
    spark.conf.set(_ARROW, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_ARROW, before) if before else spark.conf.unset(_ARROW)


def trim() -> None:
    """Give what was freed back to the system: an executor's workers stay, and would keep the peak of every stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with memory trimmed after each batch and at the end."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                trim()

        yield from run(each())
        trim()

    return trimmed


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` shuffled by ``keys`` into as many tasks as hold ``TASK_ROWS`` of its rows each; a small table as it is.

    The session's number of shuffle partitions is one for all sizes, so with it a task's memory grows with the table.
    ``rows`` is the number of rows, where it is known; otherwise they are counted.
    """
    rows = df.count() if rows is None else rows
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def materialise(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage so that later stages survive lost executors without recomputing what came before.
    """
    path = scratch(spark, tag)
    with small_batches(spark):
        df.write.mode("error").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more; None is passed over."""
    for df in tables:
        if df is not None and getattr(df, "_scratch", None):
            _delete(df.sparkSession, df._scratch)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row of ``df`` takes in memory, from the lengths of what it holds."""
    flat = sum(f.dataType.jsonValue() not in ("string", "binary") for f in df.schema)
    held = [F.coalesce(F.length(f.name), F.lit(0)) if f.dataType.jsonValue() in ("string", "binary") else F.coalesce(F.length(F.to_json(F.struct(f.name))), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType))]
    return sum(held, F.lit(24 + 16 * len(df.schema) + 8 * flat))


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the measured size of the rows of ``df`` allows a broadcast; ``df`` should be cheap to read (a written table)."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` when it is small; otherwise leave a shuffle join."""
    return F.broadcast(df) if is_small(df, limit) else df
