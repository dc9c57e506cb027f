"""Small helpers that the corpus operators share: shared tables, ASCII words, the data folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.sources.scratch import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    Cuts the lineage in a way that survives lost executors, and gives the planner
    the table's real size, so that small tables are broadcast and large ones are not.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/rowloom/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rowloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._rowloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While tables are written inside, Python workers get at most ``rows`` rows at a time.

    Elsewhere the session's limits hold (by default 10,000 rows and 64 MB a batch).
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if int(was) > rows or int(was) <= 0:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def give_back() -> None:
    """Return what a Python worker has freed to the machine.

    Workers are reused and wait between tasks; without this each keeps the most that any of its tasks
    took, and a step's workers stand beside those of the next.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def giving_back(run):
    """A function of batches that gives memory back before its first batch and after its last."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Most memory that a table marked for broadcast may take.
BROADCAST_BYTES = 32 << 20


def if_small(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if it takes at most ``limit`` bytes in memory;
    otherwise as it is, for a shuffled join.

    Memory is estimated from above by the counted rows, at eight bytes a field and 32 a
    row, and, if a field is of variable length, eight times the bytes of the files.
    """
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._rowloom_path)
    on_disk = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    if on_disk > limit:
        return table
    wide = any(not isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in table.schema)
    return F.broadcast(table) if table.count() * (32 + 8 * len(table.columns)) + wide * 8 * on_disk <= limit else table


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
