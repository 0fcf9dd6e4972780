"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: A side of a join is broadcast up to this size.
BROADCAST_BYTES = 16 << 20
#: Rows of an Arrow batch: documents are some kilobytes, so a batch of Spark's usual 10,000 would be tens of megabytes in JVM and worker.
ARROW_ROWS, ARROW_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is unset a temporary folder stands in for it, on one machine only: a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="polymix-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/polymix/{what}-{uuid.uuid4().hex}"


def settled(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session asks for a size of its own."""
    if spark.conf.get(ARROW_SETTING) == "10000":
        spark.conf.set(ARROW_SETTING, ARROW_ROWS)


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    settled(df.sparkSession)
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of ``saved`` tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, row_bytes: int | Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """A side of a join, measured (rows of ``row_bytes`` each): broadcast within ``most`` bytes, joined by a shuffle beyond."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= most else df.hint("shuffle_merge")


def release() -> None:
    """Give freed memory back at the end of a Python task: workers are kept between tasks, and share the executor's limit."""
    gc.collect()
    trim()


def trim() -> None:
    """Give back what the allocators keep of freed memory."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # no such call outside glibc
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settled(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together until they hold about ``most`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000):
    """Cut a batch so that the texts of ``column`` in a slice hold about ``most`` bytes (at least one row)."""
    lengths = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)
