"""What the operators share: tables, the shared folder, tables written in it."""

from __future__ import annotations

import ctypes
import hashlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType


#: Hadoop's schemes that pyarrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessella-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, where the cluster names it.

    Only on one machine, as in tests, may that be unset; a local folder then
    takes its place.  On a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessella-{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe from lost executors.

    The table goes when the driver ends, or before that by :func:`forgotten`.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def passing(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends."""
    fs, where = _hadoop(spark, path)
    fs.deleteOnExit(where)


def forgotten(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._written_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written in the shared folder."""
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder's URI or plain path; Hadoop's names of object stores are understood."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    if not colon:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme.lower(), scheme)}://{rest}")


def seeded(*what: object) -> int:
    """A 63-bit seed that is the same in every process."""
    return int.from_bytes(hashlib.sha256(repr(what).encode()).digest()[:8], "little") >> 1


def parts(batch: pa.RecordBatch, text: int | str, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about so many bytes of text, one row at least."""
    column = batch.column(text)
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + size)) + 1)
        yield batch.slice(start, end - start)
        start = min(end, batch.num_rows)
    give_back()


#: glibc's, by which freed memory below the top of its heaps goes back too.
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Give freed memory back to the system, Arrow's and Python's: workers live on, and their next stage has other needs."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which its worker keeps nothing of the task: neither the last batch nor what was freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def with_fields(df: DataFrame, **fields: DataType) -> StructType:
    """df's schema and further fields; df keeps its own (StructType.add would change it)."""
    return StructType([*df.schema.fields, *(StructField(name, kind) for name, kind in fields.items())])
