"""What the operators of this subpackage share: tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.operators.rounds import shared_folder


#: Rows of an Arrow batch, at most: texts are long, and a task holds some batches of them at once.
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what goes to Python at a time, for this session from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: later reads survive lost executors and compute nothing anew.
    With the path, for discard()."""
    small_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def save(df: DataFrame, what: str) -> DataFrame:
    return saved(df, what)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of save()'s, or one like it, that no result needs any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return what a worker has freed to the system: workers outlive their tasks, and share a machine with the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def key_of(name: str) -> Column:
    """A string that equals for equal ids, null included, so that joins and windows on it share a partitioning."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


class Texts(Sequence):
    """The UTF-8 bytes of the texts of an Arrow column, null as empty. A text is copied when it is asked for."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        self.at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        self.data, self.null = memoryview(data) if data else b"", column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None

    def __len__(self) -> int:
        return len(self.at) - 1

    def __getitem__(self, k):
        if isinstance(k, slice):
            return [self[n] for n in range(*k.indices(len(self)))]
        if not 0 <= k < len(self):
            raise IndexError(k)
        return b"" if self.null is not None and self.null[k] else bytes(self.data[self.at[k] : self.at[k + 1]])


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    return Texts(column)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
