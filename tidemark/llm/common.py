"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy pass works on; a longer text makes a block of its own.
BLOCK_BYTES = 2 << 20

#: Rows that Spark sends to a Python worker at once, and how many of whole texts a batch should have at most.
ARROW_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one is made only where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.saved_at = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Has the session send at most TEXT_ROWS rows at once: an executor holds a batch several times, outside its heap and in the worker. A smaller limit of the session's own stays."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= TEXT_ROWS:
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))


def drop(df: DataFrame) -> None:
    """Deletes a table that saved() wrote; only for one whose every consumer has been written itself."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each part have at most so many bytes, one row at least."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        upto = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def thrifty(run: Task) -> Task:
    """run for mapInArrow, after which a worker gives unused memory back, as it stays for other tasks beside its executor."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null texts count as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
