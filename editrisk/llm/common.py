"""Helpers shared by the operators: shared tables, size-checked joins, words.

Intermediate tables that an operator reads more than once are written as
Parquet to the shared folder that the session names in
``spark.checkpoint.dir``; a lost executor never loses them.  They are removed
when no longer needed (``discard``) or when the application ends.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editrisk.session import checkpoint_dir

#: White space and words of every contract: ASCII space and tab to return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

#: A table is broadcast only when its measured size is at most this.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``store`` that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(table: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast when the stored table's measured size is in bounds.

    Beyond the bound the table is returned unhinted: a sort-merge join, whose
    hot partitions AQE splits.
    """
    n = table.count()
    return F.broadcast(table) if n <= BROADCAST_ROWS and n * row_bytes <= BROADCAST_BYTES else table


def word_count(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run``, a task over batches, whose worker gives its free memory back at the end.

    Workers live on for other tasks and stages, and would keep the largest one's memory."""
    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
    return tidied
