"""Spark session, checkpointing and size-checked joins.

Everything the library does runs inside Spark; this module only holds the
few knobs that decide how plans are executed:

* ``build_session`` - the configuration we test with (AQE, skew join, UTC).
* ``checkpoint_dir`` / ``cut_lineage`` - lineage cuts go to the shared folder
  named by ``spark.checkpoint.dir``; a folder is only chosen when the
  session has none (tests, local runs).
* ``join_lookup`` - joins a fitted lookup table (one row per key) to the wide
  row table.  A broadcast happens only behind a size check: either a
  count measured by the caller or AQE's run-time size of the lookup's
  shuffle output; beyond the bound it is a shuffle join, where AQE splits
  partitions of hot keys on the row side.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup with at most this many rows (and estimated bytes below) is
# broadcast; both numbers are checked on the materialised lookup.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "editrisk") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(BROADCAST_MAX_BYTES))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EDITRISK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_settings(input_bytes: float, executor_cores: int = 1000 * 8) -> dict[str, str]:
    """Settings for a large cluster, sized from the bytes the pipeline reads.

    Scan splits of 256 MB; the shuffle starts with about one partition per
    256 MB of input (at least two waves of the cluster's cores) and AQE
    coalesces small partitions and splits skewed ones at run time.  Running
    operators keep window partitions bounded by their id-chunk width, so no
    setting depends on the size of the largest key.
    """
    split = 256 * 1024 * 1024
    partitions = max(2 * executor_cores, int(input_bytes // split) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_MAX_BYTES),
        "spark.sql.session.timeZone": "UTC",
    }


def configure(spark: SparkSession) -> SparkSession:
    """Settings the library relies on, applied to a session made elsewhere.

    On a local master still at Spark's default of 200 shuffle partitions,
    the width is set to twice the cores (AQE coalesces further)."""
    try:
        sc = spark.sparkContext
        if sc.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
            spark.conf.set("spark.sql.shuffle.partitions", str(2 * sc.defaultParallelism))
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. a remote session): keep its settings
        pass
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # rows go to Python workers in small batches, so that wide texts never fill a worker
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(BROADCAST_MAX_BYTES))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Read from ``spark.checkpoint.dir``.  Where it is unset, a local master (tests) gets a
    folder of its own, and any other master an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="editrisk-ckpt-")
    sc.setCheckpointDir(conf)
    return conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` written as Parquet to the shared folder, in a folder per value of ``by``, and read
    back: later filters and column choices reach the files, and no lost executor makes it
    anew.  Removed when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: list[list[DataFrame]] = []


def persist(df: DataFrame) -> DataFrame:
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _HELD:
        _HELD[-1].append(held)
    return held


@contextmanager
def releasing() -> Iterator[None]:
    """What the library caches inside is freed at the end (results must be written by then)."""
    _HELD.append([])
    try:
        yield
    finally:
        for df in _HELD.pop():
            df.unpersist()


def is_small(table: DataFrame) -> bool:
    """Whether a table that the caller has cached may be broadcast, by its measured rows and
    bytes (which fills the cache)."""
    rows = table.count()
    read = table.select("*")._jdf.queryExecution()
    stored = int(read.optimizedPlan().stats().sizeInBytes())
    # the cache is compressed: a row takes no less than its types do
    size = max(stored, rows * read.analyzed().schema().defaultSize())
    return rows <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES


def join_lookup(rows: DataFrame, lookup: DataFrame, keys: Sequence[str] | Column,
                how: str = "left", small: bool | None = None) -> DataFrame:
    """Join a per-key lookup table (one row per key) to the row table.

    * ``small=True``  - the caller measured the lookup and it is small: broadcast;
    * ``small=False`` - a shuffle join;
    * ``small=None``  - no hint: AQE measures the lookup's materialised
      shuffle output at run time and switches to a broadcast join only when
      it is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``; beyond
      that it stays a sort-merge join, where AQE splits the partitions of hot
      keys on the row side (``skewJoin``).  This costs no extra job.
    """
    if small:
        right = F.broadcast(lookup)
    elif small is False:
        right = lookup.hint("shuffle_merge")
    else:
        right = lookup
    if isinstance(keys, Column):
        return rows.join(right, keys, how)
    return rows.join(right, list(keys), how)
