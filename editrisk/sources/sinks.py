"""Result tables: metrics, statistics, rankings, vocabularies.

Tables are written by Spark (one folder per table); nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics_sink(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                 fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result table, optionally partitioned (e.g. time label, system).

    Array columns (curves) are written as JSON text when the format is CSV.
    """
    out = df
    if fmt == "csv":
        for f in df.schema.fields:
            if f.dataType.simpleString().startswith(("array", "struct", "map")):
                out = out.withColumn(f.name, F.to_json(F.col(f.name)))
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def vocabulary_sink(word_table: DataFrame, path: str, score: str = "vandalismScore",
                    fmt: str = "parquet") -> None:
    """Word table sorted by score (descending, then word), written by Spark."""
    ordered = word_table.orderBy(F.desc(score), F.asc("words"))
    metrics_sink(ordered, path, fmt=fmt)
