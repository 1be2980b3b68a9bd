"""Loading the edit log from quoted CSV (plain or .bz2) with declared types.

Every cell is read as text first (a sentinel ``nullValue`` that never occurs
keeps empty and token cells apart), then converted by column expressions:

* ``null_tokens``     - ``NA``/``NaN``/``null``/U+FFFD -> NULL; ``''`` stays ``''``
* ``decode_bool``     - ``T``/``F`` -> true/false, anything else -> NULL
* ``parse_timestamp`` - ``2014-01-01T00:00:00Z`` -> timestamp (UTC)
* numbers             - ``try_cast`` after the token rule

bz2 files are splittable, so a large file is read by many tasks.  The
loaded table should be written to Parquet once (``to_parquet``) and every
later run reads that; column pruning and range filters then reach the scan.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import schema as S

_log = logging.getLogger(__name__)
_SENTINEL = "\u0001"


def null_tokens(c: Column) -> Column:
    """Missing-value tokens -> NULL; the empty string is a value."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.isin(*S.NULL_TOKENS), F.lit(None).cast("string")).otherwise(text)


def decode_bool(c: Column) -> Column:
    return (F.when(c == S.TRUE_TOKEN, F.lit(True))
             .when(c == S.FALSE_TOKEN, F.lit(False))
             .otherwise(F.lit(None).cast("boolean")))


def parse_timestamp(c: Column) -> Column:
    """Strict ISO-8601 with ``Z``: a malformed value raises (ANSI mode)."""
    return F.to_timestamp(c, S.TIMESTAMP_FORMAT)


def schema_check(columns: Iterable[str]) -> list[str]:
    """Columns without a declared type (logged as a warning, kept as text)."""
    unknown = [c for c in columns if c not in S.DECLARED]
    for c in unknown:
        _log.warning("column %s is not declared; it is kept as text", c)
    return unknown


def number(name: str, raw: Column, dtype: str) -> Column:
    """Missing stays missing; text that is no number of the type raises."""
    value = raw.try_cast(dtype)
    message = F.concat(F.lit(f"{name}: not a {dtype}: "), raw)
    return F.when(raw.isNotNull() & value.isNull(), F.raise_error(message).cast(dtype)).otherwise(value)


def typed(c: str) -> Column:
    kind = S.DECLARED.get(c, S.STR)
    raw = null_tokens(F.col(c))
    if kind == S.BOOL:
        out = decode_bool(raw)
    elif kind == S.TS:
        out = parse_timestamp(raw)
    elif kind in (S.INT, S.LONG, S.FLOAT):
        out = number(c, raw, {S.INT: "int", S.LONG: "bigint", S.FLOAT: "float"}[kind])
    else:
        out = raw
    return out.alias(c)


def prune_columns(feature_inputs: Sequence[Sequence[str]], meta: Sequence[str] = S.META_COLUMNS,
                  label: str = S.LABEL_COLUMN) -> list[str]:
    """Columns needed by meta, features and label: first-use order, no duplicates."""
    out: list[str] = []
    for names in [list(meta), *[list(x) for x in feature_inputs], [label]]:
        for n in names:
            if n is not None and n not in out:
                out.append(n)
    return out


def read_text_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as text, header row, quote and escape ``"``."""
    header = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
              .option("nullValue", _SENTINEL).option("emptyValue", "")
              .option("multiLine", multiline).csv(path).columns)
    text_schema = StructType([StructField(c, StringType(), True) for c in header])
    return (spark.read.schema(text_schema).option("header", True)
            .option("quote", '"').option("escape", '"')
            .option("nullValue", _SENTINEL).option("emptyValue", "")
            .option("multiLine", multiline)
            .option("mode", "FAILFAST")
            .csv(path))


def load_revisions(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                   multiline: bool = False) -> DataFrame:
    """Read the log with declared types; keep ``columns`` (in that order)."""
    raw = read_text_csv(spark, path, multiline)
    schema_check(raw.columns)
    cols = list(columns) if columns is not None else raw.columns
    missing = [c for c in cols if c not in raw.columns]
    if missing:
        raise ValueError(f"declared columns missing from the file: {missing}")
    return raw.select(*[typed(c) for c in cols])


def to_parquet(df: DataFrame, path: str, order: str = "revisionId") -> None:
    """Write the loaded log once, range-partitioned and sorted by the id, so
    later id/date range filters skip whole files and row groups."""
    (df.repartitionByRange(order).sortWithinPartitions(order)
       .write.mode("overwrite").parquet(path))
