"""Reading the driver's Parquet tables and the stand-in revision log.

There is no revision corpus among the test tables, so the edit log is
derived from ``events`` with column expressions only (the same derivation is
written in SQL for the DuckDB oracle, see ``REVLOG_SQL``):

* ``revisionId``  = ``event_id`` (unique; ``ts`` never decreases along it)
* ``timestamp``   = ``ts``
* ``userId``      = ``user_id``, missing for every tenth user (missing keys)
* ``userName``    = ``'u' || userId`` (string key, missing with ``userId``)
* ``itemId``      = ``props.k`` (the edited item)
* ``groupId``     = one session per user and day
* ``contentType`` = TEXT / STATEMENT / SITELINK by the item's range, so that
  every content slice holds both classes
* ``revisionAction`` = ``event_type``; ``revisionTag`` = action and item decile
* ``value``       = ``value``, missing above 100 (numeric feature)
* ``isRegisteredUser`` = odd user ids, missing with the user
* ``label``       = ``event_type = 'error'`` (``rollbackReverted``)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

# Split boundaries of the stand-in log (data covers 2024-01-01 .. 2024-01-30).
TRAIN_START = "2024-01-01 00:00:00"
VALIDATION_START = "2024-01-19 00:00:00"
TEST_START = "2024-01-25 00:00:00"
TAIL_START = "2024-02-01 00:00:00"


def ts_lit(value: str) -> Column:
    """A ``timestamp_ntz`` literal (the test tables use timestamp_ntz)."""
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a table; a source with fewer splits than the cluster's cores
    (one small file, one row group) is spread round-robin over the cores so
    that parsing and map-side work run in parallel.  Sources of a real log
    have many splits and are left as they are."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    try:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. a remote session): read as is
        pass
    return df


def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    item = F.get_json_object("props", "$.k").cast("bigint")
    user = F.when(F.col("user_id") % 10 == 0, F.lit(None).cast("bigint")).otherwise(F.col("user_id"))
    return ev.select(
        F.col("event_id").alias("revisionId"),
        F.col("ts").alias("timestamp"),
        user.alias("userId"),
        F.concat(F.lit("u"), user.cast("string")).alias("userName"),
        item.alias("itemId"),
        (F.col("user_id") * 1000 + F.dayofyear("ts")).cast("bigint").alias("groupId"),
        F.when(item < 34, "TEXT").when(item < 67, "STATEMENT").otherwise("SITELINK").alias("contentType"),
        F.col("event_type").alias("revisionAction"),
        F.concat_ws(",", F.col("event_type"), F.concat(F.lit("k"), (item / 10).cast("bigint").cast("string"))).alias("revisionTag"),
        F.when(F.col("value") > 100, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        F.when(user.isNull(), F.lit(None).cast("boolean")).otherwise(F.col("user_id") % 2 == 1).alias("isRegisteredUser"),
        (F.col("event_type") == "error").alias("label"),
    )


# The same derivation for the DuckDB oracle.  Every oracle statement that
# needs the log starts with ``WITH revlog AS (...)``.
REVLOG_SQL = """
revlog AS (
  SELECT event_id AS revisionId,
         ts AS "timestamp",
         CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS userId,
         'u' || CAST(CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS VARCHAR) AS userName,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemId,
         CAST(user_id * 1000 + dayofyear(ts) AS BIGINT) AS groupId,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 34 THEN 'TEXT'
              WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 67 THEN 'STATEMENT'
              ELSE 'SITELINK' END AS contentType,
         event_type AS revisionAction,
         event_type || ',k' || CAST(CAST(trunc(CAST(json_extract_string(props, '$.k') AS BIGINT) / 10) AS BIGINT) AS VARCHAR) AS revisionTag,
         CASE WHEN value > 100 THEN NULL ELSE value END AS value,
         CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id % 2 = 1 END AS isRegisteredUser,
         event_type = 'error' AS label
  FROM events
)"""


def with_revlog(sql: str) -> str:
    """Prefix an oracle statement with the stand-in log CTE."""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + REVLOG_SQL + ",\n" + body[5:]
    return "WITH " + REVLOG_SQL + "\n" + body


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comment texts; the label is null where ``labels`` has none."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return docs.join(labels, "doc_id", "left")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment text with a label: ``documents`` joined to ``labels``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return docs.join(labels, "doc_id", "inner")
