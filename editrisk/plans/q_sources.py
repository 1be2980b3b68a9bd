"""Queries for loading, splits, filters, samples and row-set operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import sessions as SE
from ..operators import splits as SP
from ..operators.cumulative import number_in_order
from ..session import checkpoint_dir
from ..sources import csv_log as CL
from ..sources.sinks import metrics_sink
from ..sources.tables import (TEST_START, TRAIN_START, VALIDATION_START, revision_log,
                              with_revlog)
from . import catalog as CAT
from .pipeline import feature_pipeline
from .q_windows import SCORE_SQL, score_col
from .registry import HASH_ORDER_SQL, query, r6

FIT_SQL = "\"timestamp\" < TIMESTAMP '2024-01-19 00:00:00'"

# ---------------------------------------------------------------- CSV log
# The stand-in log written as the reference's CSV dialect: T/F booleans,
# ISO timestamps with Z, missing-value tokens, quotes inside values, one
# undeclared column.  The text of ``commentTail`` cycles through the tokens.
_TAIL_SQL = """CASE WHEN revisionAction = 'click' THEN ''
                    WHEN revisionAction = 'view' THEN 'NA'
                    WHEN revisionAction = 'purchase' THEN 'null'
                    WHEN revisionAction = 'signup' THEN 'x "q" y'
                    WHEN itemId < 50 THEN 'NaN' ELSE chr(65533) END"""


def _tail_col():
    a, item = F.col("revisionAction"), F.col("itemId")
    return (F.when(a == "click", F.lit("")).when(a == "view", F.lit("NA"))
             .when(a == "purchase", F.lit("null")).when(a == "signup", F.lit('x "q" y'))
             .when(item < 50, F.lit("NaN")).otherwise(F.lit("\ufffd")))


def write_log_csv(spark, sf) -> str:
    """Write the stand-in log as bz2 CSV into the checkpoint folder; return the path."""
    log = revision_log(spark, sf)
    text = log.select(
        F.col("revisionId").cast("string").alias("revisionId"),
        F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.coalesce(F.col("userName"), F.lit("NA")).alias("userName"),
        F.when(F.col("isRegisteredUser").isNull(), F.lit("NA"))
         .when(F.col("isRegisteredUser"), F.lit("T")).otherwise(F.lit("F")).alias("isRegisteredUser"),
        _tail_col().alias("commentTail"),
        F.coalesce(F.col("value").cast("string"), F.lit("NaN")).alias("bytesIncrease"),
        F.when(F.col("label"), F.lit("T")).otherwise(F.lit("F")).alias("rollbackReverted"),
        F.lit("events").alias("sourceTable"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/revlog-csv-{uuid.uuid4().hex}"
    (text.write.option("header", True).option("quote", '"').option("escape", '"')
         .option("quoteAll", True).option("compression", "bzip2").csv(path))
    return path


_LOADED_SQL = with_revlog(f"""
SELECT CAST(revisionId AS BIGINT) AS revisionId,
       CAST(floor(epoch("timestamp")) AS BIGINT) AS ts_seconds,
       userName, isRegisteredUser,
       CASE WHEN c IN ('NA', 'NaN', 'null', chr(65533)) THEN NULL ELSE c END AS commentTail,
       round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS bytesIncrease,
       label AS rollbackReverted
FROM (SELECT *, {_TAIL_SQL} AS c FROM revlog)""")


@query("load_revisions", _LOADED_SQL)
def q_load_revisions(spark, sf):
    path = write_log_csv(spark, sf)
    cols = ["revisionId", "timestamp", "userName", "isRegisteredUser", "commentTail",
            "bytesIncrease", "rollbackReverted"]
    d = CL.load_revisions(spark, path, cols)
    return d.select(F.col("revisionId").cast("bigint"),
                    F.unix_timestamp("timestamp").cast("bigint").alias("ts_seconds"),
                    "userName", "isRegisteredUser", "commentTail",
                    r6(F.col("bytesIncrease")).alias("bytesIncrease"), "rollbackReverted")


@query("null_tokens", with_revlog(f"""
SELECT revisionId, CASE WHEN c IN ('NA', 'NaN', 'null', chr(65533)) THEN NULL ELSE c END AS commentTail
FROM (SELECT *, {_TAIL_SQL} AS c FROM revlog)"""))
def q_null_tokens(spark, sf):
    raw = CL.read_text_csv(spark, write_log_csv(spark, sf))
    return raw.select(F.col("revisionId").cast("bigint"), CL.null_tokens(F.col("commentTail")).alias("commentTail"))


@query("decode_bool", with_revlog("SELECT revisionId, isRegisteredUser, label AS rollbackReverted FROM revlog"))
def q_decode_bool(spark, sf):
    raw = CL.read_text_csv(spark, write_log_csv(spark, sf))
    return raw.select(F.col("revisionId").cast("bigint"),
                      CL.decode_bool(CL.null_tokens(F.col("isRegisteredUser"))).alias("isRegisteredUser"),
                      CL.decode_bool(F.col("rollbackReverted")).alias("rollbackReverted"))


@query("parse_timestamp", with_revlog("""
SELECT revisionId, CAST(floor(epoch("timestamp")) AS BIGINT) AS ts_seconds FROM revlog"""))
def q_parse_timestamp(spark, sf):
    raw = CL.read_text_csv(spark, write_log_csv(spark, sf))
    return raw.select(F.col("revisionId").cast("bigint"),
                      F.unix_timestamp(CL.parse_timestamp(F.col("timestamp"))).cast("bigint").alias("ts_seconds"))


@query("schema_check", "SELECT 'sourceTable' AS undeclared_column, count(*) AS n_values FROM events")
def q_schema_check(spark, sf):
    raw = CL.read_text_csv(spark, write_log_csv(spark, sf))
    unknown = CL.schema_check(raw.columns)
    # the unknown columns and how many values of the whole file they hold
    return raw.agg(F.array(*[F.struct(F.lit(c).alias("undeclared_column"), F.count(c).alias("n_values"))
                             for c in unknown]).alias("columns")).select(F.inline("columns"))


@query("prune_columns", with_revlog("""
SELECT revisionId, groupId, contentType, epoch_us("timestamp") AS ts_us, value, revisionAction, revisionTag,
       itemId, isRegisteredUser, userName, label FROM revlog"""))
def q_prune_columns(spark, sf):
    cols = CL.prune_columns(CAT.input_columns(CAT.standin_main()), ["revisionId", "groupId", "contentType",
                                                                    "timestamp"], "label")
    d = revision_log(spark, sf).select(*cols)
    return d.withColumn("ts_us", F.unix_micros(F.col("timestamp").cast("timestamp"))).drop("timestamp")


@query("metrics_sink", with_revlog("""
SELECT 'MAIN' AS system, contentType, CAST(count(*) AS BIGINT) AS revisions,
       CAST(sum(CAST(label AS INTEGER)) AS BIGINT) AS vandalism FROM revlog GROUP BY contentType"""))
def q_metrics_sink(spark, sf):
    t = (revision_log(spark, sf).groupBy("contentType")
         .agg(F.count(F.lit(1)).alias("revisions"), F.sum(F.col("label").cast("int")).cast("bigint").alias("vandalism"))
         .withColumn("system", F.lit("MAIN")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    metrics_sink(t, path, partition_by=["system"])
    back = spark.read.parquet(path)
    return back.select("system", "contentType", F.col("revisions").cast("bigint"), "vandalism")


# ---------------------------------------------------------------- ranges
@query("slice_range", with_revlog(f"""
SELECT revisionId FROM revlog WHERE "timestamp" >= TIMESTAMP '{VALIDATION_START}' AND "timestamp" < TIMESTAMP '{TEST_START}'"""))
def q_slice_range(spark, sf):
    return SP.slice_range(revision_log(spark, sf), VALIDATION_START, TEST_START, "timestamp").select("revisionId")


def _parts_sql(col_lo, col_val, col_test, col="revisionId"):
    return f"""
SELECT revisionId, 'fit' AS part FROM revlog WHERE {col} < {col_val}
UNION ALL SELECT revisionId, 'training' FROM revlog WHERE {col} >= {col_lo} AND {col} < {col_val}
UNION ALL SELECT revisionId, 'validation' FROM revlog WHERE {col} >= {col_val} AND {col} < {col_test}"""


_ID_OF = "(SELECT min(revisionId) FROM revlog WHERE \"timestamp\" >= TIMESTAMP '{}')"


def _first_id(log, ts):
    from ..sources.tables import ts_lit
    return log.where(F.col("timestamp") >= ts_lit(ts)).agg(F.min("revisionId")).first()[0]


def _parts(fit, train, val):
    return (fit.select("revisionId", F.lit("fit").alias("part"))
            .unionByName(train.select("revisionId", F.lit("training").alias("part")))
            .unionByName(val.select("revisionId", F.lit("validation").alias("part"))))


@query("split_by_revision", with_revlog(_parts_sql(_ID_OF.format(TRAIN_START), _ID_OF.format(VALIDATION_START),
                                                   _ID_OF.format(TEST_START))))
def q_split_by_revision(spark, sf):
    log = revision_log(spark, sf)
    ids = [_first_id(log, t) for t in (TRAIN_START, VALIDATION_START, TEST_START)]
    return _parts(*SP.split_by_revision(log, *ids))


@query("split_by_date", with_revlog(_parts_sql(f"TIMESTAMP '{TRAIN_START}'", f"TIMESTAMP '{VALIDATION_START}'",
                                               f"TIMESTAMP '{TEST_START}'", '"timestamp"')))
def q_split_by_date(spark, sf):
    log = revision_log(spark, sf)
    return _parts(*SP.split_by_date(log, TRAIN_START, VALIDATION_START, TEST_START))


@query("index_for_key", with_revlog(f"""
SELECT CAST(count(*) FILTER (WHERE "timestamp" < TIMESTAMP '{VALIDATION_START}') AS BIGINT) AS "index" FROM revlog"""))
def q_index_for_key(spark, sf):
    return SP.index_for_key(revision_log(spark, sf), VALIDATION_START, "timestamp")


# ---------------------------------------------------------------- features by catalog
def _mini_catalog():
    from ..operators import steps as ST
    return CAT.grouped({
        "contextual": {"user": [CAT.Feature("userName", [ST.frequency()], "userFreq")],
                       "item": [CAT.Feature("itemId", [ST.frequency()], "itemFreq")]},
        "content": {"value": [CAT.Feature("value", [ST.impute_minus_one()], "valueImputed"),
                              CAT.Feature("value", [ST.log_scale()], "valueLog")]},
    })


def _mini_table(spark, sf, features=None):
    from ..sources.tables import ts_lit
    log = revision_log(spark, sf)
    return feature_pipeline(log, features or _mini_catalog(), F.col("timestamp") < ts_lit(VALIDATION_START))


_MINI_SQL = {
    "userFreq": f"CAST(CAST(coalesce((SELECT count(*) FROM revlog x WHERE x.userName = r.userName AND x.{FIT_SQL}), 0) AS FLOAT) AS DOUBLE)",
    "itemFreq": f"CAST(CAST(coalesce((SELECT count(*) FROM revlog x WHERE x.itemId = r.itemId AND x.{FIT_SQL}), 0) AS FLOAT) AS DOUBLE)",
    "valueImputed": "round(CAST(CAST(coalesce(value, -1) AS FLOAT) AS DOUBLE), 6)",
    "valueLog": "round(CAST(CAST(coalesce(sign(value) * ceil(log2(abs(value) + 1)), 0) AS FLOAT) AS DOUBLE), 6)",
}


def _select_query(name, names):
    sql = with_revlog("SELECT revisionId, " + ", ".join(f"{_MINI_SQL[n]} AS {n}" for n in names) + " FROM revlog r")

    @query(name, sql)
    def fn(spark, sf):
        t = _mini_table(spark, sf)
        cat = _mini_catalog()
        chosen = {"select_features": lambda: CAT.select_features(cat, ["itemFreq", "valueLog"]),
                  "select_group": lambda: CAT.select_group(cat, "content"),
                  "select_subgroup": lambda: CAT.select_subgroup(cat, "user")}[name]()
        return t.select("revisionId", *[r6(F.col(f.output)).alias(f.output) for f in chosen])
    return fn


_select_query("select_features", ["itemFreq", "valueLog"])
_select_query("select_group", ["valueImputed", "valueLog"])
_select_query("select_subgroup", ["userFreq"])


@query("add_feature", with_revlog("SELECT revisionId, " + ", ".join(f"{v} AS {n}" for n, v in _MINI_SQL.items()) + """,
       round(CAST(CAST(coalesce(value, 0) * 2 AS FLOAT) AS DOUBLE), 6) AS doubled FROM revlog r"""))
def q_add_feature(spark, sf):
    from ..operators import steps as ST
    doubled = CAT.Feature("value", [ST.impute_zero(), ST.ExprStep(lambda v: v * 2, "double")], "doubled")
    features = CAT.add_feature(_mini_catalog(), doubled)
    t = _mini_table(spark, sf, features)
    return t.select("revisionId", *[r6(F.col(n)).alias(n) for n in CAT.feature_names(features)])


@query("set_group_ids", with_revlog("""
SELECT revisionId, CAST(coalesce(userId, -1) * 100 + weekofyear("timestamp") AS BIGINT) AS groupId FROM revlog"""))
def q_set_group_ids(spark, sf):
    ids = F.coalesce(F.col("userId"), F.lit(-1)) * 100 + F.weekofyear("timestamp")
    return SE.set_group_ids(revision_log(spark, sf), ids).select("revisionId", "groupId")


# ---------------------------------------------------------------- filters
def _filter_query(name, sql_where, fn_filter, scored=False):
    src = f"(SELECT *, {SCORE_SQL} AS prob, {SCORE_SQL} > 0.5 AS pred FROM revlog)" if scored else "revlog"

    @query(name, with_revlog(f"SELECT revisionId FROM {src} WHERE {sql_where}"))
    def fn(spark, sf):
        d = revision_log(spark, sf)
        if scored:
            d = d.withColumn("prob", score_col()).withColumn("pred", S.classify_threshold(F.col("prob")))
        return fn_filter(d).select("revisionId")
    return fn


_filter_query("apply_mask", "coalesce(value > 50, false)", lambda d: SP.apply_mask(d, F.col("value") > 50))
_filter_query("complement", "NOT coalesce(value > 50, false)", lambda d: SP.complement(d, F.col("value") > 50))
_filter_query("filter_head", "contentType = 'TEXT'", SP.filter_head)
_filter_query("filter_body", "contentType IN ('STATEMENT', 'SITELINK')", SP.filter_body)
_filter_query("get_positives", "label", SP.get_positives)
_filter_query("false_negatives", "label AND NOT pred", SP.false_negatives, scored=True)
_filter_query("false_positives", "NOT label AND pred", SP.false_positives, scored=True)
_filter_query("filter_misclassified", "label AND prob < 0.25", SP.filter_misclassified, scored=True)


@query("classify_threshold", with_revlog(f"SELECT revisionId, {SCORE_SQL} > 0.5 AS pred FROM revlog"))
def q_classify_threshold(spark, sf):
    d = revision_log(spark, sf)
    return d.select("revisionId", S.classify_threshold(score_col()).alias("pred"))


@query("drop_duplicates", with_revlog("""
SELECT min(revisionId) AS revisionId, userName, itemId FROM revlog GROUP BY userName, itemId"""))
def q_drop_duplicates(spark, sf):
    d = revision_log(spark, sf).select("revisionId", "userName", "itemId")
    return SP.drop_duplicates(d, ["userName", "itemId"], order="revisionId")


@query("sort_by_revision", with_revlog("""
SELECT revisionId, userName, row_number() OVER (ORDER BY revisionId) AS "position" FROM revlog"""))
def q_sort_by_revision(spark, sf):
    # the place of each row among the sorted rows
    return number_in_order(revision_log(spark, sf).select("revisionId", "userName"), "revisionId")


@query("append", with_revlog(f"""
SELECT revisionId FROM revlog WHERE "timestamp" >= TIMESTAMP '{VALIDATION_START}' AND "timestamp" < TIMESTAMP '{TEST_START}'
UNION ALL SELECT revisionId FROM revlog WHERE "timestamp" >= TIMESTAMP '{TRAIN_START}' AND "timestamp" < TIMESTAMP '{VALIDATION_START}'"""))
def q_append(spark, sf):
    log = revision_log(spark, sf)
    _, train, val = SP.split_by_date(log, TRAIN_START, VALIDATION_START, TEST_START)
    return val.select("revisionId").unionByName(train.select("revisionId"))


# ---------------------------------------------------------------- samples
# Rows are drawn in the order of an md5 hash of seed and id, which SQL follows.
@query("sample_n", with_revlog(f"""
SELECT revisionId FROM (SELECT revisionId, row_number() OVER (ORDER BY {HASH_ORDER_SQL}, revisionId) AS rk,
                               count(*) OVER () AS n FROM revlog)
WHERE rk <= floor(0.3 * n)"""))
def q_sample_n(spark, sf):
    return SP.sample_n(revision_log(spark, sf), 0.3).select("revisionId")


@query("random_split", with_revlog(f"""
SELECT revisionId, CASE WHEN rk <= floor(0.3 * n) THEN 'first' ELSE 'second' END AS part
FROM (SELECT revisionId, row_number() OVER (ORDER BY {HASH_ORDER_SQL}, revisionId) AS rk,
             count(*) OVER () AS n FROM revlog)"""))
def q_random_split(spark, sf):
    a, b = SP.random_split(revision_log(spark, sf), 0.3)
    return a.select("revisionId", F.lit("first").alias("part")).unionByName(
        b.select("revisionId", F.lit("second").alias("part")))


@query("ordered_split", with_revlog("""
SELECT revisionId, CASE WHEN rn <= floor(0.7 * n) THEN 'first' ELSE 'second' END AS part
FROM (SELECT revisionId, row_number() OVER (ORDER BY revisionId) AS rn, count(*) OVER () AS n FROM revlog)"""))
def q_ordered_split(spark, sf):
    a, b = SP.ordered_split(revision_log(spark, sf), 0.7)
    return a.select("revisionId", F.lit("first").alias("part")).unionByName(
        b.select("revisionId", F.lit("second").alias("part")))


@query("undersample", with_revlog(f"""
SELECT revisionId, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH_ORDER_SQL}, revisionId) AS rk,
         count(*) FILTER (WHERE label) OVER () AS positives FROM revlog)
WHERE label OR rk <= positives"""))
def q_undersample(spark, sf):
    return SP.undersample(revision_log(spark, sf), 1.0).select("revisionId", "label")


@query("oversample", with_revlog("""
SELECT revisionId, CAST(unnest(generate_series(1, CASE WHEN label THEN 3 ELSE 1 END)) AS INTEGER) AS copy FROM revlog"""))
def q_oversample(spark, sf):
    s = SP.oversample(revision_log(spark, sf), 3)
    return s.select("revisionId", F.col("copy").cast("int"))


@query("balanced_sample", with_revlog(f"""
SELECT revisionId, contentType, label FROM (
  SELECT *, row_number() OVER (PARTITION BY contentType ORDER BY -ln(greatest(u, 1e-300)) * n / 0.5, revisionId) AS rk
  FROM (SELECT *, CAST('0x' || {HASH_ORDER_SQL} AS BIGINT) / pow(2.0, 60) AS u,
               count(*) OVER (PARTITION BY contentType, label) AS n FROM revlog))
WHERE rk <= 100"""))
def q_balanced_sample(spark, sf):
    s = SP.balanced_sample(revision_log(spark, sf), "contentType", "label", 100)
    return s.select("revisionId", "contentType", "label")


@query("sample_errors", with_revlog(f"""
SELECT revisionId, error FROM (
  SELECT revisionId, error, row_number() OVER (PARTITION BY error ORDER BY {HASH_ORDER_SQL}, revisionId) AS rk
  FROM (SELECT *, CASE WHEN label THEN 'FN' ELSE 'FP' END AS error FROM revlog WHERE label <> ({SCORE_SQL} > 0.5)))
WHERE rk <= 10"""))
def q_sample_errors(spark, sf):
    d = revision_log(spark, sf).withColumn("prob", score_col()).withColumn("pred", F.col("prob") > 0.5)
    return SP.sample_errors(d, "label", "pred", 10).select("revisionId", "error")


@query("topk_misclassified", with_revlog(f"""
SELECT revisionId, label, round(prob, 6) AS prob, CAST(rk AS INTEGER) AS "rank" FROM (
  SELECT revisionId, label, prob, row_number() OVER (PARTITION BY label ORDER BY
         CASE WHEN label THEN prob ELSE -prob END, revisionId) AS rk
  FROM (SELECT revisionId, label, {SCORE_SQL} AS prob FROM revlog)) WHERE rk <= 5"""))
def q_topk_misclassified(spark, sf):
    d = revision_log(spark, sf).withColumn("prob", score_col())
    t = SP.topk_misclassified(d, "label", "prob", k=5)
    return t.select("revisionId", "label", r6(F.col("prob")).alias("prob"), F.col("rank").cast("int"))
