"""Queries for the fit/transform steps (frequency, group aggregates, imputers,
scaling, time units, value classes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import steps as ST
from ..sources.tables import VALIDATION_START, read, revision_log, ts_lit, with_revlog
from .registry import query, r6

FIT_SQL = "\"timestamp\" < TIMESTAMP '2024-01-19 00:00:00'"


def fit_pred():
    return F.col("timestamp") < ts_lit(VALIDATION_START)


def _out(df, name):
    return df.select("revisionId", r6(F.col(name)).alias(name))


# ------------------------------------------------------------ frequency
@query("frequency", with_revlog(f"""
SELECT userName, CAST(count(*) AS BIGINT) AS frequency
FROM revlog WHERE {FIT_SQL} AND userName IS NOT NULL GROUP BY userName"""))
def q_frequency(spark, sf):
    log = revision_log(spark, sf)
    return ST.frequency().fit_table(log, ["userName"], "frequency", fit_pred())


@query("join_frequency", with_revlog(f"""
WITH f AS (SELECT userName, count(*) AS n FROM revlog WHERE {FIT_SQL} AND userName IS NOT NULL GROUP BY userName)
SELECT r.revisionId, round(CAST(coalesce(f.n, 0) AS DOUBLE), 6) AS userFreq
FROM revlog r LEFT JOIN f ON r.userName = f.userName"""))
def q_join_frequency(spark, sf):
    log = revision_log(spark, sf)
    return _out(ST.frequency().fit_transform(log, ["userName"], "userFreq", fit_pred()), "userFreq")


@query("log_scale", with_revlog(f"""
WITH f AS (SELECT itemId, count(*) AS n FROM revlog WHERE {FIT_SQL} AND itemId IS NOT NULL GROUP BY itemId),
j AS (SELECT r.revisionId, CAST(coalesce(f.n, 0) AS DOUBLE) AS x FROM revlog r LEFT JOIN f ON r.itemId = f.itemId)
SELECT revisionId, round(coalesce(sign(x) * ceil(log2(abs(x) + 1)), 0), 6) AS logItemFreq FROM j"""))
def q_log_scale(spark, sf):
    log = revision_log(spark, sf)
    d = ST.frequency().fit_transform(log, ["itemId"], "f", fit_pred())
    return d.select("revisionId", r6(S.log_scale(F.col("f"))).alias("logItemFreq"))


def _group_sql(agg: str, name: str, key: str = "userName", value: str = "value") -> str:
    return with_revlog(f"""
WITH g AS (SELECT {key}, {agg} AS a FROM revlog WHERE {FIT_SQL} AND {key} IS NOT NULL GROUP BY {key})
SELECT r.revisionId, round(CAST(coalesce(g.a, 0) AS DOUBLE), 6) AS {name}
FROM revlog r LEFT JOIN g ON r.{key} = g.{key}""")


def _group_query(step, name, inputs=("userName", "value")):
    def fn(spark, sf):
        log = revision_log(spark, sf)
        return _out(step().fit_transform(log, list(inputs), name, fit_pred()), name)
    return fn


query("group_agg", _group_sql("max(value)", "userMaxValue"))(
    _group_query(lambda: ST.group_agg(F.max), "userMaxValue"))
query("group_nunique", _group_sql("count(DISTINCT itemId)", "userUniqueItems"))(
    _group_query(ST.group_nunique, "userUniqueItems", ("userName", "itemId")))
query("group_sum", _group_sql("coalesce(sum(value), 0)", "userSumValue"))(
    _group_query(ST.group_sum, "userSumValue"))
query("group_mean", _group_sql("avg(value)", "userMeanValue"))(
    _group_query(ST.group_mean, "userMeanValue"))


@query("join_group_aggregate", with_revlog(f"""
WITH g AS (SELECT contentType, userName, avg(value) AS a FROM revlog WHERE {FIT_SQL}
           GROUP BY contentType, userName)
SELECT r.revisionId, round(CAST(coalesce(g.a, 0) AS DOUBLE), 6) AS userSliceMeanValue
FROM revlog r LEFT JOIN g ON r.contentType IS NOT DISTINCT FROM g.contentType
                        AND r.userName IS NOT DISTINCT FROM g.userName"""))
def q_join_group_aggregate(spark, sf):
    # category keys: a missing user is a group of its own (null-safe join)
    log = revision_log(spark, sf)
    step = ST.group_mean(null_safe=True)
    return _out(step.fit_transform(log, ["contentType", "userName", "value"], "userSliceMeanValue",
                                   fit_pred()), "userSliceMeanValue")


# ------------------------------------------------------------ imputers
def _expr_query(name, sql_expr, spark_expr):
    @query(name, with_revlog(f"SELECT revisionId, {sql_expr} AS {name}_out FROM revlog"))
    def fn(spark, sf):
        log = revision_log(spark, sf)
        return log.select("revisionId", spark_expr(log).alias(f"{name}_out"))
    return fn


_expr_query("impute_string", "coalesce(userName, 'missing')", lambda d: S.impute_string(F.col("userName")))
_expr_query("impute_zero", "round(coalesce(value, 0), 6)", lambda d: r6(S.impute_zero(F.col("value"))))
_expr_query("impute_minus_one", "round(coalesce(value, -1), 6)", lambda d: r6(S.impute_minus_one(F.col("value"))))
_expr_query("impute_boolean",
            "CAST(coalesce(CAST(CAST(value > 50 AS INTEGER) AS FLOAT), 0.5) AS DOUBLE)",
            lambda d: S.impute_boolean(F.col("value") > 50).cast("double"))
_expr_query("null_indicator", "value IS NULL", lambda d: S.null_indicator(F.col("value")))
_expr_query("to_float32", "round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6)",
            lambda d: r6(S.to_float32(F.col("value"))))
_expr_query("sqrt_scale", "round(ceil(sqrt(value + 1)), 6)", lambda d: r6(S.sqrt_scale(F.col("value"))))
_expr_query("hour_of_day", "CAST(hour(\"timestamp\") AS BIGINT)",
            lambda d: S.hour_of_day(F.col("timestamp")).cast("bigint"))
_expr_query("day_of_week", "CAST(isodow(\"timestamp\") - 1 AS BIGINT)",
            lambda d: S.day_of_week(F.col("timestamp")).cast("bigint"))
_expr_query("day_of_month", "CAST(day(\"timestamp\") AS BIGINT)",
            lambda d: S.day_of_month(F.col("timestamp")).cast("bigint"))
_expr_query("logical_or", "coalesce(value > 50, false) OR coalesce(userId IS NULL, false) OR coalesce(label, false)",
            lambda d: S.logical_or(F.col("value") > 50, F.col("userId").isNull(), F.col("label")))
_expr_query("clamp_infinity",
            "CASE WHEN value > 90 THEN 1.7976931348623157e308 WHEN value < 1 THEN -1.7976931348623157e308 "
            "ELSE value END",
            lambda d: S.clamp_infinity(
                F.when(F.col("value") > 90, F.lit(float("inf")))
                 .when(F.col("value") < 1, F.lit(float("-inf"))).otherwise(F.col("value"))))


def _scalar_query(name, stat, sql_agg):
    @query(name, with_revlog(f"""
WITH s AS (SELECT {sql_agg}(value) AS m FROM revlog WHERE {FIT_SQL})
SELECT revisionId, round(coalesce(value, (SELECT m FROM s)), 6) AS {name}_out FROM revlog"""))
    def fn(spark, sf):
        log = revision_log(spark, sf)
        return _out(ST.ScalarStep(stat).fit_transform(log, ["value"], f"{name}_out", fit_pred()),
                    f"{name}_out")
    return fn


_scalar_query("impute_mean", "mean", "avg")
_scalar_query("impute_median", "median", "median")


def _u_sql(salt):
    return (f"((CAST(('0x' || substr(md5(CAST(revisionId AS VARCHAR) || ':{salt}'), 1, 13)) AS BIGINT) + 1.0)"
            f" / 4503599627370496.0)")


@query("normal_noise", with_revlog(f"""
SELECT revisionId, round(sqrt(-2.0 * ln({_u_sql("1a")})) * cos(2.0 * pi() * {_u_sql("1b")}), 6) AS noise
FROM revlog"""))
def q_normal_noise(spark, sf):
    log = revision_log(spark, sf)
    return log.select("revisionId", r6(S.normal_noise(F.col("revisionId"), 1)).alias("noise"))


# ------------------------------------------------------------ value classes
# A language code and a revision tag per document, derived from its
# language and source so that every class rule is exercised.
_LANG_SQL = """
langs AS (
  SELECT doc_id,
         CASE CAST(substr(source, 4) AS INTEGER) % 8
              WHEN 0 THEN lang WHEN 1 THEN lang || 'wiki' WHEN 2 THEN lang || 'wikisource'
              WHEN 3 THEN lang || 'wikinews' WHEN 4 THEN lang || '-at'
              WHEN 5 THEN '' WHEN 6 THEN lang || 'wikivoyage' ELSE 'commonswiki' END AS revisionLanguage,
         CASE CAST(substr(source, 4) AS INTEGER) % 5
              WHEN 0 THEN 'OAuth CID: ' || source WHEN 1 THEN 'HHVM' WHEN 2 THEN ''
              WHEN 3 THEN NULL ELSE 'abusefilter ' || source END AS revisionTag,
         CASE WHEN n_chars < 200 THEN -1.0 WHEN n_chars > 90000 THEN NULL ELSE n_chars / 1000.0 - 5 END AS languageWordRatio
  FROM documents)"""


def _langs(spark, sf):
    d = read(spark, sf, "documents")
    m8 = F.substring("source", 4, 100).cast("int") % 8
    m5 = F.substring("source", 4, 100).cast("int") % 5
    lang = (F.when(m8 == 0, F.col("lang")).when(m8 == 1, F.concat("lang", F.lit("wiki")))
             .when(m8 == 2, F.concat("lang", F.lit("wikisource")))
             .when(m8 == 3, F.concat("lang", F.lit("wikinews")))
             .when(m8 == 4, F.concat("lang", F.lit("-at"))).when(m8 == 5, F.lit(""))
             .when(m8 == 6, F.concat("lang", F.lit("wikivoyage"))).otherwise(F.lit("commonswiki")))
    tag = (F.when(m5 == 0, F.concat(F.lit("OAuth CID: "), F.col("source"))).when(m5 == 1, F.lit("HHVM"))
            .when(m5 == 2, F.lit("")).when(m5 == 3, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("abusefilter "), F.col("source"))))
    ratio = (F.when(F.col("n_chars") < 200, F.lit(-1.0)).when(F.col("n_chars") > 90000, F.lit(None))
              .otherwise(F.col("n_chars") / 1000.0 - 5))
    return d.select("doc_id", lang.alias("revisionLanguage"), tag.alias("revisionTag"),
                    ratio.alias("languageWordRatio"))


LANGS_SQL = _LANG_SQL


@query("language_class", f"""WITH {_LANG_SQL}
SELECT doc_id, revisionLanguage,
  CASE WHEN stripped LIKE 'de-%' THEN 'de' WHEN stripped LIKE 'en-%' THEN 'en' ELSE stripped END AS languageClass
FROM (SELECT doc_id, revisionLanguage,
        CASE WHEN revisionLanguage = '' THEN 'nan'
             WHEN ends_with(revisionLanguage, 'wikisource') THEN left(revisionLanguage, length(revisionLanguage) - 10)
             WHEN ends_with(revisionLanguage, 'wikiquote') THEN left(revisionLanguage, length(revisionLanguage) - 9)
             WHEN ends_with(revisionLanguage, 'wikinews') THEN left(revisionLanguage, length(revisionLanguage) - 8)
             WHEN ends_with(revisionLanguage, 'wikivoyage') THEN left(revisionLanguage, length(revisionLanguage) - 10)
             WHEN ends_with(revisionLanguage, 'wiki') THEN left(revisionLanguage, length(revisionLanguage) - 4)
             ELSE revisionLanguage END AS stripped
      FROM langs)""")
def q_language_class(spark, sf):
    d = _langs(spark, sf)
    return d.select("doc_id", "revisionLanguage", T.language_class(F.col("revisionLanguage")).alias("languageClass"))


@query("tag_class", f"""WITH {_LANG_SQL}
SELECT doc_id, CASE WHEN revisionTag IS NULL OR revisionTag = '' THEN 'nan'
                    WHEN contains(revisionTag, 'OAuth CID') OR contains(revisionTag, 'HHVM') THEN 'EDITING TOOLS'
                    ELSE 'ABUSE FILTER' END AS tagClass
FROM langs""")
def q_tag_class(spark, sf):
    d = _langs(spark, sf)
    return d.select("doc_id", T.tag_class(F.col("revisionTag")).alias("tagClass"))


@query("ratio_class", f"""WITH {_LANG_SQL}
SELECT doc_id, CASE WHEN languageWordRatio IS NULL OR languageWordRatio = -1 THEN 'nan'
                    WHEN languageWordRatio > 0 THEN 'true' ELSE 'false' END AS ratioClass
FROM langs""")
def q_ratio_class(spark, sf):
    d = _langs(spark, sf)
    return d.select("doc_id", T.ratio_class(F.col("languageWordRatio")).alias("ratioClass"))


@query("round_thousands", """
SELECT lang, CAST(round_even(sum(n_chars) / 1000.0, 0) AS DOUBLE) AS kchars FROM documents GROUP BY lang""")
def q_round_thousands(spark, sf):
    d = read(spark, sf, "documents")
    return d.groupBy("lang").agg(S.round_thousands(F.sum("n_chars")).alias("kchars"))
