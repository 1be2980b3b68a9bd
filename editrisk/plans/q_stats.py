"""Queries for the statistics tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats as ST
from ..sources.tables import (TAIL_START, TEST_START, TRAIN_START, VALIDATION_START, read,
                              revision_log, with_revlog)
from .q_steps import LANGS_SQL, _langs
from .registry import query, r6


def _risk_out(t, name="value"):
    return t.select(name, F.col("vandalismRevisions").cast("bigint"), F.col("totalRevisions").cast("bigint"),
                    r6(F.col("vandalismProbability")).alias("vandalismProbability"))


RISK_COLS = ("CAST(v AS BIGINT) AS vandalismRevisions, CAST(t AS BIGINT) AS totalRevisions, "
             "round(v / t, 6) AS vandalismProbability")


@query("value_risk", with_revlog(f"""
SELECT value, {RISK_COLS} FROM (
  SELECT coalesce(userName, 'nan') AS value, sum(CAST(label AS BIGINT)) AS v, count(*) AS t
  FROM revlog GROUP BY 1)"""))
def q_value_risk(spark, sf):
    return _risk_out(ST.value_risk(revision_log(spark, sf), "userName"))


def _labelled_langs(spark, sf):
    lb = read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return _langs(spark, sf).join(lb, "doc_id")


_LANG_CLASS_SQL = """CASE WHEN s LIKE 'de-%' THEN 'de' WHEN s LIKE 'en-%' THEN 'en' ELSE s END"""
_STRIP_SQL = """CASE WHEN revisionLanguage = '' THEN 'nan'
             WHEN ends_with(revisionLanguage, 'wikisource') THEN left(revisionLanguage, length(revisionLanguage) - 10)
             WHEN ends_with(revisionLanguage, 'wikiquote') THEN left(revisionLanguage, length(revisionLanguage) - 9)
             WHEN ends_with(revisionLanguage, 'wikinews') THEN left(revisionLanguage, length(revisionLanguage) - 8)
             WHEN ends_with(revisionLanguage, 'wikivoyage') THEN left(revisionLanguage, length(revisionLanguage) - 10)
             WHEN ends_with(revisionLanguage, 'wiki') THEN left(revisionLanguage, length(revisionLanguage) - 4)
             ELSE revisionLanguage END"""


@query("value_risk_mapped", f"""WITH {LANGS_SQL},
base AS (SELECT coalesce(l.revisionLanguage, 'nan') AS revisionLanguage, b.toxic AS label
         FROM langs l JOIN labels b USING (doc_id)),
risk AS (SELECT revisionLanguage, sum(label) AS v, count(*) AS t FROM base GROUP BY 1),
mapped AS (SELECT CASE WHEN revisionLanguage = 'nan' THEN 'nan' ELSE {_STRIP_SQL} END AS s, v, t FROM risk)
SELECT value, {RISK_COLS} FROM (
  SELECT {_LANG_CLASS_SQL} AS value, sum(v) AS v, sum(t) AS t FROM mapped GROUP BY 1)""")
def q_value_risk_mapped(spark, sf):
    t = ST.value_risk_mapped(_labelled_langs(spark, sf), "revisionLanguage", T.language_class)
    return _risk_out(t)


@query("value_risk_topk", f"""WITH {LANGS_SQL},
base AS (SELECT coalesce(l.revisionTag, 'nan') AS value, b.toxic AS label FROM langs l JOIN labels b USING (doc_id)),
risk AS (SELECT value, sum(label) AS v, count(*) AS t FROM base GROUP BY 1),
top AS (SELECT value FROM risk WHERE value <> 'nan' ORDER BY v DESC, value ASC LIMIT 5),
folded AS (SELECT CASE WHEN value = 'nan' THEN 'nan' WHEN value IN (SELECT value FROM top) THEN value
                       ELSE 'misc' END AS value, v, t FROM risk),
tr AS (SELECT value, sum(v) AS v, sum(t) AS t FROM folded GROUP BY value),
nn AS (SELECT 'nonNan' AS value, sum(v) AS v, sum(t) AS t FROM risk WHERE value <> 'nan')
SELECT value, {RISK_COLS} FROM (SELECT * FROM nn WHERE t IS NOT NULL UNION ALL SELECT * FROM tr)""")
def q_value_risk_topk(spark, sf):
    return _risk_out(ST.value_risk_topk(_labelled_langs(spark, sf), "revisionTag"))


_FOUR = ("CAST(count(DISTINCT revisionId) AS BIGINT) AS Revisions, CAST(count(DISTINCT groupId) AS BIGINT) AS Sessions, "
         "CAST(count(DISTINCT itemId) AS BIGINT) AS Items, CAST(count(DISTINCT userName) AS BIGINT) AS Users")


_SLICE_SQL = [("ALL", "TRUE"), ("ITEM_HEAD", "contentType = 'TEXT'"),
              ("ITEM_BODY", "contentType IN ('STATEMENT', 'SITELINK')")]
_CLASS_SQL = [("Total", "TRUE"), ("Vandalism", "label"), ("Regular", "NOT label")]
# one selection per (slice, class), stacked
_CORPUS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{s}' AS slice, '{c}' AS class, {_FOUR} FROM revlog WHERE ({sw}) AND ({cw})"
    for s, sw in _SLICE_SQL for c, cw in _CLASS_SQL)


@query("corpus_statistics", with_revlog(_CORPUS_SQL))
def q_corpus_statistics(spark, sf):
    return ST.corpus_statistics(revision_log(spark, sf))


@query("dataset_statistics", with_revlog(f"""
SELECT split, {_FOUR} FROM (
  SELECT *, CASE WHEN "timestamp" >= TIMESTAMP '{TRAIN_START}' AND "timestamp" < TIMESTAMP '{VALIDATION_START}' THEN 'Training'
                 WHEN "timestamp" >= TIMESTAMP '{VALIDATION_START}' AND "timestamp" < TIMESTAMP '{TEST_START}' THEN 'Validation'
                 WHEN "timestamp" >= TIMESTAMP '{TEST_START}' AND "timestamp" < TIMESTAMP '{TAIL_START}' THEN 'Test' END AS split
  FROM revlog) WHERE split IS NOT NULL GROUP BY split"""))
def q_dataset_statistics(spark, sf):
    return ST.dataset_statistics(revision_log(spark, sf),
                                 [TRAIN_START, VALIDATION_START, TEST_START, TAIL_START], "timestamp")


@query("vandalism_fraction", with_revlog("""
SELECT round(avg(CAST(label AS DOUBLE)), 6) AS vandalism_fraction FROM revlog"""))
def q_vandalism_fraction(spark, sf):
    t = ST.vandalism_fraction(revision_log(spark, sf))
    return t.select(r6(F.col("vandalism_fraction")).alias("vandalism_fraction"))


def _num_sql(c):
    x = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS count, CAST(NULL AS BIGINT) AS \"unique\", "
            f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
            f"round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM revlog")


def _txt_sql(c):
    return (f"SELECT '{c}', CAST(count({c}) AS BIGINT), CAST(count(DISTINCT {c}) AS BIGINT), "
            f"(SELECT {c} FROM revlog WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), "
            f"(SELECT CAST(count(*) AS BIGINT) FROM revlog WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1), "
            f"NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM revlog")


@query("describe_all", with_revlog(
    "\nUNION ALL\n".join([_num_sql("value"), _num_sql("itemId"), _txt_sql("userName"),
                          _txt_sql("revisionAction")])))
def q_describe_all(spark, sf):
    d = ST.describe_all(revision_log(spark, sf), ["value", "itemId", "userName", "revisionAction"])
    return d.select("column", "count", "unique", "top", "freq",
                    *[r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])
