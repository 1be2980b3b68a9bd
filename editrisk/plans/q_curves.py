"""Queries for ROC / PR metrics on a given score column of the stand-in log.

The oracles are written independently of the Spark formulas where
possible: the ROC area by the rank-sum identity, the PR areas with
``lag`` over a plain window, the interpolated area by ``generate_series``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves as CV
from ..sources.tables import revision_log, with_revlog
from .q_windows import SCORE_SQL, score_col
from .registry import query, r6

GRID_SQL = "[" + ", ".join(repr(x) for x in CV.GRID) + "]"

_POINTS_SQL = f"""
s AS (SELECT {SCORE_SQL} AS score, CAST(label AS INTEGER) AS y, contentType FROM revlog),
t AS (SELECT 'ALL' AS slice, score, y FROM s
      UNION ALL SELECT 'ITEM_HEAD', score, y FROM s WHERE contentType = 'TEXT'
      UNION ALL SELECT 'ITEM_BODY', score, y FROM s WHERE contentType IN ('STATEMENT', 'SITELINK')),
p AS (SELECT slice, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM t GROUP BY slice, score),
r AS (SELECT slice, score, pos, neg,
             sum(pos) OVER w AS TP, sum(neg) OVER w AS FP, row_number() OVER w AS idx,
             sum(pos) OVER (PARTITION BY slice) AS P, sum(neg) OVER (PARTITION BY slice) AS N,
             count(*) OVER (PARTITION BY slice) AS npoints
      FROM p WINDOW w AS (PARTITION BY slice ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _scored(spark, sf):
    return revision_log(spark, sf).withColumn("prob", score_col())


def _points(spark, sf):
    return CV.score_points(_scored(spark, sf), "prob", "label", "contentType")


@query("roc_auc", with_revlog(f"""
WITH {_POINTS_SQL},
rk AS (SELECT slice, pos, neg, P, N,
              sum(pos + neg) OVER (PARTITION BY slice ORDER BY score ASC
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi_rank FROM r)
SELECT slice, round((sum(pos * (hi_rank - (pos + neg) + 1 + hi_rank) / 2.0) - max(P) * (max(P) + 1) / 2.0)
                    / (max(P) * max(N)), 6) AS ROC
FROM rk GROUP BY slice"""))
def q_roc_auc(spark, sf):
    a = CV.areas(_points(spark, sf))
    return a.select("slice", r6(F.col("ROC")).alias("ROC"))


@query("pr_auc_trapezoid", with_revlog(f"""
WITH {_POINTS_SQL},
q AS (SELECT slice, pos, P, TP * 1.0 / (TP + FP) AS prec,
             lag(TP * 1.0 / (TP + FP)) OVER (PARTITION BY slice ORDER BY idx) AS prev_prec,
             first_value(TP * 1.0 / (TP + FP)) OVER (PARTITION BY slice ORDER BY idx) AS first_prec FROM r)
SELECT slice, round(sum(pos * 1.0 / P * (prec + coalesce(prev_prec, first_prec)) / 2.0), 6) AS PR_trapezoid
FROM q GROUP BY slice"""))
def q_pr_auc_trapezoid(spark, sf):
    a = CV.areas(_points(spark, sf))
    return a.select("slice", r6(F.col("PR_trapezoid")).alias("PR_trapezoid"))


_INTERP_SQL = f"""
WITH {_POINTS_SQL},
seg AS (SELECT slice, score, P, TP - pos AS a, FP - neg AS b, neg * 1.0 / pos AS s, pos AS m, idx,
               min(CASE WHEN pos > 0 THEN idx END) OVER (PARTITION BY slice) AS first_idx
        FROM r WHERE pos > 0),
pts AS (SELECT slice, P, idx, first_idx, a, b, s, unnest(generate_series(1, CAST(m AS BIGINT))) AS t FROM seg),
pr AS (SELECT slice, P, idx, t, first_idx, (a + t) / (a + t + b + s * t) AS prec,
              CASE WHEN t = 1 THEN CASE WHEN a + b > 0 THEN a / (a + b) ELSE NULL END END AS start_prec
       FROM pts),
pr2 AS (SELECT slice, P, prec, coalesce(start_prec,
              lag(prec) OVER (PARTITION BY slice ORDER BY idx, t), prec) AS prev FROM pr)
SELECT slice, round(sum((prec + prev) / 2.0 / P), 6) AS PR FROM pr2 GROUP BY slice"""


@query("pr_auc_interpolated", with_revlog(_INTERP_SQL))
def q_pr_auc_interpolated(spark, sf):
    a = CV.areas(_points(spark, sf))
    return a.select("slice", r6(F.col("PR")).alias("PR"))


_CURVE_CTES = f"""
k AS (SELECT r.*, lead(pos) OVER (PARTITION BY slice ORDER BY idx) AS npos,
             lead(neg) OVER (PARTITION BY slice ORDER BY idx) AS nneg FROM r WHERE P > 0 AND N > 0),
kept AS (SELECT slice, idx, score AS thr, FP * 1.0 / N AS fpr, TP * 1.0 / P AS tpr,
                max(score) OVER (PARTITION BY slice) + 1 AS thr0
         FROM k WHERE npoints <= 2 OR idx = 1 OR idx = npoints OR npos <> pos OR nneg <> neg),
cseg AS (SELECT slice, thr, fpr, tpr,
               coalesce(lag(fpr) OVER (PARTITION BY slice ORDER BY idx), 0.0) AS fpr0,
               coalesce(lag(tpr) OVER (PARTITION BY slice ORDER BY idx), 0.0) AS tpr0,
               coalesce(lag(thr) OVER (PARTITION BY slice ORDER BY idx), thr0) AS thrp FROM kept),
grid AS (SELECT generate_subscripts(g, 1) - 1 AS i, unnest(g) AS x FROM (SELECT {GRID_SQL}::DOUBLE[] AS g)),
curve AS (SELECT slice, i, x AS fpr, (tpr - tpr0) / (fpr - fpr0) * (x - fpr0) + tpr0 AS tpr,
                 (thr - thrp) / (fpr - fpr0) * (x - fpr0) + thrp AS threshold
          FROM cseg JOIN grid ON grid.x > cseg.fpr0 AND grid.x <= cseg.fpr WHERE cseg.fpr > cseg.fpr0)"""

_ROC_CURVE_SQL = f"""
WITH {_POINTS_SQL},{_CURVE_CTES}
SELECT slice, CAST(i AS INTEGER) AS i, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr,
       round(threshold, 6) AS threshold FROM curve"""


@query("roc_curve_100", with_revlog(_ROC_CURVE_SQL))
def q_roc_curve_100(spark, sf):
    c = CV.roc_curve_100(_points(spark, sf))
    return c.select("slice", F.col("i").cast("int"), r6(F.col("fpr")).alias("fpr"),
                    r6(F.col("tpr")).alias("tpr"), r6(F.col("threshold")).alias("threshold"))


@query("thin_curve", with_revlog(f"""
WITH {_POINTS_SQL}
SELECT slice, CAST(idx AS BIGINT) AS idx, round(TP * 1.0 / P, 6) AS recall, round(TP * 1.0 / (TP + FP), 6) AS precision
FROM r WHERE idx % CAST(ceil(npoints / 300.0) AS BIGINT) = 0 OR idx = npoints"""))
def q_thin_curve(spark, sf):
    c = CV.pr_curve(_points(spark, sf), 300)  # a bound that these curves exceed
    return c.select("slice", F.col("idx").cast("bigint"), r6(F.col("recall")).alias("recall"),
                    r6(F.col("precision")).alias("precision"))


_AREAS_SQL = f"""
WITH {_POINTS_SQL},
rk AS (SELECT slice, pos, neg, P, N,
              sum(pos + neg) OVER (PARTITION BY slice ORDER BY score ASC
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi_rank FROM r),
roc AS (SELECT slice, max(P) AS P, max(N) AS N,
               (sum(pos * (hi_rank - (pos + neg) + 1 + hi_rank) / 2.0) - max(P) * (max(P) + 1) / 2.0)
               / (max(P) * max(N)) AS ROC FROM rk GROUP BY slice),
q AS (SELECT slice, pos, P, TP * 1.0 / (TP + FP) AS prec,
             lag(TP * 1.0 / (TP + FP)) OVER (PARTITION BY slice ORDER BY idx) AS prev_prec,
             first_value(TP * 1.0 / (TP + FP)) OVER (PARTITION BY slice ORDER BY idx) AS first_prec FROM r),
trap AS (SELECT slice, sum(pos * 1.0 / P * (prec + coalesce(prev_prec, first_prec)) / 2.0) AS PR_trapezoid
         FROM q GROUP BY slice),
seg AS (SELECT slice, score, P, TP - pos AS a, FP - neg AS b, neg * 1.0 / pos AS s, pos AS m, idx FROM r WHERE pos > 0),
pts AS (SELECT slice, P, idx, a, b, s, unnest(generate_series(1, CAST(m AS BIGINT))) AS t FROM seg),
pr AS (SELECT slice, P, idx, t, (a + t) / (a + t + b + s * t) AS prec,
              CASE WHEN t = 1 THEN CASE WHEN a + b > 0 THEN a / (a + b) ELSE NULL END END AS start_prec FROM pts),
pr2 AS (SELECT slice, P, prec, coalesce(start_prec, lag(prec) OVER (PARTITION BY slice ORDER BY idx, t), prec) AS prev
        FROM pr),
dg AS (SELECT slice, sum((prec + prev) / 2.0 / P) AS PR FROM pr2 GROUP BY slice)
SELECT roc.slice, CAST(P AS BIGINT) AS positives, CAST(N AS BIGINT) AS negatives, round(ROC, 6) AS ROC,
       round(dg.PR, 6) AS PR, round(PR_trapezoid, 6) AS PR_trapezoid
FROM roc JOIN trap USING (slice) JOIN dg USING (slice)"""


def _metrics(spark, sf, curves):
    m = CV.metrics_by_slice(_scored(spark, sf), "prob", "label", "contentType", curves=curves)
    return m


@query("drop_curves", with_revlog(_AREAS_SQL))
def q_drop_curves(spark, sf):
    m = CV.drop_curves(_metrics(spark, sf, True))
    return m.select("slice", "positives", "negatives", *[r6(F.col(c)).alias(c) for c in ("ROC", "PR", "PR_trapezoid")])


_METRICS_SQL = _AREAS_SQL.replace(
    "\nSELECT roc.slice,",
    "," + _CURVE_CTES + """,
txt AS (SELECT slice, string_agg(printf('%.2f', fpr), ',' ORDER BY i) AS fprValues,
               string_agg(printf('%f', tpr), ',' ORDER BY i) AS tprValues,
               string_agg(printf('%f', threshold), ',' ORDER BY i) AS rocThresholds FROM curve GROUP BY slice),
prn AS (SELECT slice, idx, npoints, CAST((2000000 * TP + TP + FP) // (2 * (TP + FP)) AS BIGINT) AS a,
               CAST((2000000 * TP + P) // (2 * P) AS BIGINT) AS b FROM r WHERE P > 0),
prtxt AS (SELECT slice, string_agg(printf('%d.%06d', a // 1000000, a % 1000000), ',' ORDER BY idx) AS precisionValues,
                 string_agg(printf('%d.%06d', b // 1000000, b % 1000000), ',' ORDER BY idx) AS recallValues
          FROM prn WHERE idx % CAST(ceil(npoints / 10000.0) AS BIGINT) = 0 OR idx = npoints GROUP BY slice)
SELECT roc.slice, txt.fprValues, txt.tprValues, txt.rocThresholds, prtxt.precisionValues, prtxt.recallValues,""").replace(
    "FROM roc JOIN trap USING (slice) JOIN dg USING (slice)",
    "FROM roc JOIN trap USING (slice) JOIN dg USING (slice) LEFT JOIN txt USING (slice) LEFT JOIN prtxt USING (slice)")


@query("metrics_by_slice", with_revlog(_METRICS_SQL))
def q_metrics_by_slice(spark, sf):
    m = _metrics(spark, sf, True)
    return m.select("slice", "positives", "negatives", *[r6(F.col(c)).alias(c) for c in ("ROC", "PR", "PR_trapezoid")],
                    *CV.CURVES)
