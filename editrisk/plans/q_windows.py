"""Queries for the running operators and the per-session joins.

The running operators use a small chunk width here so that the oracle check
at sf0.01 crosses many chunk boundaries (the offset path is exercised).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cumulative as C
from ..operators import sessions as SE
from ..sources.tables import revision_log, with_revlog
from .registry import query, r6

CHUNK = 1024  # revision ids per chunk in these checks
W_USER = "PARTITION BY userName ORDER BY revisionId ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _log(spark, sf):
    log = revision_log(spark, sf)
    # a text value that is sometimes missing
    return log.withColumn("action", F.when(F.col("value").isNotNull(), F.col("revisionAction")))


@query("cum_frequency", with_revlog(f"""
SELECT revisionId, CASE WHEN userName IS NULL THEN NULL
                        ELSE CAST(count(*) OVER ({W_USER}) AS BIGINT) END AS cumUserFreq FROM revlog"""))
def q_cum_frequency(spark, sf):
    d = C.cum_frequency(_log(spark, sf), ["userName"], "cumUserFreq", chunk_width=CHUNK)
    return d.select("revisionId", F.col("cumUserFreq").cast("bigint").alias("cumUserFreq"))


@query("cum_count", with_revlog(f"""
SELECT revisionId, CASE WHEN userName IS NULL THEN 0
                        ELSE CAST(count(*) OVER ({W_USER}) - 1 AS BIGINT) END AS cumUserCount FROM revlog"""))
def q_cum_count(spark, sf):
    d = C.cum_count(_log(spark, sf), ["userName"], "cumUserCount", chunk_width=CHUNK)
    return d.select("revisionId", F.col("cumUserCount").cast("bigint").alias("cumUserCount"))


@query("cum_sum", with_revlog(f"""
SELECT revisionId, round(CASE WHEN userName IS NULL THEN 0
                        ELSE sum(coalesce(value, 0)) OVER ({W_USER}) END, 6) AS cumUserSum FROM revlog"""))
def q_cum_sum(spark, sf):
    d = C.cum_sum(_log(spark, sf), ["userName"], "value", "cumUserSum", chunk_width=CHUNK)
    return d.select("revisionId", r6(F.col("cumUserSum")).alias("cumUserSum"))


_W_USER_SLICE = "(PARTITION BY userName, contentType ORDER BY revisionId ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("cum_agg", with_revlog(f"""
SELECT revisionId,
  round(CASE WHEN userName IS NULL OR contentType IS NULL THEN 0 ELSE coalesce(sum(value) OVER {_W_USER_SLICE}, 0) END, 6)
    AS cumUserSliceSum,
  CASE WHEN userName IS NULL OR contentType IS NULL THEN -1
    ELSE coalesce(arg_max(revisionId, struct_pack(v := value, r := -revisionId)) FILTER (WHERE value IS NOT NULL)
                  OVER {_W_USER_SLICE}, -1) END AS topRevision,
  CASE WHEN userName IS NULL OR contentType IS NULL THEN 0
    ELSE coalesce(bit_count(bit_or(1::BIGINT << (itemId % 61)::INT) OVER {_W_USER_SLICE}), 0) END AS itemBits
FROM revlog"""))
def q_cum_agg(spark, sf):
    # running functions given as expressions, over a two-column key: a sum, the revision of the
    # largest value so far (the first of several), and a bitmap sketch of the items
    keys = ["userName", "contentType"]
    total = C.Scan(F.sum, F.sum, lambda a, b: a + b)
    top = C.Scan(F.max, F.max, F.greatest, lambda s: -s["r"])
    bits = C.Scan(lambda v: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), v)), F.bit_or,
                  lambda a, b: a.bitwiseOR(b), F.bit_count)
    d = _log(spark, sf).withColumns({
        "__top": F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("v"), (-F.col("revisionId")).alias("r"))),
        "__bit": (F.col("itemId") % 61).cast("int")})
    d = C.run_batch(d, [C.op_cum_agg(keys, "value", "cumUserSliceSum", total),
                        C.op_cum_agg(keys, "__top", "topRevision", top, default=-1),
                        C.op_cum_agg(keys, "__bit", "itemBits", bits, default=0)], chunk_width=CHUNK)
    return d.select("revisionId", r6(F.col("cumUserSliceSum")).alias("cumUserSliceSum"),
                    F.col("topRevision").cast("long").alias("topRevision"),
                    F.col("itemBits").cast("int").alias("itemBits"))


def _minmax_sql(fn, name):
    return with_revlog(f"""
SELECT revisionId, round(CASE WHEN userName IS NULL OR value IS NULL THEN 0
                        ELSE {fn}(value) OVER ({W_USER}) END, 6) AS {name} FROM revlog""")


@query("cum_min", _minmax_sql("min", "cumUserMin"))
def q_cum_min(spark, sf):
    d = C.cum_min(_log(spark, sf), ["userName"], "value", "cumUserMin", chunk_width=CHUNK)
    return d.select("revisionId", r6(F.col("cumUserMin")).alias("cumUserMin"))


@query("cum_max", _minmax_sql("max", "cumUserMax"))
def q_cum_max(spark, sf):
    d = C.cum_max(_log(spark, sf), ["userName"], "value", "cumUserMax", chunk_width=CHUNK)
    return d.select("revisionId", r6(F.col("cumUserMax")).alias("cumUserMax"))


@query("cum_mean", with_revlog(f"""
SELECT revisionId, round(CASE WHEN userName IS NULL THEN 0 ELSE
   CAST(CAST(sum(coalesce(value, 0)) OVER ({W_USER}) / count(*) OVER ({W_USER}) AS FLOAT) AS DOUBLE) END, 6)
   AS cumUserMean FROM revlog"""))
def q_cum_mean(spark, sf):
    d = C.cum_mean(_log(spark, sf), ["userName"], "value", "cumUserMean", chunk_width=CHUNK)
    return d.select("revisionId", r6(F.col("cumUserMean")).alias("cumUserMean"))


@query("cum_unique", with_revlog("""
SELECT revisionId, CASE WHEN userName IS NULL THEN NULL ELSE CAST(count(DISTINCT itemId) OVER (
    PARTITION BY userName ORDER BY revisionId ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END
    AS cumUserUniqueItems FROM revlog"""))
def q_cum_unique(spark, sf):
    d = C.cum_unique(_log(spark, sf), ["userName"], "itemId", "cumUserUniqueItems", chunk_width=CHUNK)
    return d.select("revisionId", "cumUserUniqueItems")


@query("prev_value", with_revlog("""
SELECT revisionId, coalesce(CASE WHEN userName IS NULL THEN NULL ELSE
    last_value(CASE WHEN value IS NOT NULL THEN revisionAction END IGNORE NULLS) OVER (
    PARTITION BY userName ORDER BY revisionId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, 'NA')
    AS prevAction FROM revlog"""))
def q_prev_value(spark, sf):
    d = C.prev_value(_log(spark, sf), ["userName"], "action", "prevAction", chunk_width=CHUNK)
    return d.select("revisionId", "prevAction")


@query("time_since_previous", with_revlog("""
SELECT revisionId, round(CASE WHEN userName IS NULL THEN NULL ELSE
    (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (PARTITION BY userName ORDER BY revisionId)) / 1e6 END, 6)
    AS userTimeSinceLastRevision FROM revlog"""))
def q_time_since_previous(spark, sf):
    d = C.time_since_previous(_log(spark, sf), "userName", "timestamp", "userTimeSinceLastRevision",
                              chunk_width=CHUNK)
    return d.select("revisionId", r6(F.col("userTimeSinceLastRevision")).alias("userTimeSinceLastRevision"))


# ------------------------------------------------------------ sessions
SCORE_SQL = "coalesce(value, 0) / 101.0"


def score_col():
    """A given score column of the stand-in log (used where no model runs)."""
    return F.coalesce(F.col("value"), F.lit(0.0)) / 101.0


@query("join_session_size", with_revlog("""
SELECT revisionId, CAST(count(*) OVER (PARTITION BY groupId) AS BIGINT) AS sessionSize FROM revlog"""))
def q_join_session_size(spark, sf):
    d = SE.session_size(revision_log(spark, sf))
    return d.select("revisionId", F.col("sessionSize").cast("bigint"))


@query("join_session_score", with_revlog(f"""
SELECT revisionId, round(avg({SCORE_SQL}) OVER (PARTITION BY groupId), 6) AS sil_score FROM revlog"""))
def q_join_session_score(spark, sf):
    d = revision_log(spark, sf).withColumn("prob", score_col())
    return SE.single_instance(d, "prob").select("revisionId", r6(F.col("sil_score")).alias("sil_score"))


@query("single_instance", with_revlog(f"""
SELECT revisionId, round(avg({SCORE_SQL}) OVER (PARTITION BY groupId), 6) AS sil_score,
       avg({SCORE_SQL}) OVER (PARTITION BY groupId) > 0.5 AS sil_pred FROM revlog"""))
def q_single_instance(spark, sf):
    d = SE.single_instance(revision_log(spark, sf).withColumn("prob", score_col()), "prob")
    return d.select("revisionId", r6(F.col("sil_score")).alias("sil_score"),
                    (F.col("sil_score") > 0.5).alias("sil_pred"))


def _session_agg_sql():
    return with_revlog(f"""
SELECT groupId, round(avg(s), 6) AS s_mean, round(min(s), 6) AS s_min, round(max(s), 6) AS s_max,
       round(median(s), 6) AS s_median, round(arg_min(s, revisionId), 6) AS s_first,
       round(arg_max(s, revisionId), 6) AS s_last
FROM (SELECT groupId, revisionId, {SCORE_SQL} AS s FROM revlog) GROUP BY groupId""")


@query("session_agg", _session_agg_sql())
def q_session_agg(spark, sf):
    d = revision_log(spark, sf).withColumn("s", score_col())
    hows = ("mean", "min", "max", "median", "first", "last")
    found = SE.session_aggs(d, "s", {f"s_{h}": h for h in hows})
    return found.select("groupId", *[r6(F.col(f"s_{h}")).alias(f"s_{h}") for h in hows])


@query("session_minmax", with_revlog("""
SELECT groupId, round(max(value), 6) AS value_max, CAST(max(itemId) AS DOUBLE) AS itemId_max,
       round(min(value), 6) AS value_min, CAST(min(itemId) AS DOUBLE) AS itemId_min,
       CAST(max(CAST(label AS INTEGER)) AS DOUBLE) AS label
FROM revlog GROUP BY groupId"""))
def q_session_minmax(spark, sf):
    d = SE.session_minmax(revision_log(spark, sf), ["value", "itemId"], "label")
    return d.select("groupId", *[r6(F.col(c)).alias(c) for c in
                                 ("value_max", "itemId_max", "value_min", "itemId_min")],
                    F.col("label").cast("double"))


@query("combined_multi_instance", with_revlog(f"""
WITH s AS (SELECT revisionId, groupId, label, value, itemId, {SCORE_SQL} AS prob FROM revlog),
sil AS (SELECT revisionId, avg(prob) OVER (PARTITION BY groupId) AS a FROM s),
smi AS (SELECT groupId, (max(value) + min(itemId)) / 201.0 AS b FROM s GROUP BY groupId)
SELECT s.revisionId, round((sil.a + smi.b) / 2.0, 6) AS combined_score
FROM s JOIN sil USING (revisionId) LEFT JOIN smi USING (groupId)"""))
def q_combined_multi_instance(spark, sf):
    # sil: session mean of the given score; smi: a session-level score from
    # the session min/max table, spread back; combined: their mean.
    d = revision_log(spark, sf).withColumn("prob", score_col())
    sil = SE.single_instance(d, "prob", out="sil")
    mm = SE.session_minmax(d, ["value", "itemId"], None)
    smi_tab = mm.select("groupId", ((F.col("value_max") + F.col("itemId_min")) / 201.0).alias("smi"))
    both = SE.spread(sil, smi_tab)
    out = SE.combined(both, "sil", "smi")
    return out.select("revisionId", r6(F.col("combined_score")).alias("combined_score"))


@query("join_session_model", with_revlog("""
WITH smi AS (SELECT groupId, (max(value) + min(itemId)) / 201.0 AS b FROM revlog GROUP BY groupId)
SELECT r.revisionId, round(smi.b, 6) AS smi_score FROM revlog r LEFT JOIN smi USING (groupId)"""))
def q_join_session_model(spark, sf):
    d = revision_log(spark, sf)
    mm = SE.session_minmax(d, ["value", "itemId"], None)
    tab = mm.select("groupId", ((F.col("value_max") + F.col("itemId_min")) / 201.0).alias("smi_score"))
    return SE.spread(d, tab).select("revisionId", r6(F.col("smi_score")).alias("smi_score"))


@query("session_statistics", with_revlog("""
WITH sizes AS (SELECT groupId, count(*) AS size FROM revlog GROUP BY groupId),
dist AS (SELECT size, count(*) AS sessions, sum(size) AS revisions FROM sizes GROUP BY size)
SELECT CAST(size AS BIGINT) AS size, CAST(sessions AS BIGINT) AS sessions, CAST(revisions AS BIGINT) AS revisions,
       round(sum(CASE WHEN size > 1 THEN revisions ELSE 0 END) OVER () / sum(revisions) OVER (), 6)
       AS fraction_not_alone FROM dist"""))
def q_session_statistics(spark, sf):
    d = SE.session_statistics(revision_log(spark, sf))
    return d.select(F.col("size").cast("bigint"), F.col("sessions").cast("bigint"),
                    F.col("revisions").cast("bigint"), r6(F.col("fraction_not_alone")).alias("fraction_not_alone"))
