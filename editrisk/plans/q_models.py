"""Queries for the feature pipeline, models and the runs over models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curves as CV
from ..sources.tables import VALIDATION_START, revision_log, ts_lit, with_revlog
from . import catalog as CAT
from .pipeline import feature_pipeline
from .registry import query, r6

FIT_SQL = "\"timestamp\" < TIMESTAMP '2024-01-19 00:00:00'"


def fit_pred():
    return F.col("timestamp") < ts_lit(VALIDATION_START)


def feature_table(spark, sf, chunk_width=None):
    """The main system's batched feature table over the whole stand-in log."""
    log = revision_log(spark, sf)
    # the stand-in log parses JSON per row: cache its pruned projection once
    return feature_pipeline(log, CAT.standin_main(chunk_width), fit_pred(), cache_input=True)


def _freq_sql(name, keys):
    k = ", ".join(keys)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    on = " AND ".join(f"r.{c} = {name}.{c}" for c in keys)
    cte = f"{name} AS (SELECT {k}, count(*) AS n FROM revlog WHERE {FIT_SQL} AND {nn} GROUP BY {k})"
    return cte, f"LEFT JOIN {name} ON {on}", f"coalesce({name}.n, 0)"


_FREQS = [("actionFreq", ["revisionAction"]), ("sliceActionFreq", ["contentType", "revisionAction"]),
          ("itemActionFreq", ["itemId", "revisionAction"]), ("userFreq", ["userName"]),
          ("logItemFreq", ["itemId"]), ("revisionTagFreq", ["revisionTag"])]


def _feature_sql():
    ctes, joins, vals = [], [], {}
    for name, keys in _FREQS:
        c, j, v = _freq_sql("f_" + name, keys)
        ctes.append(c)
        joins.append(j)
        vals[name] = v
    w_user = "PARTITION BY userName ORDER BY revisionId ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    w_item = "PARTITION BY itemId ORDER BY revisionId ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    log = "coalesce(sign({x}) * ceil(log2(abs({x}) + 1)), 0)"
    f32 = "round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 6)"
    body = f"""
WITH {", ".join(ctes)},
med AS (SELECT median(value) AS m FROM revlog WHERE {FIT_SQL}),
um AS (SELECT userName, avg(value) AS a FROM revlog WHERE {FIT_SQL} GROUP BY userName),
win AS (SELECT revisionId,
          CASE WHEN userName IS NULL THEN NULL ELSE count(DISTINCT itemId) OVER ({w_user}) END AS cu,
          CASE WHEN itemId IS NULL THEN NULL ELSE count(DISTINCT userName) OVER ({w_item}) END AS ci,
          CASE WHEN userName IS NULL THEN NULL ELSE
            (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (PARTITION BY userName ORDER BY revisionId)) / 1e6 END AS ts_gap
        FROM revlog),
gapmed AS (SELECT median(w.ts_gap) AS m FROM win w JOIN revlog r USING (revisionId) WHERE r.{FIT_SQL})
SELECT r.revisionId, r.groupId, r.contentType,
  {f32.format(x="coalesce(r.value, (SELECT m FROM med))")} AS valueMedian,
  {f32.format(x="coalesce(r.value, -1)")} AS valueMinusOne,
  {f32.format(x=vals["actionFreq"])} AS actionFreq,
  {f32.format(x=vals["sliceActionFreq"])} AS sliceActionFreq,
  {f32.format(x=vals["itemActionFreq"])} AS itemActionFreq,
  {f32.format(x="coalesce(CAST(CAST(r.isRegisteredUser AS INTEGER) AS FLOAT), 0.5)")} AS isRegisteredUser,
  {f32.format(x=vals["userFreq"])} AS userFreq,
  {f32.format(x="coalesce(win.cu, 0)")} AS cumUserUniqueItems,
  {f32.format(x="coalesce(um.a, 0)")} AS userMeanValue,
  {f32.format(x="coalesce(win.ts_gap, (SELECT m FROM gapmed))")} AS userTimeSinceLastRevision,
  {f32.format(x=log.format(x="CAST(win.ci AS DOUBLE)"))} AS logCumItemUniqueUsers,
  {f32.format(x=log.format(x="CAST(" + vals["logItemFreq"] + " AS DOUBLE)"))} AS logItemFreq,
  {f32.format(x='hour(r."timestamp")')} AS revisionHourOfDay,
  {f32.format(x='isodow(r."timestamp") - 1')} AS revisionDayOfWeek,
  {f32.format(x=vals["revisionTagFreq"])} AS revisionTagFreq,
  CAST(r.label AS DOUBLE) AS label
FROM revlog r {" ".join(joins)}
  LEFT JOIN um ON r.userName IS NOT DISTINCT FROM um.userName
  JOIN win ON r.revisionId = win.revisionId"""
    return with_revlog(body)


FEATURES = [f.output for f in CAT.standin_main()]


@query("feature_pipeline", _feature_sql())
def q_feature_pipeline(spark, sf):
    t = feature_table(spark, sf, chunk_width=1024)
    return t.select("revisionId", "groupId", "contentType",
                    *[r6(F.col(c)).alias(c) for c in FEATURES], "label")


# ---------------------------------------------------------------- models
# No SQL gives a forest's scores.  These queries run the models and return what is fixed
# whatever the trees look like - the rows scored, positives and negatives per model and slice,
# grid points, folds, windows - and whether all scores or areas lie in their range.
from ..operators import models as M  # noqa: E402
from ..operators.splits import undersample  # noqa: E402
from ..sources.tables import TEST_START, TRAIN_START  # noqa: E402
from .registry import HASH_ORDER_SQL  # noqa: E402
from . import runs as RU  # noqa: E402

FAMILY = ["Bagging", "SIL MI", "Simple MI", "Combined MI"]
CLASSIFIERS = ["Default random forest", "Optimized random forest", *FAMILY]


def _main_split(spark, sf):
    features = CAT.standin_main()
    table = RU.build_table(revision_log(spark, sf), features, VALIDATION_START, TEST_START)
    return features, *RU.split(table, TRAIN_START, VALIDATION_START, TEST_START)


def _within(*columns, lo=0.0, hi=1.0):
    """Whether all these values lie between the bounds (missing: no), but for the rounding of sums."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c).between(lo - 1e-9, hi + 1e-9), F.lit(False))
    return out


def _counted(metrics, *keys):
    """Metric rows as keys, slice, class sizes and the check of the three areas."""
    return metrics.select(*keys, "slice", "positives", "negatives",
                          _within("ROC", "PR", "PR_trapezoid").alias("in_range"))


def _validation_sql(start=VALIDATION_START, end=TEST_START):
    return f"""val AS (SELECT * FROM revlog WHERE "timestamp" >= TIMESTAMP '{start}' AND "timestamp" < TIMESTAMP '{end}')"""


def _slices_sql(rows="val", name="cnt", key=""):
    """Class sizes per slice of ``rows`` (and per ``key``)."""
    return f"""{name} AS (
  SELECT {key} s.slice, count(*) FILTER (WHERE label) AS positives, count(*) FILTER (WHERE NOT label) AS negatives
  FROM {rows} JOIN (VALUES ('ALL'), ('ITEM_HEAD'), ('ITEM_BODY')) s(slice)
    ON s.slice = 'ALL' OR (s.slice = 'ITEM_HEAD') = (contentType = 'TEXT')
  GROUP BY ALL)"""


def _values(*rows):
    def text(r):
        return "(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")"
    return "VALUES " + ", ".join(text(r) for r in rows)


_SCORED_SQL = with_revlog(f"""
WITH {_validation_sql()} SELECT revisionId, CAST(label AS DOUBLE) AS label, TRUE AS in_range FROM val""")


def _scored_rows(spark, sf, spec):
    _, train, valid = _main_split(spark, sf)
    scored, _, _, _ = M.fit_predict(train, valid, spec)
    return scored.select("revisionId", "label", _within("prob").alias("in_range"))


@query("forest_default", _SCORED_SQL)
def q_forest_default(spark, sf):
    return _scored_rows(spark, sf, M.DEFAULT_FOREST)


@query("forest_tuned", _SCORED_SQL)
def q_forest_tuned(spark, sf):
    return _scored_rows(spark, sf, M.TUNED["MAIN"]["FOREST"])


@query("bagging", _SCORED_SQL)
def q_bagging(spark, sf):
    return _scored_rows(spark, sf, M.TUNED["MAIN"]["BAGGING"])


@query("fit_predict_evaluate", with_revlog(f"""
WITH {_validation_sql()}, {_slices_sql()}
SELECT 'Default random forest' AS model, *, TRUE AS in_range, TRUE AS timed FROM cnt"""))
def q_fit_predict_evaluate(spark, sf):
    _, train, valid = _main_split(spark, sf)
    scored, _, times = RU.forest_run(train, valid, M.DEFAULT_FOREST, "Default random forest")
    timed = times["FIT_TIME"] > 0 and times["TOTAL_TIME"] == times["FIT_TIME"] + times["PROB_TIME"]
    m = M.evaluate(scored, ["model"], curves=True)
    return _counted(m, "model").withColumn("timed", F.lit(timed))


@query("simple_multi_instance", with_revlog(f"""
WITH {_validation_sql()} SELECT revisionId, groupId, TRUE AS in_range, TRUE AS one_per_session FROM val"""))
def q_simple_multi_instance(spark, sf):
    features, train, valid = _main_split(spark, sf)
    d = RU.simple_multi_instance(train, valid, M.TUNED["MAIN"]["BAGGING"], CAT.feature_names(features))
    spread = d.groupBy("groupId").agg((F.min("smi") == F.max("smi")).alias("one_per_session"))
    return d.join(spread, "groupId").select("revisionId", "groupId", _within("smi").alias("in_range"),
                                            "one_per_session")


@query("session_family", with_revlog(f"""
WITH {_validation_sql()}, {_slices_sql()}
SELECT m.model, cnt.*, TRUE AS in_range FROM cnt CROSS JOIN ({_values(*[(x,) for x in FAMILY])}) m(model)"""))
def q_session_family(spark, sf):
    features, train, valid = _main_split(spark, sf)
    scored = RU.session_family(train, valid, M.TUNED["MAIN"]["BAGGING"], CAT.feature_names(features))
    return _counted(M.evaluate(scored, ["model"], curves=False), "model")


@query("group_classifiers", with_revlog(f"""
WITH {_validation_sql()}, {_slices_sql()}
SELECT c.classifier, g."group", cnt.*, TRUE AS in_range
FROM cnt CROSS JOIN ({_values(*[(x,) for x in ("DFOREST", "OFOREST", "BAGGING", "SIL MI", "SIMPLE MI", "COMBINED MI")])}) c(classifier)
  CROSS JOIN (VALUES ('ALL'), ('content'), ('contextual')) g("group")"""))
def q_group_classifiers(spark, sf):
    features, train, valid = _main_split(spark, sf)
    return _counted(RU.group_classifiers(train, valid, features, "MAIN"), "classifier", "group")


# Every feature, subgroup and group of the main system on the stand-in log.
_UNITS = [("content", "character", "valueMedian"), ("content", "character", "valueMinusOne"),
          ("content", "statement", "actionFreq"), ("content", "statement", "sliceActionFreq"),
          ("content", "statement", "itemActionFreq"), ("contextual", "user", "isRegisteredUser"),
          ("contextual", "user", "userFreq"), ("contextual", "user", "cumUserUniqueItems"),
          ("contextual", "user", "userMeanValue"), ("contextual", "user", "userTimeSinceLastRevision"),
          ("contextual", "item", "logCumItemUniqueUsers"), ("contextual", "item", "logItemFreq"),
          ("contextual", "revision", "revisionHourOfDay"), ("contextual", "revision", "revisionDayOfWeek"),
          ("contextual", "revision", "revisionTagFreq"),
          ("content", "character", "ALL"), ("content", "statement", "ALL"), ("contextual", "user", "ALL"),
          ("contextual", "item", "ALL"), ("contextual", "revision", "ALL"),
          ("content", "ALL", "ALL"), ("contextual", "ALL", "ALL")]
_SLICE_NAMES = ("ALL", "ITEM_HEAD", "ITEM_BODY")


@query("feature_ranking", with_revlog(f"""
WITH {_validation_sql()}, {_slices_sql()}
SELECT u.*, {", ".join(f"(SELECT {c} FROM cnt WHERE slice = '{x}') AS {x}_{c}" for x in _SLICE_NAMES for c in ("positives", "negatives"))},
       TRUE AS in_range
FROM ({_values(*_UNITS)}) u("group", subgroup, feature)"""))
def q_feature_ranking(spark, sf):
    features, train, valid = _main_split(spark, sf)
    r = RU.feature_ranking(train, valid, features)
    areas = [f"{x}_{c}" for x in (*_SLICE_NAMES, "TRAINING") for c in ("ROC", "PR")]
    return r.select("group", "subgroup", "feature",
                    *[f"{x}_{c}" for x in _SLICE_NAMES for c in ("positives", "negatives")],
                    _within(*areas).alias("in_range"))


# The orderings, on a metric table that SQL can make: the share of positives of every item,
# item decile (subgroup) and content type (group) stands for the PR area.
_GIVEN_SQL = """
given AS (SELECT contentType AS "group",
    CASE WHEN grouping(itemId // 10) = 1 THEN 'ALL' ELSE 'k' || (itemId // 10) END AS subgroup,
    CASE WHEN grouping(itemId) = 1 THEN 'ALL' ELSE 'item' || itemId END AS feature,
    avg(CAST(label AS INTEGER)) AS ALL_PR
  FROM revlog GROUP BY GROUPING SETS ((contentType), (contentType, itemId // 10), (contentType, itemId // 10, itemId)))"""
_GIVEN_UNITS = [("TEXT", "k0"), ("TEXT", "k1"), ("TEXT", "k2"), ("TEXT", "k3"), ("STATEMENT", "k3"), ("STATEMENT", "k4"),
                ("STATEMENT", "k5"), ("STATEMENT", "k6"), ("SITELINK", "k6"), ("SITELINK", "k7"), ("SITELINK", "k8"),
                ("SITELINK", "k9")]


def _given_ranking(spark, sf):
    log = revision_log(spark, sf).select(
        F.col("contentType").alias("group"), F.concat(F.lit("k"), F.expr("itemId div 10")).alias("subgroup"),
        F.concat(F.lit("item"), "itemId").alias("feature"), F.col("label").cast("int").alias("y"))
    items = log.groupBy("group", "subgroup", "feature").agg(F.sum("y").alias("p"), F.count("y").alias("n"))
    every = F.lit("ALL")
    units = items.unionByName(items.withColumn("feature", every)).unionByName(
        items.withColumns({"feature": every, "subgroup": every}))
    return units.groupBy("group", "subgroup", "feature").agg((F.sum("p") / F.sum("n")).alias("ALL_PR"))


def _placed(ordered):
    """An ordered (small) report with each row's place in it."""
    w = Window.orderBy("__at")
    return (ordered.withColumn("__at", F.monotonically_increasing_id())
            .withColumn("position", F.row_number().over(w)).drop("__at"))


@query("rank_by_pr", with_revlog(f"""
WITH {_GIVEN_SQL}
SELECT "group", subgroup, feature, round(ALL_PR, 6) AS ALL_PR,
       CAST(row_number() OVER (ORDER BY ALL_PR DESC, "group", subgroup, feature) AS INTEGER) AS position FROM given"""))
def q_rank_by_pr(spark, sf):
    r = _placed(RU.rank_by_pr(_given_ranking(spark, sf)))
    return r.withColumn("ALL_PR", r6(F.col("ALL_PR")))


@query("rank_by_group", with_revlog(f"""
WITH {_GIVEN_SQL},
o AS (SELECT *, list_position(['TEXT', 'STATEMENT', 'SITELINK'], "group") AS g,
             CASE WHEN subgroup = 'ALL' THEN -1 ELSE CAST(subgroup[2:] AS INTEGER) END AS sg FROM given)
SELECT "group", subgroup, feature, round(ALL_PR, 6) AS ALL_PR,
       CASE WHEN feature <> 'ALL' THEN feature WHEN subgroup <> 'ALL' THEN subgroup ELSE "group" END AS label,
       CAST(row_number() OVER (ORDER BY g, sg, CASE WHEN feature = 'ALL' THEN 1.0 ELSE ALL_PR END DESC, feature)
            AS INTEGER) AS position FROM o"""))
def q_rank_by_group(spark, sf):
    features = [CAT.Feature("itemId", [], f"{g}-{sg}", g, sg) for g, sg in _GIVEN_UNITS]
    r = RU.rank_by_group(_given_ranking(spark, sf), features)
    return r.withColumn("ALL_PR", r6(F.col("ALL_PR")))


@query("feature_importances", f"""
SELECT feature, TRUE AS in_range, TRUE AS sums_to_one, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '{VALIDATION_START}') AS fitted_rows
FROM ({_values(*[(u[2],) for u in _UNITS if u[2] != "ALL"])}) u(feature)""")
def q_feature_importances(spark, sf):
    features, train, _ = _main_split(spark, sf)
    model = M.fit_forest(train, M.DEFAULT_FOREST)
    t = M.importance_table(spark, model, CAT.feature_names(features))
    total = F.sum("importance").over(Window.partitionBy(F.lit(1)))  # one row per feature
    return t.select("feature", _within("importance").alias("in_range"),
                    (F.abs(total - 1) < 1e-9).alias("sums_to_one"), F.lit(train.count()).alias("fitted_rows"))


# The forest grid, in the order of its points.
_GRID_SQL = """
grid AS (SELECT CAST(f.i * 8 + d.i AS INTEGER) AS point, f.x AS features, d.x AS depth
  FROM (VALUES (0, '1'), (1, '2'), (2, 'log2'), (3, 'sqrt')) f(i, x)
  CROSS JOIN (VALUES (0, 1), (1, 2), (2, 4), (3, 8), (4, 16), (5, 32), (6, 64), (7, NULL)) d(i, x))"""


# All 174 points; a single forest's sample is a prefix of the md5 order of its seed.
_POINTS_SQL = f"""{_GRID_SQL},
train AS (SELECT * FROM revlog WHERE "timestamp" >= TIMESTAMP '{TRAIN_START}' AND "timestamp" < TIMESTAMP '{VALIDATION_START}'),
points AS (
  SELECT 'FOREST' AS grid, point, 10 AS trees, depth, features, 1 AS bags, 1.0::DOUBLE AS sample, 1 AS seed FROM grid
  UNION ALL SELECT 'BAGGING', point, 8, depth, features, 16, 0.0625::DOUBLE, 1 FROM grid
  UNION ALL SELECT 'SAMPLING', CAST(i * 10 + k AS INTEGER), 10, NULL, 'sqrt', 1, pow(0.5::DOUBLE, i), CAST(1000 + k AS INTEGER)
    FROM range(11) x(i) CROSS JOIN range(10) y(k)),
drawn AS (SELECT s.seed, s.sample, count(*) AS n, count(*) FILTER (WHERE label) AS p
  FROM train JOIN (SELECT DISTINCT seed, sample FROM points WHERE grid = 'SAMPLING' AND sample < 1) s
    ON CAST('0x' || substr(md5(s.seed || '|' || revisionId), 1, 8) AS BIGINT) < s.sample * 4294967296
  GROUP BY ALL),
whole AS (SELECT count(*) AS n, count(*) FILTER (WHERE label) AS p FROM train),
seen AS (SELECT points.*,
    CASE WHEN bags > 1 OR points.sample = 1 THEN whole.n ELSE coalesce(drawn.n, 0) END AS train_rows,
    CASE WHEN bags > 1 OR points.sample = 1 THEN whole.p ELSE coalesce(drawn.p, 0) END AS train_positives
  FROM points CROSS JOIN whole LEFT JOIN drawn ON points.seed = drawn.seed AND points.sample = drawn.sample)"""


@query("grid_search", with_revlog(f"""
WITH {_validation_sql()}, {_slices_sql()}, {_POINTS_SQL}
SELECT grid, CAST(point AS VARCHAR) AS model, trees, depth, features, bags, sample, seed, train_rows, train_positives,
       cnt.*, TRUE AS in_range
FROM seen JOIN cnt ON slice = 'ALL'"""))
def q_grid_search(spark, sf):
    features, train, valid = _main_split(spark, sf)
    table, _ = RU.optimize(train, valid, len(features))
    return _counted(table, "grid", "model", "trees", "depth", "features", "bags", "sample", "seed",
                    "train_rows", "train_positives")


@query("best_params", with_revlog(f"""
WITH {_GRID_SQL},
share AS (SELECT itemId % 32 AS point, avg(CAST(label AS INTEGER)) AS PR FROM revlog GROUP BY 1)
SELECT 10 AS trees, depth, features, 1 AS bags, 1.0::DOUBLE AS sample, 1 AS seed, round(PR, 6) AS PR
FROM grid JOIN share USING (point) ORDER BY share.PR DESC, point LIMIT 1"""))
def q_best_params(spark, sf):
    # a grid whose PR areas SQL can make: the share of positives of the items dealt to each point
    share = revision_log(spark, sf).groupBy((F.col("itemId") % 32).cast("string").alias("model")).agg(
        F.avg(F.col("label").cast("int")).alias("PR"))
    points = spark.createDataFrame(
        [(str(i), s.trees, s.depth, s.features, s.bags, s.sample, s.seed) for i, s in enumerate(RU.forest_grid())],
        "model string, trees int, depth int, features string, bags int, sample double, seed int")
    return RU.best_params(points.join(share, "model")).withColumn("PR", r6(F.col("PR")))


@query("cross_validation", with_revlog(f"""
WITH {_validation_sql(TRAIN_START)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH_ORDER_SQL}, revisionId) AS rk,
                  count(*) FILTER (WHERE label) OVER () AS positives FROM val)
SELECT revisionId, CAST(label AS DOUBLE) AS label, CAST((rk - 1) % 5 AS INTEGER) AS fold, 5::BIGINT AS folds,
       TRUE AS in_range
FROM ranked WHERE label OR rk <= positives"""))
def q_cross_validation(spark, sf):
    _, train, valid = _main_split(spark, sf)
    cv = RU.cross_validation(train, valid, scorers={"brier": RU.brier_score}).withColumn("in_range", _within(
        "roc_mean", "roc_std", "pr_mean", "pr_std", "brier_mean", "brier_std")).first()  # one row
    folds = RU.stratified_folds(undersample(train.unionByName(valid), 1.0))
    return folds.select("revisionId", "label", "fold", F.lit(cv["folds"]).alias("folds"),
                        F.lit(cv["in_range"]).alias("in_range"))


_WINDOWS = [("2024-01-15", "2024-01-22"), ("2024-01-22", "2024-01-29")]
_RUNS = [("MAIN", m) for m in FAMILY] + [("FILTER", "Default random forest"), ("BASELINE", "Default random forest")]


@query("expanding_backtest", with_revlog(f"""
WITH win(v, t) AS ({_values(*_WINDOWS)}),
val AS (SELECT v || ' to ' || t AS time_label, revlog.* FROM revlog JOIN win
        ON "timestamp" >= CAST(v AS TIMESTAMP) AND "timestamp" < CAST(t AS TIMESTAMP)),
{_slices_sql(key="time_label,")},
frac AS (SELECT time_label, avg(CAST(label AS INTEGER)) AS f FROM val GROUP BY 1)
SELECT cnt.*, r.system, r.model, round(frac.f, 6) AS VANDALISM_FRACTION, TRUE AS in_range
FROM cnt JOIN frac USING (time_label) CROSS JOIN ({_values(*_RUNS)}) r(system, model)"""))
def q_expanding_backtest(spark, sf):
    # weekly windows over the stand-in month (window length is a parameter)
    m = RU.expanding_backtest(revision_log(spark, sf), TRAIN_START, "2024-01-15 00:00:00",
                              "2024-01-29 00:00:00", 7)
    return _counted(m, "time_label", "system", "model", r6(F.col("VANDALISM_FRACTION")).alias("VANDALISM_FRACTION"))


@query("run_system", with_revlog(f"""
WITH {_validation_sql()}, {_slices_sql()}
SELECT 'VALIDATION' AS time_label, s.system, m.model, cnt.*, TRUE AS in_range
FROM cnt CROSS JOIN (VALUES ('MAIN'), ('FILTER'), ('BASELINE')) s(system)
  CROSS JOIN ({_values(*[(x,) for x in CLASSIFIERS])}) m(model)"""))
def q_run_system(spark, sf):
    log = revision_log(spark, sf)
    runs = [RU.run_system(log, s, "VALIDATION", TRAIN_START, VALIDATION_START, TEST_START) for s in CAT.SYSTEMS]
    return _counted(RU._union(runs), "time_label", "system", "model")


@query("report_order", with_revlog(f"""
WITH {_slices_sql("revlog")}
SELECT s.system, m.model, cnt.slice, cnt.positives,
       CAST(row_number() OVER (ORDER BY s.i, m.i DESC, cnt.slice) AS INTEGER) AS position
FROM cnt CROSS JOIN (VALUES (0, 'MAIN'), (1, 'FILTER'), (2, 'BASELINE')) s(i, system)
  CROSS JOIN ({_values(*enumerate(CLASSIFIERS))}) m(i, model)"""))
def q_report_order(spark, sf):
    # a given metric table: a row per system, classifier and slice, with the log's class sizes
    log = revision_log(spark, sf)
    names = [F.array(*map(F.lit, x)) for x in (CAT.SYSTEMS, CLASSIFIERS)]
    m = (CV.tag_slices(log).groupBy("slice").agg(F.sum(F.col("label").cast("long")).alias("positives"))
         .withColumn("system", F.explode(names[0])).withColumn("model", F.explode(names[1])))
    ordered = RU.report_order(m, list(CAT.SYSTEMS), CLASSIFIERS)
    return _placed(ordered.select("system", "model", "slice", "positives"))
