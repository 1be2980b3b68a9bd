"""The feature pipeline's shuffles and step rule, vector features, numbering, scorers."""

import re

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from editrisk import session as S
from editrisk.operators import categories as G
from editrisk.operators import cumulative as C
from editrisk.operators import feature_steps as FS
from editrisk.operators import models as M
from editrisk.operators import sessions as SE
from editrisk.operators import steps as ST
from editrisk.plans import runs as RU
from editrisk.plans.catalog import Feature, output_columns
from editrisk.plans.pipeline import feature_pipeline

ROWS = [(i, i // 4, "TEXT" if i % 3 else "STATEMENT", None, f"u{i % 7}" if i % 5 else None, f"i{i % 11}",
         f"c{i % 6:03d}", float(i % 13), i % 4 == 1) for i in range(400)]
COLUMNS = ("revisionId long, groupId long, contentType string, timestamp timestamp, userName string, itemId string, "
           "kind string, value double, label boolean")


@pytest.fixture(scope="module")
def log_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rules") / "log")
    spark.createDataFrame(ROWS, COLUMNS).repartition(4).write.parquet(path)
    return path


@pytest.fixture
def no_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_MAX_ROWS", 0)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


FEATURES = [Feature("userName", [ST.frequency()], "userFreq"),
            Feature("itemId", [ST.frequency()], "itemFreq"),
            Feature(["userName", "itemId"], [ST.frequency()], "pairFreq"),
            Feature(["userName", "value"], [ST.group_mean(null_safe=True)], "userMean"),
            Feature(["itemId", "value"], [ST.group_sum()], "itemSum"),
            Feature(["itemId", "userName"], [ST.cum_unique(64)], "itemUsers"),
            Feature("kind", [FS.long_tail(2)], "kindTail")]


def _table(spark, path):
    return feature_pipeline(spark.read.parquet(path), FEATURES, F.col("revisionId") < 300)


def test_large_lookups_give_the_same_features(spark, log_path, monkeypatch):
    small = sorted(_table(spark, log_path).collect())
    monkeypatch.setattr(S, "BROADCAST_MAX_ROWS", 0)
    assert sorted(_table(spark, log_path).collect()) == small
    seen = [r for r in ROWS if r[0] < 300]
    users = {r[4]: sum(x[4] == r[4] for x in seen) for r in ROWS}
    mean = {r[4]: sum(x[7] for x in seen if x[4] == r[4]) / users[r[4]] for r in ROWS}
    pairs = lambda r: sum((x[4], x[5]) == (r[4], r[5]) for x in seen) if r[4] else 0
    for got, r in zip(small, ROWS):
        assert got.userFreq == (users[r[4]] if r[4] else 0) and got.pairFreq == pairs(r)
        assert abs(got.userMean - mean[r[4]]) < 1e-5
        assert got.itemSum == sum(x[7] for x in seen if x[5] == r[5])


def test_wide_rows_are_shuffled_once(spark, log_path, no_broadcasts):
    plan = _table(spark, log_path)._jdf.queryExecution().explainString(  # noqa: SLF001
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "BroadcastHashJoin" not in plan.split("(1)")[0] and plan.count("SortMergeJoin") >= len(FEATURES) - 1
    inputs = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    wide = [x for x in inputs if "groupId#" in x and "contentType#" in x]
    assert inputs and len(wide) == 1


@pytest.mark.parametrize("broken", [lambda df: df.where("revisionId % 50 <> 7"),
                                    lambda df: df.unionByName(df.where("revisionId = 3"))])
def test_a_step_that_loses_or_repeats_rows_fails_by_name(spark, log_path, broken):
    step = ST.CustomStep(lambda df, inputs, out, fit: broken(df.withColumn(out, F.col(inputs[0]) + 1)), "shaky")
    t = feature_pipeline(spark.read.parquet(log_path), [Feature("value", [step], "v")], None)
    with pytest.raises(Exception, match="step shaky of feature v must return every row once"):
        t.select("revisionId").collect()


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_one_hot_vector_takes_any_number_of_classes(spark, n):
    df = spark.range(2 * n + 3).select("id", F.when(F.col("id") < 2 * n, F.format_string("c%05d", F.col("id") % F.lit(max(n, 1))))
                                       .alias("kind")).repartition(5)
    got = G.one_hot_vector(df, "kind", "v").select("id", vector_to_array("v").alias("v")).select(
        "id", F.size("v").alias("n"), F.array_position("v", F.lit(1.0)).alias("at"),
        F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("sum")).collect()
    assert len(got) == 2 * n + 3
    for r in got:
        assert r.n == n and (r["at"], r["sum"]) == ((r.id % n + 1, 1.0) if r.id < 2 * n else (0, 0.0))
    if n == 5000:
        # classes that the fit rows lack
        few = G.one_hot_vector(df, "kind", "v", F.col("id") < 3).select(vector_to_array("v").alias("v"), "id")
        assert {tuple(r.v) for r in few.where("id >= 3 and id < 5000").collect()} == {(0.0, 0.0, 0.0)}


def test_vector_features_reach_the_models(spark, log_path):
    features = [Feature("value", [ST.impute_zero()], "v"), Feature("kind", [FS.one_hot_vector()], "kindIs"),
                Feature("itemId", [ST.frequency()], "itemFreq")]
    t = feature_pipeline(spark.read.parquet(log_path), features, None)
    names = output_columns(features, t.columns)
    assert names == ["v", "kindIs", "itemFreq"]
    table = S.cut_lineage(M.assemble(t, names))
    one = table.where("revisionId = 8").first()
    assert list(one.features.toArray()) == [8.0, 0, 0, 1, 0, 0, 0, one.itemFreq]
    kept = M.slice_features(table, names, ["kindIs", "itemFreq"]).where("revisionId = 8").first()
    assert list(kept.features_sub.toArray()) == [0, 0, 1, 0, 0, 0, one.itemFreq]
    sessions = {r.groupId: r for r in SE.session_minmax(table, names).collect()}
    assert list(sessions[0].kindIs_max.toArray()) == [1, 1, 1, 1, 0, 0] and sessions[0].v_min == 0.0
    assert list(sessions[0].kindIs_min.toArray()) == [0] * 6
    train, valid = table.where("revisionId < 300"), table.where("revisionId >= 300")
    out = RU.session_family(train, valid, M.ForestSpec(2, 3, "sqrt", 2, 0.5), names)
    assert out.groupBy("model").count().where("count = 100").count() == 4


def test_number_in_order(spark):
    df = spark.createDataFrame([(i * 37 % 211, f"x{i}") for i in range(211)], "k long, x string").repartition(9)
    assert [r.position for r in C.number_in_order(df, "k").orderBy("k").collect()] == list(range(1, 212))
    assert C.number_in_order(df.limit(0), "k").count() == 0


def test_group_ids_must_exist(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "revisionId long, userId long")
    assert [r.groupId for r in SE.set_group_ids(df, F.coalesce("userId", F.lit(-1)) * 2).orderBy("revisionId").collect()] == [10, -2]
    with pytest.raises(Exception, match="no groupId"):
        SE.set_group_ids(df, F.col("userId")).collect()


def test_cross_validation_with_own_scorers(spark):
    rows = [(i, Vectors.dense([float(i % 2), float(i % 7)]), float(i % 2), "TEXT", i) for i in range(120)]
    df = spark.createDataFrame(rows, ["revisionId", "features", "label", "contentType", "groupId"])
    hits = lambda scored: scored.groupBy("model").agg(
        F.avg(((F.col("prob") > 0.5) == (F.col("label") > 0.5)).cast("int")).alias("value"))
    r = RU.cross_validation(df.where("revisionId < 80"), df.where("revisionId >= 80"), 3,
                            {"brier": RU.brier_score, "hits": hits}).first()
    assert (r.folds, r.hits_mean, r.hits_std) == (3, 1.0, 0.0) and r.brier_mean < 0.05
    folds = RU.stratified_folds(df, 3).groupBy("fold", "label").count().collect()
    assert {x["count"] for x in folds} == {20} and len(folds) == 6


def test_expanding_features_equal_rebuilding(spark, log_path, monkeypatch):
    from editrisk.plans.expanding import WINDOW, expandable, expanding_features
    features = [*FEATURES[:6],
                Feature(["userName", "kind"], [ST.group_nunique()], "userKinds"),
                Feature(["itemId", "userName"], [ST.cum_unique(32), ST.impute_median()], "itemRunning"),
                Feature("value", [ST.impute_mean(), ST.log_scale()], "logValue"),
                Feature("itemId", [ST.frequency(), ST.impute_median(), ST.log_scale()], "logItemFreq"),
                Feature(["kind", "label"], [FS.impact_code(0.5)], "impact")]
    log = spark.read.parquet(log_path)
    bounds = [(100, 150), (300, 320)]
    want = {w: {r.revisionId: r.asDict() for r in feature_pipeline(
        log.where(F.col("revisionId") < end), features, F.col("revisionId") < begin).collect()}
        for w, (begin, end) in enumerate(bounds)}
    at = [(F.lit(a), F.lit(b)) for a, b in bounds]
    for rows in (2_000_000, 0):
        monkeypatch.setattr(S, "BROADCAST_MAX_ROWS", rows)
        got = expanding_features(log, features, at, on="revisionId").collect()
        assert [sum(r[WINDOW] == w for r in got) for w in want] == [150, 320]
        for r in got:
            mine, other = r.asDict(), want[r[WINDOW]][r.revisionId]
            assert mine.keys() - {WINDOW} == other.keys()
            assert all(mine[c] == other[c] or abs(mine[c] - other[c]) < 1e-5 for c in other), (mine, other)
    assert not expandable([Feature("kind", [FS.one_hot()], "k")])


def test_backtest_reads_its_windows_from_one_table(spark, log_path):
    log = spark.read.parquet(log_path).withColumn("timestamp", F.timestamp_seconds(F.col("revisionId") * 3600 + 1_704_067_200))
    spans = [("2024-01-08 00:00:00", "2024-01-10 00:00:00"), ("2024-01-10 00:00:00", "2024-01-12 00:00:00")]
    sets = {"FILTER": lambda: FEATURES[:2], "BASELINE": lambda: FEATURES[3:6]}
    m = RU.expanding_backtest(log, "2024-01-01 00:00:00", "", "", systems=sets, at=spans).where("slice = 'ALL'").collect()
    assert sorted((r.system, r.time_label) for r in m) == sorted(
        (s, f"{a[:10]} to {b[:10]}") for s in sets for a, b in spans)
    assert all(r.positives == 12 and r.negatives == 36 and abs(r.VANDALISM_FRACTION - 0.25) < 1e-9 for r in m)
