"""The reference's own test cases and the hand-made fixtures (FIXTURES.md)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from editrisk.functions import text as T
from editrisk.operators import categories as CA
from editrisk.operators import cumulative as C
from editrisk.operators import curves as CV
from editrisk.operators import sessions as SE
from editrisk.operators import splits as SP


def _tags(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "revisionId long, tag string")


def test_most_frequent_tag_fit_and_transform_same_rows(spark):
    df = _tags(spark, ["abc,def,ghi", "ghi,abc", "ghi", "x1", "x1,x2,x3", "x2", "x2", None])
    out = CA.most_frequent_tag(df, "tag", "best").orderBy("revisionId").collect()
    assert [r["best"] for r in out] == ["ghi", "ghi", "ghi", "x1", "x2", "x2", "x2", None]


def test_most_frequent_tag_fit_on_other_rows(spark):
    fit = _tags(spark, ["abc", "def,abc"]).withColumn("is_fit", F.lit(True))
    new = _tags(spark, ["new,abc", "new,def,new", "x1,x2", "x3", "def", "def", None]) \
        .withColumn("revisionId", F.col("revisionId") + 10).withColumn("is_fit", F.lit(False))
    out = (CA.most_frequent_tag(fit.unionByName(new), "tag", "best", F.col("is_fit"))
           .where(~F.col("is_fit")).orderBy("revisionId").collect())
    assert [r["best"] for r in out] == ["abc", "def", "x1", "x3", "def", "def", None]


def test_index_for_key_by_date(spark):
    rows = [(dt.datetime(2005, 2, 25, 0, 0, 0),), (dt.datetime(2005, 2, 25, 0, 0, 0),),
            (dt.datetime(2005, 2, 25, 0, 0, 1),)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz")
    assert SP.index_for_key(df, "2005-02-25 00:00:00", "timestamp").first()["index"] == 0


RUNNING = [(1, "a", 1), (2, "a", None), (3, "b", 2), (4, "a", 3), (5, None, 5), (6, "b", 2), (7, "a", 1)]
EXPECTED = {
    "cum_frequency": [1, 2, 1, 3, None, 2, 4],
    "cum_count": [0, 1, 0, 2, 0, 1, 3],
    "cum_sum": [1, 1, 2, 4, 0, 4, 5],
    "cum_min": [1, 0, 2, 1, 0, 2, 1],
    "cum_max": [1, 0, 2, 3, 0, 2, 3],
    "cum_mean": [1, 0.5, 2, 4 / 3, 0, 2, 1.25],
    "cum_unique": [1, 1, 1, 2, None, 1, 2],
    "prev_value": ["NA", "1", "NA", "1", "NA", "2", "3"],
}


@pytest.mark.parametrize("width", [1, 2, 3, 1 << 20])
def test_running_operators_table(spark, width):
    df = spark.createDataFrame(RUNNING, "revisionId long, k string, v long")
    kw = {"chunk_width": width}
    res = {
        "cum_frequency": C.cum_frequency(df, ["k"], "o", **kw),
        "cum_count": C.cum_count(df, ["k"], "o", **kw),
        "cum_sum": C.cum_sum(df, ["k"], "v", "o", **kw),
        "cum_min": C.cum_min(df, ["k"], "v", "o", **kw),
        "cum_max": C.cum_max(df, ["k"], "v", "o", **kw),
        "cum_mean": C.cum_mean(df, ["k"], "v", "o", **kw),
        "cum_unique": C.cum_unique(df, ["k"], "v", "o", **kw),
        "prev_value": C.prev_value(df, ["k"], "v", "o", **kw),
    }
    for name, d in res.items():
        got = [r["o"] for r in d.orderBy("revisionId").collect()]
        want = EXPECTED[name]
        for g, w in zip(got, want):
            if isinstance(w, float):
                assert g == pytest.approx(w, rel=1e-6), name
            else:
                assert g == w, (name, got, want)


def test_frequency_and_log_scale_fixture(spark):
    from editrisk.functions.scalars import log_scale
    from editrisk.operators import steps as ST
    df = spark.createDataFrame(RUNNING, "revisionId long, k string, v long")
    d = ST.frequency().fit_transform(df, ["k"], "f", F.col("revisionId") <= 4)
    d = d.withColumn("lf", log_scale(F.col("f"))).orderBy("revisionId").collect()
    assert [r["f"] for r in d] == [3, 3, 1, 3, 0, 1, 3]
    assert [r["lf"] for r in d] == [2, 2, 1, 2, 0, 1, 2]


def _points_df(spark, points):
    # (positives, negatives) per distinct score, best score first
    rows, i = [], 0
    n = len(points)
    for j, (p, q) in enumerate(points):
        score = float(n - j)
        rows += [(i + k, score, True) for k in range(p)]
        i += p
        rows += [(i + k, score, False) for k in range(q)]
        i += q
    return spark.createDataFrame(rows, "revisionId long, prob double, label boolean")


@pytest.mark.parametrize("points,roc,pr,trap", [
    ([(1, 0), (0, 1), (1, 0), (0, 1)], 0.75, 0.791667, 0.791667),
    ([(1, 1), (1, 1)], 0.5, 0.5, 0.5),
    ([(1, 0), (2, 4)], 0.666667, 0.738095, 0.809524),
    ([(0, 2)], 0.0, 0.0, 0.0),
])
def test_area_cases(spark, points, roc, pr, trap):
    df = _points_df(spark, points)
    a = CV.areas(CV.score_points(df, "prob", "label", None)).first()
    assert a["ROC"] == pytest.approx(roc, abs=1e-6)
    assert a["PR"] == pytest.approx(pr, abs=1e-6)
    assert a["PR_trapezoid"] == pytest.approx(trap, abs=1e-6)


def test_roc_area_equals_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from editrisk.sources.tables import revision_log
    from tests.conftest import SF_SMALL
    d = revision_log(spark, SF_SMALL).withColumn("prob", F.coalesce(F.col("value"), F.lit(0.0)) / 101)
    ours = CV.areas(CV.score_points(d, "prob", "label", None)).first()["ROC"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="y", numBins=0)
    theirs = ev.evaluate(d.withColumn("y", F.col("label").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-12)


def test_language_class(spark):
    vals = ["enwiki", "en-gb", "dewikisource", "enwikinews", "de-at", "commonswiki", "fr", ""]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(T.language_class(F.col("v"))).collect()]
    assert got == ["en", "en", "de", "en", "de", "commons", "fr", "nan"]


def test_impact_code(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", 0), ("z", 0), ("q", None)],
                               "lvl string, y int")
    fit = F.col("y").isNotNull()
    d = CA.impact_code(df, "lvl", "y", "imp", 1.0, fit).collect()
    got = {r["lvl"]: r["imp"] for r in d}
    assert got["x"] == pytest.approx(0.625)
    assert got["z"] == pytest.approx(0.25)
    assert got["q"] == pytest.approx(0.5)


def test_single_instance(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.6), (3, 2, 0.9)], "revisionId long, groupId long, prob double")
    d = SE.single_instance(df, "prob").orderBy("revisionId").collect()
    assert [r["sil_score"] for r in d] == pytest.approx([0.4, 0.4, 0.9])


def test_null_tokens_csv(spark, tmp_path):
    from editrisk.sources.csv_log import load_revisions
    p = tmp_path / "log.csv"
    cells = ["", '""', "NA", "NaN", "null", "�", '"x ""q"" y"']
    lines = ["revisionId,commentTail"] + [f"{i},{c}" for i, c in enumerate(cells)]
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    d = load_revisions(spark, str(p)).orderBy("revisionId").collect()
    assert [r["commentTail"] for r in d] == ["", "", None, None, None, None, 'x "q" y']


def test_bool_and_timestamp_decoding(spark, tmp_path):
    from editrisk.sources.csv_log import load_revisions
    p = tmp_path / "log.csv"
    p.write_text("revisionId,timestamp,minorRevision\n1,2014-01-01T00:00:00Z,T\n2,2014-01-01T00:00:05Z,F\n"
                 "3,2014-01-02T10:00:00Z,NA\n", encoding="utf-8")
    d = load_revisions(spark, str(p)).orderBy("revisionId").collect()
    assert [r["minorRevision"] for r in d] == [True, False, None]
    assert d[1]["timestamp"] - d[0]["timestamp"] == dt.timedelta(seconds=5)


def test_log_scale_values(spark):
    from editrisk.functions.scalars import log_scale
    df = spark.createDataFrame([(0.0,), (1.0,), (-3.0,), (7.0,), (None,)], "x double")
    got = [r[0] for r in df.select(log_scale(F.col("x"))).collect()]
    assert got == [0.0, 1.0, -2.0, 3.0, 0.0]
    assert not any(math.isnan(v) for v in got)


def test_csv_to_parquet_round_trip_with_pushdown(spark, tmp_path):
    from editrisk.sources.csv_log import load_revisions, to_parquet
    p = tmp_path / "log.csv"
    rows = ["revisionId,timestamp,userName,rollbackReverted"]
    rows += [f"{i},2014-01-01T00:00:{i % 60:02d}Z,u{i % 3},{'T' if i % 4 == 0 else 'F'}" for i in range(50, 0, -1)]
    p.write_text("\n".join(rows) + "\n", encoding="utf-8")
    out = str(tmp_path / "log.parquet")
    to_parquet(load_revisions(spark, str(p)), out)
    back = spark.read.parquet(out)
    assert back.count() == 50
    sel = back.where((F.col("revisionId") >= 10) & (F.col("revisionId") < 20))
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(revisionId,10)" in plan and "LessThan(revisionId,20)" in plan
    assert sorted(r[0] for r in sel.select("revisionId").collect()) == list(range(10, 20))
