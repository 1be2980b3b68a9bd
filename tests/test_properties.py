"""Properties: segmented scans equal plain windows, splits are disjoint and
complete, samples have exact sizes, quantiles are exact, fits never see
validation rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from editrisk.operators import cumulative as C
from editrisk.operators import quantiles as Q
from editrisk.operators import splits as SP
from tests.conftest import SF_SMALL


def _random_log(spark, n=400, keys=7, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = None if rnd.random() < 0.1 else f"k{rnd.randrange(keys)}"
        v = None if rnd.random() < 0.2 else rnd.randrange(5)
        rows.append((i * 3 + rnd.randrange(3), k, v))
    return spark.createDataFrame(rows, "revisionId long, k string, v long")


@pytest.mark.parametrize("width", [1, 5, 64, 1 << 20])
def test_segmented_scan_equals_plain_window(spark, width):
    df = _random_log(spark)
    w = Window.partitionBy("k").orderBy("revisionId").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("revisionId",
                      F.when(F.col("k").isNotNull(), F.sum(F.coalesce("v", F.lit(0))).over(w)).alias("s"),
                      F.when(F.col("k").isNotNull(), F.count(F.lit(1)).over(w)).alias("c"),
                      F.when(F.col("k").isNotNull(), F.max("v").over(w)).alias("mx"))
    ours = C.running(df, ["k"], {"s": ("sum", "v"), "c": ("count", None), "mx": ("max", "v")},
                     chunk_width=width)
    a = {r["revisionId"]: (r["s"], r["c"], r["mx"]) for r in plain.collect()}
    b = {r["revisionId"]: (r["s"], r["c"], r["mx"]) for r in ours.collect()}
    assert a == b


def test_cum_unique_equals_collect_set(spark):
    df = _random_log(spark, 300)
    w = Window.partitionBy("k").orderBy("revisionId").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("revisionId", F.when(F.col("k").isNotNull(), F.size(F.collect_set("v").over(w))).alias("u"))
    ours = C.cum_unique(df, ["k"], "v", "u", chunk_width=17)
    assert {r[0]: r[1] for r in ref.collect()} == {r["revisionId"]: r["u"] for r in ours.collect()}


def test_splits_disjoint_and_complete(spark):
    from editrisk.sources.tables import revision_log
    log = revision_log(spark, SF_SMALL)
    a, b = SP.random_split(log, 0.3)
    n = log.count()
    ids_a = {r[0] for r in a.select("revisionId").collect()}
    ids_b = {r[0] for r in b.select("revisionId").collect()}
    assert len(ids_a) == int(0.3 * n)
    assert not ids_a & ids_b and len(ids_a | ids_b) == n
    c, d = SP.ordered_split(log, 0.7)
    assert c.count() == int(0.7 * n) and d.count() == n - int(0.7 * n)
    assert c.agg(F.max("revisionId")).first()[0] < d.agg(F.min("revisionId")).first()[0]


def test_sample_is_deterministic_and_exact(spark):
    df = _random_log(spark, 500)
    s1 = {r[0] for r in SP.sample_n(df, 0.2).select("revisionId").collect()}
    s2 = {r[0] for r in SP.sample_n(df.repartition(7), 0.2).select("revisionId").collect()}
    assert len(s1) == 100 and s1 == s2


def test_exact_quantiles(spark):
    rnd = np.random.default_rng(0)
    vals = np.concatenate([rnd.normal(size=900), np.full(100, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    got = Q.exact_quantiles(df, "x", [0.25, 0.5, 0.75])
    assert got == list(np.quantile(vals, [0.25, 0.5, 0.75], method="linear")) or \
        got == pytest.approx(list(np.quantile(vals, [0.25, 0.5, 0.75])), abs=1e-15)


def test_ordered_bits_keep_order_and_value(spark):
    rnd = np.random.default_rng(1)
    whole = rnd.integers(-2 ** 63, 2 ** 63 - 1, size=3000).view(np.float64)
    powers = [s * f(2.0 ** e) for e in range(-1074, 1024, 7) for s in (1, -1)
              for f in (lambda x: x, lambda x: np.nextafter(x, np.inf), lambda x: np.nextafter(x, 0))]
    vals = sorted({float(v) for v in [*whole[np.isfinite(whole)], *powers, 0.0, 5e-324, 1.7976931348623157e308,
                                      float("inf"), -float("inf")]})
    rows = spark.createDataFrame([(v,) for v in vals], "x double").select("x", Q.ordered_bits(F.col("x"))).collect()
    bits = dict(map(tuple, rows))
    assert [Q.from_ordered_bits(bits[v]) for v in vals] == vals
    assert all(bits[a] < bits[b] for a, b in zip(vals, vals[1:]))


def test_several_columns_in_one_selection(spark):
    rnd = np.random.default_rng(2)
    a, b = rnd.normal(size=501) * 1e300, np.repeat(7.0, 501)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    got = Q.exact_medians(df, {"a": "a", "b": "b", "none": "c"})
    assert got == {"a": float(np.median(a)), "b": 7.0, "none": None}
    assert Q.kth_smallest(df, "a", 500) == a.max() and Q.kth_smallest(df, "a", 501) is None
    assert Q.exact_medians(df.limit(0), {"a": "a"}) == {"a": None}


def test_grouped_median_spreads_a_hot_group(spark, monkeypatch):
    import statistics

    from editrisk.operators import sessions as SE
    rnd = np.random.default_rng(3)
    rows = [(None if g == 3 else int(g), None if rnd.random() < 0.1 else float(v)) for g, v in
            zip(np.where(rnd.random(900) < 0.4, 1, rnd.integers(0, 40, 900)), rnd.integers(0, 50, 900))]
    rows += [(77, None), (78, 2.0), (78, 3.0)]
    want = {g: [v for h, v in rows if h == g and v is not None] for g, _ in rows}
    df = spark.createDataFrame(rows, "groupId int, s double")
    got = dict(map(tuple, SE.session_agg(df, "s", "median").collect()))
    assert got == {g: statistics.median(v) if v else None for g, v in want.items()}


def test_fit_uses_only_fit_rows(spark):
    """Changing validation rows must not change any fitted statistic."""
    from editrisk.plans import catalog as CAT
    from editrisk.plans.pipeline import feature_pipeline
    from editrisk.sources.tables import VALIDATION_START, revision_log, ts_lit
    log = revision_log(spark, SF_SMALL)
    fit = F.col("timestamp") < ts_lit(VALIDATION_START)
    changed = log.withColumn("value", F.when(fit, F.col("value")).otherwise(F.lit(1.0))) \
                 .withColumn("revisionAction", F.when(fit, F.col("revisionAction")).otherwise(F.lit("zzz")))
    feats = [f for f in CAT.standin_main() if f.output in ("valueMedian", "actionFreq", "userMeanValue")]
    a = feature_pipeline(log, feats, fit).where(fit)
    b = feature_pipeline(changed, feats, fit).where(fit)
    cols = ["revisionId", "valueMedian", "actionFreq", "userMeanValue"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_feature_pipeline_keeps_rows(spark):
    from editrisk.plans.q_models import feature_table
    from editrisk.sources.tables import revision_log
    t = feature_table(spark, SF_SMALL)
    assert t.count() == revision_log(spark, SF_SMALL).count()
    assert t.select("revisionId").distinct().count() == t.count()


@pytest.mark.parametrize("bits, ranked", [(1, 1), (2, 3), (12, 4096)])
def test_exact_sample_does_not_depend_on_refinement(spark, monkeypatch, bits, ranked):
    from editrisk.operators import splits as SP
    df = spark.range(40).withColumnRenamed("id", "revisionId")
    whole = sorted(r[0] for r in SP.sample_n(df, 0.35).collect())
    monkeypatch.setattr(SP, "HASH_BITS", bits)
    monkeypatch.setattr(SP, "RANKED_ROWS", ranked)
    assert sorted(r[0] for r in SP.sample_n(df, 0.35).collect()) == whole and len(whole) == 14


def test_comment_words_hold_counts_and_coefficients(spark):
    from editrisk.operators import textmodels as TM
    rows = [(i, "bad word bad" if i % 3 == 0 else "good word", i % 3 == 0) for i in range(30)] + [(30, "rare", True)]
    df = spark.createDataFrame(rows, "k int, text string, y boolean")
    model = TM.comment_model(df, "text", "y", min_df=5)
    got = {r["words"]: r for r in TM.comment_words(model, df, "k", "text", "y").collect()}
    assert set(got) == {"bad", "good", "word"}  # "rare" is below min_df
    assert (got["bad"]["vandalismCount"], got["bad"]["totalCount"], got["bad"]["documents"]) == (20, 20, 10)
    assert (got["word"]["vandalismCount"], got["word"]["totalCount"]) == (10, 30)
    assert got["good"]["vandalismScore"] < 0 < got["bad"]["vandalismScore"]


def test_metric_row_holds_the_pr_curve(spark):
    from editrisk.operators import curves as CV
    df = spark.createDataFrame([(0.9, 1, "TEXT"), (0.8, 0, "TEXT"), (0.7, 1, "TEXT"), (0.1, 0, "TEXT")],
                               "prob double, label int, contentType string")
    m = CV.metrics_by_slice(df)
    got = {r["slice"]: r for r in m.collect()}
    assert got["ALL"]["precisionValues"] == "1.000000,0.500000,0.666667,0.500000"
    assert got["ALL"]["recallValues"] == "0.500000,0.500000,1.000000,1.000000"
    assert got["ITEM_BODY"]["precisionValues"] == "0.0,0.0"
    assert not set(CV.CURVES) & set(CV.drop_curves(m).columns)
