"""Null-key rules per operator, row preservation, partition invariance and
the model operators' score bounds and determinism."""

import pytest
from pyspark.sql import functions as F

from editrisk.operators import steps as ST
from tests.conftest import SF_SMALL

ROWS = [(1, "a", 1.0), (2, None, 3.0), (3, "a", 5.0), (4, None, 7.0), (5, "b", None), (6, "c", 2.0)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "revisionId long, k string, v double")


def _col(df, name):
    return [r[name] for r in df.orderBy("revisionId").collect()]


def test_frequency_null_key_not_counted(small):
    d = ST.frequency().fit_transform(small, ["k"], "f", F.col("revisionId") <= 4)
    assert _col(d, "f") == [2, 0, 2, 0, 0, 0]


def test_group_agg_null_rules(small):
    fit = F.col("revisionId") <= 4
    plain = ST.group_mean().fit_transform(small, ["k", "v"], "m", fit)
    assert _col(plain, "m") == [3.0, 0.0, 3.0, 0.0, 0.0, 0.0]
    # category keys: the missing key is a group of its own
    cat = ST.group_mean(null_safe=True).fit_transform(small, ["k", "v"], "m", fit)
    assert _col(cat, "m") == [3.0, 5.0, 3.0, 5.0, 0.0, 0.0]


def test_group_nunique_and_sum(small):
    d = ST.group_sum().fit_transform(small, ["k", "v"], "s")
    assert _col(d, "s") == [6.0, 0.0, 6.0, 0.0, 0.0, 2.0]
    d = ST.group_nunique().fit_transform(small, ["k", "v"], "u")
    assert _col(d, "u") == [2, 0, 2, 0, 0, 1]


@pytest.mark.parametrize("step", [ST.frequency(), ST.group_mean(), ST.impute_median(), ST.impute_mean(),
                                  ST.impute_minus_one(), ST.log_scale(), ST.cum_unique(2)])
def test_steps_preserve_rows(spark, small, step):
    inputs = ["v"] if step.kind in ("scalar", "expr") else ["k", "v"]
    d = step.fit_transform(small, inputs, "out", F.col("revisionId") <= 4)
    assert sorted(r[0] for r in d.select("revisionId").collect()) == [1, 2, 3, 4, 5, 6]


def test_pipeline_partition_invariance(spark):
    from editrisk.plans import catalog as CAT
    from editrisk.plans.pipeline import feature_pipeline
    from editrisk.sources.tables import VALIDATION_START, revision_log, ts_lit
    fit = F.col("timestamp") < ts_lit(VALIDATION_START)
    log = revision_log(spark, SF_SMALL)
    feats = CAT.standin_main(chunk_width=64)
    names = CAT.feature_names(feats)
    a = feature_pipeline(log, feats, fit).select("revisionId", *names).collect()
    b = feature_pipeline(log.repartition(7), CAT.standin_main(chunk_width=64), fit) \
        .select("revisionId", *names).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_forest_scores_bounded_and_deterministic(spark):
    from editrisk.operators import models as M
    from editrisk.plans import runs as RU
    from editrisk.plans import catalog as CAT
    from editrisk.sources.tables import TEST_START, TRAIN_START, VALIDATION_START, revision_log
    table = RU.build_table(revision_log(spark, SF_SMALL), CAT.standin_main(), VALIDATION_START, TEST_START)
    train, valid = RU.split(table, TRAIN_START, VALIDATION_START, TEST_START)
    s1, _, _, _ = M.fit_predict(train, valid, M.DEFAULT_FOREST)
    s2, _, _, _ = M.fit_predict(train, valid, M.DEFAULT_FOREST)
    p1 = {r["revisionId"]: r["prob"] for r in s1.collect()}
    p2 = {r["revisionId"]: r["prob"] for r in s2.collect()}
    assert p1 == p2
    assert all(0.0 <= p <= 1.0 for p in p1.values())


def test_error_positions(spark):
    from editrisk.operators import splits as SP
    rows = [(i, i % 3 == 0, i % 2 == 0) for i in range(1, 121)]
    df = spark.createDataFrame(rows, "revisionId long, label boolean, pred boolean")
    out = SP.error_positions(df, n=7).collect()
    for kind in ("FN", "FP"):
        ids = sorted(r["revisionId"] for r in out if r["error"] == kind)
        errs = sorted(i for i, y, p in rows if y != p and (("FN" if y else "FP") == kind))
        fixed = set(errs[1:7]) | set(errs[-7:])
        assert fixed <= set(ids)
        assert len(ids) <= len(fixed) + 7
        pos = {r["revisionId"]: r["position"] for r in out if r["error"] == kind}
        assert all(errs[pos[i] - 1] == i for i in ids)


def test_misclassified_report_and_sample_k(spark):
    from editrisk.operators import splits as SP
    rows = [(i, i % 3 == 0, (i % 7) / 10.0) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "revisionId long, label boolean, prob double")
    summary, sample = SP.misclassified_report(df, k=20)
    hard = [r for r in rows if r[1] and r[2] < 0.25]
    assert sample.count() == 20
    assert {r["revisionId"] for r in sample.collect()} <= {r[0] for r in hard}
    counts = {r["column"]: r["count"] for r in summary.collect()}
    assert counts["revisionId"] == len(hard)


def test_describe_top_values_in_one_pass(spark):
    from editrisk.operators import stats as S
    df = spark.createDataFrame([("a", "x", True), ("b", "x", True), ("b", "y", False), (None, "y", None)],
                               "c1 string, c2 string, b boolean")
    d = {r["column"]: r for r in S.describe_all(df).collect()}
    assert (d["c1"]["top"], d["c1"]["freq"], d["c1"]["unique"], d["c1"]["count"]) == ("b", 2, 2, 3)
    assert (d["c2"]["top"], d["c2"]["freq"]) == ("x", 2)  # tie broken by value
    assert (d["b"]["top"], d["b"]["freq"]) == ("True", 2)


def test_malformed_numbers_raise_and_large_ids_load(spark, tmp_path):
    from editrisk.sources.csv_log import load_revisions
    good = tmp_path / "good.csv"
    good.write_text('revisionId,itemId,revisionSize\n"3000000000","NA","5"\n')
    assert [tuple(r) for r in load_revisions(spark, str(good)).collect()] == [(3000000000, None, 5)]
    bad = tmp_path / "bad.csv"
    bad.write_text('revisionId,itemId,revisionSize\n"1","abc","5"\n')
    with pytest.raises(Exception, match="itemId: not a bigint"):
        load_revisions(spark, str(bad)).collect()


def test_ordered_split_of_large_ids(spark):
    from editrisk.operators.splits import ordered_split
    ids = [(1 << 60) + i for i in range(8)] + [-(1 << 62), (1 << 63) - 1]
    df = spark.createDataFrame([(i,) for i in ids], "revisionId long")
    first, rest = ordered_split(df, 0.5, "revisionId")
    assert sorted(r[0] for r in first.collect()) == sorted(ids)[:5] and rest.count() == 5


def test_float32_clamp(spark):
    from editrisk.functions.scalars import FLOAT32_MAX, finite_float32
    df = spark.createDataFrame([(float("inf"),), (-1e300,), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(finite_float32(df.x)).collect()] == [FLOAT32_MAX, -FLOAT32_MAX, 1.5, None]


def test_chunks_break_at_every_white_space(spark):
    import re
    from editrisk.operators.textmodels import chunk_tokens
    text = "".join(f"w{i}{chr(c)}" for i, c in enumerate(c for c in range(0x3001) if chr(c).isspace())) + "(end)\u200b"
    got = spark.createDataFrame([(text,)], "text string").select(chunk_tokens(F.col("text")).alias("t")).first().t
    assert got == re.findall(r"\b\S+\b", text) and len(got) == 30
