"""Runs fit, score and measure their models together."""
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from editrisk.operators import models as M
from editrisk.plans import catalog as CAT
from editrisk.plans import runs as RU

NAMES = ["a", "b", "c"]
FEATURES = CAT.grouped({"g1": {"s1": [CAT.Feature("a"), CAT.Feature("b")]}, "g2": {"s2": [CAT.Feature("c")]}})
SMALL = {"FOREST": M.ForestSpec(3, 4, "sqrt"), "BAGGING": M.ForestSpec(2, 5, "2", 3, 0.5)}


@pytest.fixture(scope="module")
def halves(spark):
    d = spark.range(600).select(F.col("id").alias("revisionId"), (F.col("id") % 150).alias("groupId"),
                                F.when(F.col("id") % 3 == 0, "TEXT").otherwise("STATEMENT").alias("contentType"),
                                (F.col("id") % 97).cast("double").alias("a"), F.rand(3).alias("b"), F.rand(4).alias("c"))
    d = d.withColumn("label", ((F.col("a") > 40) != (F.col("b") > 0.8)).cast("double"))
    d = VectorAssembler(inputCols=NAMES, outputCol="features").transform(d).persist()
    return d.where("revisionId < 400"), d.where("revisionId >= 400")


@pytest.fixture
def batches(monkeypatch):
    """The number of forests of each call that grows some."""
    seen, grow = [], M.grow_forests
    monkeypatch.setattr(M, "grow_forests", lambda train, plans, *a: seen.append(len(plans)) or grow(train, plans, *a))
    return seen


def test_all_grids_grow_and_score_at_once(halves, batches, monkeypatch):
    train, valid = halves
    monkeypatch.setattr(RU, "grids", lambda: {
        "FOREST": [M.ForestSpec(3, d, f) for f in ("1", "2") for d in (1, 30, None)],
        "SAMPLING": [M.ForestSpec(3, None, "sqrt", 1, share, 7) for share in (1.0, 0.5, 0.0)]})
    table, best = RU.optimize(train, valid, 3)
    got = {(r.grid, r.model): r for r in table.collect()}
    assert batches == [7]  # points that coincide are fitted once
    assert sorted(got) == [("FOREST", str(i)) for i in range(6)] + [("SAMPLING", str(i)) for i in range(3)]
    assert got["FOREST", "1"].ROC == got["FOREST", "2"].ROC > got["FOREST", "0"].ROC and got["FOREST", "2"].depth is None
    assert got["SAMPLING", "0"].train_rows == 400 and 150 < got["SAMPLING", "1"].train_rows < 250 and got["SAMPLING", "2"].train_rows == 0
    assert all(r.positives + r.negatives == 200 for r in got.values())
    assert got["SAMPLING", "2"].ROC == pytest.approx(0.5)
    top = max((r for r in got.values() if r.grid == "FOREST"), key=lambda r: (r.PR, -int(r.model)))
    assert (best["FOREST"].depth, best["FOREST"].features) == (top.depth, top.features)


def areas(table, *keys):
    return {tuple(r[k] for k in (*keys, "slice")): (r.ROC, r.PR, r.positives, r.negatives) for r in table.collect()}


def test_a_system_fits_rows_and_sessions_once_each(halves, batches):
    train, valid = halves
    scored = RU.classify(train, valid, "MAIN", NAMES, SMALL)
    assert batches == [3, 1]
    assert {r.model: r["count"] for r in scored.groupBy("model").count().collect()} == {
        m: 200 for m in ("Default random forest", "Optimized random forest", "Bagging", "SIL MI", "Simple MI", "Combined MI")}
    got = areas(M.evaluate(scored, ["model"], curves=False), "model")
    alone, _, _ = RU.forest_run(train, valid, M.DEFAULT_FOREST, "Default random forest")
    want = areas(M.evaluate(RU._union([alone, RU.session_family(train, valid, SMALL["BAGGING"], NAMES)]), ["model"], curves=False), "model")
    assert len(want) == 15
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9)


def test_groups_and_ranking_fit_together(halves, batches):
    train, valid = halves
    groups = areas(RU.group_classifiers(train, valid, FEATURES, "MAIN", SMALL), "classifier", "group")
    assert batches == [9, 3] and len(groups) == 6 * 3 * 3
    assert {k[0] for k in groups} == {"DFOREST", "OFOREST", "BAGGING", "SIL MI", "SIMPLE MI", "COMBINED MI"}
    assert groups["DFOREST", "g1", "ALL"][0] > 0.9 > groups["DFOREST", "g2", "ALL"][0]
    assert groups["SIMPLE MI", "g1", "ALL"][0] > groups["SIMPLE MI", "g2", "ALL"][0]
    batches.clear()
    ranking = {(r.group, r.subgroup, r.feature): r for r in RU.feature_ranking(train, valid, FEATURES).collect()}
    assert batches == [7] and len(ranking) == 7
    whole = ranking["g1", "ALL", "ALL"]
    assert whole.TRAINING_ROC >= whole.ALL_ROC > ranking["g2", "s2", "c"].ALL_ROC
    assert whole.ALL_positives + whole.ALL_negatives == 200 == sum(whole[f"{s}_{c}"] for s in ("ITEM_HEAD", "ITEM_BODY") for c in ("positives", "negatives"))
