"""Running functions given by the user, nested samples, forests of odd samples."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from editrisk.operators import cumulative as C
from editrisk.operators import models as M
from editrisk.operators import splits as S
from editrisk.plans import runs as RU


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, f"u{i % 3}" if i % 5 else None, float(i * 7 % 11) if i % 4 else None) for i in range(1, 121)]
    return spark.createDataFrame(rows, "revisionId long, userName string, value double").cache()


@pytest.mark.parametrize("width", [3, 17, 1 << 20])
def test_cum_agg_takes_any_associative_function(log, width):
    rows = [tuple(r) for r in log.orderBy("revisionId").collect()]
    product = C.Scan(F.product, F.product, lambda a, b: a * b, lambda x: F.round(F.log(x + 1), 6))
    spread = C.Scan(lambda v: F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")),
                    lambda s: F.struct(F.min(s["lo"]).alias("lo"), F.max(s["hi"]).alias("hi")),
                    lambda a, b: F.struct(F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi")),
                    lambda s: s["hi"] - s["lo"])
    distinct = C.Scan(lambda v: F.hll_sketch_agg(v.cast("string")), F.hll_union_agg, F.hll_union, F.hll_sketch_estimate)
    d = log.withColumn("small", F.when(F.col("value").isNotNull(), 1 + F.col("value") / 100))
    with pytest.raises(Exception):
        C.run_batch(d, [C.op_cum_agg(["userName"], "value", "x", "no kind")])
    got = {r.revisionId: r for r in C.run_batch(d, [
        C.op_cum_agg(["userName"], "small", "product", product), C.op_cum_agg(["userName"], "value", "distinct", distinct, 0),
    ], chunk_width=width).collect()}
    import math
    seen = {}
    for key, user, value in rows:
        if user is None:
            assert got[key].product == 0.0 and got[key].distinct == 0
            continue
        if value is not None:
            seen.setdefault(user, []).append(value)
        mine = seen.get(user, [])
        assert got[key].distinct == len(set(mine))
        want = round(math.log(math.prod(1 + v / 100 for v in mine) + 1), 6) if mine else 0.0
        assert abs(got[key].product - want) < 2e-6
    assert spread.finish(F.struct(F.lit(1).alias("lo"), F.lit(3).alias("hi"))) is not None


def test_samples_of_one_seed_are_nested(log):
    ids = lambda share, seed: {r.revisionId for r in S.hash_share(log, share, seed=seed).collect()}
    whole = {r.revisionId for r in log.collect()}
    assert ids(1.0, 1) == whole
    for seed in (1, 2):
        parts = [ids(1 / 2 ** i, seed) for i in range(1, 8)]
        assert all(b <= a for a, b in zip(parts, parts[1:])) and 30 < len(parts[0]) < 90
    assert ids(0.5, 1) != ids(0.5, 2) and ids(0.5, 1) == {r.revisionId for r in S.hash_share(log.repartition(7), 0.5).collect()}


def test_forests_of_one_class_and_empty_samples(spark):
    rows = [(i, Vectors.dense([float(i % 7), float(i % 3)]), float(i % 40 == 0), "TEXT", i) for i in range(200)]
    df = spark.createDataFrame(rows, ["revisionId", "features", "label", "contentType", "groupId"])
    for train in (df.where("label = 0"), df.limit(0)):
        spec = M.ForestSpec(3, 4, "sqrt", 1, 0.5, 7)
        scores = {r.prob for r in M.fit_forest(train, spec, n_features=2).score(df).collect()}
        assert scores == {0.0}
    assert {r.prob for r in M.fit_forest(df.where("label = 1"), M.ForestSpec(3, 4), n_features=2).score(df).collect()} == {1.0}
    # points down to samples without a row keep their row of the table
    points = [M.ForestSpec(2, 3, "sqrt", 1, 1 / 2 ** i, 1000) for i in (0, 3, 30)]
    got = {r.model: r for r in RU.grid_search(df, df, points, 2).collect()}
    assert [got[str(i)].train_rows for i in range(3)] == [200, S.hash_share(df, 1 / 8, seed=1000).count(), 0]
    assert got["0"].train_positives == 5 and got["2"].PR is not None


def test_grids_hold_all_points():
    assert {k: len(v) for k, v in RU.grids().items()} == {"FOREST": 32, "BAGGING": 32, "SAMPLING": 110}
