"""Tree-ensemble models (``forests``) and their evaluation.

Features are assembled once into a vector column; subsets for single
features, subgroups and groups are ``VectorSlicer`` views of the same
persisted table (no re-assembly).  Scores are the positive-class
probability.  Metrics come from ``curves.metrics_by_slice`` with a
``model`` group column, so many models are evaluated in one pass.

Parity notes: features have at most 256 bins and the depth is capped at 30,
so the library defaults (unlimited depth) and the grid depths 32 and 64
become 30; grid points that coincide after capping are evaluated once.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import accumulate

from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist
from . import curves as CV
from .forests import Grown, Plan, grow_forests, score_forests

MAX_DEPTH = 30
PARALLEL_FITS = 8


@dataclass(frozen=True)
class ForestSpec:
    """A forest on ``sample`` of the rows (drawn with replacement); ``bags`` > 1 means
    bagging of ``bags`` such forests, each on a sample of its own."""
    trees: int = 10
    depth: int | None = None
    features: str = "sqrt"  # '1', '2', 'log2', 'sqrt', 'all'
    bags: int = 1
    sample: float = 1.0
    seed: int = 1
    nested: bool = False  # bagging as separate forests (True) or one forest

    def key(self) -> tuple:
        return (self.trees, min(self.depth or MAX_DEPTH, MAX_DEPTH), self.features, self.bags,
                self.sample, self.seed, self.nested)


DEFAULT_FOREST = ForestSpec()
# The stored best parameters per system (forest and bagging).
TUNED = {
    "MAIN": {"FOREST": ForestSpec(10, 8, "sqrt"), "BAGGING": ForestSpec(8, 32, "2", 16, 1 / 16)},
    "FILTER": {"FOREST": ForestSpec(10, 16, "1"), "BAGGING": ForestSpec(8, 8, "1", 16, 1 / 16)},
    "BASELINE": {"FOREST": ForestSpec(10, 16, "sqrt"), "BAGGING": ForestSpec(8, 16, "sqrt", 16, 1 / 16)},
}


def assemble(df: DataFrame, feature_cols: Sequence[str], out: str = "features") -> DataFrame:
    """One vector column; a missing feature value is an error naming the row's columns."""
    return VectorAssembler(inputCols=list(feature_cols), outputCol=out, handleInvalid="error").transform(df)


def width(df: DataFrame, col: str) -> int:
    """Elements of a feature column: 1, or those of its vectors (all of one size)."""
    if col not in df.columns or not isinstance(df.schema[col].dataType, VectorUDT):
        return 1
    known = df.schema[col].metadata.get("ml_attr", {}).get("num_attrs")
    if known is not None:
        return known
    row = df.select(F.size(vector_to_array(F.col(col)))).first()
    return row[0] if row else 1


def places(df: DataFrame, all_cols: Sequence[str], keep: Sequence[str]) -> list[int]:
    """The places of the features ``keep`` in the vector of ``all_cols``; a vector feature has as
    many places as elements."""
    sizes = [width(df, c) for c in all_cols]
    first = dict(zip(all_cols, accumulate(sizes, initial=0)))
    size = dict(zip(all_cols, sizes))
    return [i for c in keep for i in range(first[c], first[c] + size[c])]


def slice_features(df: DataFrame, all_cols: Sequence[str], keep: Sequence[str],
                   src: str = "features", out: str = "features_sub") -> DataFrame:
    """The vector of the features ``keep`` (see ``places``)."""
    return VectorSlicer(inputCol=src, outputCol=out, indices=places(df, all_cols, keep)).transform(df)


def _per_node(spec: ForestSpec, n: int) -> int:
    """Features looked at in a node."""
    if spec.features in ("1", "2"):
        return min(int(spec.features), n)
    return {"log2": max(1, math.ceil(math.log2(max(n, 1)))), "sqrt": max(1, math.ceil(math.sqrt(n))), "all": n}[spec.features]


def _plan(spec: ForestSpec, places: Sequence[int]) -> Plan:
    bagged = spec.bags > 1
    return Plan(tuple(places), spec.trees * (spec.bags if bagged else 1), min(spec.depth or MAX_DEPTH, MAX_DEPTH),
                _per_node(spec, len(places)), spec.sample if bagged else 1.0, 1.0 if bagged else spec.sample, spec.seed,
                spec.trees if bagged and spec.nested else 0)


class FittedForest:
    def __init__(self, grown: Grown | None, features_col: str):
        self.grown = grown
        self.features_col = features_col

    def score(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Mean positive share over the trees' leaves.

        A forest that has seen regular rows only knows one class and gives 0; one without
        rows (an empty sample) gives every row 0."""
        if self.grown is None:
            return df.withColumn(out, F.lit(0.0))
        return self.grown.score(df, self.features_col, out)

    def importances(self) -> list[float]:
        return [] if self.grown is None else [float(x) for x in self.grown.importances()]


def fit_forests(train: DataFrame, wanted: Sequence[tuple[ForestSpec, Sequence[int] | None]], features_col: str = "features",
                n_features: int | None = None, key: str = "revisionId") -> list[FittedForest]:
    """Fit forests or bagging ensembles, each a spec and the places of its features in the vector
    (None: all), over the same rows in the same jobs.

    A single forest with ``sample`` < 1 sees that share of the rows by the hash of ``key``
    (nested samples of one seed); a sample may hold one class or no row.

    Bagging (``bags`` > 1) is by default ONE forest of ``bags * trees`` trees, each of which
    draws its own sample.  With ``nested=True`` the trees of a member share one sample, from
    which each draws again."""
    if n_features is None and any(places is None for _, places in wanted):
        first = train.select(F.size(vector_to_array(F.col(features_col)))).first()
        n_features = first[0] if first else 0
    plans = [_plan(spec, range(n_features) if places is None else places) for spec, places in wanted]
    grown = grow_forests(train, plans, features_col, key) or [None] * len(plans)
    return [FittedForest(g, features_col) for g in grown]


def score_all(models: Sequence[FittedForest], df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``df``'s columns ``keep``, ``prob`` and ``model`` (the name) for every row and model; the models are
    of one ``fit_forests`` and share passes over the rows."""
    if models[0].grown is None:
        return df.select(*keep, F.lit(0.0).alias("prob"), F.explode(F.array(*map(F.lit, names))).alias("model"))
    features_col = models[0].features_col
    frames = score_forests([m.grown for m in models], df.select(*dict.fromkeys([*keep, features_col])), features_col, names)
    return reduce(DataFrame.unionByName, [f.select(*keep, "prob", "model") for f in frames])


def fit_forest(train: DataFrame, spec: ForestSpec, features_col: str = "features",
               n_features: int | None = None, key: str = "revisionId") -> FittedForest:
    """One forest or bagging ensemble (see ``fit_forests``)."""
    return fit_forests(train, [(spec, None)], features_col, n_features, key)[0]


def fit_predict(train: DataFrame, valid: DataFrame, spec: ForestSpec, features_col: str = "features",
                n_features: int | None = None, out: str = "prob"):
    """(scored validation, fit seconds, score seconds); the scores are persisted."""
    t0 = time.time()
    model = fit_forest(train, spec, features_col, n_features)
    t1 = time.time()
    scored = persist(model.score(valid, out))
    scored.count()
    t2 = time.time()
    return scored, model, t1 - t0, t2 - t1


def evaluate(scored: DataFrame, model_cols: Sequence[str] = (), score: str = "prob",
             curves: bool = True) -> DataFrame:
    """Metrics per model and slice (one pass for all models in ``scored``)."""
    return CV.metrics_by_slice(scored, score, "label", "contentType", list(model_cols), curves=curves)


def importance_table(spark, model: FittedForest, names: Sequence[str]) -> DataFrame:
    """Feature importances sorted descending (one row per feature)."""
    rows = list(zip(names, [float(x) for x in model.importances()]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def top_feature(spark, model: FittedForest, names: Sequence[str]) -> DataFrame:
    """The most important feature (one row)."""
    return importance_table(spark, model, names).limit(1)


def capped(specs: Sequence[ForestSpec]) -> list[ForestSpec]:
    """Grid points after the depth cap, duplicates removed (first kept)."""
    seen, out = set(), []
    for s in specs:
        s2 = replace(s, depth=min(s.depth or MAX_DEPTH, MAX_DEPTH))
        if s2.key() not in seen:
            seen.add(s2.key())
            out.append(s2)
    return out
