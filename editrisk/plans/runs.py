"""System runs: feature table -> models -> metric tables.

Every function returns a Spark DataFrame; the driver holds only the
catalog, model objects and small metric rows.  The assembled feature
table is checkpointed to the cluster's shared checkpoint folder before the
model loop, so a lost executor never recomputes the feature pipeline and
the loop's plans stay short.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cumulative as C
from ..operators import curves as CV
from ..operators import models as M
from ..operators import sessions as SE
from ..operators.splits import ORDER_BITS, hash_order, share_hash
from ..operators.stats import corpus_statistics
from ..session import cut_lineage, persist, releasing, stored
from ..sources import constants as K
from ..sources.csv_log import load_revisions, to_parquet
from ..sources.schema import LABEL_COLUMN
from ..sources.sinks import metrics_sink
from ..sources.tables import ts_lit
from . import catalog as CAT
from . import feature_sets as SETS
from .expanding import WINDOW, expandable, expanding_features
from .pipeline import feature_pipeline

KEEP = ["revisionId", "groupId", "contentType", "label"]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _bound(value: str | int) -> Column:
    return ts_lit(value) if isinstance(value, str) else F.lit(value)


def build_table(log: DataFrame, features: Sequence[CAT.Feature], validation_start: str | int,
                end: str | int | None = None, cache_input: bool = True, on: str = "timestamp",
                label: str = "label") -> DataFrame:
    """Feature table of all rows before ``end``, fitted on rows before the
    validation start, assembled and checkpointed.  The bounds are those of the
    column ``on``: times, or revision ids."""
    rows = log if end is None else log.where(F.col(on) < _bound(end))
    table = feature_pipeline(rows, features, F.col(on) < _bound(validation_start),
                             label=label, cache_input=cache_input)
    return cut_lineage(M.assemble(table, CAT.output_columns(features, table.columns)))


def split(table: DataFrame, train_start: str | int, validation_start: str | int, test_start: str | int,
          on: str = "timestamp"):
    at = F.col(on)
    train = table.where((at >= _bound(train_start)) & (at < _bound(validation_start)))
    valid = table.where((at >= _bound(validation_start)) & (at < _bound(test_start)))
    return train, valid


def _scored(frame: DataFrame, model: str, score: str = "prob") -> DataFrame:
    return frame.select(*KEEP, F.col(score).alias("prob"), F.lit(model).alias("model"))


# ------------------------------------------------------------------ classifiers
def forest_run(train: DataFrame, valid: DataFrame, spec: M.ForestSpec, name: str,
               features_col: str = "features"):
    scored, model, fit_s, prob_s = M.fit_predict(train, valid, spec, features_col)
    return _scored(scored, name), model, {"model": name, "FIT_TIME": fit_s, "PROB_TIME": prob_s,
                                          "TOTAL_TIME": fit_s + prob_s}


def session_scores(train: DataFrame, valid: DataFrame, spec: M.ForestSpec,
                   variants: dict[str, Sequence[str]]) -> DataFrame:
    """Session models: per-session max and min of every feature (label = max), and a bagging
    model on the sessions for each variant (name and features): the scores ``smi`` of the
    sessions of ``valid``, with the variant's name as ``model``.  All variants read one session table."""
    names = list(dict.fromkeys(c for some in variants.values() for c in some))

    def of(some):
        return [f"{c}_max" for c in some] + [f"{c}_min" for c in some]

    def sessions(df, label):
        # the feature table keeps the single feature columns next to the vector
        s = M.assemble(SE.session_minmax(df, names, label), of(names))
        # a fit reads its rows more than once, and so do scores
        return s, persist(s.select(SE.SESSION, "features", *([label] if label else [])))
    wide, s_train = sessions(train, "label")
    models = M.fit_forests(s_train, [(spec, M.places(wide, of(names), of(some))) for some in variants.values()], key=SE.SESSION)
    _, s_valid = sessions(valid, None)
    return M.score_all(models, s_valid, list(variants), [SE.SESSION]).withColumnRenamed("prob", "smi")


def simple_multi_instance(train: DataFrame, valid: DataFrame, spec: M.ForestSpec,
                          names: Sequence[str]) -> DataFrame:
    """Session model: the session scores of all features spread back to the rows."""
    return SE.spread(valid, session_scores(train, valid, spec, {"ALL": names}).drop("model"))


def _family(bag: DataFrame, s_scored: DataFrame, valid: DataFrame) -> DataFrame:
    """The session family's scores from those of bagging (``KEEP`` and ``prob``) and of the sessions."""
    sil = SE.single_instance(bag, "prob", "mean", out="sil")
    smi = SE.spread(valid.select("revisionId", SE.SESSION), s_scored).select("revisionId", "smi")
    both = persist(sil.join(smi, "revisionId"))
    comb = SE.combined(both, "sil", "smi", "comb")
    return _union([_scored(bag, "Bagging"), _scored(comb, "SIL MI", "sil"),
                   _scored(comb, "Simple MI", "smi"), _scored(comb, "Combined MI", "comb")])


def session_family(train: DataFrame, valid: DataFrame, spec: M.ForestSpec,
                   names: Sequence[str], features_col: str = "features") -> DataFrame:
    """Bagging, its session mean (SIL MI), the session model (Simple MI) and
    their mean (Combined MI), as one scored table with a ``model`` column.
    ``names`` are the features in the vector ``features_col``."""
    model = M.fit_forest(train, spec, features_col, len(names))
    bag = persist(model.score(valid, "prob").select(*KEEP, "prob"))
    return _family(bag, session_scores(train, valid, spec, {"ALL": names}).drop("model"), valid)


def classify(train: DataFrame, valid: DataFrame, system: str, names: Sequence[str],
             tuned: dict[str, M.ForestSpec] | None = None) -> DataFrame:
    """Default forest, tuned forest and the session family of one system, with the
    ``tuned`` parameters (default: the stored ones).  The three models of rows are fitted together."""
    tuned = tuned or M.TUNED[system]
    specs = {"Default random forest": M.DEFAULT_FOREST, "Optimized random forest": tuned["FOREST"], "Bagging": tuned["BAGGING"]}
    models = M.fit_forests(train, [(spec, None) for spec in specs.values()])
    scores = persist(M.score_all(models, valid, list(specs), KEEP))
    is_bag = F.col("model") == "Bagging"
    s_scored = session_scores(train, valid, tuned["BAGGING"], {"ALL": names}).drop("model")
    return _union([scores.where(~is_bag), _family(scores.where(is_bag).drop("model"), s_scored, valid)])


def run_system(log: DataFrame, system: str, time_label: str, train_start: str, validation_start: str,
               test_start: str, curves: bool = False) -> DataFrame:
    """One (time label, system) run: metrics per classifier and slice."""
    return execute(log, CAT.SYSTEMS[system](), system, time_label,
                   (train_start, validation_start, test_start), curves=curves, cache_input=True)["metrics"]


def execute(log: DataFrame, features: Sequence[CAT.Feature], system: str, time_label: str,
            bounds: tuple, on: str = "timestamp", label: str = "label", rank: bool = False,
            tune: bool = False, by_group: bool = False, curves: bool = True,
            cache_input: bool = False) -> dict[str, DataFrame]:
    """One run as result tables: ``metrics`` (classifiers by slice) and, where asked for,
    ``ranking``, ``grid`` (whose best points are then the tuned models' parameters) and
    ``groups``.  ``bounds`` are the starts of training, validation and test in ``on``."""
    train_start, validation_start, test_start = bounds
    table = build_table(log, features, validation_start, test_start, cache_input, on, label)
    train, valid = split(table, train_start, validation_start, test_start, on)
    names = CAT.output_columns(features, table.columns)
    tables, tuned = {}, M.TUNED[system]
    if rank:
        tables["ranking"] = feature_ranking(train, valid, features)
    if tune:
        tables["grid"], tuned = optimize(train, valid, len(names))
    tables["metrics"] = M.evaluate(classify(train, valid, system, names, tuned), ["model"], curves=curves)
    if by_group:
        tables["groups"] = group_classifiers(train, valid, features, system, tuned)
    return {name: t.select(F.lit(time_label).alias("time_label"), F.lit(system).alias("system"), "*")
            for name, t in tables.items()}


def run_all(spark: SparkSession, path: str, out: str, systems: dict | None = None, test: bool = False,
            rank: bool = False, tune: bool = False, by_group: bool = False, statistics: bool = False,
            backtest: bool = False, bounds: Callable[[bool], tuple] = K.revision_bounds,
            months: Sequence[tuple[str, str]] | None = None) -> list[str]:
    """From a CSV log to result tables: the log is written to ``out/log`` as typed Parquet
    once, then every system runs on the validation set and, with ``test``, on the test
    set.  Tables go to ``out/<table>/time_label=.../system=...``; their names are returned.

    Rankings and the group report are made for the first system only, the group
    report on the test set; parameters are tuned on the validation set and used in
    its run.  ``out`` is a folder that all executors share."""
    systems = systems or SETS.SYSTEMS
    stored = f"{out.rstrip('/')}/log"
    to_parquet(load_revisions(spark, path), stored)
    log = spark.read.parquet(stored)
    written = []

    def write(name: str, table: DataFrame) -> None:
        metrics_sink(table, f"{out.rstrip('/')}/{name}")
        written.append(name)

    if statistics:
        write("statistics", corpus_statistics(log, label=LABEL_COLUMN))
    first = next(iter(systems))
    for use_test in (False, True) if test else (False,):
        when = "TEST" if use_test else "VALIDATION"
        for system, make in systems.items():
            with releasing():
                tables = execute(log, make(), system, when, bounds(use_test), on="revisionId",
                                 label=LABEL_COLUMN, rank=rank and system == first,
                                 tune=tune and not use_test,
                                 by_group=by_group and use_test and system == first)
                for name, table in tables.items():
                    write(f"{name}/time_label={when}/system={system}", table.drop("time_label", "system"))
    if backtest:
        with releasing():
            write("backtest", expanding_backtest(
                log, K.BACKTEST_TRAINING_START, "", "", systems=systems, label=LABEL_COLUMN,
                at=months or month_windows()))
    return written


# ------------------------------------------------------------------ groups and ranking
def group_classifiers(train: DataFrame, valid: DataFrame, features: Sequence[CAT.Feature],
                      system: str, tuned: dict[str, M.ForestSpec] | None = None) -> DataFrame:
    """Default forest, tuned forest and the four models of the session family, each on all
    features and on each group."""
    tuned = tuned or M.TUNED[system]
    names = CAT.output_columns(features, train.columns)
    variants = [("ALL", names)] + [(g, CAT.output_columns(CAT.select_group(features, g), names))
                                   for g in CAT.groups(features)]
    specs = [("DFOREST", M.DEFAULT_FOREST), ("OFOREST", tuned["FOREST"]), ("BAGGING", tuned["BAGGING"])]
    # all models of rows are fitted together, and so are those of sessions
    jobs = [(f"{clf}|{group}", spec, cols) for clf, spec in specs for group, cols in variants]
    models = M.fit_forests(train, [(spec, M.places(train, names, cols)) for _, spec, cols in jobs])
    scores = persist(M.score_all(models, valid, [name for name, _, _ in jobs], KEEP))
    s_scored = persist(session_scores(train, valid, tuned["BAGGING"], dict(variants)))
    frames = [scores.where(~F.col("model").startswith("BAGGING|"))]
    for group, _ in variants:
        bag = scores.where(F.col("model") == f"BAGGING|{group}").drop("model")
        family = _family(bag, s_scored.where(F.col("model") == group).drop("model"), valid)
        frames.append(family.withColumn("model", F.concat(F.upper("model"), F.lit(f"|{group}"))))
    m = M.evaluate(_union(frames), ["model"], curves=False)
    return (m.withColumn("classifier", F.split("model", r"\|")[0])
             .withColumn("group", F.split("model", r"\|")[1]).drop("model"))


def feature_ranking(train: DataFrame, valid: DataFrame, features: Sequence[CAT.Feature]) -> DataFrame:
    """Default forest per feature, per subgroup and per group; validation
    metrics per slice plus training metrics on all rows."""
    names = CAT.output_columns(features, train.columns)
    units = [((f.group, f.subgroup, f.output), [f]) for f in features]
    units += [((g, sg, "ALL"), [f for f in features if (f.group, f.subgroup) == (g, sg)])
              for g, sg in CAT.subgroups(features)]
    units += [((g, "ALL", "ALL"), CAT.select_group(features, g)) for g in CAT.groups(features)]
    units = [(key, CAT.output_columns(some, names)) for key, some in units]

    models = M.fit_forests(train, [(M.DEFAULT_FOREST, M.places(train, names, cols)) for _, cols in units])
    labels = ["|".join(label) for label, _ in units]
    # the metrics read the scores more than once: only the narrow rows are kept
    val = M.evaluate(persist(M.score_all(models, valid, labels, KEEP)), ["model"], curves=False)
    trn = (CV.metrics_by_slice(persist(M.score_all(models, train, labels, ["label"])), "prob", "label", None, ["model"], curves=False)
           .where(F.col("slice") == "ALL")
           .select("model", F.col("ROC").alias("TRAINING_ROC"), F.col("PR").alias("TRAINING_PR")))
    wide = (val.groupBy("model").pivot("slice", ["ALL", "ITEM_HEAD", "ITEM_BODY"])
               .agg(*[F.first(c).alias(c) for c in ("positives", "negatives", "ROC", "PR")]))
    out = wide.join(trn, "model")
    parts = F.split("model", r"\|")
    return out.select(parts[0].alias("group"), parts[1].alias("subgroup"), parts[2].alias("feature"),
                      *[c for c in out.columns if c != "model"])


def rank_by_pr(ranking: DataFrame, pr: str = "ALL_PR") -> DataFrame:
    """Features (and aggregates) by validation PR area, best first."""
    return ranking.orderBy(F.desc(pr), "group", "subgroup", "feature")


def rank_by_group(ranking: DataFrame, features: Sequence[CAT.Feature], pr: str = "ALL_PR") -> DataFrame:
    """Group order, subgroup order with 'ALL' first, then PR descending with
    aggregate rows forced to the top (order value 1.0).  The ranking table
    has one row per feature/subgroup/group, so the final window is small."""
    g_order = {g: i for i, g in enumerate(CAT.groups(features))}
    sg_order = {"ALL": 0}
    for _, sg in CAT.subgroups(features):
        sg_order.setdefault(sg, len(sg_order))
    g_map = F.create_map(*[x for k, v in g_order.items() for x in (F.lit(k), F.lit(v))])
    sg_map = F.create_map(*[x for k, v in sg_order.items() for x in (F.lit(k), F.lit(v))])
    order = F.when(F.col("feature") == "ALL", F.lit(1.0)).otherwise(F.col(pr))
    w = Window.orderBy(g_map[F.col("group")], sg_map[F.col("subgroup")], F.desc(order), "feature")
    label = (F.when((F.col("subgroup") == "ALL") & (F.col("feature") == "ALL"), F.col("group"))
              .when(F.col("feature") == "ALL", F.col("subgroup")).otherwise(F.col("feature")))
    return ranking.select("*", label.alias("label"), F.row_number().over(w).alias("position"))


def report_order(metrics: DataFrame, systems: Sequence[str], classifiers: Sequence[str]) -> DataFrame:
    """Systems in run order, classifiers in reverse run order inside a system."""
    s_map = F.create_map(*[x for i, s in enumerate(systems) for x in (F.lit(s), F.lit(i))])
    c_map = F.create_map(*[x for i, c in enumerate(classifiers) for x in (F.lit(c), F.lit(i))])
    return metrics.orderBy(s_map[F.col("system")], F.desc(c_map[F.col("model")]), "slice")


# ------------------------------------------------------------------ tuning
def forest_grid() -> list[M.ForestSpec]:
    # The forest grid (max features x max depth, 10 trees).
    return [M.ForestSpec(10, d, f) for f in ("1", "2", "log2", "sqrt")
            for d in (1, 2, 4, 8, 16, 32, 64, None)]


def bagging_grid() -> list[M.ForestSpec]:
    return [M.ForestSpec(8, d, f, 16, 1 / 16) for f in ("1", "2", "log2", "sqrt")
            for d in (1, 2, 4, 8, 16, 32, 64, None)]


def sampling_grid() -> list[M.ForestSpec]:
    # one default forest on 1/2^i of the rows, i = 0..10, ten seeds each
    return [M.ForestSpec(10, None, "sqrt", 1, 1 / 2 ** i, 1000 + s) for i in range(11) for s in range(10)]


def grid_search(train: DataFrame, valid: DataFrame, specs: Sequence[M.ForestSpec],
                n_features: int) -> DataFrame:
    """Every grid point ('2' features dropped when there is one feature): validation metrics
    on all rows.  Points that coincide under MLlib's depth limit are fitted once and
    keep a row each; ``model`` is the point's number, ``depth`` null where unlimited.
    ``train_rows`` and ``train_positives`` are the rows the point draws from: its own sample for a
    single forest, all of ``train`` for bagging (whose members draw theirs)."""
    return search_grids(train, valid, {"": specs}, n_features).drop("grid")


def search_grids(train: DataFrame, valid: DataFrame, wanted: dict[str, Sequence[M.ForestSpec]],
                 n_features: int) -> DataFrame:
    """Several grids (see ``grid_search``; column ``grid``), whose points are fitted, scored and
    measured together."""
    points = [(name, i, s) for name, specs in wanted.items() for i, s in enumerate(
        [s for s in specs if not (n_features < 2 and s.features == "2")])]
    fits = M.capped([s for _, _, s in points])
    fit_of = {s.key(): i for i, s in enumerate(fits)}

    models = M.fit_forests(train, [(s, None) for s in fits], n_features=n_features)
    # all points are scored together, and only the narrow scores are kept
    scores = persist(M.score_all(models, valid, [str(i) for i in range(len(fits))], ["label"]))
    m = (CV.metrics_by_slice(scores, "prob", "label", None, ["model"], curves=False).where(F.col("slice") == "ALL")
         .withColumnRenamed("model", "__fit"))
    seen = sample_sizes(train, [s for _, _, s in points])
    params = train.sparkSession.createDataFrame(
        [(str(fit_of[s.key()]), name, str(i), s.trees, s.depth, s.features, s.bags, float(s.sample), s.seed, *seen[s.key()])
         for name, i, s in points],
        "__fit string, grid string, model string, trees int, depth int, features string, bags int, sample double, seed int, "
        "train_rows long, train_positives long")
    # one row per grid point
    return m.join(F.broadcast(params), "__fit").drop("__fit")


def sample_sizes(train: DataFrame, points: Sequence[M.ForestSpec]) -> dict[tuple, tuple[int, int]]:
    """Rows and positives that each point draws from, all counted in one pass."""
    draws = {s.key(): (s.sample if s.bags <= 1 else 1.0, s.seed if s.bags <= 1 and s.sample < 1.0 else 0) for s in points}
    each = sorted(set(draws.values()))
    # a row's hash is made once per seed
    hashed = train.select((F.col("label") > 0).alias("__p"), *[share_hash(seed=seed).alias(f"__h{seed}") for seed in {s for _, s in each}])
    within = [F.lit(True) if share >= 1.0 else F.col(f"__h{seed}") < int(share * 2 ** 32) for share, seed in each]
    counted = [F.struct(F.count_if(c).alias("n"), F.count_if(c & F.col("__p")).alias("p")).alias(f"s{i}")
               for i, c in enumerate(within)]
    row = hashed.agg(*counted).first()
    return {k: tuple(row[f"s{each.index(d)}"]) for k, d in draws.items()}


def best_params(grid: DataFrame, pr: str = "PR") -> DataFrame:
    """The grid point with the largest PR area (ties: first point)."""
    return grid.agg(F.max_by(F.struct("trees", "depth", "features", "bags", "sample", "seed", pr),
                             F.struct(F.col(pr), -F.col("model").cast("int"))).alias("best")).select("best.*")


def grids() -> dict[str, list[M.ForestSpec]]:
    """The 174 points of the three grids, in order."""
    return {"FOREST": forest_grid(), "BAGGING": bagging_grid(), "SAMPLING": sampling_grid()}


def optimize(train: DataFrame, valid: DataFrame, n_features: int):
    """All three grids of one system (forest, bagging, sampling): the metric
    table of every grid point (column ``grid``) and the best point per grid
    as ``ForestSpec`` values, ready for the tuned runs."""
    table, best = persist(search_grids(train, valid, grids(), n_features)), {}
    for name in grids():
        b = best_params(table.where(F.col("grid") == name)).first()
        best[name] = M.ForestSpec(b["trees"], b["depth"], b["features"], b["bags"], b["sample"], b["seed"])
    return table, best


# ------------------------------------------------------------------ cross validation
def stratified_folds(df: DataFrame, k: int = 5, key: str = "revisionId", seed: int = 1) -> DataFrame:
    """Fold = (rank inside the class by a seeded hash) mod k: exact
    stratification, ranks from the segmented running count (no per-class
    single-task window)."""
    d = df.withColumn("__h", hash_order(key, seed))
    r = C.running(d, ["label"], {"__rk": ("count", None)}, order="__h",
                  chunk_col=F.shiftright(F.col("__h"), ORDER_BITS - 16))
    return r.withColumn("fold", ((F.col("__rk") - 1) % k).cast("int")).drop("__h", "__rk")


def brier_score(scored: DataFrame) -> DataFrame:
    """A scorer: the mean squared distance of score and label, per model."""
    return scored.groupBy("model").agg(F.avg(F.pow(F.col("prob") - F.col("label"), 2)).alias("value"))


def cross_validation(train: DataFrame, valid: DataFrame, k: int = 5,
                     scorers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Train and validation rows together, 1:1 undersampled, k stratified
    folds, default forest; mean and std of ROC and PR areas over folds.

    ``scorers`` are the user's measures by name.  Each is a function of the scored rows of all
    folds (columns ``KEEP``, ``prob`` and ``model``, the fold's number as text) to one row
    ``model, value`` per fold, so that a single pass scores all folds; they add
    ``{name}_mean`` and ``{name}_std``."""
    from ..operators.splits import undersample
    data = persist(stratified_folds(undersample(train.unionByName(valid), 1.0)))

    def one(i):
        scored, _, _, _ = M.fit_predict(data.where(F.col("fold") != i), data.where(F.col("fold") == i),
                                        M.DEFAULT_FOREST)
        return _scored(scored, str(i))
    with ThreadPoolExecutor(M.PARALLEL_FITS) as ex:
        frames = list(ex.map(one, range(k)))
    scored = _union(frames)
    m = M.evaluate(scored, ["model"], curves=False).where(F.col("slice") == "ALL")
    own = []
    for name, scorer in (scorers or {}).items():
        m = m.join(scorer(scored).select("model", F.col("value").cast("double").alias(f"__{name}")), "model", "left")
        own += [F.avg(f"__{name}").alias(f"{name}_mean"), F.stddev_pop(f"__{name}").alias(f"{name}_std")]
    return m.agg(F.avg("ROC").alias("roc_mean"), F.stddev_pop("ROC").alias("roc_std"),
                 F.avg("PR_trapezoid").alias("pr_mean"), F.stddev_pop("PR_trapezoid").alias("pr_std"),
                 F.count(F.lit(1)).alias("folds"), *own)


# ------------------------------------------------------------------ backtest
def _add_months(d: dt.datetime, months: int) -> dt.datetime:
    m = d.month - 1 + months
    return d.replace(year=d.year + m // 12, month=m % 12 + 1)


def windows(train_start: str, first_validation: str, end: str, step_days: int = 7,
            step_months: int | None = None) -> list[tuple[str, str]]:
    """(validation start, test start) pairs: the validation window and the
    step have the same length (days, or calendar months when ``step_months``
    is given); the last test start is at most ``end``."""
    fmt = "%Y-%m-%d %H:%M:%S"
    stop = dt.datetime.strptime(end, fmt)

    def nxt(x):
        return _add_months(x, step_months) if step_months else x + dt.timedelta(days=step_days)
    v = dt.datetime.strptime(first_validation, fmt)
    out = []
    while nxt(v) <= stop:
        out.append((v.strftime(fmt), nxt(v).strftime(fmt)))
        v = nxt(v)
    return out


def month_windows() -> list[tuple[str, str]]:
    """The real corpus' backtest: from 2013-05-01, two-month windows and steps."""
    fmt = "%Y-%m-%d %H:%M:%S"
    first = _add_months(dt.datetime.strptime(K.BACKTEST_TRAINING_START, fmt), K.BACKTEST_VALIDATION_MONTHS)
    return windows(K.BACKTEST_TRAINING_START, first.strftime(fmt), K.BACKTEST_END,
                   step_months=K.BACKTEST_STEP_MONTHS)


def expanding_backtest(log: DataFrame, train_start: str, first_validation: str, end: str,
                       step_days: int = 7, systems: dict[str, Callable] | None = None,
                       step_months: int | None = None, label: str = "label",
                       at: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Train from the start to t, validate [t, t + step): the main system runs
    the session family, the baselines the default forest; adds the positive
    fraction of each validation window.  ``at`` gives the windows themselves.

    The features of a system are made for all windows together (``plans.expanding``) and
    written once, a folder per window; sets with steps that cannot be are rebuilt per window."""
    frames = []
    spans = list(at or windows(train_start, first_validation, end, step_days, step_months))
    for system, make in (systems or CAT.SYSTEMS).items():
        features = make()
        together = None
        if expandable(features):
            t = expanding_features(log, features, [(_bound(v), _bound(e)) for v, e in spans], label=label)
            together = stored(M.assemble(t, CAT.output_columns(features, t.columns)), "backtest", [WINDOW])
        for i, (v_start, t_start) in enumerate(spans):
            span = f"{v_start[:10]} to {t_start[:10]}"
            table = together.where(F.col(WINDOW) == i).drop(WINDOW) if together is not None else build_table(
                log, features, v_start, t_start, label=label)
            names = CAT.output_columns(features, table.columns)
            train, valid = split(table, train_start, v_start, t_start)
            if system == "MAIN":
                scored = session_family(train, valid, M.TUNED[system]["BAGGING"], names)
            else:
                scored, _, _ = forest_run(train, valid, M.DEFAULT_FOREST, "Default random forest")
            m = M.evaluate(scored, ["model"], curves=False)
            frac = valid.agg(F.avg("label")).first()[0]  # one scalar
            frames.append(m.select(F.lit(span).alias("time_label"), F.lit(system).alias("system"), "*",
                                   F.lit(frac).cast("double").alias("VANDALISM_FRACTION")))
    return _union(frames)


