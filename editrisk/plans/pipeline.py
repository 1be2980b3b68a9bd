"""The feature pipeline: every feature's step chain, fitted on the fit rows
and applied to all rows, batched into few Spark jobs.

Steps are applied in rounds (round r = the r-th step of every feature):

* scalar steps (mean/median imputers): means of all features in ONE ``agg``;
  medians by the distributed exact quantile (no single-task gather);
* lookup steps: one ``groupBy`` per distinct key set, with all the round's
  aggregates on that key set.  The tables of a round are made side by side and
  measured: those within the bounds are broadcast to the rows, the others are
  joined to a projection of (id, keys), where AQE splits hot keys;
* window steps: segmented prefix scans (``operators.cumulative``), all
  running operators of one key set in one scan (one shuffle) of (id, keys, values);
* custom steps: their own plan on (id, inputs);
* expression steps: one ``select``.

What was made on projections comes back as tables of (id, values), which are joined to
the rows on the id one after the other: the rows are dealt by id for the first of
these joins and stay so for the others.  However many key sets there are, a
round shuffles the wide rows at most once.  Revision ids are unique.

Only the columns the features need are read (``prune_columns``).  The result is one table:
meta columns, one float column per feature (a vector where its last step gives one) and
the label.

A custom step must return every row of its input once: otherwise the table fails,
naming step and feature, when it is made (rows of ids it was not given are left out).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_float32
from ..session import is_small, join_lookup, persist
from ..operators.cumulative import run_batch
from ..operators.quantiles import exact_medians
from ..sources.csv_log import prune_columns
from .catalog import Feature, feature_names

META = ["revisionId", "groupId", "contentType", "timestamp"]
ORDER = "revisionId"
TABLES_AT_ONCE = 8  # lookup tables of a round that are made side by side


def _time_cols(df: DataFrame) -> list[str]:
    # the fit predicate of custom steps may refer to the timestamp
    return [c for c in ("timestamp",) if c in df.columns]


def _check_unique(features: Sequence[Feature]) -> None:
    names = [f.output for f in features]
    dup = {n for n in names if names.count(n) > 1}
    if dup:
        raise ValueError(f"duplicate column: {sorted(dup)}")


def _look_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str],
             null_safe: bool, how: str, small: bool) -> DataFrame:
    """``rows`` with the ``values`` of their keys (``null_safe``: a missing part is a key too)."""
    if not null_safe:
        return join_lookup(rows, table, keys, how, small=small)
    right = table.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *values)
    match = reduce(and_, [rows[k].eqNullSafe(right[f"__k_{k}"]) for k in keys])
    return join_lookup(rows, right, match, how, small=small).drop(*[f"__k_{k}" for k in keys])


def feature_pipeline(df: DataFrame, features: Sequence[Feature], fit: Column | None,
                     label: str = "label", meta: Sequence[str] = META,
                     cache_input: bool = False) -> DataFrame:
    """Feature table of ``df``; ``cache_input`` also caches the pruned input
    (worth it when the input is derived by costly expressions, not for a
    typed Parquet log, whose pruned columns are cheaper to re-read)."""
    _check_unique(features)
    cols = prune_columns([f.inputs for f in features], meta, label)
    cur = df.select(*cols)
    current = {f.output: list(f.inputs) for f in features}
    rounds = max((len(f.steps) for f in features), default=0)
    for r in range(rounds):
        active = [(f, f.steps[r]) for f in features if r < len(f.steps)]
        tmp = {f.output: f"__{f.output}__{r}" for f, _ in active}
        # Every fit of this round reads the round's start table.  From round 1
        # on it carries computed features and is cached once, so the plan
        # stays linear in the number of features; round 0 is the pruned scan
        # itself, which is cheaper to re-read than to cache.
        start = cur if (r == 0 and not cache_input) else persist(cur)
        fit_rows = start if fit is None else start.where(fit)
        cur = start

        # scalar steps: one agg for the means, distributed exact medians
        scalars = [(f, s) for f, s in active if s.kind == "scalar"]
        if scalars:
            means = [(f, s) for f, s in scalars if s.stat == "mean"]
            stats = {}
            if means:
                row = fit_rows.agg(*[F.avg(F.col(current[f.output][0]).cast("double")).alias(f.output)
                                     for f, _ in means]).first()
                stats.update(row.asDict())
            medians = [f for f, s in scalars if s.stat == "median"]
            if medians:
                stats.update(exact_medians(fit_rows, {f.output: current[f.output][0] for f in medians}))
            cur = cur.select("*", *[s.apply(current[f.output][0], {"v": stats[f.output]}, "v").alias(tmp[f.output])
                                    for f, s in scalars])

        # lookup steps: one groupBy per (key set, null rule), measured
        by_keys: OrderedDict = OrderedDict()
        for f, s in active:
            if s.kind == "lookup":
                key = (tuple(s.keys(current[f.output])), s.null_safe)
                by_keys.setdefault(key, []).append((f, s))

        def lookup_table(job):
            (keys, _), items = job
            f, s = items[0]
            table = persist(fit_rows.where(s.fit_filter(current[f.output])).groupBy(*keys).agg(
                *[s.agg_expr(current[f.output]).alias(tmp[f.output]) for f, s in items]))
            return table, is_small(table)
        with ThreadPoolExecutor(TABLES_AT_ONCE) as ex:
            tables = list(ex.map(lookup_table, by_keys.items()))

        by_id: list[DataFrame] = []  # (id, values), to be joined to the rows
        defaults = {}
        for ((keys, null_safe), items), (table, small) in zip(by_keys.items(), tables):
            values = [tmp[f.output] for f, _ in items]
            if small:
                cur = _look_up(cur, table, keys, values, null_safe, "left", True)
            else:
                pairs = start.select(*dict.fromkeys([ORDER, *keys]))
                by_id.append(_look_up(pairs, table, keys, values, null_safe, "inner", False).select(ORDER, *values))
            for f, s in items:
                default = F.lit(s.default).cast("double")
                defaults[tmp[f.output]] = F.coalesce(F.col(tmp[f.output]).cast("double"), default)

        # window steps: all running operators of one key set in ONE segmented
        # scan, on a narrow projection of the round's start (id, keys, values)
        by_window: OrderedDict = OrderedDict()
        for f, s in active:
            if s.kind == "window":
                op = s.running_op(start, current[f.output], tmp[f.output])
                by_window.setdefault((tuple(op.keys), s.chunk_width), []).append((f, s, op))
        for (keys, width), items in by_window.items():
            cols = [ORDER, *keys]
            for f, _, _ in items:
                cols += current[f.output]
            narrow = start.select(*dict.fromkeys(cols))
            ops = [s.running_op(narrow, current[f.output], tmp[f.output]) for f, s, _ in items]
            w = run_batch(narrow, ops, chunk_width=width)
            by_id.append(w.select(ORDER, *[tmp[f.output] for f, _, _ in items]))

        # custom steps (text models, tags ...): their own plan, rows counted per id
        many: dict[str, list[str]] = {}
        checks = {}
        for i, (f, s) in enumerate(active):
            if s.kind == "custom":
                narrow = start.select(*dict.fromkeys([ORDER, *current[f.output], *_time_cols(start)]))
                w = s.fit_transform(narrow, current[f.output], tmp[f.output], fit)
                made = [tmp[f.output]]
                if s.many:
                    made = many[f.output] = [c for c in w.columns if c.startswith(f"{tmp[f.output]}_")]
                n = f"__rows_{i}"
                checks[n] = f"step {s.name} of feature {f.output} must return every row once"
                by_id.append(w.groupBy(ORDER).agg(F.count(F.lit(1)).alias(n),
                                                  *[F.first(f"`{c}`").alias(c) for c in made]))

        for part in by_id:
            cur = cur.join(part, ORDER, "left")
        for n, message in checks.items():
            once = F.coalesce(F.col(n), F.lit(0)) == 1
            cur = cur.where(F.assert_true(once, message).isNull()).drop(n)
        cur = cur.withColumns(defaults)

        # expression steps: one select
        exprs = [(f, s) for f, s in active if s.kind == "expr"]
        if exprs:
            cur = cur.select("*", *[s.expr(current[f.output]).alias(tmp[f.output]) for f, s in exprs])

        for f, _ in active:
            current[f.output] = many.get(f.output, [tmp[f.output]])

    outs = []
    for f in features:
        src = current[f.output]
        names = [f.output]
        if f.steps and getattr(f.steps[-1], "many", False):
            names = [f.output + c[len(f"__{f.output}__{len(f.steps) - 1}"):] for c in src]
        elif len(src) != 1:
            raise ValueError(f"feature {f.output} ends with {len(src)} columns")
        if f.steps and getattr(f.steps[-1], "vector", False):
            outs.append(F.col(src[0]).alias(f.output))
            continue
        outs += [finite_float32(F.col(f"`{c}`").cast("double")).alias(n) for c, n in zip(src, names)]
    return cur.select(*[F.col(m) for m in meta], *outs, F.col(label).cast("double").alias("label"))
