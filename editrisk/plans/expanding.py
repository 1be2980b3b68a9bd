"""Feature tables of expanding windows, made together.

A backtest fits the same features on ever longer prefixes of the log and applies them to
the rows before each window's end.  Nothing is rebuilt per window here:

* running features look back only, so they are made once for the whole log (ids must
  not decrease with time);
* a lookup's fit is a prefix: the log is aggregated once per (keys, stretch between
  two window starts), and the states of a stretch are merged into every window after it.
  What fans out over the windows is one state per key, not the rows.  Aggregates
  without mergeable states (distinct counts) are grouped by (window, keys);
* means and medians are one grouped pass for all windows;
* custom steps (text models) are fitted per window, as each has a model of its own.

The rows, once per window that covers them, take the lookups as in ``pipeline``: measured,
broadcast within the bounds, else joined on projections and brought back by (id, window).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_float32
from ..operators.cumulative import run_batch
from ..operators.quantiles import grouped_median
from ..session import is_small, persist
from ..sources.csv_log import prune_columns
from .catalog import Feature
from .pipeline import META, ORDER, TABLES_AT_ONCE, _check_unique, _look_up

WINDOW = "window"
FROM = "__fit_from"  # the first window whose fit covers the row


def expandable(features: Sequence[Feature]) -> bool:
    """Whether the features can be made for all windows together: running steps come first in
    their chain, and no step gives several columns or vectors (which differ by window)."""
    return all(s.kind != "window" for f in features for s in f.steps[1:]) and not any(
        getattr(s, "many", False) or getattr(s, "vector", False) for f in features for s in f.steps)


def _after(on: str, bounds: Sequence[Column]) -> Column:
    """How many of the bounds the row is not before."""
    return reduce(add, [F.when(F.col(on) >= b, 1).otherwise(0) for b in bounds])


def _with_running(rows: DataFrame, features: Sequence[Feature]) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with the running features, and their columns by feature."""
    made, by_window = {}, OrderedDict()
    for f in features:
        if f.steps and f.steps[0].kind == "window":
            s, made[f.output] = f.steps[0], f"__{f.output}__run"
            keys = tuple(s.running_op(rows, f.inputs, made[f.output]).keys)
            by_window.setdefault((keys, s.chunk_width), []).append((f, s))
    out = rows
    for (keys, chunk), items in by_window.items():
        narrow = rows.select(*dict.fromkeys([ORDER, *keys, *[c for f, _ in items for c in f.inputs]]))
        ops = [s.running_op(narrow, f.inputs, made[f.output]) for f, s in items]
        done = run_batch(narrow, ops, chunk_width=chunk).select(ORDER, *[o.out for o in ops])
        out = out.join(done, ORDER, "left")
    return out, made


def expanding_features(log: DataFrame, features: Sequence[Feature], windows: Sequence[tuple[Column, Column]],
                       on: str = "timestamp", label: str = "label", meta: Sequence[str] = META) -> DataFrame:
    """The feature tables of all ``windows`` as one, with the window's number as ``window``.

    A window is (validation start, end) in the column ``on``, both increasing from window to
    window.  Its table holds the rows before its end, with features fitted on the rows before
    its start: the same as ``feature_pipeline`` gives for these rows alone."""
    if not expandable(features):
        raise ValueError("running steps come first, and features have one column")
    _check_unique(features)
    starts, ends = zip(*windows)
    last = len(windows) - 1
    columns = prune_columns([f.inputs for f in features], [*meta, on], label)
    rows = log.where(F.col(on) < ends[-1]).select(*columns)
    rows, running = _with_running(rows, features)
    rows = persist(rows.withColumn(FROM, _after(on, starts)))
    chains = {f.output: f.steps[1:] if f.output in running else f.steps for f in features}
    current = {f.output: [running[f.output]] if f.output in running else list(f.inputs) for f in features}
    cur = rows.withColumn(WINDOW, F.explode(F.sequence(_after(on, ends), F.lit(last))))

    for r in range(max(map(len, chains.values()), default=0)):
        active = [(f, chains[f.output][r]) for f in features if r < len(chains[f.output])]
        tmp = {f.output: f"__{f.output}__{r}" for f, _ in active}
        start = cur if r == 0 else persist(cur)
        fit_rows = start.where(F.col(WINDOW) >= F.col(FROM))
        cur = start

        # scalar steps: a row per window, so the broadcast is bounded by the number of windows
        scalars = [(f, s) for f, s in active if s.kind == "scalar"]
        means = [f for f, s in scalars if s.stat == "mean"]
        tables = [grouped_median(fit_rows, WINDOW, current[f.output][0], f"__{f.output}__stat")
                  for f, s in scalars if s.stat == "median"]
        if means:
            tables.append(fit_rows.groupBy(WINDOW).agg(*[
                F.avg(F.col(current[f.output][0]).cast("double")).alias(f"__{f.output}__stat") for f in means]))
        for table in tables:
            cur = cur.join(F.broadcast(table), WINDOW, "left")
        if scalars:
            cur = cur.withColumns({tmp[f.output]: s.apply(current[f.output][0], {"v": F.col(f"__{f.output}__stat")}, "v")
                                   for f, s in scalars}).drop(*[f"__{f.output}__stat" for f, _ in scalars])

        # lookup steps: states of the stretches merged into the windows
        by_keys: OrderedDict = OrderedDict()
        for f, s in active:
            if s.kind == "lookup":
                by_keys.setdefault((tuple(s.keys(current[f.output])), s.null_safe, s.parts is not None), []).append((f, s))

        def lookup_table(job):
            (keys, _, mergeable), items = job
            f, s = items[0]
            known = s.fit_filter(current[f.output])
            if r == 0 and mergeable:
                states = rows.where(known & (F.col(FROM) <= last)).groupBy(*keys, FROM).agg(
                    *[s.state_expr(current[f.output]).alias(tmp[f.output]) for f, s in items])
                table = states.withColumn(WINDOW, F.explode(F.sequence(F.col(FROM), F.lit(last)))).groupBy(
                    WINDOW, *keys).agg(*[s.parts.merge(F.col(tmp[f.output])).alias(tmp[f.output]) for f, s in items])
            else:
                table = fit_rows.where(known).groupBy(WINDOW, *keys).agg(
                    *[s.agg_expr(current[f.output]).alias(tmp[f.output]) for f, s in items])
            table = persist(table)
            return table, is_small(table)
        with ThreadPoolExecutor(TABLES_AT_ONCE) as ex:
            tables = list(ex.map(lookup_table, by_keys.items()))
        by_id: list[DataFrame] = []  # (id, window, values)
        defaults = {}
        for ((keys, null_safe, _), items), (table, small) in zip(by_keys.items(), tables):
            values, keys = [tmp[f.output] for f, _ in items], [WINDOW, *keys]
            if small:
                cur = _look_up(cur, table, keys, values, null_safe, "left", True)
            else:
                pairs = start.select(*dict.fromkeys([ORDER, *keys]))
                by_id.append(_look_up(pairs, table, keys, values, null_safe, "inner", False)
                             .select(ORDER, WINDOW, *values))
            for f, s in items:
                defaults[tmp[f.output]] = F.coalesce(F.col(tmp[f.output]).cast("double"),
                                                     F.lit(s.default).cast("double"))

        # custom steps: a fit per window, rows counted per id
        checks = {}
        for i, (f, s) in enumerate(active):
            if s.kind == "custom":
                n = f"__rows_{i}"
                checks[n] = f"step {s.name} of feature {f.output} must return every row once"
                parts = []
                for w, begin in enumerate(starts):
                    narrow = start.where(F.col(WINDOW) == w).select(*dict.fromkeys([ORDER, *current[f.output], on]))
                    done = s.fit_transform(narrow, current[f.output], tmp[f.output], F.col(on) < begin)
                    parts.append(done.groupBy(ORDER).agg(F.count(F.lit(1)).alias(n), F.first(tmp[f.output]).alias(
                        tmp[f.output])).withColumn(WINDOW, F.lit(w)))
                by_id.append(reduce(DataFrame.unionByName, parts))
        for part in by_id:
            cur = cur.join(part, [ORDER, WINDOW], "left")
        for n, message in checks.items():
            once = F.coalesce(F.col(n), F.lit(0)) == 1
            cur = cur.where(F.assert_true(once, message).isNull()).drop(n)
        cur = cur.withColumns(defaults)

        exprs = [(f, s) for f, s in active if s.kind == "expr"]
        cur = cur.select("*", *[s.expr(current[f.output]).alias(tmp[f.output]) for f, s in exprs])
        for f, _ in active:
            current[f.output] = [tmp[f.output]]

    outs = [finite_float32(F.col(current[f.output][0]).cast("double")).alias(f.output) for f in features]
    return cur.select(*dict.fromkeys([WINDOW, *meta, on]), *outs, F.col(label).cast("double").alias("label"))
