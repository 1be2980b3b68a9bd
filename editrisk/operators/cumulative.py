"""Running ("up to now") operators per key, ordered by the revision id.

Plain ``Window.partitionBy(keys).orderBy(id)`` puts every row of a key into
one task; a bot user holding a third of the log would be one task.  All
operators here are therefore *segmented prefix scans*:

1. each row gets a chunk number ``floor(id / chunk_width)``;
2. a window over ``(keys, chunk)`` gives the running value inside the chunk
   (a hot key is spread over all of its chunks);
3. the last local value of each chunk is its total (a groupBy on the
   columns the local scan is already partitioned by: no extra shuffle), and
   a window over that small table gives the total of all *earlier* chunks
   of the key (the offset);
4. offset and local value are combined after a join on ``(keys, chunk)``;
   the row side is already partitioned on those columns by step 2, so only
   the small offset table moves (or it is broadcast after a size check).

The result equals the plain window for any ``chunk_width`` (tested).
Rows whose key has a missing part are skipped, as in the reference:
running sums then give 0, distinct counts give missing, the previous value
gives ``'NA'``.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, join_lookup, persist

ORDER = "revisionId"
# Revision ids per chunk.  Chosen so that a chunk of the busiest key fits a
# task comfortably at full scale; any value gives the same results.
DEFAULT_CHUNK_WIDTH = 1 << 20

_KINDS = ("count", "sum", "min", "max", "last_before")


@dataclass(frozen=True)
class Scan:
    """A running function given by the user, as column expressions over any state.

    ``add`` aggregates values to a state (an aggregate function, usable over a window),
    ``merge`` aggregates states of consecutive stretches, ``combine`` joins the state before a
    stretch with the state inside it, and ``finish`` turns a state into the result.  States
    may be numbers, structs or sketches; null means that no value has been seen.
    """

    add: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda state: state


def _any_null(keys: Sequence[str]) -> Column:
    cond = F.lit(False)
    for k in keys:
        cond = cond | F.col(k).isNull()
    return cond


def running(df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, str | None]],
            order: str = ORDER, chunk_width: int = DEFAULT_CHUNK_WIDTH,
            chunk_col: Column | None = None) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order`` (inclusive frame).

    ``specs`` maps an output name to ``(kind, value column)``:

    * ``count``       - rows so far (value column ignored)
    * ``sum``         - sum of the values so far, missing values add 0
    * ``min``/``max`` - running min / max of the non-missing values
    * ``last_before`` - last non-missing value strictly before this row
    * a ``Scan``      - the user's running function of the value column

    Rows with a missing key get NULL; callers apply the operator's rule.
    ``chunk_col`` replaces the id-range chunks by any expression that does
    not decrease along ``order`` (e.g. a score bucket).
    """
    keys = list(keys)
    chunk = "__chunk"
    if chunk_col is None:
        chunk_col = F.floor(F.col(order) / F.lit(chunk_width)).cast("bigint")
    rows = df.withColumn(chunk, chunk_col)
    part = keys + [chunk]
    w_loc = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    w_before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    local_cols, total_aggs, offset_cols = [], [], []
    w_tot = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    for out, (kind, value) in specs.items():
        if kind not in _KINDS and not isinstance(kind, Scan):
            raise ValueError(f"unknown running kind {kind}")
        loc, tot, off = f"__{out}_loc", f"__{out}_tot", f"__{out}_off"
        v = F.col(value) if value else None
        lc = F.col(loc)
        # chunk totals are read off the local scan (its last row per chunk)
        if isinstance(kind, Scan):
            local_cols.append(kind.add(v).over(w_loc).alias(loc))
            total_aggs.append(F.max_by(lc, F.col(order)).alias(tot))
            offset_cols.append(kind.merge(F.col(tot)).over(w_tot).alias(off))
        elif kind == "count":
            local_cols.append(F.count(F.lit(1)).over(w_loc).alias(loc))
            total_aggs.append(F.max(lc).alias(tot))
            offset_cols.append(F.coalesce(F.sum(tot).over(w_tot), F.lit(0)).alias(off))
        elif kind == "sum":
            local_cols.append(F.sum(F.coalesce(v, F.lit(0))).over(w_loc).alias(loc))
            total_aggs.append(F.max_by(lc, F.col(order)).alias(tot))
            offset_cols.append(F.sum(tot).over(w_tot).alias(off))
        elif kind in ("min", "max"):
            fn = F.min if kind == "min" else F.max
            local_cols.append(fn(v).over(w_loc).alias(loc))
            total_aggs.append(fn(lc).alias(tot))
            offset_cols.append(fn(tot).over(w_tot).alias(off))
        else:  # last_before
            local_cols.append(F.last(v, ignorenulls=True).over(w_before).alias(loc))
            total_aggs.append(F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(tot))
            offset_cols.append(F.last(tot, ignorenulls=True).over(w_tot).alias(off))

    # One shuffle of the rows: the local scan is partitioned by (keys, chunk),
    # so the chunk totals (a groupBy on the same columns) and the final join
    # on them need no further exchange of the rows; only the small offset
    # table moves.  Rows with a missing key part are computed along (their
    # window never matches an offset) and masked at the end.
    # ``local`` is cached: its totals and the final join read the same scan
    # (otherwise the optimizer's inferred null filters would make the totals
    # branch shuffle the rows a second time)
    local = persist(rows.select("*", *local_cols))
    totals = local.groupBy(*part).agg(*total_aggs)
    # (no key filter here: it would be pushed below the window and stop the
    # local scan's shuffle from being reused; missing keys never join)
    offsets = totals.select(*part, *offset_cols)
    joined = join_lookup(local, offsets, part, "left")

    masked = _any_null(keys)
    outs = []
    for out, (kind, _value) in specs.items():
        loc, off = F.col(f"__{out}_loc"), F.col(f"__{out}_off")
        if isinstance(kind, Scan):
            val = kind.finish(F.when(off.isNull(), loc).when(loc.isNull(), off).otherwise(kind.combine(off, loc)))
        elif kind == "count":
            val = loc + F.coalesce(off, F.lit(0))
        elif kind == "sum":
            val = F.when(off.isNull(), loc).otherwise(loc + off)
        elif kind == "min":
            val = F.least(loc, off)
        elif kind == "max":
            val = F.greatest(loc, off)
        else:
            val = F.coalesce(loc, off)
        outs.append(F.when(~masked, val).alias(out))
    return joined.select(*[F.col(c) for c in df.columns], *outs)


def number_in_order(df: DataFrame, by: str, out: str = "position") -> DataFrame:
    """``df`` sorted by ``by``, with the place of every row (from 1).

    The sort deals the rows into ranges, and places go on from the rows of the ranges before:
    only one count per range meets in one task.  The sorted rows are checkpointed, so
    that places never change when an executor is lost.
    """
    placed = cut_lineage(df.orderBy(by).withColumn("__place", F.monotonically_increasing_id()))
    # the upper bits of the id are the range
    return running(placed, [], {out: ("count", None)}, order="__place",
                   chunk_col=F.shiftright("__place", 33)).drop("__place")


def first_occurrence(df: DataFrame, keys: Sequence[str], value: str,
                     order: str = ORDER, flag: str = "__first") -> DataFrame:
    """Flag the row where ``value`` appears for the first time within ``keys``.

    The first id per (keys, value) comes from a grouped ``min`` (partial
    aggregation absorbs hot pairs); the flag is joined back on the unique
    row id, which cannot be skewed.
    """
    firsts = (df.where(~_any_null(keys) & F.col(value).isNotNull())
                .groupBy(*keys, value).agg(F.min(order).alias(order))
                .select(order, F.lit(1).alias(flag)))
    return df.join(firsts, order, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


# --------------------------------------------------------------------------
# Operators.  Each is a ``RunningOp``: helper columns to add first (``pre``),
# scan specs for ``running`` and the expression of the result (``post``).
# ``run_batch`` evaluates any number of operators sharing one key set in ONE
# segmented scan (one shuffle); the single-operator functions below use it.
# --------------------------------------------------------------------------

@dataclass
class RunningOp:
    keys: list[str]
    out: str
    specs: dict[str, tuple[str, str | None]]
    post: Column
    pre: list = field(default_factory=list)  # [(name, Column)] or ("first", keys, value, name)
    helpers: list[str] = field(default_factory=list)


def _ts_micros(df: DataFrame, ts: str) -> Column:
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        # wall-clock difference, independent of the session time zone
        return F.timestamp_diff("MICROSECOND", F.lit(datetime.datetime(1970, 1, 1)).cast("timestamp_ntz"),
                                F.col(ts))
    return F.unix_micros(F.col(ts))


def op_cum_frequency(keys, out, df=None) -> RunningOp:
    """1-based running count of the key tuple; missing key -> missing."""
    c = f"__{out}_c"
    return RunningOp(list(keys), out, {c: ("count", None)}, F.col(c).cast("bigint"), helpers=[c])


def op_cum_count(keys, out, df=None) -> RunningOp:
    """0-based running count; missing key -> 0."""
    c = f"__{out}_c"
    return RunningOp(list(keys), out, {c: ("count", None)}, F.coalesce(F.col(c) - 1, F.lit(0)), helpers=[c])


def op_cum_sum(keys, value, out, df=None) -> RunningOp:
    """Running sum of ``value`` (missing adds 0); missing key -> 0."""
    c = f"__{out}_s"
    return RunningOp(list(keys), out, {c: ("sum", value)},
                     F.coalesce(F.col(c).cast("double"), F.lit(0.0)), helpers=[c])


def _op_extreme(kind, keys, value, out) -> RunningOp:
    c = f"__{out}_{kind}"
    post = F.when(F.col(value).isNull() | F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c).cast("double"))
    return RunningOp(list(keys), out, {c: (kind, value)}, post, helpers=[c])


def op_cum_min(keys, value, out, df=None) -> RunningOp:
    """Running min; a row whose own value is missing (or key missing) -> 0."""
    return _op_extreme("min", keys, value, out)


def op_cum_max(keys, value, out, df=None) -> RunningOp:
    return _op_extreme("max", keys, value, out)


def op_cum_mean(keys, value, out, df=None) -> RunningOp:
    """Running sum / running row count (rows with a missing value count too)."""
    s_, n_ = f"__{out}_s", f"__{out}_n"
    mean = (F.col(s_).cast("double") / F.col(n_)).cast("float").cast("double")
    return RunningOp(list(keys), out, {s_: ("sum", value), n_: ("count", None)},
                     F.coalesce(mean, F.lit(0.0)), helpers=[s_, n_])


def op_cum_agg(keys, value, out, scan: Scan, default=0.0) -> RunningOp:
    """The user's running function; missing (and missing keys) -> ``default`` (None: kept)."""
    c = f"__{out}_a"
    post = F.col(c) if default is None else F.coalesce(F.col(c), F.lit(default))
    return RunningOp(list(keys), out, {c: (scan, value)}, post, helpers=[c])


def op_cum_unique(keys, value, out, df=None) -> RunningOp:
    """Running number of distinct ``value`` per key, inclusive; missing key -> missing."""
    flag, c = f"__{out}_first", f"__{out}_u"
    return RunningOp(list(keys), out, {c: ("sum", flag)}, F.col(c).cast("bigint"),
                     pre=[("first", list(keys), value, flag)], helpers=[flag, c])


def op_prev_value(keys, value, out, df=None) -> RunningOp:
    """Last non-missing value before this row in the key, as text; else 'NA'."""
    c = f"__{out}_p"
    return RunningOp(list(keys), out, {c: ("last_before", value)},
                     F.coalesce(F.col(c).cast("string"), F.lit("NA")), helpers=[c])


def op_time_since_previous(key, ts, out, df) -> RunningOp:
    """Seconds since the previous row of the same key; first row -> missing.
    A row with a missing key has no previous row -> missing."""
    us, prev = f"__{out}_us", f"__{out}_prev"
    post = ((F.col(us) - F.col(prev)) / F.lit(1e6)).cast("double")
    return RunningOp([key], out, {prev: ("last_before", us)}, post,
                     pre=[(us, _ts_micros(df, ts))], helpers=[us, prev])


def run_batch(df: DataFrame, ops: Sequence[RunningOp], order: str = ORDER,
              chunk_width: int = DEFAULT_CHUNK_WIDTH) -> DataFrame:
    """Evaluate operators that share one key set in a single segmented scan."""
    keys = ops[0].keys
    if any(o.keys != keys for o in ops):
        raise ValueError("run_batch needs one key set")
    d = df
    for o in ops:
        for p in o.pre:
            if p[0] == "first":
                _, k, value, flag = p
                d = first_occurrence(d, k, value, order, flag)
            else:
                d = d.withColumn(p[0], p[1])
    specs = {}
    for o in ops:
        specs.update(o.specs)
    r = running(d, keys, specs, order, chunk_width)  # keeps d's columns (helpers included)
    outs = [o.post.alias(o.out) for o in ops]
    helpers = {h for o in ops for h in o.helpers}
    return r.select(*[c for c in r.columns if c not in helpers], *outs)


def _one(df, op, **kw):
    return run_batch(df, [op], **kw)


def cum_frequency(df: DataFrame, keys: Sequence[str], out: str, **kw) -> DataFrame:
    return _one(df, op_cum_frequency(keys, out), **kw)


def cum_count(df: DataFrame, keys: Sequence[str], out: str, **kw) -> DataFrame:
    return _one(df, op_cum_count(keys, out), **kw)


def cum_sum(df: DataFrame, keys: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    return _one(df, op_cum_sum(keys, value, out), **kw)


def cum_min(df: DataFrame, keys: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    return _one(df, op_cum_min(keys, value, out), **kw)


def cum_max(df: DataFrame, keys: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    return _one(df, op_cum_max(keys, value, out), **kw)


def cum_mean(df: DataFrame, keys: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    return _one(df, op_cum_mean(keys, value, out), **kw)


def cum_agg(df: DataFrame, keys: Sequence[str], value: str, out: str, scan: Scan, default=0.0, **kw) -> DataFrame:
    return _one(df, op_cum_agg(keys, value, out, scan, default), **kw)


def cum_unique(df: DataFrame, keys: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    return _one(df, op_cum_unique(keys, value, out), **kw)


def prev_value(df: DataFrame, keys: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    return _one(df, op_prev_value(keys, value, out), **kw)


def time_since_previous(df: DataFrame, key: str, ts: str, out: str, **kw) -> DataFrame:
    return _one(df, op_time_since_previous(key, ts, out, df), **kw)
