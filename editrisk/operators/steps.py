"""Fit/transform steps.

A feature is a chain of steps.  Every step is *fitted on the fit rows* (a
row predicate, e.g. everything before the validation start) and *applied to
all rows*.  Steps come in four shapes so that the feature pipeline can batch
them (``plans/pipeline.py``):

* ``ExprStep``    - stateless column expression;
* ``ScalarStep``  - needs one or more scalar statistics of the fit rows
  (mean, median); all scalar statistics of a pipeline round are one ``agg``;
* ``LookupStep``  - needs a per-key table of the fit rows (frequency, group
  aggregate, smoothed rate); steps with the same key set share one
  ``groupBy`` and one join;
* ``WindowStep``  - running operators over the ordered log (no fit).

Each step can also run alone through ``fit_transform``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import join_lookup
from . import cumulative as C
from .quantiles import exact_median


def _fit_rows(df: DataFrame, fit: Column | None) -> DataFrame:
    return df if fit is None else df.where(fit)


class Step:
    kind = "expr"

    def fit_transform(self, df: DataFrame, inputs: Sequence[str], out: str,
                      fit: Column | None = None) -> DataFrame:
        raise NotImplementedError


# ---------------------------------------------------------------- stateless
@dataclass
class ExprStep(Step):
    fn: Callable[..., Column]
    name: str = "expr"
    kind: str = "expr"

    def expr(self, inputs: Sequence[str]) -> Column:
        return self.fn(*[F.col(c) for c in inputs])

    def fit_transform(self, df, inputs, out, fit=None):
        return df.withColumn(out, self.expr(inputs))


def to_float32() -> ExprStep:
    return ExprStep(S.to_float32, "to_float32")


def impute_zero() -> ExprStep:
    return ExprStep(S.impute_zero, "impute_zero")


def impute_minus_one() -> ExprStep:
    return ExprStep(S.impute_minus_one, "impute_minus_one")


def impute_string() -> ExprStep:
    return ExprStep(S.impute_string, "impute_string")


def impute_boolean() -> ExprStep:
    return ExprStep(S.impute_boolean, "impute_boolean")


def null_indicator() -> ExprStep:
    return ExprStep(S.null_indicator, "null_indicator")


def log_scale() -> ExprStep:
    return ExprStep(S.log_scale, "log_scale")


def sqrt_scale() -> ExprStep:
    return ExprStep(S.sqrt_scale, "sqrt_scale")


def time_unit(unit: str) -> ExprStep:
    if unit not in S.TIME_UNITS:
        raise ValueError(f"no such time unit: {unit}")
    return ExprStep(lambda c: S.time_unit(c, unit), f"time_{unit}")


def logical_or() -> ExprStep:
    return ExprStep(S.logical_or, "logical_or")


def normal_noise(seed: int, key: str = C.ORDER) -> ExprStep:
    # The noise is keyed by the row id, not by the input value.
    return ExprStep(lambda *_: S.normal_noise(F.col(key), seed), f"normal_noise_{seed}")


# ------------------------------------------------------------ scalar fitted
@dataclass
class ScalarStep(Step):
    """Imputes missing values with a statistic of the fit rows."""
    stat: str  # 'mean' | 'median'
    kind: str = "scalar"

    def aggs(self, col: str, prefix: str) -> dict[str, Column]:
        c = F.col(col).cast("double")
        if self.stat == "mean":
            return {prefix: F.avg(c)}
        if self.stat == "median":
            # only for small inputs; ``fit_value`` computes the exact median
            # without gathering the column into one task
            return {prefix: F.median(c)}
        raise ValueError(self.stat)

    def apply(self, col: str, stats: dict, prefix: str) -> Column:
        value = stats[prefix]
        filled = F.coalesce(F.col(col).cast("double"),
                            F.lit(value).cast("double") if value is not None else F.lit(None).cast("double"))
        return S.clamp_infinity(filled)

    def fit_value(self, df: DataFrame, col: str, fit: Column | None = None):
        rows = _fit_rows(df, fit)
        if self.stat == "median":
            return exact_median(rows, col)
        return rows.agg(F.avg(F.col(col).cast("double")).alias("m")).first()["m"]

    def fit_transform(self, df, inputs, out, fit=None):
        (col,) = inputs
        return df.withColumn(out, self.apply(col, {"s": self.fit_value(df, col, fit)}, "s"))


def impute_mean() -> ScalarStep:
    return ScalarStep("mean")


def impute_median() -> ScalarStep:
    return ScalarStep("median")


# ------------------------------------------------------------ lookup fitted
@dataclass(frozen=True)
class Parts:
    """A lookup's aggregate in two parts, for fits on several stretches of the log: ``state`` of
    the values of a stretch, and ``merge`` of the states of some stretches to the result."""
    state: Callable[..., Column]
    merge: Callable[[Column], Column]


@dataclass
class LookupStep(Step):
    """A per-key statistic of the fit rows joined back to every row.

    ``agg`` gets the input columns and returns the aggregate Column;
    ``key_count`` says how many leading inputs are keys (None = all).
    ``null_safe``: a missing key part is a group of its own (category keys);
    otherwise rows with a missing key are not counted and get ``default``.
    """
    agg: Callable[..., Column]
    default: float | None = 0.0
    key_count: int | None = None
    null_safe: bool = False
    name: str = "lookup"
    kind: str = "lookup"
    default_fn: Callable[[DataFrame, Sequence[str]], Column] | None = None
    parts: Parts | None = None  # None: there are no mergeable states

    def keys(self, inputs: Sequence[str]) -> list[str]:
        n = len(inputs) if self.key_count is None else self.key_count
        return list(inputs[:n])

    def values(self, inputs: Sequence[str]) -> list[str]:
        n = len(inputs) if self.key_count is None else self.key_count
        return list(inputs[n:])

    def fit_filter(self, inputs: Sequence[str]) -> Column:
        if self.null_safe:
            return F.lit(True)
        cond = F.lit(True)
        for k in self.keys(inputs):
            cond = cond & F.col(k).isNotNull()
        return cond

    def agg_expr(self, inputs: Sequence[str]) -> Column:
        return self.agg(*[F.col(c) for c in self.values(inputs)])

    def state_expr(self, inputs: Sequence[str]) -> Column:
        return self.parts.state(*[F.col(c) for c in self.values(inputs)])

    def fit_table(self, df: DataFrame, inputs: Sequence[str], out: str,
                  fit: Column | None = None) -> DataFrame:
        keys = self.keys(inputs)
        return (_fit_rows(df, fit).where(self.fit_filter(inputs))
                .groupBy(*keys).agg(self.agg_expr(inputs).alias(out)))

    def fit_transform(self, df, inputs, out, fit=None):
        keys = self.keys(inputs)
        table = self.fit_table(df, inputs, out, fit)
        if self.null_safe:
            r = table.select(*[F.col(k).alias(f"__k_{k}") for k in keys], out)
            cond = None
            for k in keys:
                c = df[k].eqNullSafe(r[f"__k_{k}"])
                cond = c if cond is None else cond & c
            joined = df.join(r, cond, "left").drop(*[f"__k_{k}" for k in keys])
        else:
            joined = join_lookup(df, table, keys, "left")
        default = F.lit(self.default) if self.default is not None else F.lit(None)
        return joined.withColumn(out, F.coalesce(F.col(out).cast("double"), default.cast("double")))


def frequency() -> LookupStep:
    """How often the key tuple occurs in the fit rows; unseen/missing -> 0."""
    return LookupStep(lambda *_: F.count(F.lit(1)), 0.0, None, False, "frequency",
                      parts=Parts(lambda *_: F.count(F.lit(1)), F.sum))


def group_agg(fn: Callable[[Column], Column], null_safe: bool = False, name: str = "group_agg",
              parts: Parts | None = None) -> LookupStep:
    """Aggregate of the last input per tuple of the other inputs; unseen -> 0."""
    return LookupStep(fn, 0.0, -1, null_safe, name, parts=parts)


def group_nunique(null_safe: bool = False, missing_is_value: bool = False) -> LookupStep:
    if missing_is_value:
        fn = lambda v: F.count_distinct(F.coalesce(v.cast("string"), F.lit("\u0000nan")))
    else:
        fn = lambda v: F.count_distinct(v)
    return group_agg(fn, null_safe, "group_nunique")


def group_sum(null_safe: bool = False) -> LookupStep:
    return group_agg(lambda v: F.coalesce(F.sum(v), F.lit(0)), null_safe, "group_sum",
                     Parts(lambda v: F.coalesce(F.sum(v), F.lit(0)), F.sum))


def group_mean(null_safe: bool = False) -> LookupStep:
    return group_agg(lambda v: F.avg(v), null_safe, "group_mean", Parts(
        lambda v: F.struct(F.sum(v.cast("double")).alias("sum"), F.count(v).alias("n")),
        lambda p: F.try_divide(F.sum(p["sum"]), F.sum(p["n"]))))


# ------------------------------------------------------------ window steps
@dataclass
class WindowStep(Step):
    op: str
    chunk_width: int = C.DEFAULT_CHUNK_WIDTH
    kind: str = "window"

    def running_op(self, df: DataFrame, inputs: Sequence[str], out: str) -> "C.RunningOp":
        """The operator as a batchable spec (see ``cumulative.run_batch``)."""
        inputs = list(inputs)
        if self.op == "cum_frequency":
            return C.op_cum_frequency(inputs, out)
        if self.op == "cum_count":
            return C.op_cum_count(inputs[:-1], out)
        if self.op == "time_since_previous":
            return C.op_time_since_previous(inputs[0], inputs[1], out, df)
        fn = {"cum_sum": C.op_cum_sum, "cum_min": C.op_cum_min, "cum_max": C.op_cum_max,
              "cum_mean": C.op_cum_mean, "cum_unique": C.op_cum_unique,
              "prev_value": C.op_prev_value}[self.op]
        return fn(inputs[:-1], inputs[-1], out)

    def fit_transform(self, df, inputs, out, fit=None):
        return C.run_batch(df, [self.running_op(df, inputs, out)], chunk_width=self.chunk_width)


def cum_unique(chunk_width: int = C.DEFAULT_CHUNK_WIDTH) -> WindowStep:
    return WindowStep("cum_unique", chunk_width)


def time_since_previous(chunk_width: int = C.DEFAULT_CHUNK_WIDTH) -> WindowStep:
    return WindowStep("time_since_previous", chunk_width)


@dataclass
class CustomStep(Step):
    """Any ``(df, inputs, out, fit) -> df`` function (text models, tags...) that keeps every row
    once; with ``many`` it gives any number of columns, named ``{out}_...``, with ``vector`` one
    vector column."""
    fn: Callable[..., DataFrame]
    name: str = "custom"
    kind: str = "custom"
    params: dict = field(default_factory=dict)
    many: bool = False
    vector: bool = False

    def fit_transform(self, df, inputs, out, fit=None):
        return self.fn(df, list(inputs), out, fit, **self.params)

