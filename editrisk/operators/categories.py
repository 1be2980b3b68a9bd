"""Category operators: tags, one-hot coding, long tail, impact coding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_lookup
from .cumulative import number_in_order


def _fit_rows(df: DataFrame, fit: Column | None) -> DataFrame:
    return df if fit is None else df.where(fit)


# ------------------------------------------------------------------ tags
def tag_counts(df: DataFrame, col: str, fit: Column | None = None) -> DataFrame:
    """How often each tag occurs (tags are comma-joined; missing rows skipped)."""
    return (_fit_rows(df, fit).where(F.col(col).isNotNull())
            .select(F.explode(F.split(F.col(col), ",")).alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("frequency")))


def most_frequent_tag(df: DataFrame, col: str, out: str, fit: Column | None = None) -> DataFrame:
    """Replace each tag list by its tag most frequent in the fit rows.

    Ties go to the tag that comes first in the row; unseen tags count 0; a
    missing value stays missing.  The choice is made once per *distinct*
    tag list (``posexplode`` + join to the counts + ``max_by``) and joined
    back, so a frequent list is resolved once.
    """
    counts = tag_counts(df, col, fit).select(F.col("tag").alias("__tag"), F.col("frequency").alias("__freq"))
    lists = df.where(F.col(col).isNotNull()).select(col).distinct()
    exploded = lists.select(col, F.posexplode(F.split(F.col(col), ",")).alias("__pos", "__tag"))
    scored = join_lookup(exploded, counts, ["__tag"], "left").withColumn(
        "__freq", F.coalesce(F.col("__freq"), F.lit(0)))
    best = scored.groupBy(col).agg(
        F.max_by("__tag", F.struct(F.col("__freq"), -F.col("__pos"))).alias(out))
    return join_lookup(df, best, [col], "left")


# ------------------------------------------------------------------ one-hot
def class_index(df: DataFrame, col: str, fit: Column | None = None) -> DataFrame:
    """(``col``, ``index``): the non-missing values of the fit rows, numbered from 0 in their
    order.  A table of any length; no value reaches the driver."""
    classes = _fit_rows(df, fit).where(F.col(col).isNotNull()).select(col).distinct()
    return number_in_order(classes, col, "index").withColumn("index", F.col("index") - 1)


def one_hot_classes(df: DataFrame, col: str, fit: Column | None = None) -> list:
    """Sorted distinct non-missing values of the fit rows."""
    return [r[0] for r in _fit_rows(df, fit).where(F.col(col).isNotNull()).select(col).distinct()
            .orderBy(col).collect()]


def one_hot(df: DataFrame, col: str, out: str, fit: Column | None = None) -> DataFrame:
    """One 0/1 column ``{out}_{class}`` per class seen in the fit rows
    (always one column per class); unseen and missing values are all 0.

    The classes become the table's schema, which the driver holds: where they are many,
    ``one_hot_vector`` gives the same as one column."""
    classes = one_hot_classes(df, col, fit)
    return df.select("*", *[F.when(F.col(col) == F.lit(v), 1.0).otherwise(0.0).alias(f"{out}_{v}")
                            for v in classes])


def one_hot_vector(df: DataFrame, col: str, out: str, fit: Column | None = None) -> DataFrame:
    """One sparse 0/1 vector with a place per class of the fit rows, in their order
    (``class_index``); unseen and missing values are the zero vector."""
    index = class_index(df, col, fit)
    n = index.count()
    if n == 0:
        return df.withColumn(out, array_to_vector(F.array().cast("array<double>")))
    place = f"__{out}_place"
    placed = join_lookup(df, index.withColumnRenamed("index", place), [col], "left")
    placed = placed.withColumn(place, F.coalesce(F.col(place), F.lit(n)).cast("double"))
    # of n + 1 categories the last one (none of the classes) has no place in the vector
    encoder = OneHotEncoder(inputCols=[place], outputCols=[out], dropLast=True).fit(
        df.sparkSession.createDataFrame([(float(n),)], f"`{place}` double"))
    return encoder.transform(placed).select(*df.columns, out)


# ------------------------------------------------------------------ long tail
def long_tail(df: DataFrame, col: str, out: str, count: int) -> DataFrame:
    """Frequency of the value if it is among the ``count`` most frequent
    values (ties by value), else 0; fitted and applied on the same rows."""
    top = (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
             .orderBy(F.desc(out), F.asc(col)).limit(count))
    # ``count`` rows: the broadcast is bounded by the parameter
    j = df.join(top, [col], "left")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("double"))


# ------------------------------------------------------------------ impact coding
def impact_table(df: DataFrame, col: str, label: str, alpha: float,
                 fit: Column | None = None, out: str = "impact") -> tuple[DataFrame, float]:
    """Smoothed positive rate per level, ``(n1 + p alpha) / (n0 + n1 + alpha)``,
    and the prior ``p`` (the value of unseen levels).  Missing is the level 'nan'."""
    rows = _fit_rows(df, fit).select(F.coalesce(F.col(col).cast("string"), F.lit("nan")).alias(col),
                                     F.col(label).cast("double").alias("__y"))
    prior = rows.agg(F.avg("__y")).first()[0]  # one scalar
    p = F.lit(prior).cast("double")
    levels = rows.groupBy(col).agg(F.sum("__y").alias("n1"), F.count(F.lit(1)).alias("n"))
    tab = levels.select(col, ((F.col("n1") + p * alpha) / (F.col("n") + alpha)).alias(out))
    return tab, prior


def impact_code(df: DataFrame, col: str, label: str, out: str, alpha: float = 1.0,
                fit: Column | None = None) -> DataFrame:
    tab, prior = impact_table(df, col, label, alpha, fit, out)
    key = F.coalesce(F.col(col).cast("string"), F.lit("nan"))
    d = df.withColumn("__lvl", key)
    j = join_lookup(d, tab.select(F.col(col).alias("__lvl"), out), ["__lvl"], "left")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(prior).cast("double"))).drop("__lvl")


def column_names(df: DataFrame, prefix: str) -> Sequence[str]:
    return [c for c in df.columns if c.startswith(prefix + "_")]
