"""Mixing sources to target weights by systematic sampling.

Every source has a target (words it shall contribute).  A document's expected
copies are its source's target over its source's size.  The documents of a
source are ordered by size and id, expected copies are summed along that order,
one random offset is added, and a document is taken once for every integer
boundary its stretch of the sum crosses.  Taken words differ from the target by
at most about the size of the source's longest document.

The order is made by one range partitioning over (source, size, id): a source
with a third of all rows lies in many partitions.  Ranks come from windows over
single partitions plus the partitions' offsets; no window spans a source.

Defined results: null text has size 0; null source is a source of its own, last
in order; rows equal in id, source, size and text are one unit of sampling, which takes as
many steps of the sum as it has rows (so null and repeated ids keep a source near its
target); an empty table gives an empty mix; a source of size 0 has target 0.  Reruns with one seed agree.  Internal column names start
with ``__``, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editrisk.llm.common import broadcast_if_small, discard, shuffle_width, store, word_count


def source_targets(units: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """One row per source: its size and its target (water filling below the caps).

    Sources by code point, null last, get the weights in turn.  With the
    sources ordered by cap / weight, the first one that stays below its cap fixes
    the level; all before it are at their caps.  The windows run over one row
    per source.
    """
    per = units.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__n")).alias("__total"))
    by_name = Window.orderBy(F.asc_nulls_last("__source"))
    listed = per.withColumn("__w", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    most = F.col("__total") * F.lit(float(cap))
    listed = listed.withColumn("__most", most).withColumn("__ratio", F.col("__most") / F.col("__w"))
    order = Window.orderBy("__ratio", F.asc_nulls_last("__source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("__total").over(every) - F.coalesce(F.sum("__most").over(before), F.lit(0.0))
    open_w = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    listed = listed.withColumns({"__level": left / open_w, "__pos": F.row_number().over(order)})
    below = F.when(F.col("__level") <= F.col("__ratio"), F.struct("__pos", "__level"))
    level = F.min(below).over(every)["__level"]
    return listed.withColumn("__level", level).select(
        "__source", F.col("__total").alias("__source_size"),
        F.least(F.col("__most"), F.col("__level") * F.col("__w")).alias("__target"))


def random_offset(seed: int) -> Column:
    """A number in [0, 1) fixed by seed and source."""
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), F.col("__source")), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 7,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Where the sum stands: ``__id, __source, __size, __text`` (a digest), ``__n`` (equal rows),
    ``__before`` (steps before them), ``__source_size, __target, __rate, __offset``; one row per
    distinct (id, source, size, text)."""
    spark = docs.sparkSession
    units = store(
        docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"),
                    word_count(F.col(text_col)).alias("__size"), F.xxhash64(text_col).alias("__text"))
        .groupBy("__id", "__source", "__size", "__text").agg(F.count("*").alias("__n")), "mix-units")
    targets = store(source_targets(units, weights, cap), "mix-targets")
    ranged = store(
        units.repartitionByRange(shuffle_width(spark), "__source", "__size", "__id", "__text")
        .withColumn("__part", F.spark_partition_id()), "mix-order")
    discard(units)

    ranked = running_total(ranged, "__part", ["__source"], ["__size", "__id", "__text"], F.col("__n")).withColumn(
        "__before", F.col("__total") - F.col("__n")).drop("__total")
    t = broadcast_if_small(targets.withColumnRenamed("__source", "__s"), 256)
    ranked = ranked.join(t, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")

    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    return ranked.select("__id", "__source", "__size", "__text", "__n", "__before", "__source_size", "__target",
                         rate.alias("__rate"), random_offset(seed).alias("__offset"))


def running_total(table: DataFrame, part: str, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """``table`` with ``__total``: the sum of ``value`` along parts, then ``order``, for equal ``keys``.

    Windows run inside a part, plus the sums of the parts before it."""
    here = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    names = [f"__key{i}" for i in range(len(keys))]
    sums = table.groupBy(F.col(part).alias("__p"), *[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__p", *names, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__earlier"))
    same = F.col(part) == F.col("__p")
    for k, n in zip(keys, names):
        same &= F.col(k).eqNullSafe(F.col(n))
    out = table.withColumn("__total", F.sum(value).over(here)).join(offsets, same).drop("__p", *names)
    return out.withColumn("__total", F.col("__total") + F.col("__earlier")).drop("__earlier")


def copies(step: Column) -> Column:
    """How often the row that takes the ``step``-th step of its source's sum is taken."""
    edge = lambda r: F.floor(r * F.col("__rate") + F.col("__offset"))
    return edge(step) - edge(step - 1)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, ``size, source_size, target, taken``."""
    p = mix_plan(docs, **options)
    p = p.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__i"))
    return p.select(F.col("__id").alias(options.get("id_col", "doc_id")), F.col("__size").alias("size"),
                    F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                    (copies(F.col("__before") + F.col("__i")) * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the plan takes it."""
    p = store(mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options), "mix-plan")
    rows = docs.withColumns({"__words": word_count(F.col(text_col)), "__digest": F.xxhash64(text_col)})

    def planned(units: DataFrame) -> DataFrame:
        return rows.join(units, rows[id_col].eqNullSafe(units["__id"]) & rows[source_col].eqNullSafe(units["__source"])
                         & (rows["__words"] == units["__size"]) & (rows["__digest"] == units["__text"]))

    def taken(steps: DataFrame, step: Column) -> DataFrame:
        steps = steps.withColumn("__copies", copies(step)).where(F.col("__copies") > 0)
        return steps.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(
            *[F.col(f"`{c}`") for c in docs.columns])

    # of units of one row only those that are taken are looked up
    alone = p.where((F.col("__n") == 1) & (copies(F.col("__before") + 1) > 0))
    out = taken(planned(alone), F.col("__before") + 1)
    repeated = p.where(F.col("__n") > 1)
    if repeated.isEmpty():
        return out
    # equal rows are numbered by their place in a stored table, each of its parts by itself
    placed = store(planned(repeated).withColumn("__row", F.monotonically_increasing_id())
                   .withColumn("__part", F.shiftright("__row", 33)), "mix-repeated")
    numbered = running_total(placed, "__part", ["__id", "__source", "__size", "__text"], ["__row"], F.lit(1))
    return out.unionByName(taken(numbered, F.col("__before") + F.col("__total")))
