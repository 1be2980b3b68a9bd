"""Exact order statistics without gathering a column, or a group, into one task.

Whole columns: doubles are mapped to 64-bit integers in the same order (``ordered_bits``),
and the k-th smallest is found by radix selection.  Each round is one grouped pass
over all columns and ranks: it counts the next 12 bits of the values that share the
bits found so far (at most 4096 counts per column and rank come to the driver).
A rank is found as soon as its bucket holds a single value, after six rounds at most;
the way is the same for every size.

Groups (``grouped_median``): one row per (group, value) with its count, running counts
from the segmented scan with value buckets as chunks, and the middle rows; a group with a
third of all rows is spread over its buckets.

Quantiles use linear interpolation between the neighbouring order
statistics (the definition of pandas' ``quantile`` and of ``median``).  NaN counts as the
largest value, as in Spark's order; missing values are left out.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_lookup, persist
from . import cumulative as C

#: Bits that a round looks at lie above these positions.
SHIFTS = (52, 40, 28, 16, 4, 0)
#: Value buckets of the grouped median: so many at least, and one per ``BUCKET_VALUES``.
BUCKETS = 1000
BUCKET_VALUES = 1 << 20

_INFINITY = 2047 << 52


def ordered_bits(x: Column) -> Column:
    """A long for each double, in the same order: the bits of the absolute value, with the sign.

    Scaling by powers of two is exact, so the exponent and the 52 bits after the
    leading one are read off with arithmetic."""
    a = F.abs(x)
    near = F.floor(F.log2(a))
    two = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(a < two(near), near - 1).when(a >= two(near + 1), near + 1).otherwise(near)
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((a / two(e) - 1.0) * F.lit(2.0 ** 52)).cast("long")
    tiny = (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
    bits = (F.when(F.isnan(x), F.lit(_INFINITY + 1)).when(a == float("inf"), F.lit(_INFINITY))
            .when(a < F.lit(2.0 ** -1022), tiny).otherwise(normal))
    return F.when(x < 0, -bits).otherwise(bits)


def from_ordered_bits(bits: int) -> float:
    value = struct.unpack("<d", struct.pack("<q", abs(bits)))[0]
    return -value if bits < 0 else value


def order_statistics(df: DataFrame, columns: dict[str, str],
                     ranks: Callable[[int], Iterable[int]]) -> dict[str, tuple[int, dict[int, float]]]:
    """Per name the number ``n`` of non-missing values of its column, and the value of each rank
    (from 0) that ``ranks(n)`` asks for."""
    names = list(columns)
    images = persist(df.select(*[ordered_bits(F.col(c).cast("double")).alias(f"__v{i}")
                                 for i, c in enumerate(columns.values())]))
    sizes: dict[int, int] = {}
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[int | None, int]] = {}  # (column, rank) -> bits so far, rank inside
    for at, shift in enumerate(SHIFTS):
        cells = []
        for i in range(len(names)):
            v = F.col(f"__v{i}")
            if at:
                inside = sorted({p for (j, _), (p, _) in open_.items() if j == i})
                if not inside:
                    continue
                match = F.shiftright(v, SHIFTS[at - 1]).isin(inside)
            else:
                match = v.isNotNull()
            cells.append(F.when(match, F.struct(F.lit(i).alias("i"), v.alias("v"))))
        if not cells:
            break
        rows = images.select(F.explode(F.array_compact(F.array(*cells))).alias("c"))
        counts = defaultdict(list)
        for r in rows.groupBy("c.i", F.shiftright("c.v", shift).alias("p")).agg(
                F.count(F.lit(1)).alias("n"), F.min("c.v").alias("lo"), F.max("c.v").alias("hi")).collect():
            counts[r["i"]].append((r["p"], r["n"], r["lo"], r["hi"]))
        if not at:
            for i in range(len(names)):
                sizes[i] = sum(c[1] for c in counts[i])
                open_ |= {(i, k): (None, k) for k in (ranks(sizes[i]) if sizes[i] else ())}
        ordered = {i: sorted(c) for i, c in counts.items()}
        for (i, k), (prefix, rank) in list(open_.items()):
            for p, n, lo, hi in ordered[i]:
                if prefix is not None and p >> (SHIFTS[at - 1] - shift) != prefix:
                    continue
                if rank < n:
                    open_[i, k] = (p, rank)
                    if lo == hi:
                        found[i, k] = from_ordered_bits(lo)
                        del open_[i, k]
                    break
                rank -= n
    images.unpersist()
    return {name: (sizes.get(i, 0), {k: v for (j, k), v in found.items() if j == i}) for i, name in enumerate(names)}


def kth_smallest(values: DataFrame, col: str, k: int):
    """Value of rank ``k`` (0-based) among the non-missing values of ``col``; none beyond them."""
    return order_statistics(values, {col: col}, lambda n: [k] if 0 <= k < n else [])[col][1].get(k)


def exact_quantiles_of(df: DataFrame, columns: dict[str, str], qs: Sequence[float]) -> dict[str, list]:
    """Linear-interpolated quantiles of several columns: ``{name: column}`` -> ``{name: values}``."""
    if not columns:
        return {}

    def ends(n: int) -> list[int]:
        return [k for q in qs for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))]

    out = {}
    for name, (n, at) in order_statistics(df, columns, ends).items():
        if not n:
            out[name] = [None for _ in qs]
            continue
        out[name] = []
        for q in qs:
            pos = q * (n - 1)
            a, b = at[math.floor(pos)], at[math.ceil(pos)]
            part = pos - math.floor(pos)
            out[name].append((a + b) / 2.0 if part == 0.5 else a + (b - a) * part if part else a)
    return out


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float]) -> list:
    return exact_quantiles_of(df, {col: col}, qs)[col]


def exact_median(df: DataFrame, col: str):
    return exact_quantiles(df, col, [0.5])[0]


def exact_medians(df: DataFrame, columns: dict[str, str]) -> dict:
    """Exact medians of several columns: ``{name: column}`` -> ``{name: median}``."""
    return {name: v[0] for name, v in exact_quantiles_of(df, columns, [0.5]).items()}


def grouped_median(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """``key, out``: the median of ``col`` for every group (missing without values; a missing
    key is a group)."""
    group = F.struct(F.col(key).alias("key"))  # never null itself
    points = persist(df.select(group.alias("__g"), F.col(col).cast("double").alias("__v"))
                     .where(F.col("__v").isNotNull()).groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__n")))
    buckets = max(BUCKETS, -(-points.count() // BUCKET_VALUES))
    cuts = points.agg(F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
    splits = [-float("inf"), *sorted({float(c) for c in cuts or [] if math.isfinite(c)}), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="__v", outputCol="__b", handleInvalid="keep").transform(points)
    run = C.running(placed, ["__g"], {"__upto": ("sum", "__n")}, order="__v", chunk_col=F.col("__b").cast("long"))
    sizes = points.groupBy("__g").agg(F.sum("__n").alias("__size"))
    low, high = F.floor((F.col("__size") - 1) / 2), F.floor(F.col("__size") / 2)
    first = F.col("__upto") - F.col("__n")
    middle = join_lookup(run, sizes, ["__g"], "inner").where((first <= high) & (F.col("__upto") > low))
    medians = middle.groupBy("__g").agg(((F.min("__v") + F.max("__v")) / 2.0).alias(out))
    groups = df.select(group.alias("__g")).distinct()
    return groups.join(medians, "__g", "left").select(F.col("__g.key").alias(key), out)
