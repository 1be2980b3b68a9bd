"""Row ranges, splits, filters and exact-size samples.

There is no positional index: the order column (``revisionId``) or the
timestamp defines ranges, so every split is a range filter that reaches
the Parquet scan as a pushed filter.

Exact-size random samples rank rows by a seeded hash of the row id.  The
rank of the k-th row is found without a global sort: a histogram of the
hash's top bits (a grouped count, tiny) locates the bucket holding the
k-th row, and only that bucket's rows are ranked.  NumPy's draw order
cannot be reproduced; the contract is size, disjointness, determinism.  The
hash is the start of an md5 sum, so SQL draws the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ts_lit

ORDER = "revisionId"
ORDER_BITS = 60    # of the hash that puts rows into a random order: 15 hex digits
HASH_BITS = 12     # bits of the hash that one histogram of the exact-size threshold looks at
RANKED_ROWS = 4096  # a bucket of more rows gets a histogram of its own


# ------------------------------------------------------------------ ranges
def slice_range(df: DataFrame, lo=None, hi=None, col: str = ORDER) -> DataFrame:
    """Rows with ``lo <= col < hi`` (either bound may be open)."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(col) >= _lit(lo, df, col))
    if hi is not None:
        cond = cond & (F.col(col) < _lit(hi, df, col))
    return df.where(cond)


def _lit(v, df: DataFrame, col: str) -> Column:
    if isinstance(v, Column):
        return v
    dtype = df.schema[col].dataType.simpleString()
    if dtype == "timestamp_ntz":
        return ts_lit(str(v))
    if dtype == "timestamp":
        return F.lit(str(v)).cast("timestamp")
    return F.lit(v)


def split_by_revision(df: DataFrame, train: int, validation: int, test: int, col: str = ORDER):
    """(fit rows, training, validation): fit = everything before validation."""
    return (slice_range(df, None, validation, col), slice_range(df, train, validation, col),
            slice_range(df, validation, test, col))


def split_by_date(df: DataFrame, train, validation, test, col: str = "timestamp"):
    return split_by_revision(df, train, validation, test, col)


def index_for_key(df: DataFrame, value, col: str = ORDER) -> DataFrame:
    """Rank (0-based) of the first row with ``col >= value`` (one-row table)."""
    return df.agg(F.count(F.when(F.col(col) < _lit(value, df, col), 1)).alias("index"))


def fit_predicate(col: str, validation_start) -> Column:
    if isinstance(validation_start, str):
        return F.col(col) < ts_lit(validation_start)
    return F.col(col) < F.lit(validation_start)


# ------------------------------------------------------------------ filters
def apply_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(F.coalesce(mask, F.lit(False)))


def filter_head(df: DataFrame, col: str = "contentType") -> DataFrame:
    return df.where(F.col(col) == "TEXT")


def filter_body(df: DataFrame, col: str = "contentType") -> DataFrame:
    return df.where(F.col(col).isin("STATEMENT", "SITELINK"))


def get_positives(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label))


def false_negatives(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.where(F.col(label) & ~F.col(pred))


def false_positives(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.where(~F.col(label) & F.col(pred))


def filter_misclassified(df: DataFrame, label: str = "label", prob: str = "prob",
                         below: float = 0.25) -> DataFrame:
    """Positive rows scored below ``below`` (the reference's hard misses)."""
    return df.where(F.col(label) & (F.col(prob) < below))


def sample_k(df: DataFrame, k: int, key: str = ORDER, seed: int = 1) -> DataFrame:
    """Exactly min(k, n) rows, seeded (hash rank threshold, no global sort)."""
    return df.where(_below(hash_threshold(df, k, key, seed), key, seed))


def misclassified_report(df: DataFrame, label: str = "label", prob: str = "prob",
                         below: float = 0.25, k: int = 1000):
    """(summary statistics, sample of at most k rows) of the hard misses."""
    from .stats import describe_all
    rows = filter_misclassified(df, label, prob, below)
    return describe_all(rows), sample_k(rows, k)


def complement(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows not selected by ``predicate`` (a missing predicate counts as not selected)."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def drop_duplicates(df: DataFrame, cols=None, order: str | None = None) -> DataFrame:
    """Distinct rows; with ``order`` the first row (by order) of each duplicate set."""
    if order is None:
        return df.dropDuplicates(cols) if cols else df.distinct()
    keys = cols or [c for c in df.columns if c != order]
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


# ----------------------------------------------------------- exact samples
def hash_order(key: str, seed: int) -> Column:
    """The row's place in the seed's random order: the first 60 bits of md5(``seed|key``)."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, ORDER_BITS // 4), 16, 10).cast("long")


def hash_threshold(df: DataFrame, k: int, key: str = ORDER, seed: int = 1):
    """Return (h, key) such that exactly ``k`` rows have (hash, key) < (h, key).

    A histogram over the top ``HASH_BITS`` of the hash finds the bucket of the k-th row;
    the next bits are looked at in that bucket alone, until it has ``RANKED_ROWS`` rows at
    most, which are ranked.  Says so when k is 0 (take nothing) or k > n (take all).
    """
    if k <= 0:
        return ("none", None)
    h = hash_order(key, seed)
    rows = df.select(h.alias("h"), F.col(key).alias("key"))
    left, need = ORDER_BITS, k  # bits not looked at yet; 1-based rank among ``rows``
    while left > 0:
        left = max(left - HASH_BITS, 0)
        bucket = F.shiftright("h", left)
        hit = (rows.groupBy(bucket.alias("b")).count()
                   .withColumn("cum", F.sum("count").over(Window.orderBy("b")))
                   .where(F.col("cum") >= need).orderBy("b").first())
        if hit is None:
            return ("all", None)
        need -= hit["cum"] - hit["count"]
        rows = rows.where(bucket == hit["b"])
        if hit["count"] <= RANKED_ROWS:
            break
    # repeated keys are one row here
    row = (rows.groupBy("h", "key").count()
               .withColumn("r", F.sum("count").over(Window.orderBy("h", "key")))
               .where(F.col("r") >= need).orderBy("h", "key").first())
    return ("cut", (row["h"], row["key"]))


def _below(cut, key: str, seed: int) -> Column:
    kind, val = cut
    if kind == "none":
        return F.lit(False)
    if kind == "all":
        return F.lit(True)
    hv, kv = val
    h = hash_order(key, seed)
    return (h < F.lit(hv)) | ((h == F.lit(hv)) & (F.col(key) <= F.lit(kv)))


def hash_share(df: DataFrame, fraction: float, key: str = ORDER, seed: int = 1) -> DataFrame:
    """The rows whose seeded 32-bit hash lies below ``fraction`` of its range.

    Samples of one seed are nested (a smaller fraction takes a prefix of the hash order),
    need no count and no shuffle, and are the same on every run and in SQL (md5)."""
    return df if fraction >= 1.0 else df.where(in_share(fraction, key, seed))


def in_share(fraction: float, key: str = ORDER, seed: int = 1) -> Column:
    """Whether a row is in its seed's sample of this share."""
    if fraction >= 1.0:
        return F.lit(True)
    return share_hash(key, seed) < F.lit(int(fraction * 2 ** 32))


def share_hash(key: str = ORDER, seed: int = 1) -> Column:
    """The row's seeded 32-bit hash (missing with the key)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8), 16, 10)
    return h.cast("long")


def sample_n(df: DataFrame, fraction: float, key: str = ORDER, seed: int = 1) -> DataFrame:
    """Exactly floor(fraction * n) rows, without replacement, seeded."""
    n = df.count()
    k = math.floor(fraction * n)
    return df.where(_below(hash_threshold(df, k, key, seed), key, seed))


def random_split(df: DataFrame, fraction: float, key: str = ORDER, seed: int = 1):
    """Disjoint split; the first part has exactly floor(fraction * n) rows."""
    n = df.count()
    cond = _below(hash_threshold(df, math.floor(fraction * n), key, seed), key, seed)
    return df.where(cond), df.where(~cond)


def ordered_split(df: DataFrame, fraction: float, order: str = ORDER):
    """First floor(fraction * n) rows by ``order`` / the rest."""
    n = df.count()
    k = math.floor(fraction * n)
    if k <= 0:
        return df.where(F.lit(False)), df
    if k >= n:
        return df, df.where(F.lit(False))
    # k-th smallest order value without a global sort
    kth = _kth_smallest(df, order, k)
    kth = kth if isinstance(kth, Column) else F.lit(kth)
    return df.where(F.col(order) <= kth), df.where(F.col(order) > kth)


def _kth_smallest(df: DataFrame, col: str, k: int):
    """The k-th smallest value (1-based), found without ranking rows.

    Whole numbers and timestamps are searched on 64 bits: each round counts 4096 equal ranges
    of the present interval in one grouped pass, until a range is a single value.
    Other columns use the refinement search of ``quantiles.kth_smallest``.
    """
    kind = df.schema[col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "timestamp"):
        from .quantiles import kth_smallest
        return kth_smallest(df.select(F.col(col).cast("double").alias(col)), col, k - 1)
    value = F.unix_micros(col) if kind == "timestamp" else F.col(col).cast("long")
    values = df.select(value.alias("v")).where("v IS NOT NULL")
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    while lo < hi:
        width = (hi - lo) // 4096 + 1
        # decimals: the distance of two longs may need more than 63 bits
        place = F.expr(f"(cast(v AS decimal(20,0)) - cast('{lo}' AS decimal(20,0))) div cast('{width}' AS decimal(20,0))")
        counts = sorted(values.where(F.col("v").between(lo, hi)).groupBy(place.alias("p")).count().collect())
        for p, n in counts:  # at most 4096 rows
            if k <= n:
                lo, hi = lo + p * width, min(hi, lo + (p + 1) * width - 1)
                break
            k -= n
    return F.timestamp_micros(F.lit(lo)) if kind == "timestamp" else F.lit(lo).cast("long")


def undersample(df: DataFrame, n_times: float, label: str = "label", key: str = ORDER,
                seed: int = 1) -> DataFrame:
    """All positives plus floor(n_times * positives) random negatives."""
    y = F.col(label).cast("boolean")
    pos = df.where(y).count()
    neg = df.where(~y)
    k = math.floor(n_times * pos)
    cut = hash_threshold(neg, k, key, seed)
    return df.where(y | _below(cut, key, seed))


def oversample(df: DataFrame, n_times: int, label: str = "label") -> DataFrame:
    """Each positive row ``n_times`` times (a ``copy`` column numbers them)."""
    reps = F.when(F.col(label).cast("boolean"), F.lit(n_times)).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), reps)))


def balanced_sample(df: DataFrame, slice_col: str = "contentType", label: str = "label",
                    n: int = 100, key: str = ORDER, seed: int = 1) -> DataFrame:
    """At most ``n`` rows per slice, weight 1/2 per class (Efraimidis-Spirakis).

    Each row gets the key ``-log(u) / w`` with ``w = 0.5 / rows of its
    (slice, label)``; the ``n`` smallest keys per slice form the sample.  The
    ranking is a top-n per slice, which Spark evaluates with a per-partition
    limit before the shuffle.
    """
    u = hash_order(key, seed).cast("double") / F.lit(float(2 ** ORDER_BITS))
    u = F.greatest(u, F.lit(1e-300))
    # Class sizes: one row per (slice, label), so broadcasting is bounded by
    # the number of slices times two.
    sizes = df.groupBy(slice_col, label).agg(F.count(F.lit(1)).alias("__cls_n"))
    keyed = (df.join(sizes, [slice_col, label], "left")
               .withColumn("__es", -F.log(u) * F.col("__cls_n") / F.lit(0.5))
               .drop("__cls_n"))
    rn = F.row_number().over(Window.partitionBy(slice_col).orderBy("__es", key))
    return keyed.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__es", "__rn")


def sample_errors(df: DataFrame, label: str = "label", pred: str = "pred", n: int = 10,
                  key: str = ORDER, seed: int = 1, content_type: str | None = None,
                  slice_col: str = "contentType") -> DataFrame:
    """Up to ``n`` random false positives and ``n`` false negatives."""
    d = df if content_type is None else df.where(F.col(slice_col) == content_type)
    err = d.where(F.col(label) != F.col(pred)).withColumn(
        "error", F.when(F.col(label), F.lit("FN")).otherwise(F.lit("FP")))
    h = hash_order(key, seed)
    rn = F.row_number().over(Window.partitionBy("error").orderBy(h, key))
    return err.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def error_positions(df: DataFrame, label: str = "label", pred: str = "pred", key: str = ORDER,
                    seed: int = 1, n: int = 7) -> DataFrame:
    """Fixed positions of each error list (false negatives, false positives)
    ordered by id: positions 2..n, the last n, and n seeded random ones.

    Ranks come from the segmented running count (``cumulative.running``),
    so a long error list is never ranked in one task.
    """
    from .cumulative import running
    err = (df.where(F.col(label) != F.col(pred))
             .withColumn("error", F.when(F.col(label), F.lit("FN")).otherwise(F.lit("FP"))))
    r = running(err, ["error"], {"position": ("count", None)}, order=key, chunk_width=1 << 16)
    sizes = err.groupBy("error").agg(F.count(F.lit(1)).alias("__n"))
    h = hash_order(key, seed)
    # n random ones: the n smallest hashes per list (a per-partition limit before the shuffle)
    rnd = (err.withColumn("__h", h)
              .withColumn("__r", F.row_number().over(Window.partitionBy("error").orderBy("__h", key)))
              .where(F.col("__r") <= n).select(key, F.lit(True).alias("__random")))
    # two rows (one per error kind): a bounded broadcast
    j = r.join(F.broadcast(sizes), "error").join(rnd, key, "left")
    pos = F.col("position")
    keep = ((pos >= 2) & (pos <= n)) | (pos > F.col("__n") - n) | F.col("__random").isNotNull()
    return j.where(keep).drop("__n", "__random")


def topk_misclassified(df: DataFrame, label: str = "label", prob: str = "prob",
                       key: str = ORDER, k: int = 5) -> DataFrame:
    """The k lowest-scored positives and the k highest-scored negatives."""
    order = F.when(F.col(label), F.col(prob)).otherwise(-F.col(prob))
    rn = F.row_number().over(Window.partitionBy(label).orderBy(order, key))
    return df.withColumn("rank", rn).where(F.col("rank") <= k)
