"""ROC and precision-recall metrics per content slice, on Spark.

Everything starts from the *points* table: one row per (group, slice,
distinct score) with the positives and negatives at that score.  Running
true/false positive counts in descending score order come from the
segmented prefix scan of ``cumulative.running`` with score buckets as
chunks (bucket bounds from ``percentile_approx``), so no window ever runs
over a whole slice in one task.

From the points:

* ROC area   = sum_i neg_i * (2 TP_i - pos_i) / (2 P N)   (trapezoids; equal
  to the library's exact area, collinear points do not change it)
* PR area, trapezoid = sum_i pos_i / P * (prec_i + prec_(i-1)) / 2, where the
  curve starts at recall 0 with the precision of its first point
* PR area, interpolated (Davis & Goadrich 2006) - between neighbouring
  points A, B with TP_B > TP_A and s = (FP_B - FP_A) / (TP_B - TP_A), the
  points t = 1 .. TP_B - TP_A have precision (TP_A + t) / (TP_A + t + FP_A
  + s t); the area is the trapezoid sum over them.  The t values are
  generated by ``sequence`` in chunks, re-partitioned, so a score shared by
  a third of all positives is spread over many tasks.
* ROC curve at FPR 0.01 ... 1.00: the library's curve (points with equal
  increments on both sides dropped, a start point (0, 0) with threshold
  max + 1 when the first point has false positives), linearly interpolated.

Groups (``group_cols``) let many models or features be evaluated in one
pass: all group/slice combinations share every job.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist
from . import cumulative as C

# Content slices of the metrics (name, contentType values).
SLICES = [("ALL", None), ("ITEM_HEAD", ["TEXT"]), ("ITEM_BODY", ["STATEMENT", "SITELINK"])]
GRID = [float(x) for x in np.arange(0.01, 1.005, 0.01)]  # FPR grid of the ROC curve
MAX_CURVE_POINTS = 10000  # thin_curve bound
CURVES = ["fprValues", "tprValues", "rocThresholds", "recallValues", "precisionValues"]
T_CHUNK = 4096  # interpolation steps per task row
SCORE_BUCKETS = 1000  # at least so many score buckets, and one per BUCKET_POINTS points
BUCKET_POINTS = 1 << 20


def tag_slices(df: DataFrame, slice_col: str | None = "contentType",
               slices=SLICES) -> DataFrame:
    """Add ``slice`` (rows of overlapping slices are repeated)."""
    if slice_col is None:
        return df.withColumn("slice", F.lit("ALL"))
    arr = F.array(*[F.lit(name) if vals is None else F.when(F.col(slice_col).isin(*vals), F.lit(name))
                    for name, vals in slices])
    return df.withColumn("slice", F.explode(F.array_compact(arr)))


def score_points(df: DataFrame, score: str = "prob", label: str = "label",
                 slice_col: str | None = "contentType", group_cols: Sequence[str] = (),
                 slices=SLICES) -> DataFrame:
    """Points with running counts: keys, score, pos, neg, TP, FP, idx, n, P, N.

    ``score`` is renamed to ``score``; ``idx`` is the 1-based rank in
    descending score order and ``npoints`` the number of points of the slice
    (Spark names are case-insensitive, so not ``n`` next to ``N``).
    """
    keys = list(group_cols) + ["slice"]
    lab = F.col(label).cast("double")
    pts = (tag_slices(df.select(*group_cols, F.col(score).cast("double").alias("score"), label,
                                *([slice_col] if slice_col else [])), slice_col, slices)
           .groupBy(*keys, "score")
           .agg(F.sum(lab).cast("bigint").alias("pos"),
                F.sum(1 - lab).cast("bigint").alias("neg")))
    # the grouped points feed three passes (bounds, local scan, chunk totals)
    pts = persist(pts)
    # score buckets for the segmented scan (descending score = ascending chunk)
    buckets = max(SCORE_BUCKETS, -(-pts.count() // BUCKET_POINTS))
    bounds = pts.agg(F.percentile_approx(F.col("score"), [i / buckets for i in range(1, buckets)],
                                         10 * buckets).alias("b")).first()["b"] or []
    splits = [-float("inf")] + sorted(set(float(b) for b in bounds)) + [float("inf")]
    pts = pts.withColumn("__s", F.col("score"))
    pts = Bucketizer(splits=splits, inputCol="__s", outputCol="__bk").transform(pts)
    pts = (pts.withColumn("__ord", -F.col("__s"))
              .withColumn("__chunk", (F.lit(len(splits)) - F.col("__bk")).cast("bigint"))
              .drop("__bk", "__s"))
    run = C.running(pts, keys, {"TP": ("sum", "pos"), "FP": ("sum", "neg"), "idx": ("count", None)},
                    order="__ord", chunk_col=F.col("__chunk"))
    totals = pts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                                    F.count(F.lit(1)).alias("npoints"))
    # one row per (group, slice): bounded by the number of evaluated models x 3
    return run.join(totals, keys).drop("__ord", "__chunk")


def _prec(tp: Column, fp: Column) -> Column:
    return tp.cast("double") / (tp + fp).cast("double")


def areas(points: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """ROC, PR (interpolated) and PR (trapezoid) per group and slice.

    A slice without positives gets 0 for all areas (the reference's rule);
    ROC is missing when the slice has no negatives (undefined).
    """
    keys = list(group_cols) + ["slice"]
    p = points
    tp_prev, fp_prev = F.col("TP") - F.col("pos"), F.col("FP") - F.col("neg")
    prec_i = _prec(F.col("TP"), F.col("FP"))
    prec_prev = F.when(tp_prev + fp_prev > 0, _prec(tp_prev, fp_prev)).otherwise(prec_i)
    simple = (p.groupBy(*keys).agg(
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum(F.col("neg").cast("double") * (2 * F.col("TP") - F.col("pos"))).alias("__roc"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") / F.col("P") * (prec_i + prec_prev) / 2.0)
               .otherwise(0.0)).alias("PR_trapezoid")))
    interp = pr_interpolated(points, group_cols)
    out = simple.join(interp, keys, "left")
    return out.select(
        *keys, F.col("P").alias("positives"), F.col("N").alias("negatives"),
        F.when(F.col("P") == 0, F.lit(0.0)).when(F.col("N") == 0, F.lit(None).cast("double"))
         .otherwise(F.col("__roc") / (2.0 * F.col("P") * F.col("N"))).alias("ROC"),
        F.when(F.col("P") == 0, F.lit(0.0)).otherwise(F.coalesce(F.col("PR"), F.lit(0.0))).alias("PR"),
        F.when(F.col("P") == 0, F.lit(0.0)).otherwise(F.col("PR_trapezoid")).alias("PR_trapezoid"))


def pr_interpolated(points: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Davis-Goadrich interpolated PR area per group and slice."""
    keys = list(group_cols) + ["slice"]
    seg = (points.where(F.col("pos") > 0)
           .select(*keys, "P",
                   (F.col("TP") - F.col("pos")).cast("double").alias("a"),
                   (F.col("FP") - F.col("neg")).cast("double").alias("b"),
                   F.col("pos").alias("m"),
                   (F.col("neg") / F.col("pos")).alias("s"),
                   F.col("TP").alias("TP"), F.col("FP").alias("FP"),
                   F.col("score").alias("__id")))  # (keys, score) is unique: a stable segment id

    def p_t(t: Column) -> Column:
        return (F.col("a") + t) / (F.col("a") + t + F.col("b") + F.col("s") * t)

    ends = seg.select(*keys, "__id", "P",
                      _prec(F.col("TP"), F.col("FP")).alias("p_end"),
                      F.when(F.col("a") + F.col("b") > 0, F.col("a") / (F.col("a") + F.col("b")))
                       .otherwise(p_t(F.lit(1.0))).alias("p_start"))
    chunks = (seg.select(*keys, "__id", "a", "b", "s", "m",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), ((F.col("m") - 1) / T_CHUNK).cast("bigint")))
                          .alias("c"))
                 .repartition("__id", "c"))
    steps = chunks.select(*keys, "__id", "a", "b", "s",
                          F.explode(F.sequence(F.col("c") * T_CHUNK + 1,
                                               F.least(F.col("m"), (F.col("c") + 1) * T_CHUNK)))
                           .alias("t"))
    sums = steps.groupBy(*keys, "__id").agg(F.sum(p_t(F.col("t").cast("double"))).alias("S"))
    per_seg = sums.join(ends, keys + ["__id"])
    return (per_seg.groupBy(*keys)
                   .agg(F.sum((F.col("S") - F.col("p_end") / 2.0 + F.col("p_start") / 2.0) / F.col("P"))
                         .alias("PR")))


def roc_curve_100(points: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """TPR and threshold at FPR 0.01 ... 1.00 per group and slice (long form)."""
    keys = list(group_cols) + ["slice"]
    p = points.where((F.col("P") > 0) & (F.col("N") > 0))
    nxt = p.select(*keys, (F.col("idx") - 1).alias("idx"), F.col("pos").alias("npos"),
                   F.col("neg").alias("nneg"))
    # neighbour by rank: an equi-join on (keys, idx), which is unique
    q = p.join(nxt, keys + ["idx"], "left")
    keep = ((F.col("npoints") <= 2) | (F.col("idx") == 1) | (F.col("idx") == F.col("npoints"))
            | (F.col("npos") != F.col("pos")) | (F.col("nneg") != F.col("neg")))
    score = "score"
    kept = (q.where(keep)
             .select(*keys, "idx", F.col(score).cast("double").alias("thr"),
                     (F.col("FP") / F.col("N")).alias("fpr"), (F.col("TP") / F.col("P")).alias("tpr")))
    first_thr = p.where(F.col("idx") == 1).select(*keys, (F.col(score).cast("double") + 1).alias("thr0"))
    seg = C.running(kept, keys, {"fpr0": ("last_before", "fpr"), "tpr0": ("last_before", "tpr"),
                                 "thrp": ("last_before", "thr")}, order="idx", chunk_width=1 << 16)
    seg = (seg.join(first_thr, keys, "left")
              .withColumn("thrp", F.coalesce(F.col("thrp"), F.col("thr0")))
              .withColumn("fpr0", F.coalesce(F.col("fpr0"), F.lit(0.0)))
              .withColumn("tpr0", F.coalesce(F.col("tpr0"), F.lit(0.0)))
              .where(F.col("fpr") > F.col("fpr0")))
    grid = F.array(*[F.lit(x) for x in GRID])
    lo = F.greatest(F.lit(0), F.floor(F.col("fpr0") * 100).cast("int") - 2)
    hi = F.least(F.lit(len(GRID) - 1), F.ceil(F.col("fpr") * 100).cast("int") + 1)
    cand = seg.select(*keys, "fpr0", "tpr0", "thrp", "fpr", "tpr", "thr",
                      F.explode(F.sequence(lo, hi)).alias("j"))
    x = F.element_at(grid, F.col("j") + 1)
    cand = cand.withColumn("x", x).where((F.col("x") > F.col("fpr0")) & (F.col("x") <= F.col("fpr")))
    dx = F.col("fpr") - F.col("fpr0")
    ty = (F.col("tpr") - F.col("tpr0")) / dx * (F.col("x") - F.col("fpr0")) + F.col("tpr0")
    tt = (F.col("thr") - F.col("thrp")) / dx * (F.col("x") - F.col("fpr0")) + F.col("thrp")
    return cand.select(*keys, F.col("j").alias("i"), F.col("x").alias("fpr"), ty.alias("tpr"),
                       tt.alias("threshold"))


def curve_strings(curve: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """The curve as the reference's text columns (``%.2f`` / ``%f``, comma-joined).

    ``collect_list`` gathers at most 100 grid rows per group and slice.
    """
    keys = list(group_cols) + ["slice"]
    pts = F.array_sort(F.collect_list(F.struct("i", "fpr", "tpr", "threshold")))
    g = curve.groupBy(*keys).agg(pts.alias("c"))
    return g.select(*keys,
                    F.array_join(F.transform("c", lambda s: F.format_string("%.2f", s["fpr"])), ",").alias("fprValues"),
                    F.array_join(F.transform("c", lambda s: F.format_string("%f", s["tpr"])), ",").alias("tprValues"),
                    F.array_join(F.transform("c", lambda s: F.format_string("%f", s["threshold"])), ",")
                     .alias("rocThresholds"))


def thin_curve(points: DataFrame, max_points: int = MAX_CURVE_POINTS) -> DataFrame:
    """Keep every ceil(npoints / max_points)-th point and always the last one."""
    step = F.ceil(F.col("npoints") / F.lit(max_points))
    return points.where((F.col("idx") % step == 0) | (F.col("idx") == F.col("npoints")))


def pr_curve(points: DataFrame, max_points: int = MAX_CURVE_POINTS) -> DataFrame:
    """(recall, precision) per point, thinned to at most ``max_points`` per slice."""
    t = thin_curve(points, max_points)
    return t.select(*[c for c in t.columns if c not in ("pos", "neg")],
                    (F.col("TP") / F.col("P")).alias("recall"),
                    _prec(F.col("TP"), F.col("FP")).alias("precision"))


def pr_strings(points: DataFrame, group_cols: Sequence[str] = (),
               max_points: int = MAX_CURVE_POINTS) -> DataFrame:
    """The PR curve as text columns (six places, comma-joined, by falling score).  The places come
    from whole numbers, so that every engine rounds alike.

    Every ``ceil(npoints / max_points)``-th point and the last one, so ``collect_list`` gathers
    at most ``max_points`` and one per group and slice."""
    keys = list(group_cols) + ["slice"]
    micro = lambda part, whole: F.expr(f"(2000000 * {part} + {whole}) div (2 * {whole})")
    curve = thin_curve(points.where(F.col("P") > 0), max_points)
    g = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "idx", micro("TP", "(TP + FP)").alias("precision"), micro("TP", "P").alias("recall")))).alias("c"))
    text = lambda name: F.array_join(F.transform("c", lambda s: F.format_string(
        "%d.%06d", F.floor(s[name] / 1000000), s[name] % 1000000)), ",")
    return g.select(*keys, text("precision").alias("precisionValues"), text("recall").alias("recallValues"))


def metrics_by_slice(df: DataFrame, score: str = "prob", label: str = "label",
                     slice_col: str | None = "contentType", group_cols: Sequence[str] = (),
                     curves: bool = True) -> DataFrame:
    """ROC, PR and both curves as text per group and slice (ALL, HEAD, BODY).

    Slices with no row at all still appear, with zero areas.
    """
    keys = list(group_cols) + ["slice"]
    pts = persist(score_points(df, score, label, slice_col, group_cols))
    a = areas(pts, group_cols)
    if curves:
        a = a.join(curve_strings(roc_curve_100(pts, group_cols), group_cols), keys, "left")
        a = a.join(pr_strings(pts, group_cols), keys, "left")
    # every group gets all slices (one generated row per slice, no join)
    slice_names = F.explode(F.array(*[F.lit(n) for n, _ in SLICES])).alias("slice")
    if group_cols:
        full = df.select(*group_cols).distinct().select(*group_cols, slice_names)
    else:
        full = df.sparkSession.range(1).select(slice_names)
    out = full.join(a, keys, "left")
    for c in ("ROC", "PR", "PR_trapezoid"):
        out = out.withColumn(c, F.when(F.col("positives").isNull(), F.lit(0.0)).otherwise(F.col(c)))
    for c in ("positives", "negatives"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    if curves:
        zeros = F.lit("0.0,0.0")  # two zero points, as the reference stores for empty slices
        for c in CURVES:
            out = out.withColumn(c, F.coalesce(F.col(c), zeros))
    return out


def drop_curves(metrics: DataFrame) -> DataFrame:
    return metrics.drop(*CURVES)
