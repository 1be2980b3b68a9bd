"""ROC / PR areas and the ROC curve against plain-Python brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from editrisk.operators import curves as CV


def _brute(scores, labels):
    s = np.asarray(scores, float)
    y = np.asarray(labels, bool)
    P, N = y.sum(), (~y).sum()
    # ROC: probability a positive outranks a negative (ties count 1/2)
    pos, neg = s[y], s[~y]
    roc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (P * N)
    # distinct-score points, best first
    pts = []
    for v in sorted(set(s), reverse=True):
        pts.append((int(((s == v) & y).sum()), int(((s == v) & ~y).sum())))
    tp = fp = 0
    curve = []  # Davis-Goadrich interpolated (recall, precision)
    trap = []
    for p, q in pts:
        if p > 0:
            slope = q / p
            for t in range(1, p + 1):
                curve.append(((tp + t) / P, (tp + t) / (tp + t + fp + slope * t)))
        else:
            # only false positives: same recall, lower precision
            curve.append((tp / P, tp / (tp + fp + q)))
        tp, fp = tp + p, fp + q
        trap.append((tp / P, tp / (tp + fp)))

    def area(points):
        first = points[0][1]
        prev_r, prev_p, a = 0.0, first, 0.0
        for r, p in points:
            a += (r - prev_r) * (p + prev_p) / 2
            prev_r, prev_p = r, p
        return a
    return roc, area(curve), area(trap)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), min_size=4, max_size=60))
def test_areas_match_brute_force(spark, data):
    scores = [float(a) for a, _ in data]
    labels = [b for _, b in data]
    if all(labels) or not any(labels):
        return
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(zip(scores, labels))],
                               "revisionId long, prob double, label boolean")
    a = CV.areas(CV.score_points(df, "prob", "label", None)).first()
    roc, pr, trap = _brute(scores, labels)
    assert a["ROC"] == pytest.approx(roc, abs=1e-9)
    assert a["PR"] == pytest.approx(pr, abs=1e-9)
    assert a["PR_trapezoid"] == pytest.approx(trap, abs=1e-9)


def test_roc_curve_interpolation_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 300
    scores = np.round(rng.random(n), 2)
    labels = rng.random(n) < 0.3
    df = spark.createDataFrame([(i, float(s), bool(y)) for i, (s, y) in enumerate(zip(scores, labels))],
                               "revisionId long, prob double, label boolean")
    got = {r["i"]: (r["fpr"], r["tpr"]) for r in CV.roc_curve_100(CV.score_points(df, "prob", "label", None)).collect()}
    # brute-force curve (points at distinct scores, start at 0, 0), linear interpolation
    P, N = labels.sum(), (~labels).sum()
    xs, ys = [0.0], [0.0]
    for v in sorted(set(scores), reverse=True):
        xs.append(((scores >= v) & ~labels).sum() / N)
        ys.append(((scores >= v) & labels).sum() / P)
    for i, x in enumerate(CV.GRID):
        j = next(k for k in range(len(xs)) if xs[k] >= x)
        y = ys[j - 1] + (ys[j] - ys[j - 1]) * (x - xs[j - 1]) / (xs[j] - xs[j - 1])
        assert got[i][1] == pytest.approx(y, abs=1e-9)
