"""Evaluation metrics vs brute-force definitions."""

import random

from fraudlens.operators import metrics as M


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return 0.0
    u = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return u / (len(pos) * len(neg))


def brute_ap(rows):
    P = sum(y for _, y in rows)
    ap = 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        sel = [y for t, y in rows if t >= s]
        tp_here = sum(y for t, y in rows if t == s)
        ap += tp_here / P * (sum(sel) / len(sel))
    return ap


def test_auc_ap_with_ties(spark):
    rnd = random.Random(3)
    rows = [(round(rnd.random(), 1), int(rnd.random() < 0.3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "score double, label int")
    cum = M.cumulative_counts(M.score_counts(df))
    assert abs(M.roc_auc(cum).first().auc - brute_auc(rows)) < 1e-12
    assert abs(M.average_precision(cum).first().ap - brute_ap(rows)) < 1e-9


def test_auc_one_class_is_zero(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 1)], "score double, label int")
    assert M.roc_auc(M.cumulative_counts(M.score_counts(df))).first().auc == 0.0


def test_ap_differs_from_trapezoid_example(spark):
    # step-wise AP on a 5-row example is 0.5 (a trapezoidal PR area would give 0.333)
    rows = [(0.9, 0), (0.8, 1), (0.7, 0), (0.6, 0), (0.5, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    assert abs(M.average_precision(M.cumulative_counts(M.score_counts(df))).first().ap - 0.5) < 1e-12


def test_threshold_sweep_and_default(spark):
    rnd = random.Random(5)
    rows = [(rnd.random(), int(rnd.random() < 0.2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score double, label int")
    sweep = {round(r.threshold, 2): r for r in M.threshold_sweep(df).collect()}
    for i in range(41):
        t = (10 + 2 * i) / 100
        tp = sum(1 for s, y in rows if s >= t and y == 1)
        fp = sum(1 for s, y in rows if s >= t and y == 0)
        assert (sweep[round(t, 2)].tp, sweep[round(t, 2)].fp) == (tp, fp)
    zero = spark.createDataFrame([(0.0, 1), (0.0, 0)], "score double, label int")
    assert M.best_threshold(M.threshold_sweep(zero)).first().best_threshold == 0.5


def test_confusion_strict_vs_inclusive(spark):
    df = spark.createDataFrame([(0.5, 1), (0.4, 0)], "score double, label int")
    assert M.confusion(df).first().tp == 1
    assert M.confusion(df, strict=True).first().tp == 0
