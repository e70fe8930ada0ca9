"""Quantiles and rank metrics over ranges of values."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from fraudlens.operators import metrics as M
from fraudlens.operators.ranges import exact_quantile, running_totals
from tests.test_metrics import brute_ap, brute_auc
from tests.test_plans import plan


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(2)
    values = [("a", float(v)) for v in np.round(rng.exponential(size=301), 2)] + [("b", 4.0)] * 50 + [("c", -1.5), ("c", None), (None, 2.0)]
    df = spark.createDataFrame(values, "g string, v double")
    for q in (0.0, 0.25, 0.99, 1.0):
        got = {r.g: r.quantile for r in exact_quantile(df, "v", q, ["g"]).collect()}
        for g in ("a", "b", "c"):
            assert abs(got[g] - np.quantile([v for k, v in values if k == g and v is not None], q)) < 1e-12
        every = exact_quantile(df, "v", q).first().quantile
        assert abs(every - np.quantile([v for _, v in values if v is not None], q)) < 1e-12
    assert exact_quantile(df.filter("g = 'z'"), "v", 0.5).first().quantile is None


def test_no_task_holds_a_whole_group(spark, sf):
    for name in ("trimmed_amounts", "card_frequency"):
        assert "percentile" not in plan(E.queries()[name](spark, sf)).lower()


def test_crowded_scores_are_spread(spark):
    rng = np.random.default_rng(4)
    scores = np.where(rng.random(4000) < 0.99, rng.random(4000) * 1e-3, rng.random(4000))
    rows = [(float(s), int(rng.random() < 0.2 + s)) for s in scores]
    df = spark.createDataFrame(rows, "score double, label int")
    counts = M.score_counts(df)
    parts = running_totals(counts, ["score"], ["pos"], 8).select(F.spark_partition_id().alias("p"))
    assert parts.count() == len({s for s, _ in rows})
    spread = counts.repartitionByRange(8, "score").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 1500
    ev = M.evaluate(df, threshold=5e-4).first()
    some = rows[:400]
    few = M.evaluate(spark.createDataFrame(some, "score double, label int")).first()
    assert abs(few.auc - brute_auc(some)) < 1e-8 and abs(few.ap - brute_ap(some)) < 1e-8
    assert (ev.tp, ev.fp) == tuple(sum(1 for s, y in rows if s >= 5e-4 and y == k) for k in (1, 0))
    assert ev.tp + ev.fp + ev.tn + ev.fn == len(rows)
