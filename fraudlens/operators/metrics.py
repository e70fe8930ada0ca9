"""Scoring evaluation.

Everything starts from per-score counts ``(score, pos, neg)``: a grouped
aggregate that map-side combines, so a heavily tied score costs one partial
row per partition.  Rank-based metrics (ROC-AUC with ties, average
precision, curves) need cumulative counts over the *distinct* scores in
order: running totals over ranges of scores whose bounds are sampled
(``ranges.running_totals``), so no task holds them all and scores that crowd
in a small part of [0, 1] are spread as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.functions import columns as C
from fraudlens.operators.ranges import running_totals

PRECISION = 9
# Fixed values of the threshold sweep: 0.10, 0.12, ..., 0.90; default 0.5.
SWEEP_START, SWEEP_STEP, SWEEP_COUNT, SWEEP_DEFAULT = 10, 2, 41, 0.5
LOG_FLOOR = -100.0  # log clamp of binary cross-entropy


def score_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    y = F.col(label).cast("int")
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(y).cast("bigint").alias("pos"), F.sum(1 - y).cast("bigint").alias("neg"))


def cumulative_counts(counts: DataFrame) -> DataFrame:
    """Add, per distinct score, positives / negatives strictly below and at
    or above it (``pos_lt``, ``neg_lt``, ``pos_ge``, ``neg_ge``) and the
    class totals ``P``, ``N``."""
    t = running_totals(counts, ["score"], ["pos", "neg"])
    out = t.select("score", "pos", "neg", F.col("pos_before").alias("pos_lt"), F.col("neg_before").alias("neg_lt"),
                   F.col("pos_total").alias("P"), F.col("neg_total").alias("N"))
    return out.select("*", (F.col("P") - F.col("pos_lt")).alias("pos_ge"), (F.col("N") - F.col("neg_lt")).alias("neg_ge"))


def _auc(u: str, p: str, n: str):
    return F.when((F.col(p) > 0) & (F.col(n) > 0), F.col(u) / (F.col(p) * F.col(n))).otherwise(0.0)


def _rank_sums():
    """What AUC and AP need of each distinct score, and the class totals."""
    precision = F.col("pos_ge") / (F.col("pos_ge") + F.col("neg_ge"))
    return [F.sum(F.col("pos") * (F.col("neg_lt") + 0.5 * F.col("neg"))).alias("_u"),
            F.sum(F.col("pos") * precision).alias("_s"), F.max("P").alias("P"), F.max("N").alias("N")]


def _ap():
    return F.when((F.col("P") > 0) & (F.col("N") > 0), F.round(F.col("_s") / F.col("P"), PRECISION)).otherwise(0.0)


def roc_auc(cum: DataFrame) -> DataFrame:
    """Mann-Whitney AUC with ties counted one half; 0 with one class."""
    return cum.agg(*_rank_sums()).select(_auc("_u", "P", "N").alias("auc"))


def average_precision(cum: DataFrame) -> DataFrame:
    """Step-wise AP = sum over distinct scores of (delta recall) x precision."""
    return cum.agg(*_rank_sums()).select(_ap().alias("ap"))


def curves(cum: DataFrame) -> DataFrame:
    """ROC and precision-recall points, one per distinct score threshold."""
    return cum.select(
        F.col("score").alias("threshold"),
        C.safe_div("neg_ge", "N").alias("fpr"),
        C.safe_div("pos_ge", "P").alias("tpr"),
        (F.col("pos_ge") / (F.col("pos_ge") + F.col("neg_ge"))).alias("precision"),
        C.safe_div("pos_ge", "P").alias("recall"))


def confusion(df: DataFrame, score: str = "score", label: str = "label",
              threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """E26 + E27: confusion counts and P / R / F1 (zero division -> 0)."""
    pred = (F.col(score) > threshold) if strict else (F.col(score) >= threshold)
    y = F.col(label) == 1

    def cnt(c):
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    m = df.agg(cnt(~pred & ~y).alias("tn"), cnt(pred & ~y).alias("fp"),
               cnt(~pred & y).alias("fn"), cnt(pred & y).alias("tp"))
    return with_prf(m)


def with_prf(m: DataFrame) -> DataFrame:
    p = C.safe_div("tp", F.col("tp") + F.col("fp"))
    r = C.safe_div("tp", F.col("tp") + F.col("fn"))
    m = m.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return m.withColumn("f1", f1)


def confusion_share(m: DataFrame) -> DataFrame:
    """Each confusion cell as a share of all rows."""
    tot = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return m.select("*", *[(F.col(c) / tot).alias(f"{c}_share") for c in ("tn", "fp", "fn", "tp")])


def _sweep_index(score_col):
    """Largest sweep index i with (10 + 2i) / 100 <= score (-1 if none).

    A float floor is corrected by one step both ways so the comparison is
    made against the same doubles (10 + 2i) / 100 the SQL oracle uses."""
    def thr(i):
        return (F.lit(SWEEP_START) + F.lit(SWEEP_STEP) * i) / 100.0
    i0 = F.floor((score_col * 100 - SWEEP_START) / SWEEP_STEP).cast("int")
    i1 = F.when(score_col >= thr(i0 + 1), i0 + 1).otherwise(i0)
    i2 = F.when(score_col < thr(i1), i1 - 1).otherwise(i1)
    return F.least(F.greatest(i2, F.lit(-1)), F.lit(SWEEP_COUNT - 1))


def threshold_sweep(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """E31 (table): P / R / F1 at each of the 41 thresholds, predicate ``>=``.

    Rows are counted per sweep index (<= 42 groups), then suffix sums give
    the positives predicted at every threshold: no per-threshold pass."""
    idx = df.groupBy(_sweep_index(F.col(score).cast("double")).alias("i")).agg(
        F.sum(F.col(label)).cast("bigint").alias("pos"), F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = spark.range(SWEEP_COUNT).select(F.col("id").cast("int").alias("i"))
    full = grid.join(F.broadcast(idx), "i", "left").fillna(0)  # <= 42 rows each side
    P = df.select(F.sum(label).cast("bigint")).scalar()
    w = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = full.select("i", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("pred"))
    m = s.select(((F.lit(SWEEP_START) + F.lit(SWEEP_STEP) * F.col("i")) / 100.0).alias("threshold"),
                 F.col("tp").cast("bigint").alias("tp"),
                 (F.col("pred") - F.col("tp")).cast("bigint").alias("fp"),
                 (P - F.col("tp")).cast("bigint").alias("fn"))
    return with_prf(m)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """First threshold with the maximal F1; 0.5 when every F1 is 0."""
    best = sweep.agg(F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("t"),
                     F.max("f1").alias("best_f1"))
    return best.select(F.when(F.col("best_f1") > 0, F.col("t")).otherwise(SWEEP_DEFAULT)
                       .alias("best_threshold"), "best_f1")


def _log(c):
    return F.greatest(F.log(F.when(c > 0, c)), F.lit(LOG_FLOOR))


def losses(df: DataFrame, score: str = "score", label: str = "label",
           fraud_weight: float = 10.0, gamma: float = 2.0) -> DataFrame:
    """Focal loss, class-weighted cross-entropy and binary cross-entropy
    of probabilities ``score`` against 0/1 ``label`` (log clamped at -100)."""
    p = F.col(score).cast("double")
    y = F.col(label)
    pt = F.when(y == 1, p).otherwise(1 - p)
    ce = -_log(pt)
    w = F.when(y == 1, F.lit(fraud_weight)).otherwise(F.lit(1.0))
    agg = df.agg(F.avg(w * F.pow(1 - pt, gamma) * ce).alias("focal"),
                 (F.sum(w * ce) / F.sum(w)).alias("weighted_ce"),
                 F.avg(-(y * _log(p) + (1 - y) * _log(1 - p))).alias("bce"))
    return agg.select(*[F.round(c, PRECISION).alias(c) for c in ("focal", "weighted_ce", "bce")])


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives / positives (null when there is no positive)."""
    a = df.agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"),
               F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"))
    return a.select(F.when(F.col("pos") > 0, F.col("neg") / F.col("pos")).alias("class_weight"))


def score_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """Mean / population std / max of a score column."""
    return df.agg(F.round(F.avg(score), PRECISION).alias("mean"),
                  F.round(F.stddev_pop(score), PRECISION).alias("std"),
                  F.max(score).alias("max"))


def evaluate(df: DataFrame, score: str = "score", label: str = "label",
             threshold: float = 0.5) -> DataFrame:
    """AUC, AP, P / R / F1 and the confusion matrix in one row, from one pass over
    the counts of distinct scores (a null score is in no cell of the matrix)."""
    hit = F.col("score") >= threshold

    def cell(c, n):
        return F.sum(F.when(c, F.col(n)).otherwise(0)).cast("bigint")
    m = cumulative_counts(score_counts(df, score, label)).agg(
        *_rank_sums(), cell(~hit, "neg").alias("tn"), cell(hit, "neg").alias("fp"),
        cell(~hit, "pos").alias("fn"), cell(hit, "pos").alias("tp"))
    m = m.withColumn("auc", F.round(_auc("_u", "P", "N"), PRECISION)).withColumn("ap", _ap())
    return with_prf(m).select("auc", "ap", "precision", "recall", "f1", "tn", "fp", "fn", "tp")


def long_metrics(row: DataFrame, metrics=("auc", "ap", "precision", "recall", "f1"),
                 model: str | None = None) -> DataFrame:
    """H3: wide metric row -> (model, metric, value) rows."""
    long = row.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [], list(metrics), "metric", "value")
    return long if model is None else long.select(F.lit(model).alias("model"), "metric", "value")


def ablation(baseline: DataFrame, candidate: DataFrame,
             metrics=("auc", "ap", "precision", "recall", "f1")) -> DataFrame:
    """Join baseline and candidate metrics on the metric name; delta."""
    b = long_metrics(baseline, metrics).withColumnRenamed("value", "baseline")
    c = long_metrics(candidate, metrics).withColumnRenamed("value", "candidate")
    return b.join(c, "metric").select(
        "metric", "baseline", "candidate",
        F.round(F.col("candidate") - F.col("baseline"), PRECISION).alias("delta"))
