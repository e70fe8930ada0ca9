"""Registered evaluation and scoring queries (E26-E33, E36, J9, J13 rules, D13, B22-B24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlens.functions import columns as C
from fraudlens.operators import metrics as M
from fraudlens.operators import velocity as V
from fraudlens.plans import sql as S
from fraudlens.plans.registry import TX_SQL, register
from fraudlens.sources.tables import transactions

# Score under evaluation: a deterministic, heavily tied score from the amount
# (0.01 steps) so tie handling is exercised.
SCORE_SQL = """
sc AS (SELECT transaction_id, least(floor(amt / 2) / 100, 1.0) AS score, is_fraud AS label
       FROM tx)"""


def scored(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return tx.select("transaction_id",
                     F.least(F.floor(F.col("amt") / 2) / 100, F.lit(1.0)).alias("score"),
                     F.col("is_fraud").alias("label"))


CUM_SQL = """
cnt AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
        FROM sc GROUP BY score),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM cnt),
cum AS (
  SELECT score, pos, neg,
    coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_lt,
    coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_lt
  FROM cnt),
cum2 AS (SELECT cum.*, P, N, P - pos_lt AS pos_ge, N - neg_lt AS neg_ge FROM cum, tot)"""

AUC_SQL = """SELECT CASE WHEN max(P) > 0 AND max(N) > 0
  THEN round(sum(pos * (neg_lt + 0.5 * neg)) / (max(P) * max(N)), 9) ELSE 0.0 END AS auc FROM cum2"""
AP_SQL = """SELECT CASE WHEN max(P) > 0 AND max(N) > 0
  THEN round(sum(pos * (pos_ge / (pos_ge + neg_ge))) / max(P), 9) ELSE 0.0 END AS ap FROM cum2"""


@register("roc_auc", S.ctes(TX_SQL, SCORE_SQL, CUM_SQL) + AUC_SQL)
def roc_auc(spark, sf_dir):
    """ROC-AUC with ties (two-level prefix sums over distinct scores)."""
    cum = M.cumulative_counts(M.score_counts(scored(spark, sf_dir)))
    return M.roc_auc(cum).select(F.round("auc", 9).alias("auc"))


@register("average_precision", S.ctes(TX_SQL, SCORE_SQL, CUM_SQL) + AP_SQL)
def average_precision(spark, sf_dir):
    """Step-wise average precision over distinct scores."""
    return M.average_precision(M.cumulative_counts(M.score_counts(scored(spark, sf_dir))))


@register("roc_pr_curve", S.ctes(TX_SQL, SCORE_SQL, CUM_SQL) + """
SELECT score AS threshold, CASE WHEN N > 0 THEN neg_ge / N ELSE 0.0 END AS fpr,
       CASE WHEN P > 0 THEN pos_ge / P ELSE 0.0 END AS tpr,
       pos_ge / (pos_ge + neg_ge) AS precision, CASE WHEN P > 0 THEN pos_ge / P ELSE 0.0 END AS recall
FROM cum2""")
def roc_pr_curve(spark, sf_dir):
    """ROC and PR curve points per distinct threshold."""
    return M.curves(M.cumulative_counts(M.score_counts(scored(spark, sf_dir))))


def _prf_sql(src: str) -> str:
    return f"""
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
               ELSE 0.0 END AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
      FROM ({src}))"""


def _cm_sql(pred: str) -> str:
    return f"""SELECT CAST(sum(CASE WHEN NOT ({pred}) AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN ({pred}) AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN NOT ({pred}) AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN ({pred}) AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM sc"""


@register("confusion_matrix", S.ctes(TX_SQL, SCORE_SQL) + """
SELECT *, tn / (tn + fp + fn + tp) AS tn_share, fp / (tn + fp + fn + tp) AS fp_share,
       fn / (tn + fp + fn + tp) AS fn_share, tp / (tn + fp + fn + tp) AS tp_share
FROM (""" + _prf_sql(_cm_sql("score >= 0.5")) + ")")
def confusion_matrix(spark, sf_dir):
    """E26 + E27: confusion matrix at 0.5 (>=), shares and P / R / F1."""
    return M.confusion_share(M.confusion(scored(spark, sf_dir)))


@register("confusion_strict", S.ctes(TX_SQL, SCORE_SQL) + _prf_sql(_cm_sql("score > 0.5")))
def confusion_strict(spark, sf_dir):
    """E26 + E27 with the comparators' strict ``p > 0.5`` predicate."""
    return M.confusion(scored(spark, sf_dir), strict=True)


SWEEP_SQL = """
th AS (SELECT CAST(i AS INTEGER) AS i, (10 + 2 * i) / 100 AS threshold FROM range(41) r(i)),
sw0 AS (
  SELECT threshold,
    CAST(sum(CASE WHEN score >= threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN score >= threshold AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN score < threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM th, sc GROUP BY threshold)"""


@register("threshold_sweep", S.ctes(TX_SQL, SCORE_SQL, SWEEP_SQL) + _prf_sql("SELECT * FROM sw0"))
def threshold_sweep(spark, sf_dir):
    """E31 table: P / R / F1 for thresholds 0.10 .. 0.90 step 0.02."""
    return M.threshold_sweep(scored(spark, sf_dir))


@register("best_threshold", S.ctes(TX_SQL, SCORE_SQL, SWEEP_SQL) + f"""
, sw AS ({_prf_sql("SELECT * FROM sw0")})
SELECT CASE WHEN max(f1) > 0 THEN arg_min(threshold, (-f1, threshold)) ELSE 0.5 END AS best_threshold,
       max(f1) AS best_f1 FROM sw""".replace("\n, sw AS", ", sw AS", 1))
def best_threshold(spark, sf_dir):
    """Best-F1 threshold (first maximum, default 0.5)."""
    return M.best_threshold(M.threshold_sweep(scored(spark, sf_dir)))


def _log_sql(x: str) -> str:
    return f"greatest(ln(CASE WHEN {x} > 0 THEN {x} END), -100.0)"


@register("losses", S.ctes(TX_SQL, SCORE_SQL, """
l AS (SELECT score AS p, label AS y, CASE WHEN label = 1 THEN score ELSE 1 - score END AS pt,
             CASE WHEN label = 1 THEN 10.0 ELSE 1.0 END AS w FROM sc)""") + f"""
SELECT round(avg(w * pow(1 - pt, 2.0) * -{_log_sql('pt')}), 9) AS focal,
       round(sum(w * -{_log_sql('pt')}) / sum(w), 9) AS weighted_ce,
       round(avg(-(y * {_log_sql('p')} + (1 - y) * {_log_sql('1 - p')})), 9) AS bce
FROM l""")
def losses(spark, sf_dir):
    """Focal, weighted cross-entropy and binary cross-entropy."""
    return M.losses(scored(spark, sf_dir))


@register("class_weight", S.ctes(TX_SQL, SCORE_SQL) + """
SELECT CASE WHEN sum(label) > 0 THEN sum(1 - label) / sum(label) END AS class_weight FROM sc""")
def class_weight(spark, sf_dir):
    """Negatives / positives."""
    return M.class_weight(scored(spark, sf_dir))


@register("score_summary", S.ctes(TX_SQL, SCORE_SQL) + """
SELECT round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std, max(score) AS max FROM sc""")
def score_summary(spark, sf_dir):
    """Mean / std / max of the score."""
    return M.score_summary(scored(spark, sf_dir))


EVAL_SQL = S.ctes(TX_SQL, SCORE_SQL, CUM_SQL) + f"""
SELECT (SELECT round(auc, 9) FROM ({AUC_SQL})) AS auc, (SELECT ap FROM ({AP_SQL})) AS ap,
       precision, recall, f1, tn, fp, fn, tp
FROM ({_prf_sql(_cm_sql("score >= 0.5"))})"""


@register("evaluation", EVAL_SQL)
def evaluation(spark, sf_dir):
    """One-row evaluation of a scored table."""
    return M.evaluate(scored(spark, sf_dir))


# ---------------------------------------------------------------------------
# Rule-based transaction scoring (B22-B24, the rule part of J13) and ablation
# ---------------------------------------------------------------------------
RULE_SQL = S.ctes(TX_SQL, SCORE_SQL, """
v AS (
  SELECT tx.transaction_id, tx.amt, CAST((tx.dt // 3600) % 24 AS INTEGER) AS hour, sc.score AS raw, sc.label,
    count(*) OVER (PARTITION BY card_id ORDER BY dt RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS tx_1h,
    count(*) OVER (PARTITION BY card_id ORDER BY dt RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS tx_24h,
    row_number() OVER (PARTITION BY card_id ORDER BY dt, tx.transaction_id) AS seq,
    coalesce(dt - lag(dt) OVER (PARTITION BY card_id ORDER BY dt, tx.transaction_id), 999999) AS gap
  FROM tx JOIN sc ON tx.transaction_id = sc.transaction_id),
f AS (
  SELECT *, CASE WHEN seq = 1 THEN 1 ELSE 0 END AS new_card, CASE WHEN tx_1h >= 3 THEN 1 ELSE 0 END AS burst
  FROM v),
g AS (
  SELECT *,
    (CASE WHEN amt >= 1500 THEN 1 ELSE 0 END) + (CASE WHEN hour >= 0 AND hour < 6 THEN 1 ELSE 0 END)
    + (CASE WHEN tx_1h >= 3 THEN 1 ELSE 0 END) + (CASE WHEN tx_24h >= 15 THEN 1 ELSE 0 END)
    + (CASE WHEN gap <= 120 THEN 1 ELSE 0 END) + (CASE WHEN new_card = 1 THEN 1 ELSE 0 END)
    + (CASE WHEN burst = 1 THEN 1 ELSE 0 END) AS signals,
    least(greatest(1.0 / (1.0 + exp(-((raw - 0.5) * 3))), 0.0), 1.0) AS calibrated
  FROM f),
h AS (
  SELECT *, least(greatest(CASE WHEN signals >= 2
      THEN 0.7 * calibrated + 0.3 * raw + least(0.16, 0.02 * signals)
      ELSE 0.7 * calibrated + 0.3 * raw END, 0.0), 1.0) AS prob
  FROM g)""")


def rule_scores(spark, sf_dir):
    sc = scored(spark, sf_dir)
    tx = transactions(spark, sf_dir).select("transaction_id", "card_id", "dt", "amt")
    v = V.trailing_features(tx, "card_id", {"1h": (V.HOUR, False), "24h": (V.HOUR_24, False)},
                            prefix="card", with_sequence=True, with_gap=True)
    v = v.join(sc, "transaction_id")
    v = v.select("transaction_id", "amt", C.hour_of_day("dt").alias("hour"),
                 F.col("score").alias("raw"), "label",
                 F.col("card_tx_1h").alias("tx_1h"), F.col("card_tx_24h").alias("tx_24h"),
                 F.col("time_since_last_tx").alias("gap"),
                 C.is_new_card("card_tx_seq").alias("new_card"),
                 C.is_burst("card_tx_1h").alias("burst"))
    sig = C.risk_signal_count("amt", "hour", "tx_1h", "tx_24h", "gap", "new_card", "burst")
    return v.withColumn("signals", sig).withColumn(
        "prob", C.boosted_probability("raw", "signals", "sigmoid"))


@register("rule_scoring", RULE_SQL + """
SELECT transaction_id, CAST(signals AS INTEGER) AS signals, round(prob, 9) AS prob,
  prob >= 0.26 AS is_fraud_pred,
  concat_ws(',', CASE WHEN amt > 1000 THEN 'large_amount' END,
    CASE WHEN hour >= 0 AND hour < 6 THEN 'night' END,
    CASE WHEN tx_1h >= 3 THEN 'high_velocity_1h' END, CASE WHEN new_card = 1 THEN 'new_card' END,
    CASE WHEN burst = 1 THEN 'burst' END, CASE WHEN gap < 60 THEN 'short_gap' END) AS reasons
FROM h""")
def rule_scoring(spark, sf_dir):
    """B22 B23 B24 (J13 rule part): calibration, signal boost, verdict, reasons."""
    r = rule_scores(spark, sf_dir)
    reasons = C.risk_reasons("amt", "hour", "tx_1h", "new_card", "burst", "gap")
    return r.select("transaction_id", F.col("signals").cast("int").alias("signals"),
                    F.round("prob", 9).alias("prob"),
                    (F.col("prob") >= C.FRAUD_THRESHOLD).alias("is_fraud_pred"),
                    F.array_join(reasons, ",").alias("reasons"))


@register("score_ablation", RULE_SQL + f"""
, base AS ({_prf_sql(_cm_sql("score >= 0.5"))}),
cand AS ({_prf_sql(_cm_sql("score >= 0.5").replace("FROM sc", "FROM (SELECT prob AS score, label FROM h)"))}),
bl AS (UNPIVOT (SELECT precision, recall, f1 FROM base) ON precision, recall, f1 INTO NAME metric VALUE baseline),
cl AS (UNPIVOT (SELECT precision, recall, f1 FROM cand) ON precision, recall, f1 INTO NAME metric VALUE candidate)
SELECT bl.metric, baseline, candidate, round(candidate - baseline, 9) AS delta
FROM bl JOIN cl ON bl.metric = cl.metric""".replace("\n, base AS", ", base AS", 1))
def score_ablation(spark, sf_dir):
    """D13 + H3: baseline score vs rule-boosted score, metric deltas."""
    r = rule_scores(spark, sf_dir)
    base = M.confusion(r.select(F.col("raw").alias("score"), "label"))
    cand = M.confusion(r.select(F.col("prob").alias("score"), "label"))
    return M.ablation(base, cand, metrics=("precision", "recall", "f1"))
