"""Registered feature queries: velocity windows, encodings, node/edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlens.operators import velocity as V
from fraudlens.plans.registry import register, with_tx
from fraudlens.sources.tables import transactions


def _frame(key, width):
    return (f"OVER (PARTITION BY {key} ORDER BY dt RANGE BETWEEN {width} PRECEDING "
            f"AND 1 PRECEDING)")


def _money_sum(key, width):
    return (f"coalesce(CAST(sum(CAST(amt AS DECIMAL(18,3))) {_frame(key, width)} AS DOUBLE), 0.0)")


CARD_VELOCITY_COLS = [
    "transaction_id", "card_id", "dt", "amt", "card_tx_1h", "card_tx_6h", "card_tx_24h",
    "card_amt_1h", "card_amt_6h", "card_amt_24h", "card_avg_amt_1h", "card_avg_amt_24h",
    "amt_ratio_1h", "amt_ratio_24h", "card_tx_seq", "time_since_last_tx", "is_new_card",
    "is_burst"]

CARD_VELOCITY_SQL = with_tx(f"""
, w AS (
  SELECT transaction_id, card_id, dt, amt,
    count(*) {_frame('card_id', 3600)} AS card_tx_1h,
    count(*) {_frame('card_id', 21600)} AS card_tx_6h,
    count(*) {_frame('card_id', 86400)} AS card_tx_24h,
    {_money_sum('card_id', 3600)} AS card_amt_1h,
    {_money_sum('card_id', 21600)} AS card_amt_6h,
    {_money_sum('card_id', 86400)} AS card_amt_24h,
    CAST(row_number() OVER (PARTITION BY card_id ORDER BY dt, transaction_id) AS INTEGER) AS card_tx_seq,
    lag(dt) OVER (PARTITION BY card_id ORDER BY dt, transaction_id) AS prev_dt
  FROM tx),
a AS (
  SELECT *, CASE WHEN card_tx_1h > 0 THEN card_amt_1h / card_tx_1h ELSE 0.0 END AS card_avg_amt_1h,
            CASE WHEN card_tx_24h > 0 THEN card_amt_24h / card_tx_24h ELSE 0.0 END AS card_avg_amt_24h
  FROM w)
SELECT transaction_id, card_id, dt, amt, card_tx_1h, card_tx_6h, card_tx_24h,
  card_amt_1h, card_amt_6h, card_amt_24h, card_avg_amt_1h, card_avg_amt_24h,
  CASE WHEN card_avg_amt_1h > 0 THEN amt / card_avg_amt_1h ELSE 1.0 END AS amt_ratio_1h,
  CASE WHEN card_avg_amt_24h > 0 THEN amt / card_avg_amt_24h ELSE 1.0 END AS amt_ratio_24h,
  card_tx_seq, coalesce(dt - prev_dt, 999999) AS time_since_last_tx,
  CASE WHEN card_tx_seq = 1 THEN 1 ELSE 0 END AS is_new_card,
  CASE WHEN card_tx_1h >= 3 THEN 1 ELSE 0 END AS is_burst
FROM a""")


@register("card_velocity", CARD_VELOCITY_SQL, headline=True)
def card_velocity(spark, sf_dir):
    """Per-card trailing 1h/6h/24h counts and sums."""
    tx = transactions(spark, sf_dir).select("transaction_id", "card_id", "dt", "amt")
    return V.card_velocity(tx).select(*CARD_VELOCITY_COLS)


# ---------------------------------------------------------------------------
# Enriched pipeline: clean -> windows -> encodings -> node / edge tables
# ---------------------------------------------------------------------------
from fraudlens.operators import encodings as ENC  # noqa: E402
from fraudlens.operators import nodes as N  # noqa: E402
from fraudlens.operators.enrich import enriched_transactions  # noqa: E402
from fraudlens.plans import sql as S  # noqa: E402
from fraudlens.sources.tables import transactions_with_identity  # noqa: E402

CLEAN_COLS = ["transaction_id", "card_id", "merchant_id", "uid", "uid2", "hour", "day_of_week",
              "day", "is_night", "is_weekend", "amt_decimal", "is_round_amt"]


@register("clean_columns", S.clean_sql(
    f"SELECT {', '.join(CLEAN_COLS)}, round(log_amt, 9) AS log_amt FROM cl"))
def clean_columns(spark, sf_dir):
    """B1-B9 + D1: keys, time and amount parts over transactions ⟕ identity."""
    df = ENC.clean(transactions_with_identity(spark, sf_dir))
    return df.select(*CLEAN_COLS, F.round("log_amt", 9).alias("log_amt"))


MERCHANT_VELOCITY_COLS = ["transaction_id", "merchant_id", "dt", "merchant_tx_1h",
                          "merchant_tx_24h", "merchant_unique_cards_1h"]


@register("merchant_velocity", S.ctes(S.TX_SQL, """
mv AS (
  SELECT transaction_id, merchant_id, dt,
    count(*) OVER (PARTITION BY merchant_id ORDER BY dt RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS merchant_tx_1h,
    count(*) OVER (PARTITION BY merchant_id ORDER BY dt RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS merchant_tx_24h,
    count(DISTINCT card_id) OVER (PARTITION BY merchant_id ORDER BY dt RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS merchant_unique_cards_1h
  FROM tx)""") + "SELECT * FROM mv")
def merchant_velocity(spark, sf_dir):
    """Per-merchant trailing counts and exact distinct cards in 1h."""
    tx = transactions(spark, sf_dir).select("transaction_id", "merchant_id", "card_id", "dt", "amt")
    return V.merchant_velocity(tx).select(*MERCHANT_VELOCITY_COLS)


UID_VELOCITY_COLS = ["transaction_id", "uid", "dt", "uid_tx_1h", "uid_tx_24h", "uid_amt_24h",
                     "uid_tx_seq"]


@register("uid_velocity", S.clean_sql(f"""
SELECT transaction_id, uid, dt,
  count(*) {S.frame('uid', 3600)} AS uid_tx_1h,
  count(*) {S.frame('uid', 86400)} AS uid_tx_24h,
  {S.money_sum_over('uid', 86400)} AS uid_amt_24h,
  CAST(row_number() OVER (PARTITION BY uid ORDER BY dt, transaction_id) AS INTEGER) AS uid_tx_seq
FROM cl"""))
def uid_velocity(spark, sf_dir):
    """F7 + F5(uid): trailing counts / amount and sequence per uid."""
    df = ENC.clean(transactions_with_identity(spark, sf_dir)).select(
        "transaction_id", "uid", "dt", "amt")
    return V.uid_velocity(df).select(*UID_VELOCITY_COLS)


@register("time_threshold", S.ctes(S.TX_SQL) + """
SELECT max(dt) AS threshold FROM (
  SELECT dt, row_number() OVER (ORDER BY dt) AS rn FROM tx)
WHERE rn <= (SELECT CAST(floor(CAST(0.7 AS DOUBLE) * count(*)) AS BIGINT) FROM tx)""")
def time_threshold(spark, sf_dir):
    """G1: dt of the floor(0.7 n)-th transaction by time, without a global sort."""
    return ENC.time_threshold(transactions(spark, sf_dir).select("dt"))


@register("frequency_encoding", S.enriched_sql(
    "SELECT transaction_id, card1_freq, addr1_freq, email_domain_freq FROM enr"))
def frequency_encoding(spark, sf_dir):
    """E2 + D2: category frequencies joined back (null key -> 0)."""
    df = ENC.clean(transactions_with_identity(spark, sf_dir))
    return ENC.frequency_encoding(df).select(
        "transaction_id", "card1_freq", "addr1_freq", "email_domain_freq")


@register("target_encoding", S.enriched_sql("SELECT transaction_id, card1_te, uid_te FROM enr"))
def target_encoding(spark, sf_dir):
    """E3 + D3 + D11: smoothed fraud rate on the first 70 % by time."""
    df = ENC.clean(transactions_with_identity(spark, sf_dir))
    return ENC.target_encoding(df).select("transaction_id", "card1_te", "uid_te")


CARD_FEATURES_SQL = S.enriched_sql(f"""
SELECT card_id, count(*) AS tx_count, {S.money_mean()} AS amt_mean,
  coalesce(round(stddev_samp(amt), 6), 0) AS amt_std, max(amt) AS amt_max, min(amt) AS amt_min,
  avg(is_round_amt) AS amt_decimal_ratio, round(avg(log_amt), 9) AS log_amt_mean,
  count(DISTINCT merchant_id) AS unique_merchants, count(DISTINCT product) AS unique_products,
  count(DISTINCT addr1) AS unique_addr, avg(is_night) AS night_ratio,
  avg(is_weekend) AS weekend_ratio, max(dt) - min(dt) AS time_span,
  coalesce(round(stddev_samp(dt), 6), 0) AS dt_std, coalesce(round(stddev_samp(hour), 6), 0) AS hour_std,
  avg(card_tx_1h) AS avg_tx_1h, avg(card_tx_24h) AS avg_tx_24h, max(card_tx_1h) AS max_tx_1h,
  max(card_tx_24h) AS max_tx_24h, round(avg(amt_ratio_24h), 9) AS avg_amt_ratio,
  max(amt_ratio_24h) AS max_amt_ratio, avg(is_burst) AS burst_ratio,
  avg(time_since_last_tx) AS avg_time_between_tx, min(time_since_last_tx) AS min_time_between_tx,
  max(card1_te) AS card1_te, avg(is_fraud) AS fraud_rate
FROM enr GROUP BY card_id""")


@register("card_features", CARD_FEATURES_SQL, headline=True)
def card_features(spark, sf_dir):
    """Card node table over the full enriched pipeline (one plan: a
    single aggregate needs no lineage cut; shuffle files cover failures)."""
    return N.card_features(enriched_transactions(spark, sf_dir, checkpoint=False))


MERCHANT_FEATURES_SQL = S.enriched_sql(f"""
, m AS (
  SELECT merchant_id, count(*) AS tx_count, count(DISTINCT card_id) AS unique_cards,
    count(DISTINCT uid) AS unique_uids, {S.money_mean()} AS amt_mean,
    round(stddev_samp(amt), 6) AS amt_std, max(amt) AS amt_max, avg(is_fraud) AS fraud_rate,
    CAST(sum(CAST(amt AS DECIMAL(18,3))) AS DOUBLE) / count(DISTINCT card_id) AS avg_amt_per_card,
    stddev_samp(dt) AS dt_std_raw, avg(is_night) AS night_ratio, avg(is_round_amt) AS round_amt_ratio,
    avg(is_weekend) AS weekend_ratio, round(stddev_samp(hour), 6) AS hour_std,
    avg(merchant_tx_1h) AS avg_tx_1h, avg(merchant_tx_24h) AS avg_tx_24h,
    max(merchant_tx_1h) AS max_tx_1h, max(merchant_tx_24h) AS max_tx_24h,
    avg(merchant_unique_cards_1h) AS avg_unique_cards_1h
  FROM enr GROUP BY merchant_id),
reuse AS (
  SELECT merchant_id, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) / count(*) AS card_reuse_rate
  FROM (SELECT merchant_id, card_id, count(*) AS n FROM enr GROUP BY merchant_id, card_id)
  GROUP BY merchant_id),
mx AS (SELECT CASE WHEN max(dt_std_raw) IS NULL OR max(dt_std_raw) = 0 THEN 1.0
                   ELSE max(dt_std_raw) END AS v FROM m)
SELECT m.merchant_id, tx_count, unique_cards, unique_uids, amt_mean, coalesce(amt_std, 0) AS amt_std,
  amt_max, fraud_rate, avg_amt_per_card, coalesce(round(dt_std_raw, 6), 0) AS dt_std, night_ratio,
  round_amt_ratio, weekend_ratio, coalesce(hour_std, 0) AS hour_std, avg_tx_1h, avg_tx_24h,
  max_tx_1h, max_tx_24h, avg_unique_cards_1h, coalesce(card_reuse_rate, 0) AS card_reuse_rate,
  coalesce(round(1 - dt_std_raw / (SELECT v FROM mx), 9), 0) AS time_concentration
FROM m LEFT JOIN reuse ON m.merchant_id = reuse.merchant_id""".replace("\n, m AS", ", m AS", 1))


@register("merchant_features", MERCHANT_FEATURES_SQL, headline=True)
def merchant_features(spark, sf_dir):
    """Merchant node table with card reuse and time concentration
    (the per-merchant aggregate is written once for the max(dt_std) subquery)."""
    return N.merchant_features(enriched_transactions(spark, sf_dir, checkpoint=False))


def _edge_select_sql():
    cols = [c if c != "log_amt" else "round(log_amt, 9) AS log_amt" for c in N.EDGE_BASE_COLUMNS]
    return "SELECT " + ", ".join(cols) + " FROM enr"


@register("edge_table", S.enriched_sql(_edge_select_sql()))
def edge_table(spark, sf_dir):
    """Schema-tolerant edge projection, nulls -> 0."""
    e = N.edge_table(enriched_transactions(spark, sf_dir, checkpoint=False))
    return e.withColumn("log_amt", F.round("log_amt", 9))


@register("graph_stats", S.ctes(S.TX_SQL) + """
SELECT (SELECT count(DISTINCT card_id) FROM tx) AS num_cards,
       (SELECT count(DISTINCT merchant_id) FROM tx) AS num_merchants,
       (SELECT count(*) FROM tx) AS num_edges,
       (SELECT CAST(sum(is_fraud) AS BIGINT) FROM tx) AS fraud_count,
       (SELECT avg(is_fraud) FROM tx) AS fraud_rate,
       (SELECT avg(n) FROM (SELECT card_id, count(*) AS n FROM tx GROUP BY card_id)) AS card_avg_degree,
       (SELECT max(n) FROM (SELECT card_id, count(*) AS n FROM tx GROUP BY card_id)) AS card_max_degree""")
def graph_stats(spark, sf_dir):
    """Graph statistics as one row."""
    return N.graph_stats(transactions(spark, sf_dir), spark)
