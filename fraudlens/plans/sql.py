"""Reusable DuckDB SQL fragments for the oracle queries.

These are written the straightforward way (plain ``PARTITION BY key``
windows, global ``ORDER BY``), independent of the Spark formulation, so a
match means the distributed rewrite computes the same thing.
"""

from __future__ import annotations

from fraudlens.plans.registry import IDENTITY_SQL, TX_SQL  # noqa: F401


def seeded(seed, c: str) -> str:
    """The seeded hash of a value: 60 bits of an md5."""
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({c} AS VARCHAR)), 1, 15) AS BIGINT)"


def frame(key: str, width: int) -> str:
    return f"OVER (PARTITION BY {key} ORDER BY dt RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"


def money_sum_over(key: str, width: int) -> str:
    return f"coalesce(CAST(sum(CAST(amt AS DECIMAL(18,3))) {frame(key, width)} AS DOUBLE), 0.0)"


def money_mean() -> str:
    return "CAST(sum(CAST(amt AS DECIMAL(18,3))) AS DOUBLE) / count(*)"


CLEAN_SQL = """
txi AS (
  SELECT tx.*, ident.email_domain, ident.device_type, ident.device_info, ident.d1
  FROM tx LEFT JOIN ident ON tx.card1 = ident.card1),
cl AS (
  SELECT *,
    concat_ws('_', CAST(card1 AS VARCHAR), coalesce(CAST(addr1 AS VARCHAR), '-1'),
              coalesce(email_domain, 'unknown')) AS uid,
    concat_ws('_', CAST(card1 AS VARCHAR), coalesce(CAST(addr1 AS VARCHAR), '-1'),
              coalesce(CAST(d1 AS VARCHAR), '-1')) AS uid2,
    CAST((dt // 3600) % 24 AS INTEGER) AS hour,
    CAST((dt // 86400) % 7 AS INTEGER) AS day_of_week,
    CAST(dt // 86400 AS INTEGER) AS day,
    CASE WHEN (dt // 3600) % 24 < 6 THEN 1 ELSE 0 END AS is_night,
    CASE WHEN (dt // 86400) % 7 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
    amt - floor(amt) AS amt_decimal,
    CASE WHEN amt - floor(amt) < 0.01 THEN 1 ELSE 0 END AS is_round_amt,
    ln(1 + amt) AS log_amt
  FROM txi)"""

VELOCITY_SQL = f"""
cv AS (
  SELECT *,
    count(*) {frame('card_id', 3600)} AS card_tx_1h,
    count(*) {frame('card_id', 21600)} AS card_tx_6h,
    count(*) {frame('card_id', 86400)} AS card_tx_24h,
    {money_sum_over('card_id', 3600)} AS card_amt_1h,
    {money_sum_over('card_id', 21600)} AS card_amt_6h,
    {money_sum_over('card_id', 86400)} AS card_amt_24h,
    CAST(row_number() OVER (PARTITION BY card_id ORDER BY dt, transaction_id) AS INTEGER) AS card_tx_seq,
    lag(dt) OVER (PARTITION BY card_id ORDER BY dt, transaction_id) AS prev_tx_dt,
    count(*) {frame('merchant_id', 3600)} AS merchant_tx_1h,
    count(*) {frame('merchant_id', 86400)} AS merchant_tx_24h,
    count(DISTINCT card_id) {frame('merchant_id', 3600)} AS merchant_unique_cards_1h,
    count(*) {frame('uid', 3600)} AS uid_tx_1h,
    count(*) {frame('uid', 86400)} AS uid_tx_24h,
    {money_sum_over('uid', 86400)} AS uid_amt_24h,
    CAST(row_number() OVER (PARTITION BY uid ORDER BY dt, transaction_id) AS INTEGER) AS uid_tx_seq
  FROM cl),
cv2 AS (
  SELECT *,
    CASE WHEN card_tx_1h > 0 THEN card_amt_1h / card_tx_1h ELSE 0.0 END AS card_avg_amt_1h,
    CASE WHEN card_tx_24h > 0 THEN card_amt_24h / card_tx_24h ELSE 0.0 END AS card_avg_amt_24h,
    coalesce(dt - prev_tx_dt, 999999) AS time_since_last_tx,
    CASE WHEN card_tx_seq = 1 THEN 1 ELSE 0 END AS is_new_card,
    CASE WHEN card_tx_1h >= 3 THEN 1 ELSE 0 END AS is_burst
  FROM cv),
vel AS (
  SELECT *,
    CASE WHEN card_avg_amt_1h > 0 THEN amt / card_avg_amt_1h ELSE 1.0 END AS amt_ratio_1h,
    CASE WHEN card_avg_amt_24h > 0 THEN amt / card_avg_amt_24h ELSE 1.0 END AS amt_ratio_24h
  FROM cv2)"""

ENCODING_SQL = """
f_card AS (SELECT card1, count(*) AS card1_freq FROM vel GROUP BY card1),
f_addr AS (SELECT addr1, count(*) AS addr1_freq FROM vel GROUP BY addr1),
f_mail AS (SELECT email_domain, count(*) AS email_domain_freq FROM vel GROUP BY email_domain),
thr AS (
  SELECT max(dt) AS threshold FROM (
    SELECT dt, row_number() OVER (ORDER BY dt) AS rn FROM vel)
  WHERE rn <= (SELECT CAST(floor(CAST(0.7 AS DOUBLE) * count(*)) AS BIGINT) FROM vel)),
train AS (SELECT * FROM vel WHERE dt <= (SELECT threshold FROM thr)),
prior AS (SELECT avg(is_fraud) AS g FROM train),
te_card AS (
  SELECT card1, (avg(is_fraud) * count(*) + (SELECT g FROM prior) * 10) / (count(*) + 10) AS card1_te
  FROM train GROUP BY card1),
te_uid AS (
  SELECT uid, (avg(is_fraud) * count(*) + (SELECT g FROM prior) * 10) / (count(*) + 10) AS uid_te
  FROM train GROUP BY uid),
enr AS (
  SELECT vel.*,
    coalesce(f_card.card1_freq, 0) AS card1_freq,
    coalesce(f_addr.addr1_freq, 0) AS addr1_freq,
    coalesce(f_mail.email_domain_freq, 0) AS email_domain_freq,
    coalesce(te_card.card1_te, (SELECT g FROM prior)) AS card1_te,
    coalesce(te_uid.uid_te, (SELECT g FROM prior)) AS uid_te
  FROM vel
  LEFT JOIN f_card ON vel.card1 = f_card.card1
  LEFT JOIN f_addr ON vel.addr1 = f_addr.addr1
  LEFT JOIN f_mail ON vel.email_domain = f_mail.email_domain
  LEFT JOIN te_card ON vel.card1 = te_card.card1
  LEFT JOIN te_uid ON vel.uid = te_uid.uid)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip("\n") for p in parts) + "\n"


def clean_sql(body: str) -> str:
    return ctes(TX_SQL, IDENTITY_SQL, CLEAN_SQL) + body


def enriched_sql(body: str) -> str:
    return ctes(TX_SQL, IDENTITY_SQL, CLEAN_SQL, VELOCITY_SQL, ENCODING_SQL) + body
