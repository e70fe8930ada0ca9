"""Registered streaming queries (L1, L2)."""

from __future__ import annotations

from fraudlens.plans import graph as PG
from fraudlens.plans import sql as S
from fraudlens.plans.registry import TX_SQL, register
from fraudlens.streaming import pipelines as P

CARD_TABLE_SQL = """
cards AS (SELECT card_id, CAST(sum(CAST(amt AS DECIMAL(18,3))) AS DOUBLE) / count(*) AS card_amt_mean
          FROM tx GROUP BY card_id)"""


def _cards(spark, sf_dir):
    f = PG._node_features(PG._tx(spark, sf_dir), "card_id")
    return f.select("card_id", f["amt_mean"].alias("card_amt_mean"))


@register("stream_scoring", S.ctes(TX_SQL, CARD_TABLE_SQL, """
s AS (
  SELECT tx.transaction_id, tx.card_id, tx.amt, tx.dt, CAST((dt // 3600) % 24 AS INTEGER) AS hour,
         least(floor(amt / 2) / 100, 1.0) AS raw, coalesce(cards.card_amt_mean, 0.0) AS card_amt_mean,
         count(*) OVER (PARTITION BY tx.card_id ORDER BY dt RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS tx_1h,
         count(*) OVER (PARTITION BY tx.card_id ORDER BY dt RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS tx_24h,
         row_number() OVER (PARTITION BY tx.card_id ORDER BY dt, transaction_id) AS seq,
         coalesce(dt - lag(dt) OVER (PARTITION BY tx.card_id ORDER BY dt, transaction_id), 999999) AS gap
  FROM tx LEFT JOIN cards ON tx.card_id = cards.card_id),
g AS (
  SELECT *, (CASE WHEN amt >= 1500 THEN 1 ELSE 0 END) + (CASE WHEN hour >= 0 AND hour < 6 THEN 1 ELSE 0 END)
           + (CASE WHEN tx_1h >= 3 THEN 1 ELSE 0 END) + (CASE WHEN tx_24h >= 15 THEN 1 ELSE 0 END)
           + (CASE WHEN gap <= 120 THEN 1 ELSE 0 END) + (CASE WHEN seq = 1 THEN 1 ELSE 0 END)
           + (CASE WHEN tx_1h >= 3 THEN 1 ELSE 0 END) AS signals,
         least(greatest(1.0 / (1.0 + exp(-((raw - 0.5) * 3))), 0.0), 1.0) AS calibrated
  FROM s),
h AS (
  SELECT *, least(greatest(CASE WHEN signals >= 2
      THEN 0.7 * calibrated + 0.3 * raw + least(0.16, 0.02 * signals)
      ELSE 0.7 * calibrated + 0.3 * raw END, 0.0), 1.0) AS prob
  FROM g)""") + """
SELECT transaction_id, card_id, CAST(signals AS INTEGER) AS signals, round(prob, 9) AS prob,
       prob >= 0.26 AS is_fraud_pred,
       round(CASE WHEN card_amt_mean > 0 THEN amt / card_amt_mean ELSE 1.0 END, 9) AS amt_ratio
FROM h""")
def stream_scoring(spark, sf_dir):
    """L1 (+ J13 rules, D10-style default): stream scoring with a stream-static join (cards)
    and the history kept in keyed state; every row, those that wait for the watermark of
    1 h when the run ends from the state."""
    return P.stream_scoring(spark, P.transaction_stream(spark, sf_dir, None), _cards(spark, sf_dir), table=PG._tx(spark, sf_dir))


@register("stream_history", S.ctes(TX_SQL) + """
SELECT transaction_id, card_id, tx_1h, tx_24h, seq, gap, CAST(seq = 1 AS INTEGER) AS new_card, CAST(tx_1h >= 3 AS INTEGER) AS burst FROM (
  SELECT transaction_id, card_id, dt,
         count(*) OVER (PARTITION BY card_id ORDER BY dt RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS tx_1h,
         count(*) OVER (PARTITION BY card_id ORDER BY dt RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS tx_24h,
         row_number() OVER (PARTITION BY card_id ORDER BY dt, transaction_id) AS seq,
         coalesce(dt - lag(dt) OVER (PARTITION BY card_id ORDER BY dt, transaction_id), 999999) AS gap
  FROM tx WHERE dt IS NOT NULL)
WHERE dt <= (SELECT max(dt) FROM tx) - 3600""")
def stream_history(spark, sf_dir):
    """L1 / L2: exact trailing counts, sequence and gap of every transaction, from keyed
    stream state with event-time timers (watermark of 1 h)."""
    told = P.stream_history(spark, P.transaction_stream(spark, sf_dir))
    return told.select("transaction_id", "card_id", "tx_1h", "tx_24h", "seq", "gap", "new_card", "burst")


@register("stream_velocity", S.ctes(TX_SQL, """
w AS (
  SELECT card_id, amt, is_fraud, dt, (dt // 1800) * 1800 - k * 1800 AS window_start
  FROM tx, (SELECT 0 AS k UNION ALL SELECT 1 AS k) ks),
mx AS (SELECT max(epoch_us(CAST(ts AS TIMESTAMP))) - 1704067200000000 AS max_us FROM events)""") + """
SELECT card_id, window_start, window_start + 3600 AS window_end, count(*) AS tx_count,
       CAST(sum(CAST(amt AS DECIMAL(18,3))) AS DOUBLE) AS amt_sum, CAST(sum(is_fraud) AS BIGINT) AS fraud_count
FROM w
WHERE (window_start + 3600) * 1000000 <= (SELECT max_us FROM mx) - 3600000000
GROUP BY card_id, window_start""")
def stream_velocity(spark, sf_dir):
    """L2: per-card sliding 1 h / 30 min windows with a 1 h watermark."""
    return P.stream_velocity(spark, sf_dir)


@register("stream_velocity_24h", S.ctes(TX_SQL, """
w AS (
  SELECT card_id, amt, is_fraud, dt, (dt // 43200) * 43200 - k * 43200 AS window_start
  FROM tx, (SELECT 0 AS k UNION ALL SELECT 1 AS k) ks),
mx AS (SELECT max(epoch_us(CAST(ts AS TIMESTAMP))) - 1704067200000000 AS max_us FROM events)""") + """
SELECT card_id, window_start, window_start + 86400 AS window_end, count(*) AS tx_count,
       CAST(sum(CAST(amt AS DECIMAL(18,3))) AS DOUBLE) AS amt_sum, CAST(sum(is_fraud) AS BIGINT) AS fraud_count
FROM w
WHERE (window_start + 86400) * 1000000 <= (SELECT max_us FROM mx) - 3600000000
GROUP BY card_id, window_start""")
def stream_velocity_24h(spark, sf_dir):
    """L2: per-card sliding 24 h / 12 h windows with a 1 h watermark."""
    return P.stream_velocity(spark, sf_dir, "24 hours", "12 hours")
