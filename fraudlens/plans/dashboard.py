"""Registered dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlens.functions import columns as C
from fraudlens.operators import dashboard as D
from fraudlens.operators.encodings import clean
from fraudlens.plans import sql as S
from fraudlens.plans.registry import TX_SQL, register
from fraudlens.sources.tables import transactions, transactions_with_identity

CAL_SQL = """
cal AS (
  SELECT *, make_timestamp((1512086400 + dt) * 1000000) AS tx_time FROM tx),
cal2 AS (
  SELECT *, CAST(hour(tx_time) AS INTEGER) AS cal_hour,
         CAST(isodow(tx_time) - 1 AS INTEGER) AS cal_weekday,
         CAST(CAST(tx_time AS DATE) AS VARCHAR) AS cal_date
  FROM cal)"""


@register("risk_heatmap", S.ctes(TX_SQL, CAL_SQL, """
agg AS (
  SELECT cal_weekday AS day_of_week, cal_hour AS hour, CAST(sum(is_fraud) AS BIGINT) AS fraud,
         count(*) AS total
  FROM cal2 GROUP BY cal_weekday, cal_hour),
grid AS (SELECT CAST(i // 24 AS INTEGER) AS day_of_week, CAST(i % 24 AS INTEGER) AS hour
         FROM range(168) r(i))""") + """
SELECT g.day_of_week, g.hour, CAST(coalesce(fraud, 0) AS BIGINT) AS fraud,
       CAST(coalesce(total, 0) AS BIGINT) AS total,
       CASE WHEN total > 0 THEN fraud / total ELSE 0.0 END AS risk
FROM grid g LEFT JOIN agg a ON g.day_of_week = a.day_of_week AND g.hour = a.hour""")
def risk_heatmap(spark, sf_dir):
    """E16 + B6: dense weekday x hour fraud-rate grid."""
    return D.risk_heatmap(transactions(spark, sf_dir).select("dt", "is_fraud"))


@register("daily_trend", S.ctes(TX_SQL, CAL_SQL, """
d AS (
  SELECT cal_date AS day, CAST(sum(is_fraud) AS BIGINT) AS fraud, count(*) AS total
  FROM cal2 GROUP BY cal_date ORDER BY cal_date DESC LIMIT 30),
r AS (
  SELECT day, fraud, total, round_even(fraud / total * 100, 2) AS fraud_rate,
         total - fraud AS normal_count, round_even((total - fraud) / total * 100, 2) AS normal_rate
  FROM d)""") + """
SELECT *, round_even(avg(fraud_rate) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2)
       AS fraud_rate_ma7
FROM r""")
def daily_trend(spark, sf_dir):
    """E17 + G4 + F8: last 30 days with 7-day moving average of the rate."""
    tx = transactions(spark, sf_dir).select("dt", "is_fraud")
    return D.daily_trend(tx).withColumn("day", F.col("day").cast("string"))


AMOUNT_BIN_SQL = """CASE WHEN amt >= 5000 THEN '5K+' WHEN amt >= 1000 THEN '1K-5K'
  WHEN amt >= 500 THEN '500-1K' WHEN amt >= 200 THEN '200-500' WHEN amt >= 100 THEN '100-200'
  WHEN amt >= 50 THEN '50-100' ELSE '0-50' END"""


@register("amount_bins", S.ctes(TX_SQL) + f"""
SELECT bin, fraud_count, total_count, round_even(fraud_count / total_count * 100, 2) AS fraud_rate,
       total_count - fraud_count AS normal_count
FROM (SELECT {AMOUNT_BIN_SQL} AS bin, CAST(sum(is_fraud) AS BIGINT) AS fraud_count,
             count(*) AS total_count
      FROM tx WHERE amt >= 0 GROUP BY 1)""")
def amount_bins(spark, sf_dir):
    """Left-closed amount bins with fraud rate."""
    return D.amount_bins(transactions(spark, sf_dir).select("amt", "is_fraud"))


@register("trimmed_amounts", S.ctes(TX_SQL) + """
SELECT tx.transaction_id, tx.is_fraud, tx.amt FROM tx
JOIN (SELECT is_fraud, quantile_cont(amt, 0.99) AS cut FROM tx GROUP BY is_fraud) q
  ON tx.is_fraud = q.is_fraud
WHERE tx.amt < q.cut""")
def trimmed_amounts(spark, sf_dir):
    """C2 + C4 + E23: amounts below the per-class 99th percentile."""
    tx = transactions(spark, sf_dir).select("transaction_id", "is_fraud", "amt")
    return D.trimmed_amounts(tx).select("transaction_id", "is_fraud", "amt")


@register("card_frequency", S.ctes(TX_SQL, """
c AS (SELECT card1, count(*) AS n FROM tx GROUP BY card1),
b AS (SELECT CAST(min(n) AS DOUBLE) AS lo, CAST(max(n) AS DOUBLE) AS hi FROM c),
h AS (
  SELECT CAST(CASE WHEN (hi - lo) / 50 > 0 THEN least(floor((n - lo) / ((hi - lo) / 50)), 49)
              ELSE 0 END AS INTEGER) AS bin, count(*) AS count, min(lo) AS lo, min(hi) AS hi
  FROM c, b GROUP BY 1)""") + """
SELECT bin, count, lo + bin * (hi - lo) / 50 AS bin_start,
       (SELECT round(quantile_cont(n, 0.95), 9) FROM c) AS p95
FROM h""")
def card_frequency(spark, sf_dir):
    """E19 + E23 + E24: card volume histogram (50 bins) and its 95th percentile."""
    out = D.card_frequency_summary(transactions(spark, sf_dir).select("card1"))
    return out.withColumn("p95", F.round("p95", 9))


@register("amount_histogram", S.ctes(TX_SQL, """
b AS (SELECT is_fraud, min(amt) AS lo, max(amt) AS hi FROM tx GROUP BY is_fraud),
h AS (
  SELECT tx.is_fraud, CAST(CASE WHEN (hi - lo) / 50 > 0 THEN least(floor((amt - lo) / ((hi - lo) / 50)), 49)
              ELSE 0 END AS INTEGER) AS bin, count(*) AS count, min(lo) AS lo, min(hi) AS hi
  FROM tx JOIN b ON tx.is_fraud = b.is_fraud GROUP BY 1, 2)""") + """
SELECT is_fraud, bin, count, lo + bin * (hi - lo) / 50 AS bin_start FROM h""")
def amount_histogram(spark, sf_dir):
    """50-bin amount histogram per class."""
    tx = transactions(spark, sf_dir).select("amt", "is_fraud")
    return D.histogram(tx, "amt", 50, by=["is_fraud"])


@register("top_cards", S.ctes(TX_SQL) + """
SELECT 'Card_' || right(CAST(card1 AS VARCHAR), 4) AS card, card1, fraud, total FROM (
  SELECT card1, CAST(sum(is_fraud) AS BIGINT) AS fraud, count(*) AS total
  FROM tx GROUP BY card1 ORDER BY total DESC, card1 LIMIT 10)""")
def top_cards(spark, sf_dir):
    """G3 + B20: ten busiest cards with masked labels."""
    return D.top_cards(transactions(spark, sf_dir).select("card1", "is_fraud"))


@register("hourly_stats", S.ctes(TX_SQL, CAL_SQL, """
h AS (SELECT cal_hour AS hour, CAST(sum(is_fraud) AS BIGINT) AS fraud, count(*) AS total
      FROM cal2 GROUP BY cal_hour)""") + """
SELECT hour, fraud, total, fraud / total * 100 AS rate,
       round(avg(fraud / total * 100) OVER (), 9) AS mean_hourly_rate FROM h""")
def hourly_stats(spark, sf_dir):
    """Hourly fraud statistics and the mean hourly rate."""
    return D.hourly_stats(transactions(spark, sf_dir).select("dt", "is_fraud"))


CORR_FEATURES = ["amt", "addr1", "hour", "day_of_week", "is_night", "is_weekend",
                 "is_round_amt", "amt_decimal"]


@register("label_correlations", S.clean_sql(f"""
, c AS (SELECT {', '.join(f'corr(CAST({f} AS DOUBLE), CAST(is_fraud AS DOUBLE)) AS {f}' for f in CORR_FEATURES)} FROM cl),
l AS (UNPIVOT c ON {', '.join(CORR_FEATURES)} INTO NAME feature VALUE corr),
z AS (SELECT feature, round(CASE WHEN corr IS NULL OR isnan(corr) OR isinf(corr) THEN 0.0 ELSE corr END, 9) AS corr FROM l)
SELECT feature, corr, row_number() OVER (ORDER BY abs(corr) DESC, feature) AS abs_rank FROM z""".replace("\n, c AS", ", c AS", 1)))
def label_correlations(spark, sf_dir):
    """E21 + G7: feature-label correlations ranked by absolute value."""
    df = clean(transactions_with_identity(spark, sf_dir))
    return D.label_correlations(df, CORR_FEATURES).withColumn("abs_rank", F.col("abs_rank").cast("bigint"))


@register("product_stats", S.ctes(TX_SQL) + """
SELECT product, CAST(sum(is_fraud) AS BIGINT) AS fraud, count(*) AS total,
       sum(is_fraud) / count(*) AS rate
FROM tx WHERE product IS NOT NULL GROUP BY product""")
def product_stats(spark, sf_dir):
    """Fraud statistics by product."""
    return D.group_fraud_stats(transactions(spark, sf_dir), "product", "product", percent=False)


@register("device_stats", S.ctes(TX_SQL, S.IDENTITY_SQL) + """
SELECT device_type, CAST(sum(is_fraud) AS BIGINT) AS fraud, count(*) AS total,
       sum(is_fraud) / count(*) * 100 AS rate
FROM tx LEFT JOIN ident ON tx.card1 = ident.card1
WHERE device_type IS NOT NULL GROUP BY device_type""")
def device_stats(spark, sf_dir):
    """E22 + D1: fraud statistics by device type (null devices dropped)."""
    return D.group_fraud_stats(transactions_with_identity(spark, sf_dir), "device_type", "device_type")


BROWSER_SQL = """CASE WHEN device_info IS NULL THEN 'Unknown'
  WHEN contains(lower(device_info), 'chrome') THEN 'Chrome'
  WHEN contains(lower(device_info), 'safari') THEN 'Safari'
  WHEN contains(lower(device_info), 'firefox') THEN 'Firefox'
  WHEN contains(lower(device_info), 'edge') THEN 'Edge'
  WHEN contains(lower(device_info), 'ie') THEN 'IE' ELSE 'Other' END"""


@register("browser_stats", S.ctes(TX_SQL, S.IDENTITY_SQL) + f"""
SELECT browser, CAST(sum(is_fraud) AS BIGINT) AS fraud, count(*) AS total,
       sum(is_fraud) / count(*) * 100 AS rate
FROM (SELECT {BROWSER_SQL} AS browser, is_fraud FROM tx LEFT JOIN ident ON tx.card1 = ident.card1)
GROUP BY browser""")
def browser_stats(spark, sf_dir):
    """E22 + B18: fraud statistics by browser family of the device string."""
    df = transactions_with_identity(spark, sf_dir)
    return D.group_fraud_stats(df, C.browser_family("device_info"), "browser")


PRODUCT_FROM_MERCHANT_SQL = """CASE WHEN merchant_id IS NULL THEN 'Unknown'
  WHEN contains(merchant_id, '_') THEN split_part(merchant_id, '_', 1)
  WHEN length(merchant_id) = 1 AND contains('WCHSR', merchant_id) THEN merchant_id
  ELSE 'Unknown' END"""


@register("top_products_by_rate", S.ctes(TX_SQL) + f"""
SELECT product, fraud, total, rate FROM (
  SELECT {PRODUCT_FROM_MERCHANT_SQL} AS product, CAST(sum(is_fraud) AS BIGINT) AS fraud,
         count(*) AS total, sum(is_fraud) / count(*) * 100 AS rate
  FROM tx GROUP BY 1)
WHERE total >= 100 ORDER BY rate DESC, product LIMIT 10""")
def top_products_by_rate(spark, sf_dir):
    """B19 + C6 + G8: product parsed from merchant key, >= 100 rows, top 10 by rate."""
    stats = D.group_fraud_stats(transactions(spark, sf_dir),
                                C.product_from_merchant("merchant_id"), "product")
    return D.top_groups_by_rate(stats, "product")


CLASS_MEAN_FEATURES = ["amt", "hour", "is_night", "is_weekend", "is_round_amt", "log_amt"]


@register("class_means", S.clean_sql(
    "SELECT is_fraud, " + ", ".join(f"round(avg({c}), 9) AS {c}_mean" for c in CLASS_MEAN_FEATURES)
    + ", count(*) AS n FROM cl GROUP BY is_fraud"))
def class_means(spark, sf_dir):
    """Class-conditional feature means."""
    return D.class_means(clean(transactions_with_identity(spark, sf_dir)), CLASS_MEAN_FEATURES)
