"""Monitoring queries of the dashboard.

All inputs are transaction-shaped DataFrames (``dt``, ``is_fraud``, ``amt``
...).  Everything is a grouped aggregate (map-side combined, so a hot group
costs one partial row per partition) over a bounded key space (weekday x
hour, day, amount bin, product, device), followed by operations on the tiny
aggregated result.  Windows without a partition key only ever run over such
bounded results (<= 30 days, <= 24 hours, <= 168 cells).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.functions import columns as C
from fraudlens.operators.ranges import exact_quantile

# Amount bin edges (left-closed) and their labels.
AMOUNT_BIN_EDGES = [0, 50, 100, 200, 500, 1000, 5000]
AMOUNT_BIN_LABELS = ["0-50", "50-100", "100-200", "200-500", "500-1K", "1K-5K", "5K+"]
TRIM_QUANTILE = 0.99
TREND_DAYS = 30
MOVING_AVERAGE_ROWS = 7
MIN_GROUP_VOLUME = 100


def _fraud_total(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("is_fraud").cast("bigint").alias("fraud"),
                                 F.count(F.lit(1)).alias("total"))


def with_calendar(df: DataFrame) -> DataFrame:
    """Dashboard calendar columns (2017-12-01 anchor, Monday = 0)."""
    ts = C.dashboard_timestamp("dt")
    return df.select("*", ts.alias("tx_time"), F.hour(ts).alias("cal_hour"),
                     C.monday_weekday(ts).alias("cal_weekday"), F.to_date(ts).alias("cal_date"))


def risk_heatmap(df: DataFrame) -> DataFrame:
    """Fraud rate per (weekday, hour), dense 7 x 24 grid, 0 where empty."""
    spark = df.sparkSession
    cal = with_calendar(df)
    agg = _fraud_total(cal, F.col("cal_weekday").alias("day_of_week"),
                       F.col("cal_hour").alias("hour"))
    grid = spark.range(7 * 24).select((F.col("id") / 24).cast("int").alias("day_of_week"),
                                      (F.col("id") % 24).cast("int").alias("hour"))
    out = grid.join(agg, ["day_of_week", "hour"], "left")
    return out.select("day_of_week", "hour",
                      F.coalesce("fraud", F.lit(0)).cast("bigint").alias("fraud"),
                      F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
                      C.safe_div("fraud", "total").alias("risk"))


def daily_trend(df: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """E17 + G4 + F8: last ``days`` days, rates in % (2 dp, half-even) and a
    7-row moving average over the rounded rates (min_periods = 1)."""
    daily = _fraud_total(with_calendar(df), F.col("cal_date").alias("day"))
    last = daily.orderBy(F.col("day").desc()).limit(days)
    w = Window.orderBy("day").rowsBetween(-(MOVING_AVERAGE_ROWS - 1), 0)
    rate = F.bround(F.col("fraud") / F.col("total") * 100, 2)
    out = last.select("day", "fraud", "total", rate.alias("fraud_rate"),
                      (F.col("total") - F.col("fraud")).alias("normal_count"),
                      F.bround((F.col("total") - F.col("fraud")) / F.col("total") * 100, 2)
                      .alias("normal_rate"))
    return out.withColumn("fraud_rate_ma7", F.bround(F.avg("fraud_rate").over(w), 2))


def amount_bin(amt) -> "F.Column":
    e, lab = AMOUNT_BIN_EDGES, AMOUNT_BIN_LABELS
    expr = F.when(F.col(amt) >= e[-1], F.lit(lab[-1]))
    for i in range(len(e) - 2, -1, -1):
        expr = expr.when((F.col(amt) >= e[i]) & (F.col(amt) < e[i + 1]), F.lit(lab[i]))
    return expr


def amount_bins(df: DataFrame) -> DataFrame:
    """Fraud statistics per amount bin (only bins that occur)."""
    b = _fraud_total(df.filter(F.col("amt") >= 0), amount_bin("amt").alias("bin"))
    return b.select("bin", F.col("fraud").alias("fraud_count"), F.col("total").alias("total_count"),
                    F.bround(F.col("fraud") / F.col("total") * 100, 2).alias("fraud_rate"),
                    (F.col("total") - F.col("fraud")).alias("normal_count"))


def trimmed_amounts(df: DataFrame, q: float = TRIM_QUANTILE) -> DataFrame:
    """C2 + C4 + E23: per class, rows strictly below the class's q-quantile
    (linear interpolation).  The quantile table has one row per class (two
    rows), so broadcasting it is size-safe."""
    cut = exact_quantile(df, "amt", q, ["is_fraud"], "_cut")
    return (df.join(F.broadcast(cut), "is_fraud")
              .filter(F.col("amt") < F.col("_cut")).drop("_cut"))


def card_frequency_summary(df: DataFrame, q: float = 0.95, bins: int = 50) -> DataFrame:
    """E19 + E23 + E24: per-card transaction counts -> 95th percentile and a
    ``bins``-bin histogram over [min, max] of the counts."""
    counts = df.groupBy("card1").agg(F.count(F.lit(1)).alias("n"))
    return histogram(counts, "n", bins).withColumn(
        "p95", exact_quantile(counts, "n", q).scalar())


def histogram(df: DataFrame, c: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] (the max falls in the last
    bin), optionally per group; scalar bounds come from scalar subqueries."""
    by = by or []
    x = F.col(c).cast("double")
    if by:
        bounds = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        d = df.join(bounds, by)
    else:
        d = df.withColumn("_lo", df.select(F.min(x)).scalar()).withColumn(
            "_hi", df.select(F.max(x)).scalar())
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.when(width > 0, F.least(F.floor((x - F.col("_lo")) / width), F.lit(bins - 1))) \
           .otherwise(F.lit(0)).cast("int")
    return (d.groupBy(*by, idx.alias("bin"))
             .agg(F.count(F.lit(1)).alias("count"),
                  F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
             .select(*by, "bin", "count",
                     (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins)
                     .alias("bin_start")))


def top_cards(df: DataFrame, k: int = 10) -> DataFrame:
    """G3 + B20: top-k cards by volume (ties by card), masked label."""
    t = _fraud_total(df, "card1").orderBy(F.col("total").desc(), F.col("card1")).limit(k)
    return t.select(C.masked_card("card1").alias("card"), "card1", "fraud", "total")


def hourly_stats(df: DataFrame) -> DataFrame:
    """Per hour fraud / total / rate (%) and the unweighted mean of the
    hourly rates (a window over at most 24 rows)."""
    h = _fraud_total(with_calendar(df), F.col("cal_hour").alias("hour"))
    rate = F.col("fraud") / F.col("total") * 100
    return h.select("hour", "fraud", "total", rate.alias("rate")).withColumn(
        "mean_hourly_rate", F.round(F.avg("rate").over(Window.partitionBy()), 9))


def label_correlations(df: DataFrame, features: list[str], label: str = "is_fraud") -> DataFrame:
    """E21 + G7: Pearson correlation of each feature with the label in one
    pass (one aggregate row), unpivoted; NaN / null -> 0; rank by |corr|."""
    one = df.select(*[F.col(c).try_cast("double").alias(c) for c in features],
                    F.col(label).cast("double").alias(label))
    row = one.agg(*[F.corr(c, label).alias(c) for c in features])
    long = row.unpivot([], features, "feature", "corr")
    val = F.round(C.finite_or_zero("corr"), 9)
    long = long.select("feature", val.alias("corr"))
    w = Window.orderBy(F.abs("corr").desc(), "feature")
    return long.withColumn("abs_rank", F.row_number().over(w))


def group_fraud_stats(df: DataFrame, key, name: str, percent: bool = True) -> DataFrame:
    """Fraud / total / rate per category; null keys dropped (pandas)."""
    k = (F.col(key) if isinstance(key, str) else key).alias(name)
    g = _fraud_total(df.select(k, "is_fraud").filter(F.col(name).isNotNull()), name)
    rate = F.col("fraud") / F.col("total") * (100 if percent else 1)
    return g.select(name, "fraud", "total", rate.alias("rate"))


def class_means(df: DataFrame, features: list[str], label: str = "is_fraud") -> DataFrame:
    """Per-class feature means."""
    return df.groupBy(label).agg(*[F.round(F.avg(c), 9).alias(f"{c}_mean") for c in features],
                                 F.count(F.lit(1)).alias("n"))


def top_groups_by_rate(stats: DataFrame, key: str, k: int = 10,
                       min_total: int = MIN_GROUP_VOLUME) -> DataFrame:
    """C6 + G8: groups with at least ``min_total`` rows, top-k by fraud rate."""
    return (stats.filter(F.col("total") >= min_total)
                 .orderBy(F.col("rate").desc(), F.col(key)).limit(k))
