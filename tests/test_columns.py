"""Scalar expressions (B*) on hand-written rows."""

from pyspark.sql import functions as F

from fraudlens.functions import columns as C


def test_round_amount_one_vs_two_sided(spark):
    df = spark.createDataFrame([(10.00,), (10.995,), (10.5,), (10.004,)], "amt double")
    rows = df.select("amt", C.is_round_amt("amt").alias("one"),
                     C.is_round_amt_two_sided("amt").alias("two")).orderBy("amt").collect()
    got = {r.amt: (r.one, r.two) for r in rows}
    assert got[10.0] == (1, 1)
    assert got[10.004] == (1, 1)
    assert got[10.5] == (0, 0)
    assert got[10.995] == (0, 1)  # only the two-sided test sees x.995 as round


def test_time_parts_and_flags(spark):
    df = spark.createDataFrame([(0,), (5 * 3600 + 59,), (6 * 3600,), (5 * 86400 + 1,)], "dt long")
    r = df.select("dt", C.hour_of_day("dt").alias("h"), C.day_of_week("dt").alias("d"),
                  C.is_night(C.hour_of_day("dt")).alias("n"),
                  C.is_weekend(C.day_of_week("dt")).alias("w")).orderBy("dt").collect()
    assert [(x.h, x.d, x.n, x.w) for x in r] == [(0, 0, 1, 0), (5, 0, 1, 0), (6, 0, 0, 0), (0, 5, 1, 1)]


def test_dashboard_calendar_is_monday_based(spark):
    # dt = 0 is 2017-12-01, a Friday -> weekday 4 (Monday = 0)
    r = spark.range(1).select(C.monday_weekday(C.dashboard_timestamp(F.lit(0))).alias("w")).first()
    assert r.w == 4


def test_keys_and_labels(spark):
    df = spark.createDataFrame([("12.0", "W_315", None), ("abc", "C", "Mozilla Chrome/1"),
                                (None, "xyz", "Safari")], "raw string, mid string, info string")
    r = df.select(C.normalize_id("raw").alias("n"), C.product_from_merchant("mid").alias("p"),
                  C.browser_family("info").alias("b"), C.masked_card(F.lit(123456)).alias("m")).collect()
    assert [x.n for x in r] == ["12", "abc", None]
    assert [x.p for x in r] == ["W", "C", "Unknown"]
    assert [x.b for x in r] == ["Unknown", "Chrome", "Safari"]
    assert r[0].m == "Card_3456"


def test_merchant_and_uid_defaults(spark):
    df = spark.createDataFrame([("W", None, 7, None)], "p string, a int, c long, e string")
    r = df.select(C.merchant_id("p", "a").alias("m"), C.uid("c", "a", "e").alias("u")).first()
    assert r.m == "W_-1" and r.u == "7_-1_unknown"


def test_calibration_and_boost(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "p double")
    r = df.select("p", C.calibrate("p", "stretch").alias("s"), C.calibrate("p", "power").alias("w"),
                  C.calibrate("p", "sigmoid").alias("g"),
                  C.boosted_probability("p", F.lit(3)).alias("b3"),
                  C.boosted_probability("p", F.lit(1)).alias("b1")).orderBy("p").collect()
    assert r[0].s == 0.0 and abs(r[1].s - 0.5) < 1e-12 and r[2].s == 1.0
    assert abs(r[1].g - 0.5) < 1e-12
    # two or more signals add min(0.16, 0.02 n) before clipping
    assert abs((r[1].b3 - r[1].b1) - 0.06) < 1e-12


def test_risk_reasons(spark):
    df = spark.createDataFrame([(2000.0, 3, 4, 1, 1, 30)], "amt double, hour int, t1 int, nc int, b int, gap int")
    r = df.select(C.risk_reasons("amt", "hour", "t1", "nc", "b", "gap").alias("r")).first()
    assert r.r == ["large_amount", "night", "high_velocity_1h", "new_card", "burst", "short_gap"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0])], "a array<double>, b array<double>")
    r = df.select(C.vec_norm("a").alias("n"), C.vec_dot("a", "b").alias("d"),
                  C.vec_diff("a", "b").alias("df"), C.vec_prod("a", "b").alias("p")).first()
    assert r.n == 5.0 and r.d == 11.0 and r.df == [2.0, 2.0] and r.p == [3.0, 8.0]
