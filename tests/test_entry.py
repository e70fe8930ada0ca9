"""Driver contract and a streaming-equals-batch check on sf0.001."""

import __spark_entry__ as E
from fraudlens.plans import graph as PG
from fraudlens.sources.tables import EVENTS_SCHEMA, transactions
from fraudlens.streaming import pipelines as P


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "card_tx_1h" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 80


def test_stream_scoring_equals_batch(spark, sf):
    cards = PG._node_features(PG._tx(spark, sf), "card_id").selectExpr("card_id", "amt_mean AS card_amt_mean")
    tx = transactions(spark, sf)
    stream = P.stream_scoring(spark, P.transaction_stream(spark, sf), cards)
    last = tx.selectExpr("max(dt) - 3600").first()[0]
    batch = P.score_transactions(tx.filter(f"dt <= {last}").join(P.velocity_table(tx), "transaction_id"), cards)
    assert stream.count() == batch.count() > 0
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def test_stream_velocity_equals_closed_batch_windows(spark, sf):
    from pyspark.sql import functions as F

    from fraudlens.functions import columns as C
    stream = P.stream_velocity(spark, sf)
    tx = transactions(spark, sf).withColumn("event_time", F.timestamp_seconds(F.col("dt") + 1704067200))
    wm = tx.select(F.max("event_time")).first()[0]
    batch = (tx.groupBy(F.window("event_time", "1 hour", "30 minutes").alias("w"), "card_id")
               .agg(F.count(F.lit(1)).alias("tx_count"),
                    F.sum(C.money("amt")).cast("double").alias("amt_sum"),
                    F.sum("is_fraud").cast("bigint").alias("fraud_count"))
               .filter(F.col("w.end") <= F.lit(wm) - F.expr("INTERVAL 1 HOUR"))
               .select("card_id", (F.unix_seconds("w.start") - 1704067200).alias("window_start"),
                       (F.unix_seconds("w.end") - 1704067200).alias("window_end"),
                       "tx_count", "amt_sum", "fraud_count"))
    assert stream.count() == batch.count() > 0
    assert stream.exceptAll(batch).count() == 0


def test_stream_scoring_scores_every_row(spark, tmp_path):
    import datetime

    import duckdb

    start = datetime.datetime(2024, 1, 2)
    rows = [(i, None if i % 10 == 9 else start + datetime.timedelta(seconds=600 * i), None if i % 7 == 6 else i % 3,
             "view", float(5 * i), '{"k": %d}' % (i % 4)) for i in range(60)]
    rows += [(100, None, 50, "view", 9.0, '{"k": 1}'), (101, None, 50, "view", 2000.0, '{"k": 1}')]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, EVENTS_SCHEMA).repartition(3).write.parquet(path)
    got = E.queries()["stream_scoring"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = db.execute(E.oracle_sql()["stream_scoring"]).fetchall()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(want)
