"""Driver tables and the transaction model built on top of them.

The reference consumes a card-transaction CSV (TransactionID, TransactionDT,
TransactionAmt, ProductCD, card1, addr1, ...) and an optional identity CSV.
The driver ships TPC-H-like tables plus an ``events`` table; the mapping used
throughout this package is:

    events.event_id               -> transaction_id
    events.user_id                -> card1   (card_id = its text form)
    events.event_type             -> product (ProductCD)
    events.props.k (JSON)         -> addr1
    events.value                  -> amt     (TransactionAmt)
    events.ts - 2024-01-01 (sec)  -> dt      (TransactionDT)
    rule on k / value / event_id  -> is_fraud
    supplier (s_suppkey=user_id)  -> identity side table (email, device)

Everything is a lazy DataFrame; column pruning and filters reach the parquet
scan because only ``select``/``filter`` are used on top of ``read.parquet``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.functions import columns as C

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed values of the data mapping (must match the SQL oracle).
EPOCH_OFFSET_SECONDS = 1704067200  # 2024-01-01T00:00:00Z: dt is seconds since then


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Scan one driver table; ``columns`` keeps only those that exist (A3)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns is not None:
        present = set(df.columns)
        df = df.select(*[c for c in columns if c in present])
    return df


EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                 "value double, props string")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction fact table (one row per event)."""
    ev = read_table(spark, sf_dir, "events",
                    ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return events_to_transactions(ev)


def events_to_transactions(ev: DataFrame) -> DataFrame:
    """Row-wise mapping events -> transactions (batch or streaming input)."""
    addr = F.get_json_object("props", "$.k").try_cast("int")
    dt = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(EPOCH_OFFSET_SECONDS)
    return ev.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("card1"),
        C.card_id(F.col("user_id")).alias("card_id"),
        F.col("event_type").alias("product"),
        addr.alias("addr1"),
        F.col("value").alias("amt"),
        dt.alias("dt"),
    ).withColumn(
        "is_fraud", C.fraud_rule(F.col("addr1"), F.col("amt"), F.col("transaction_id"))
    ).withColumn(
        "merchant_id", C.merchant_id(F.col("product"), F.col("addr1"))
    )


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity-style side table keyed by card1 (may miss cards: genuine nulls)."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    return s.select(
        F.col("s_suppkey").alias("card1"),
        F.col("s_name").alias("email_domain"),
        F.col("s_nationkey").cast("string").alias("device_type"),
        F.col("s_name").alias("device_info"),
        F.col("s_nationkey").cast("double").alias("d1"),
    )


def transactions_with_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions left-joined with identity.

    ``supplier`` is tiny next to the fact table but it still grows with the
    data, so no broadcast hint: AQE picks a broadcast at runtime when the
    measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return transactions(spark, sf_dir).join(identity(spark, sf_dir), "card1", "left")
