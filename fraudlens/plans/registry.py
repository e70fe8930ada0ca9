"""Registry of named queries and their DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables.  The
oracle is an independent ANSI-SQL formulation (plain windows / joins / group
bys, no bucketing tricks) that DuckDB runs on the same parquet files; the
two must agree on column names, types and values.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []

# Shared SQL prelude: the transaction model of ``sources.tables.transactions``.
TX_SQL = """
tx0 AS (
  SELECT event_id AS transaction_id, user_id AS card1, CAST(user_id AS VARCHAR) AS card_id,
         event_type AS product, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS addr1,
         value AS amt, (epoch_us(CAST(ts AS TIMESTAMP)) // 1000000) - 1704067200 AS dt
  FROM events),
tx AS (
  SELECT *, CAST(CASE WHEN (addr1 % 10 = 0 AND amt >= 30) OR transaction_id % 50 = 0
                      THEN 1 ELSE 0 END AS INTEGER) AS is_fraud,
         concat_ws('_', product, coalesce(CAST(addr1 AS VARCHAR), '-1')) AS merchant_id
  FROM tx0)"""

IDENTITY_SQL = """
ident AS (
  SELECT s_suppkey AS card1, s_name AS email_domain, CAST(s_nationkey AS VARCHAR) AS device_type,
         s_name AS device_info, CAST(s_nationkey AS DOUBLE) AS d1
  FROM supplier)"""


def with_tx(body: str, *extra_ctes: str) -> str:
    ctes = [TX_SQL] + list(extra_ctes)
    return "WITH " + ",\n".join(c.strip("\n") for c in ctes) + "\n" + body


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco
