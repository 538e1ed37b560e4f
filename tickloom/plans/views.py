"""Market-data views of the tables: ticks, quotes, book updates, ladders, features and ledgers, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_ticks(events: DataFrame) -> DataFrame:
    """seq, us, day, price, volume, key and user of events, a table or a stream; k is the number in props."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("seq"), us.alias("us"), F.to_date("ts").cast("string").alias("day"), F.col("value").alias("price"), (1 + k).alias("volume"), k.alias("k"),
        F.col("event_type").alias("key"), F.col("user_id").alias("user"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(_read(spark, sf_dir, "events"))


TICKS = """ticks AS (SELECT event_id AS seq, epoch_us(ts) AS us, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, value AS price, 1 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS key, user_id AS user FROM events)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).filter(F.col("key").isin("click", "view", "purchase"))


TRADES = TICKS + ", trades AS (SELECT * FROM ticks WHERE key IN ('click', 'view', 'purchase'))"


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).filter(F.col("key").isin("signup", "error"))


QUOTES = TRADES + ", quotes AS (SELECT * FROM ticks WHERE key IN ('signup', 'error'))"


def book_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, us, day, side (0 bid, 1 ask), depth from 1 to 10, action (2 removes), price and size."""
    action = F.when(F.col("k") % 7 == 0, 2).when(F.col("k") % 2 == 0, 0).otherwise(1)
    return ticks(spark, sf_dir).select("seq", "us", "day", (F.col("seq") % 2).alias("side"), (1 + F.col("k") % 10).alias("depth"), action.alias("action"), "price", F.col("k").alias("size"))


BOOK = TICKS + """, book AS (SELECT seq, us, day, seq % 2 AS side, 1 + k % 10 AS depth, CASE WHEN k % 7 = 0 THEN 2 WHEN k % 2 = 0 THEN 0 ELSE 1 END AS action, price, k AS size FROM ticks)"""


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue, price, qty: parts as offers of their brand."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("level_id"), F.col("p_brand").alias("venue"), F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("long").alias("qty"))


LADDER = "ladder AS (SELECT p_partkey AS level_id, p_brand AS venue, CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS BIGINT) AS qty FROM part)"


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as events with features f1 to f3, a target and an outcome y."""
    return _read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_discount").cast("double").alias("f1"),
        F.col("l_tax").cast("double").alias("f2"), F.col("l_quantity").cast("double").alias("f3"), F.col("l_extendedprice").cast("double").alias("target"), F.col("l_returnflag").alias("grp"), F.col("l_shipdate").cast("date").alias("day"),
    )


FEAT = """feat AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS o, l_linenumber AS l, CAST(l_discount AS DOUBLE) AS f1, CAST(l_tax AS DOUBLE) AS f2, CAST(l_quantity AS DOUBLE) AS f3,
 CAST(l_extendedprice AS DOUBLE) AS target, l_returnflag AS grp, CAST(l_shipdate AS DATE) AS day FROM lineitem)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, day, gate and pnl in cents around 150,000: orders as closed trades."""
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trade_id"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("gate"), (F.round(F.col("o_totalprice").cast("double") * 100).cast("long") - 15000000).alias("pnl"))


LEDGER = "ledger AS (SELECT o_orderkey AS trade_id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS gate, CAST(round(CAST(o_totalprice AS DOUBLE) * 100) AS BIGINT) - 15000000 AS pnl FROM orders)"
