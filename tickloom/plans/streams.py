"""Registered queries that replay the events table as a stream; their SQL is the same over the table.

What the last watermark doesn't pass is still open in a stream and so not in the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans import views as v
from tickloom.plans.market import query
from tickloom.session import shared_folder
from tickloom.streaming import orders
from tickloom.streaming.ticks import journal, stream_bars

SNAPSHOT_US = 21_600_000_000
HORIZONS = (600, 3600, 14400)


def replay(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``build`` makes of the stream of ticks, run to the end of the events that are there, journaled and read."""
    folder, path = shared_folder(spark), f"{sf_dir}/events[.]parquet"  # a pattern may be a file or a folder
    stream = v.as_ticks(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)).withColumn("ts", F.timestamp_micros("us"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", orders.PROVIDER)
    built = build(stream)
    journal(built, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(built.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


@query(f"""
WITH {v.TICKS}, s AS (SELECT DISTINCT key AS ticker, (us // {SNAPSHOT_US} + 1) * {SNAPSHOT_US} AS us, user AS order_id FROM ticks),
r AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY us) - row_number() OVER (PARTITION BY ticker, order_id ORDER BY us) AS island FROM s)
SELECT ticker, us, order_id, us - min(us) OVER (PARTITION BY ticker, order_id, island) AS age_us FROM r WHERE us < (SELECT max(us) FROM s)""")
def stream_order_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages of users as visible orders of each key, with a snapshot every six hours."""
    at = (F.floor(F.col("us") / SNAPSHOT_US) + 1) * SNAPSHOT_US
    shown = lambda t: t.select(F.col("key").alias("ticker"), at.alias("us"), F.col("user").alias("order_id")).withColumn("ts", F.timestamp_micros("us"))
    return replay(spark, sf_dir, lambda t: orders.order_ages(shown(t), "0 seconds"))


@query(f"""
WITH {v.QUOTES}, m AS (SELECT max(us) // 1000 AS mark FROM ticks), h AS (SELECT t.seq, CAST(s AS BIGINT) AS horizon, t.day, t.price, t.us + CAST(s AS BIGINT) * 1000000 AS due
  FROM trades t, m, (VALUES {", ".join(f"({s})" for s in HORIZONS)}) x(s) WHERE t.us // 1000 < mark),
r AS (SELECT h.seq, horizon, q.seq AS quote_seq, q.price - h.price AS delta, row_number() OVER (PARTITION BY h.seq, horizon ORDER BY q.us, q.seq) AS r
  FROM h JOIN quotes q ON q.day = h.day AND q.us >= due, m WHERE q.us // 1000 < mark)
SELECT seq, horizon, quote_seq, round(delta, 6) AS delta FROM r WHERE r = 1""")
def stream_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first quote at or after each due time of every trade, from state and timers."""
    rows = lambda t: t.filter(F.col("key").isNotNull()).withColumn("quote", F.col("key").isin("signup", "error"))
    found = replay(spark, sf_dir, lambda t: orders.followups(rows(t), HORIZONS, "0 seconds"))
    return found.select("seq", "horizon", "quote_seq", F.round("delta", 6).alias("delta"))


@query(f"""
WITH {v.TICKS}, m AS (SELECT max(us) // 1000 AS mark FROM ticks), b AS (SELECT key, us // 3600000000 AS hour, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (us, seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY ALL)
SELECT b.* FROM b, m WHERE (hour + 1) * 3600000 <= mark""")
def stream_hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each key, final once the watermark has passed their end."""
    bars = replay(spark, sf_dir, lambda t: stream_bars(t.select("ts", "seq", "key", "price", "volume"), "1 hour", "0 seconds"))
    return bars.select("key", F.floor(F.unix_micros("start") / 3_600_000_000).alias("hour"), "open", "high", "low", "close", "volume")
