"""Streaming forms of de-duplication, bars and the journal sink; on a replay they equal the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_of_key(ticks: DataFrame, key: list[str], late: str) -> DataFrame:
    """The first row of each key; a key is remembered for ``late`` of event time ts after it was seen."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def stream_bars(ticks: DataFrame, width: str, late: str) -> DataFrame:
    """Open, high, low, close and volume of ticks(ts, seq, key, price, volume) by key and window.

    A bar is final, and its state dropped, once the watermark has passed its end; the state is one row per open bar.
    """
    at = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "key")
    out = bars.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return out.select("key", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def journal(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there as Parquet, a folder for each batch: a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
