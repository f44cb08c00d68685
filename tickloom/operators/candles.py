"""Bars of an event stream, and the last bars of each symbol as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ticks(events: DataFrame) -> DataFrame:
    """(symbol, ts, event_id, price) of an events table: the type is the symbol, the value the price."""
    return events.where("value > 0").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))


def bars(t: DataFrame, hours: int = 1) -> DataFrame:
    """OHLC bars with the number of ticks; ties of time are broken by event_id. One partial aggregation, one shuffle."""
    at = F.struct("ts", "event_id")
    bucket = F.window("ts", f"{hours} hours").start.cast("timestamp_ntz") if hours > 1 else F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return t.groupBy("symbol", bucket.alias("bar")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("n_ticks")
    )


def last_bars(b: DataFrame, n: int = 120) -> DataFrame:
    """(symbol, c, h, l): the last n bars' closes, highs and lows in order. Trimmed before they are collected."""
    w = Window.partitionBy("symbol").orderBy(F.desc("bar"))
    b = b.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    s = F.sort_array(F.collect_list(F.struct("bar", "close", "high", "low")))
    return b.groupBy("symbol").agg(s.alias("s")).select("symbol", F.col("s.close").alias("c"), F.col("s.high").alias("h"), F.col("s.low").alias("l"))
