"""Structured Streaming over files of ticks: the latest price of each symbol, and bars with a watermark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # A file stream watches a folder: the file's own, and in it only what has the file's name.
    folder, name = path.rstrip("/").rsplit("/", 1)
    s = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).where("value > 0")
    return s.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one only where they all are this machine."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        return f"{have.rstrip('/')}/tickloom/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tickloom-stream-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def drain(df: DataFrame) -> DataFrame:
    """Run the stream over what there is and return its complete result, which each batch writes anew; nothing of it is held by the driver."""
    folder = _folder(df.sparkSession)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    q = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/result")


def coalesced(ticks: DataFrame, width: str = "100 milliseconds", late: str = "5 minutes", ahead: str = "1 minute", now: str | None = None) -> DataFrame:
    """The latest price of each symbol in each window; ticks from the future (more than `ahead` after `now`) are dropped."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    t = ticks.where(F.col("ts") <= at + F.expr(f"INTERVAL {ahead}")).withWatermark("ts", late)
    w = t.groupBy("symbol", F.window("ts", width)).agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.count(F.lit(1)).alias("n"))
    return w.select("symbol", F.col("window.start").alias("at"), "price", "n")


def with_static(ticks: DataFrame, static: DataFrame) -> DataFrame:
    """A stream of ticks with the rows of a static table of its symbols (left: symbols without one stay), and the price's distance to its stop and target."""
    j = ticks.join(F.broadcast(static), "symbol", "left")  # a row a symbol
    return j.groupBy("symbol").agg(F.max_by(F.struct("price", "stop", "target"), F.struct("ts", "event_id")).alias("x")).select("symbol", "x.price", (F.col("x.price") <= F.col("x.stop")).alias("stopped"), (F.col("x.price") >= F.col("x.target")).alias("reached"))


def latest_price(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"))


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "5 minutes") -> DataFrame:
    at = F.struct("ts", "event_id")
    w = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width))
    return w.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("n_ticks")).select("symbol", F.col("window.start").alias("bar"), "open", "high", "low", "close", "n_ticks")
