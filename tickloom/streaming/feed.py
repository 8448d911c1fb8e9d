"""Live bars: JSON kline messages as a stream, late bars dropped and repeated bars replaced by the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "symbol string, k struct<t: bigint, o: string, h: string, l: string, c: string, v: string, x: boolean>"


def parsed(messages: DataFrame) -> DataFrame:
    """(symbol, at, o, h, l, c, v, closed) from a column ``value`` of JSON text; numbers come as strings."""
    k = messages.select(F.from_json(F.col("value").cast("string"), MESSAGE).alias("m")).select("m.symbol", "m.k.*")
    return k.select(F.upper(F.replace("symbol", F.lit("/"), F.lit(""))).alias("symbol"), F.timestamp_millis("t").alias("at"), *(F.col(x).cast("double").alias(x) for x in "ohlcv"), F.col("x").alias("closed"))


def closed_bars(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Closed bars, each once; those later than the watermark are dropped."""
    return parsed(messages).where("closed").withWatermark("at", late).dropDuplicatesWithinWatermark(["symbol", "at"])


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)
