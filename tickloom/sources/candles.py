"""Candles: one row for each (symbol, bar), numbered by ``i`` within its symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def series() -> WindowSpec:
    """A symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("i")


def numbered(candles: DataFrame) -> DataFrame:
    return candles.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("t")) - 1)


def _raised(pieces: DataFrame, within: list[str], order: str) -> DataFrame:
    """pieces with o, h, l and c raised by the totals of the pieces before them.

    A piece is null up to its first value that is not; what comes before that stands at the piece's start."""
    prior = F.sum("total").over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    flat = F.when(F.col("o").isNull(), 0)
    values = {"o": F.coalesce("o", F.lit(0)), "h": F.greatest("h", flat), "l": F.least("l", flat), "c": F.coalesce("c", F.lit(0))}
    return pieces.withColumn("prior", prior).withColumns({k: F.when(F.col("prior").isNull(), F.col(k)).otherwise(F.col("prior") + v) for k, v in values.items()}).drop("prior")


def from_events(events: DataFrame) -> DataFrame:
    """(symbol, i, t, o, h, l, c, v): hourly bars of each event type's integer walk; t counts hours from 1970.

    Events are walked inside their second only, seconds inside their hour and hours inside their symbol, each
    from the totals before it, so no task sorts a symbol's events."""
    at = F.struct("ts", "event_id")
    steps = events.select(F.col("event_type").alias("symbol"), (F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")).cast("long").alias("t"), (F.minute("ts") * 60 + F.second("ts")).alias("s"), at.alias("at"), (F.round(F.col("value") * 100) - 5000).cast("long").alias("step"))
    walk = F.sum("step").over(Window.partitionBy("symbol", "t", "s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    seconds = steps.withColumn("cents", walk).groupBy("symbol", "t", "s").agg(F.min_by("cents", "at").alias("o"), F.max("cents").alias("h"), F.min("cents").alias("l"), F.max_by("cents", "at").alias("c"), F.sum("step").alias("total"), F.count("*").alias("v"))
    second = F.struct("s")
    hours = _raised(seconds, ["symbol", "t"], "s").groupBy("symbol", "t").agg(F.min_by("o", second).alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", second).alias("c"), F.sum("total").alias("total"), F.sum("v").cast("double").alias("v"))
    price = lambda c: ((F.lit(5_000_000) + F.col(c)).cast("double") / 100.0).alias(c)
    return numbered(_raised(hours, ["symbol"], "t").select("symbol", "t", *(price(c) for c in "ohlc"), "v"))


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def price_summary(candles: DataFrame) -> DataFrame:
    """Price change of each symbol, last close against first."""
    ends = candles.groupBy("symbol").agg(F.min_by("c", "i").alias("first_c"), F.max_by("c", "i").alias("last_c"), F.count("*").alias("bars"))
    change = F.col("last_c") - F.col("first_c")
    return ends.select("symbol", "bars", "first_c", "last_c", F.when(change > 0, "up").when(change < 0, "down").otherwise("flat").alias("dir"))
