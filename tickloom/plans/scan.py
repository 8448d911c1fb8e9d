"""The flagship scan: the newest bar of each symbol with its indicators, zone and bias."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..sources.candles import series


def newest(candles: DataFrame) -> DataFrame:
    """One row for each symbol: last close, 20-bar mean, bands, stochastic, change over 10 bars and direction."""
    up, mid, low = I.bollinger(F.col("c"))
    bars = candles.withColumns({"bb_up": up, "bb_mid": mid, "bb_low": low, "k": I.stochastic_k(), "roc10": I.roc(F.col("c"), 10), "bull30": F.avg(F.when(F.col("c") > F.col("o"), 100.0).otherwise(0.0)).over(series().rowsBetween(-29, 0))})
    names = ["i", "c", "bb_up", "bb_mid", "bb_low", "k", "roc10", "bull30"]
    last = bars.groupBy("symbol").agg(F.max_by(F.struct(*names), "i").alias("x")).select("symbol", *(F.col(f"x.{n}").alias(n) for n in names))
    return last.withColumn("direction", F.when((F.col("c") > F.col("bb_mid")) & (F.col("roc10") > 0), "long").when((F.col("c") < F.col("bb_mid")) & (F.col("roc10") < 0), "short").otherwise("neutral"))
