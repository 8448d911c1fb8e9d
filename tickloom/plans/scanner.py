"""One row for each symbol's newest bars: price, change, the modules' ensemble, regime and phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import modules
from . import snapshot

#: Bars that are looked at, and how many a symbol needs to be scored.
BARS, LEAST = 250, 100


def scanned(candles: DataFrame, most: int = BARS, least: int = LEAST) -> DataFrame:
    """(symbol, enough, price, change_pct, raw_score, probability, direction, confidence, regime, wyckoff, modules); a
    symbol with too few bars has a row without a score."""
    all_of = Window.partitionBy("symbol")
    cut = candles.withColumn("cut", F.greatest(F.lit(0), F.max("i").over(all_of) + 1 - most))
    bars = cut.where("i >= cut").withColumn("i", (F.col("i") - F.col("cut")).cast("int")).drop("cut")
    ends = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min_by("c", "i").alias("first"), F.max_by("c", "i").alias("price"))
    around = snapshot.newest(bars)
    score = modules.ensemble(modules.evaluate(around))
    named = around.select("symbol", F.concat_ws("-", "trend", "strength").alias("regime"), F.col("phase").alias("wyckoff"))
    rows = ends.join(score, "symbol", "left").join(named, "symbol", "left").withColumn("enough", F.col("bars") >= least)
    change = F.when(F.col("first") != 0, (F.col("price") - F.col("first")) / F.col("first") * 100.0).otherwise(0.0)
    told = {"price": (F.col("price"), 0.0), "change_pct": (change, 0.0), "raw_score": (F.col("raw_score"), 0.0), "probability": (F.col("probability"), 0.5), "direction": (F.col("direction"), "neutral"), "confidence": (F.col("confidence"), 0.0), "regime": (F.col("regime"), "—"), "wyckoff": (F.col("wyckoff"), "—"), "modules": (F.col("participating"), 0)}
    return rows.select("symbol", "enough", *(F.when(F.col("enough"), x).otherwise(F.lit(y)).alias(n) for n, (x, y) in told.items()))
