"""What follows from the ensemble: entry, targets and stop, and the bias by time frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trade_setup(snapshot: DataFrame, ensemble: DataFrame) -> DataFrame:
    """(symbol, side, entry_min, entry_max, tp1, tp2, sl, rr1, rr2, leverage, rsi14): distances in mean ranges from
    the close; without a side targets and stop are the close. Symbols without a mean range are left out."""
    c, a = F.col("c"), F.col("atr14")
    d = F.when(F.col("direction") == "long", 1).when(F.col("direction") == "short", -1).otherwise(0)
    rows = ensemble.select("symbol", "direction", "raw_score").join(snapshot.select("symbol", "c", "atr14", "rsi14"), "symbol").where("atr14 > 0").withColumn("d", d)
    d, some = F.col("d"), F.col("d") != 0
    leverage = F.when(some, F.floor(2.5 + 8.0 * F.least(F.lit(1.0), F.abs("raw_score"))).cast("int")).otherwise(1)
    side = F.when(d > 0, "LONG").when(d < 0, "SHORT").otherwise("NEUTRAL")
    return rows.select("symbol", side.alias("side"), (c - 0.25 * a).alias("entry_min"), (c + 0.25 * a).alias("entry_max"), (c + d * 1.5 * a).alias("tp1"), (c + d * 3.0 * a).alias("tp2"), (c - d * 1.5 * a).alias("sl"), F.when(some, 1.0).alias("rr1"), F.when(some, 2.0).alias("rr2"), leverage.alias("leverage"), "rsi14")


def bias(snapshot: DataFrame) -> DataFrame:
    """(symbol, tf, direction, confidence, bull_pct, aligned, phase, tf_bias, score): one score, scaled for each of
    four time frames."""
    s = F.col("trend_score")
    named = lambda x, up, down: F.when(x == up, "Bullish").when(x == down, "Bearish").otherwise("Neutral")
    frames = F.explode(F.array(*(F.struct(F.lit(tf).alias("tf"), F.lit(share).alias("share")) for tf, share in (("5m", 0.6), ("15m", 0.8), ("1h", 1.0), ("4h", 0.9))))).alias("x")
    confidence = F.when(F.col("strength") == "strong", "High").when(F.col("strength") == "moderate", "Medium").otherwise("Low")
    rows = snapshot.select("symbol", "trend", "phase", "trend_score", confidence.alias("confidence"), frames).select("*", "x.*")
    return rows.select("symbol", "tf", named(F.col("trend"), "up", "down").alias("direction"), "confidence", F.floor(50.5 + 50.0 * s).cast("int").alias("bull_pct"), (F.abs(s) > 0.4).alias("aligned"), "phase", named(F.signum(s), 1.0, -1.0).alias("tf_bias"), (s * F.col("share")).alias("score"))
