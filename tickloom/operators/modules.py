"""Signal modules over a symbol's newest bar, as SQL expressions of the snapshot's columns, and their ensemble.

A module gives a signal within -1 and 1 and a confidence within 0 and 1; missing inputs make both 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .regime import clamp, doubles, staged

#: The modules' categories.
CATEGORIES = {
    "trend-follow": "trend", "mean-reversion": "mean-reversion", "momentum": "momentum", "breakout": "structure", "support-resistance": "levels",
    "volatility-regime": "volatility", "volume-profile": "volume", "candle-patterns": "patterns", "order-blocks": "smc", "liquidity": "smc",
    "premium-discount": "smc", "session-calendar": "context", "cisd": "smc", "trendline": "structure", "chart-patterns": "structure",
}

#: Values that several modules use. All thresholds and weights here are fixed values.
SHARED: list[dict[str, str]] = [
    {
        "side": "CASE alignment WHEN 'bullish-stack' THEN 1.0 WHEN 'bearish-stack' THEN -1.0 WHEN 'mixed' THEN 0.0 END",
        "adx_conf": "CASE WHEN adx14 < 20 THEN 0.0 WHEN adx14 < 25 THEN 0.2 WHEN adx14 < 40 THEN 0.2 + (adx14 - 25.0) / 15.0 * 0.7 ELSE least(1.0, 0.9 + (adx14 - 40.0) / 40.0 * 0.1) END",
        "z": "coalesce((c - bb_mid) / nullif(bb_up - bb_mid, 0.0), 0.0)",
        "calm": "CASE WHEN adx14 IS NULL THEN 0.5 WHEN adx14 < 20 THEN 1.0 WHEN adx14 < 25 THEN 0.7 WHEN adx14 < 30 THEN 0.4 ELSE 0.15 END",
        "h_sign": "sign(hist0)",
        "turn": "(hist0 - hist1) * CASE WHEN hist0 < 0 THEN -1.0 ELSE 1.0 END",
        "turn_before": "coalesce((hist1 - hist2) * CASE WHEN hist0 < 0 THEN -1.0 ELSE 1.0 END, 0.0)",
        "push": "least(1.0, abs(hist0) / c * 2000.0)",
        "roc_sign": "coalesce(sign(roc10), 0.0)",
        "break_age": "i - break_i",
        "break_side": "CASE break_dir WHEN 'up' THEN 1.0 WHEN 'down' THEN -1.0 END",
        "break_volume": "coalesce(break_v / nullif(break_v20, 0.0), break_v)",
        "near": "coalesce(0.5 * atr14, 0.005 * c)",
        "obv_slope": "CASE WHEN abs(obv20) > 1 THEN (obv - obv20) / greatest(1.0, abs(obv20)) ELSE 0.0 END",
        "cmf_sign": "CASE WHEN cmf20 > 0.05 THEN 1.0 WHEN cmf20 < -0.05 THEN -1.0 ELSE 0.0 END",
        "surge": "CASE WHEN v / nullif(v20_before, 0.0) >= 1.5 THEN 1.0 ELSE 0.0 END",
        "pat_age": "i - pat_i",
        "multiplier": "CASE WHEN session = 'off-hours' THEN 0.6 WHEN session IN ('london', 'ny-am') THEN 1.1 ELSE 1.0 END * CASE WHEN in_event THEN 0.4 ELSE 1.0 END",
        "swept_age": "i - swept_i",
        "block_side": "CASE block_dir WHEN 'bull' THEN 1.0 WHEN 'bear' THEN -1.0 END",
        "block_fresh": "CASE WHEN i - block_i <= 5 THEN 1.0 WHEN i - block_i <= 20 THEN 0.7 WHEN i - block_i <= 50 THEN 0.4 ELSE 0.2 END",
        "block_close": "greatest(0.0, 1.0 - block_dist / (2.0 * block_tol))",
    },
    {
        "break_boost": "CASE WHEN break_volume >= 2 THEN 0.3 WHEN break_volume >= 1.5 THEN 0.2 WHEN break_volume >= 1.2 THEN 0.1 ELSE 0.0 END",
        "break_fresh": "CASE WHEN break_age <= 2 THEN 0.25 WHEN break_age <= 5 THEN 0.15 ELSE 0.05 END",
        "break_base": "CASE WHEN break_type = 'CHoCH' THEN 0.4 ELSE 0.5 END",
        "at_support": "coalesce(c - support <= near, false)",
        "at_resistance": "coalesce(resistance - c <= near, false)",
        "where_between": "(c - support) / nullif((c - support) + (resistance - c), 0.0)",
        "obv_sign": "CASE WHEN obv_slope > 0.005 THEN 1.0 WHEN obv_slope < -0.005 THEN -1.0 ELSE 0.0 END",
        "flow": "greatest(least(1.0, coalesce(abs(cmf20), 0.0) * 2.0), least(1.0, abs(obv_slope) * 10.0))",
        "bullish": "CASE swing WHEN 'down' THEN 0.7 WHEN 'range' THEN 0.45 ELSE 0.25 END",
        "bearish": "CASE swing WHEN 'up' THEN 0.7 WHEN 'range' THEN 0.45 ELSE 0.25 END",
        "pat_fresh": "CASE pat_age WHEN 0 THEN 0.15 WHEN 1 THEN 0.08 ELSE 0.0 END",
        "swept_fresh": "CASE WHEN swept_age = 0 THEN 1.0 WHEN swept_age <= 2 THEN 0.8 ELSE 0.5 END",
        "pool_up": "pool_high - c",
        "pool_down": "c - pool_low",
        "block_conf": "CASE WHEN block_dir IS NOT NULL THEN least(1.0, 0.3 + 0.4 * block_fresh + 0.3 * block_close) END",
        "rank_of": "CASE WHEN zone = 'discount' THEN greatest(0.0, (0.45 - pct) / 0.45) WHEN zone = 'premium' THEN greatest(0.0, (pct - 0.55) / 0.45) END",
    },
    {
        "agree": "CASE WHEN obv_sign <> 0 AND obv_sign = cmf_sign THEN 1.0 ELSE 0.0 END",
        "flow_side": "CASE WHEN obv_sign <> 0 THEN obv_sign ELSE cmf_sign END",
        "pat_side": "CASE WHEN pat_bull = 1 AND (pat_bear = 0 OR bullish > bearish OR (bullish = bearish AND bull_at < bear_at)) THEN 1.0 WHEN pat_bear = 1 THEN -1.0 END",
        "pat_score": "CASE WHEN pat_bull = 1 AND pat_bear = 1 THEN greatest(bullish, bearish) WHEN pat_bull = 1 THEN bullish WHEN pat_bear = 1 THEN bearish END",
        "pool_side": "CASE WHEN pool_up < coalesce(pool_down, pool_up + 1.0) AND pool_up < 8.0 * coalesce(atr14, 0.005 * c) THEN 1.0 WHEN pool_down < coalesce(pool_up, pool_down + 1.0) AND pool_down < 8.0 * coalesce(atr14, 0.005 * c) THEN -1.0 END",
    },
]

#: (id, weight, signal, confidence), in registry order.
MODULES: list[tuple[str, float, str, str]] = [
    (
        "trend-follow",
        1.2,
        "CASE WHEN adx14 IS NULL THEN 0.0 WHEN adx14 < 20 THEN side * 0.15 WHEN (plus_di - minus_di) * side <= 0 THEN side * 0.2 ELSE side * (0.4 + 0.6 * adx_conf) END",
        "CASE WHEN adx14 IS NULL OR side IS NULL THEN 0.0 WHEN side = 0 THEN 0.1 WHEN adx14 < 20 THEN 0.15 WHEN (plus_di - minus_di) * side <= 0 THEN 0.25 ELSE adx_conf END",
    ),
    (
        "mean-reversion",
        1.0,
        "CASE WHEN bb_mid IS NULL THEN 0.0 WHEN z <= -1 AND rsi14 < 35 THEN (0.4 + 0.4 * least(1.0, -z - 1.0) + 0.2 * greatest(0.0, (35.0 - rsi14) / 35.0)) * calm WHEN z >= 1 AND rsi14 > 65 THEN -(0.4 + 0.4 * least(1.0, z - 1.0) + 0.2 * greatest(0.0, (rsi14 - 65.0) / 35.0)) * calm WHEN rsi14 < 30 THEN 0.15 * calm WHEN rsi14 > 70 THEN -0.15 * calm ELSE 0.0 END",
        "CASE WHEN bb_mid IS NULL OR rsi14 IS NULL THEN 0.0 WHEN (z <= -1 AND rsi14 < 35) OR (z >= 1 AND rsi14 > 65) THEN least(1.0, 0.4 + 0.3 * (abs(z) - 1.0) + 0.3 * calm) WHEN rsi14 < 30 OR rsi14 > 70 THEN 0.15 ELSE 0.05 END",
    ),
    (
        "momentum",
        1.0,
        "CASE WHEN hist1 IS NOT NULL THEN h_sign * (0.3 + 0.7 * push) + h_sign * CASE WHEN turn > 0 THEN 0.4 ELSE -0.1 END + h_sign * CASE WHEN roc_sign = h_sign THEN 0.3 WHEN roc_sign = 0 THEN 0.0 ELSE -0.2 END END",
        "CASE WHEN hist1 IS NOT NULL THEN 0.5 * push + CASE WHEN turn > 0 THEN 0.25 ELSE 0.0 END + CASE WHEN turn > 0 AND turn_before > 0 THEN 0.1 ELSE 0.0 END + CASE WHEN roc_sign = h_sign THEN 0.15 ELSE 0.0 END END",
    ),
    (
        "breakout",
        1.1,
        "CASE WHEN break_age <= 10 THEN break_side * least(1.0, break_base + break_boost + break_fresh) ELSE 0.0 END",
        "CASE WHEN break_age <= 10 THEN least(1.0, break_base + break_boost + 0.8 * break_fresh) WHEN break_age > 10 THEN 0.05 END",
    ),
    (
        "support-resistance",
        0.9,
        "CASE WHEN at_support AND NOT at_resistance THEN 0.4 + 0.4 * least(1.0, support_strength / 5.0) WHEN at_resistance AND NOT at_support THEN -(0.4 + 0.4 * least(1.0, resistance_strength / 5.0)) ELSE (0.5 - where_between) * 0.5 END",
        "CASE WHEN at_support AND NOT at_resistance THEN 0.4 + 0.3 * least(1.0, support_strength / 5.0) WHEN at_resistance AND NOT at_support THEN 0.4 + 0.3 * least(1.0, resistance_strength / 5.0) ELSE abs(0.5 - where_between) END",
    ),
    (
        "volatility-regime",
        0.7,
        "CASE WHEN width < 0.7 * width50 THEN 0.25 * h_sign ELSE 0.0 END",
        "CASE WHEN width IS NULL THEN 0.0 WHEN width < 0.7 * width50 THEN CASE WHEN h_sign <> 0 THEN 0.3 ELSE 0.1 END WHEN width > 1.3 * width50 THEN 0.1 ELSE 0.15 END",
    ),
    ("volume-profile", 0.8, "flow_side * (0.3 + 0.5 * flow + 0.1 * surge + 0.1 * agree)", "0.25 + 0.35 * flow + 0.2 * agree + 0.1 * surge"),
    (
        "candle-patterns",
        0.7,
        "CASE WHEN pat_age <= 3 THEN pat_side * least(1.0, pat_score + pat_fresh) ELSE 0.0 END",
        "CASE WHEN pat_age <= 3 THEN CASE WHEN pat_side IS NOT NULL THEN least(1.0, 0.9 * pat_score + pat_fresh) ELSE 0.0 END WHEN pat_age > 3 THEN 0.05 END",
    ),
    ("order-blocks", 0.9, "block_side * (0.3 + 0.7 * block_conf)", "CASE WHEN block_conf IS NOT NULL THEN block_conf WHEN open_blocks > 0 THEN 0.08 WHEN blocks > 0 THEN 0.05 END"),
    (
        "liquidity",
        0.9,
        "CASE WHEN swept_age <= 5 THEN (CASE swept_kind WHEN 'high' THEN 1.0 ELSE -1.0 END) * (0.4 + 0.4 * swept_fresh) WHEN pool_side = 1 THEN 0.15 + 0.2 * least(1.0, high_touches / 4.0) WHEN pool_side = -1 THEN -(0.15 + 0.2 * least(1.0, low_touches / 4.0)) ELSE 0.0 END",
        "CASE WHEN swept_age <= 5 THEN 0.35 + 0.45 * swept_fresh WHEN pool_side = 1 THEN 0.2 + 0.2 * least(1.0, high_touches / 4.0) WHEN pool_side = -1 THEN 0.2 + 0.2 * least(1.0, low_touches / 4.0) ELSE 0.05 END",
    ),
    (
        "premium-discount",
        0.7,
        "CASE zone WHEN 'discount' THEN 0.2 + 0.4 * rank_of WHEN 'premium' THEN -(0.2 + 0.4 * rank_of) ELSE 0.0 END",
        "CASE WHEN zone IN ('discount', 'premium') THEN 0.25 + 0.35 * rank_of WHEN zone IS NOT NULL THEN 0.1 END",
    ),
    ("session-calendar", 0.5, "0.0", "CASE WHEN session = 'off-hours' THEN 0.1 WHEN session IN ('london', 'ny-am') THEN 0.25 ELSE 0.2 END - CASE WHEN in_event THEN 0.15 ELSE 0.0 END"),
    ("cisd", 1.1, "cisd_signal", "cisd_confidence"),
    ("trendline", 1.0, "line_signal", "line_confidence"),
    ("chart-patterns", 1.0, "chart_signal", "chart_confidence"),
]


def bounded(signal: str, confidence: str) -> tuple[str, str]:
    return doubles(f"coalesce({clamp(signal)}, 0.0)") if signal != "0.0" else doubles("0.0"), doubles(f"coalesce({clamp(confidence, '0.0')}, 0.0)")


def evaluate(snapshot: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, module, weight, signal, confidence, applied, direction): every module for every row. ``applied`` is the
    confidence after the session's multiplier, which is less in an event's window (``in_event``, if snapshot has it)."""
    if "in_event" not in snapshot.columns:
        snapshot = snapshot.withColumn("in_event", F.lit(False))
    rows = staged(snapshot, SHARED)
    made = [F.struct(F.lit(name).alias("module"), F.lit(weight).alias("weight"), *(F.expr(x).alias(k) for k, x in zip(("signal", "confidence"), bounded(signal, confidence), strict=True))) for name, weight, signal, confidence in MODULES]
    long = rows.select(*keys, "multiplier", F.explode(F.array(*made)).alias("m")).select(*keys, "multiplier", "m.*")
    applied = F.when(F.col("module") == "session-calendar", F.col("confidence")).otherwise(F.least(F.lit(1.0), F.col("confidence") * F.col("multiplier")))
    side = F.when(F.col("signal") > 0.05, "long").when(F.col("signal") < -0.05, "short").otherwise("neutral")
    return long.select(*keys, "module", "weight", "signal", "confidence", applied.alias("applied"), side.alias("direction"))


def listed(signals: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The signals of the modules in ``only`` (all, if None) that are not in ``exclude``."""
    if only is not None:
        signals = signals.where(F.col("module").isin(only))
    return signals.where(~F.col("module").isin(exclude)) if exclude else signals


def registry(spark: SparkSession) -> DataFrame:
    """(place, module, category, weight) of every module, in order."""
    rows = [(k, name, CATEGORIES[name], float(weight)) for k, (name, weight, _, _) in enumerate(MODULES)]
    return spark.createDataFrame(rows, "place int, module string, category string, weight double")


def ensemble(signals: DataFrame, keys: tuple[str, ...] = ("symbol",), calibrated: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, raw_score, confidence, participating, probability, direction): the modules that have something to say, by
    weight. calibrated: a probability from a score, held within 0 and 1; else the logistic curve of three times the score."""
    heard = signals.where("applied >= 0.05 OR abs(signal) >= 0.1")
    sums = heard.groupBy(*keys).agg((F.sum(F.col("signal") * F.col("applied") * F.col("weight")) / F.sum("weight")).alias("raw_score"), F.avg("applied").alias("confidence"), F.count("*").alias("participating"))
    score = F.col("raw_score")
    probability = 1.0 / (1.0 + F.exp(-3.0 * score)) if calibrated is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), calibrated(score)))
    scored = sums.withColumn("probability", probability)
    return scored.withColumn("direction", F.when(F.col("probability") > 0.55, "long").when(F.col("probability") < 0.45, "short").otherwise("neutral"))
