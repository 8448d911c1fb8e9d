"""Regime and Wyckoff phase of a bar, as stages of SQL expressions over its features; later stages use earlier ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doubles(text: str) -> str:
    """Rules with their decimal literals as doubles, on one line."""
    return re.sub(r"\b(\d+\.\d+)\b", r"\1e0", " ".join(text.split()))


def clamp(x: str, low: str = "-1.0", high: str = "1.0") -> str:
    """x within the bounds; null stays null, which greatest and least would skip."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({low}, least({high}, {x})) END"


REGIME: list[dict[str, str]] = [
    {
        "strength": "CASE WHEN adx14 >= 40 THEN 'strong' WHEN adx14 >= 25 THEN 'moderate' ELSE 'weak' END",
        "atr_pct": "CASE WHEN c > 0 THEN atr14 / c END",
        "width": "(bb_up - bb_low) / nullif(bb_mid, 0.0)",
        "alignment": "CASE WHEN ema20 IS NULL OR ema50 IS NULL OR ema200 IS NULL THEN 'flat' WHEN ema20 > ema50 AND ema50 > ema200 THEN 'bullish-stack' WHEN ema20 < ema50 AND ema50 < ema200 THEN 'bearish-stack' ELSE 'mixed' END",
    },
    {
        "volatility": "CASE WHEN atr_pct <= 0.003 THEN 'low' WHEN atr_pct >= 0.015 THEN 'high' WHEN atr_pct IS NOT NULL THEN 'normal' WHEN width <= 0.02 THEN 'low' WHEN width >= 0.1 THEN 'high' ELSE 'normal' END",
        "vol_score": f"coalesce({clamp('(atr_pct - 0.003) / 0.012', '0.0')}, {clamp('(width - 0.02) / 0.08', '0.0')}, 0.0)",
        "trend_score": "CASE WHEN strength <> 'weak' AND plus_di IS NOT NULL THEN (CASE WHEN plus_di > minus_di THEN 1.0 ELSE -1.0 END) * abs(plus_di - minus_di) / greatest(1.0, plus_di + minus_di) WHEN swing = 'up' THEN 0.4 WHEN swing = 'down' THEN -0.4 WHEN alignment = 'bullish-stack' THEN 0.3 WHEN alignment = 'bearish-stack' THEN -0.3 ELSE 0.0 END",
        "trend": "CASE WHEN strength <> 'weak' AND plus_di IS NOT NULL THEN CASE WHEN plus_di > minus_di THEN 'up' ELSE 'down' END WHEN swing IN ('up', 'down') THEN swing WHEN alignment = 'bullish-stack' THEN 'up' WHEN alignment = 'bearish-stack' THEN 'down' ELSE 'range' END",
        "mom_score": clamp(f"coalesce({clamp('CASE WHEN c > 0 THEN macd_hist / c * 1000.0 END')}, 0.0) + coalesce((rsi14 - 50.0) / 50.0, 0.0) * 0.5"),
        "breakout": "CASE WHEN i - break_i <= 10 THEN break_dir ELSE 'none' END",
    },
    {
        "momentum": "CASE WHEN mom_score > 0.15 THEN 'up' WHEN mom_score < -0.15 THEN 'down' ELSE 'flat' END",
        "regime": "concat(CASE WHEN trend = 'range' THEN 'range' ELSE concat('trending-', trend) END, '-', strength, '-', volatility, '-vol')",
    },
]

WYCKOFF: list[dict[str, str]] = [
    {
        "phase": """CASE WHEN alignment = 'bullish-stack' AND adx14 >= 22 AND volume_slope >= 0 THEN 'markup'
            WHEN alignment = 'bearish-stack' AND adx14 >= 22 AND volume_slope >= 0 THEN 'markdown'
            WHEN bull30 >= 62 AND coalesce(width, 1.0) >= 0.03 THEN 'markup' WHEN bull30 <= 38 AND coalesce(width, 1.0) >= 0.03 THEN 'markdown'
            WHEN alignment = 'bullish-stack' AND volume_slope < 0 AND width <= 0.04 THEN 'distribution'
            WHEN alignment = 'bearish-stack' AND volume_slope < 0 AND width <= 0.04 THEN 'accumulation'
            WHEN width <= 0.04 THEN CASE WHEN bull30 >= 50 THEN 'accumulation' ELSE 'distribution' END ELSE 'neutral' END"""
    }
]


def staged(rows: DataFrame, stages: list[dict[str, str]]) -> DataFrame:
    for stage in stages:
        rows = rows.withColumns({name: F.expr(doubles(rule)) for name, rule in stage.items()})
    return rows


def classify(features: DataFrame) -> DataFrame:
    """features with regime fields and Wyckoff phase."""
    return staged(features, REGIME + WYCKOFF)
