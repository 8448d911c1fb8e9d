"""Queries from recurrences over structure to decisions, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import indicators as I
from .operators import modules, setups, structure
from .plans import snapshot
from .decisions_sql import _BLOCKS, _BREAKS, _MARKED, _of, _POOLS, _PROFILE, _REC, _RECURSIVE, _TOL, _TREND
from .queries import _PIVOT, _S, _WITH, _after, _bars, _r
from .state_sql import states, votes

_REGIME = ("strength", "volatility", "alignment", "trend", "momentum", "breakout", "regime", "phase")


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(_r(n) if t == "double" else F.col(n) for n, t in rows.dtypes))


def _newest(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return _bars(lambda b: _rounded(f(snapshot.newest(b))))


def _last(bars: DataFrame) -> DataFrame:
    return snapshot.regimes(bars).where("newer IS NULL")


def _tolerances(bars: DataFrame, share: float) -> DataFrame:
    return bars.groupBy("symbol").agg((F.max_by("c", "i") * share / 100.0).alias("tolerance"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dema_tema": _after(I.recurrences, "dema20", "tema20"),
    "adx": _after(I.recurrences, "plus_di", "minus_di", "adx14"),
    "psar": _after(I.recurrences, "psar", "psar_side"),
    "keltner": _after(lambda b: I.keltner(I.recurrences(b)), "kc_up", "kc_mid", "kc_low"),
    "trend": _bars(structure.trend),
    "breaks": _bars(structure.breaks),
    "order_blocks": _bars(lambda b: structure.order_blocks(I.recurrences(b))),
    "equal_levels": _bars(lambda b: _rounded(structure.equal_levels(b, _tolerances(b, 0.25)))),
    "sweeps": _bars(lambda b: _rounded(structure.sweeps(b, structure.equal_levels(b, _tolerances(b, 0.25))))),
    "value_area": _bars(lambda b: structure.value_area(structure.volume_profile(b))),
    "volume_nodes": _bars(lambda b: structure.volume_nodes(structure.volume_profile(b)).select("symbol", "bucket", "volume", "node")),
    "regime": _bars(lambda b: _rounded(_last(b).select("symbol", *_REGIME, "vol_score", "trend_score", "mom_score"))),
    "modules": _newest(lambda n: modules.evaluate(n)),
    "ensemble": _newest(lambda n: modules.ensemble(modules.evaluate(n))),
    "trade_setup": _newest(lambda n: setups.trade_setup(n, modules.ensemble(modules.evaluate(n)))),
    "bias": _bars(lambda b: _rounded(setups.bias(_last(b)))),
}


_NEWEST = "true QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1"
_STATE = states(_NEWEST)
_VOTED = _STATE + votes()

SQL: dict[str, str] = {
    "recurrences": _REC + _of("ema20 ema50 rsi14 atr14 macd macd_signal macd_hist"),
    "dema_tema": _REC + ", x AS (SELECT symbol, i, 2 * ema20 - two AS dema20, 3 * ema20 - 3 * two + three AS tema20 FROM rec)" + _of("dema20 tema20", "x"),
    "adx": _REC + _of("plus_di minus_di adx14"),
    "keltner": _REC + ", x AS (SELECT symbol, i, ema20 + 2 * atr14 AS kc_up, ema20 AS kc_mid, ema20 - 2 * atr14 AS kc_low FROM rec)" + _of("kc_up kc_mid kc_low", "x"),
    "psar": _RECURSIVE + f""", d AS MATERIALIZED (SELECT symbol, i, h, l, LEAD(h) OVER ({_S}) AS hn, MIN(l) OVER ({_S} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l2, MAX(h) OVER ({_S} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS h2 FROM b),
r(symbol, i, up, ep, sar, af) AS (SELECT symbol, 0, hn >= h, CASE WHEN hn >= h THEN h ELSE l END, CASE WHEN hn >= h THEN l ELSE h END, 0.02::DOUBLE FROM d WHERE i = 0 AND hn IS NOT NULL UNION ALL
SELECT symbol, i, up <> flip, CASE WHEN flip THEN CASE WHEN up THEN l ELSE h END WHEN up THEN GREATEST(ep, h) ELSE LEAST(ep, l) END, CASE WHEN flip THEN ep ELSE s END, CASE WHEN flip THEN 0.02::DOUBLE WHEN (up AND h > ep) OR (NOT up AND l < ep) THEN LEAST(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END
FROM (SELECT *, CASE WHEN up THEN l < s ELSE h > s END AS flip FROM (SELECT d.*, up, ep, af, CASE WHEN up THEN LEAST(sar + af * (ep - sar), l2) ELSE GREATEST(sar + af * (ep - sar), h2) END AS s FROM r JOIN d ON d.symbol = r.symbol AND d.i = r.i + 1)))
SELECT symbol, i, ROUND(sar, 6) AS psar, CASE WHEN up THEN 1.0 ELSE -1.0 END::DOUBLE AS psar_side FROM r""",
    "trend": _WITH + _PIVOT + _TREND + " SELECT * FROM swings",
    "breaks": _RECURSIVE + _MARKED + _BREAKS + " SELECT * FROM brk",
    "order_blocks": _REC + _MARKED + _BLOCKS + " SELECT * FROM obs",
    "equal_levels": _RECURSIVE + _PIVOT + _TOL + _POOLS + " SELECT symbol, kind, ROUND(price, 6) AS price, touches, last_i FROM eq",
    "sweeps": _RECURSIVE + _PIVOT + _TOL + _POOLS + " SELECT symbol, kind, ROUND(price, 6) AS price, touches, last_i, swept_at FROM swp",
    "value_area": _PROFILE + """, a AS (SELECT symbol, ARG_MAX(bucket, (volume, -bucket)) AS poc, MAX(volume) AS top, SUM(volume) AS total FROM vp GROUP BY symbol),
r(symbol, poc, "first", "last", covered, total) AS (SELECT symbol, poc, poc, poc, top, total FROM a UNION ALL SELECT r.symbol, poc, CASE WHEN COALESCE(u.volume, -1) >= COALESCE(d.volume, -1) THEN "first" ELSE "first" - 1 END, CASE WHEN COALESCE(u.volume, -1) >= COALESCE(d.volume, -1) THEN "last" + 1 ELSE "last" END, covered + GREATEST(COALESCE(u.volume, -1), COALESCE(d.volume, -1)), total
FROM r LEFT JOIN vp u ON u.symbol = r.symbol AND u.bucket = "last" + 1 LEFT JOIN vp d ON d.symbol = r.symbol AND d.bucket = "first" - 1 WHERE covered < 0.7::DOUBLE * total AND (u.volume IS NOT NULL OR d.volume IS NOT NULL))
SELECT symbol, poc, "first", "last", covered FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "last" - "first" DESC) = 1""",
    "volume_nodes": _PROFILE + ", m AS (SELECT symbol, list_sort(list(volume))[COUNT(*) // 2 + 1] AS mid, AVG(volume) FILTER (volume > 0) AS mean FROM vp GROUP BY symbol), nodes AS (SELECT vp.*, CASE WHEN mid > 0 THEN mid ELSE mean END AS base FROM vp JOIN m ON m.symbol = vp.symbol) SELECT symbol, bucket, volume, CASE WHEN volume >= 1.5 * base THEN 'HVN' WHEN volume > 0 AND volume <= 0.4::DOUBLE * base THEN 'LVN' END AS node FROM nodes",
    "regime": f"{_STATE} SELECT symbol, {', '.join(_REGIME)}, ROUND(vol_score, 6) AS vol_score, ROUND(trend_score, 6) AS trend_score, ROUND(mom_score, 6) AS mom_score FROM re",
    "modules": f"{_VOTED} SELECT symbol, module, weight, ROUND(signal, 6) AS signal, ROUND(confidence, 6) AS confidence, ROUND(applied, 6) AS applied, direction FROM sg",
    "ensemble": f"{_VOTED} SELECT symbol, ROUND(raw_score, 6) AS raw_score, ROUND(confidence, 6) AS confidence, participating, ROUND(probability, 6) AS probability, direction FROM en",
    "trade_setup": f"""{_VOTED}, s AS (
    SELECT en.symbol, CASE direction WHEN 'long' THEN 1 WHEN 'short' THEN -1 ELSE 0 END AS d, c, atr14 AS a, rsi14, LEAST(1.0, ABS(raw_score)) AS k FROM en JOIN re USING (symbol, mt) WHERE atr14 > 0)
SELECT symbol, CASE d WHEN 1 THEN 'LONG' WHEN -1 THEN 'SHORT' ELSE 'NEUTRAL' END AS side, ROUND(c - 0.25 * a, 6) AS entry_min, ROUND(c + 0.25 * a, 6) AS entry_max,
    ROUND(c + d * 1.5 * a, 6) AS tp1, ROUND(c + d * 3.0 * a, 6) AS tp2, ROUND(c - d * 1.5 * a, 6) AS sl, CASE WHEN d <> 0 THEN 1.0::DOUBLE END AS rr1,
    CASE WHEN d <> 0 THEN 2.0::DOUBLE END AS rr2, CASE WHEN d = 0 THEN 1 ELSE CAST(FLOOR(2.5 + 8 * k) AS INTEGER) END AS leverage, ROUND(rsi14, 6) AS rsi14 FROM s""",
    "bias": f"""{_STATE} SELECT symbol, tf, CASE WHEN trend = 'up' THEN 'Bullish' WHEN trend = 'down' THEN 'Bearish' ELSE 'Neutral' END AS direction,
    CASE strength WHEN 'strong' THEN 'High' WHEN 'moderate' THEN 'Medium' ELSE 'Low' END AS confidence, CAST(FLOOR(50.5 + 50 * trend_score) AS INTEGER) AS bull_pct, ABS(trend_score) > 0.4 AS aligned, phase,
    CASE WHEN trend_score > 0 THEN 'Bullish' WHEN trend_score < 0 THEN 'Bearish' ELSE 'Neutral' END AS tf_bias, ROUND(trend_score * share_of, 6) AS score
FROM re CROSS JOIN (VALUES ('5m', 0.6::DOUBLE), ('15m', 0.8::DOUBLE), ('1h', 1.0::DOUBLE), ('4h', 0.9::DOUBLE)) x(tf, share_of)""",
}
