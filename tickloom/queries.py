"""Registered queries over candles made of ``events``, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import indicators as I
from .operators import structure
from .plans import scan
from .sources import candles

def _r(name: str, places: int = 6):
    return F.round(F.col(name), places).alias(name)


def _bars(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(candles.load(spark, sf_dir))


def _series(made: Callable[[], dict]) -> Callable[[SparkSession, str], DataFrame]:
    """Bars with columns that are expressions of them, rounded."""
    return _bars(lambda bars: bars.withColumns(made()).select("symbol", "i", *(_r(n) for n in made())))


def _after(f: Callable[[DataFrame], DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return _bars(lambda bars: f(bars).select("symbol", "i", *(_r(n) for n in names)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "candles": _bars(lambda b: b),
    "price_summary": _bars(candles.price_summary),
    "sma": _series(lambda: dict(sma20=I.sma(F.col("c"), 20), sma50=I.sma(F.col("c"), 50))),
    "wma": _series(lambda: dict(wma10=I.wma(F.col("c"), 10))),
    "roc": _series(lambda: dict(roc10=I.roc(F.col("c"), 10))),
    "bollinger": _series(lambda: dict(**dict(zip(("up", "mid", "low"), I.bollinger(F.col("c")), strict=True)))),
    "stochastic": _bars(lambda b: b.withColumn("k", I.stochastic_k()).withColumn("d", I.full(F.avg("k").over(I.rows(3)), 16)).select("symbol", "i", _r("k"), _r("d"))),
    "williams_r": _series(lambda: dict(wr14=I.williams_r())),
    "vwap": _series(lambda: dict(vwap20=I.vwap())),
    "obv": _after(I.obv, "obv"),
    "cmf": _series(lambda: dict(cmf20=I.cmf())),
    "mfi": _after(I.money_flow, "mfi"),
    "cci": _after(I.commodity_channel, "cci"),
    "ichimoku": _after(I.ichimoku, "tenkan", "kijun", "senkou_a", "senkou_b", "chikou"),
    "recurrences": _after(I.recurrences, "ema20", "ema50", "rsi14", "atr14", "macd", "macd_signal", "macd_hist"),
    "ema": _after(I.recurrences, "ema20"),
    "pivots": _bars(structure.pivots),
    "gaps": _bars(structure.gaps),
    "session_stats": _bars(lambda b: structure.session_stats(b).select("symbol", "session", "bars", _r("avg_range"), _r("avg_volume"))),
    "candle_patterns": _bars(structure.candle_patterns),
    "volume_profile": _bars(structure.volume_profile),
    "anchored_vwap": _after(I.anchored_vwap, "vwap_day"),
    "bull_share": _series(lambda: dict(bull30=I.bull_share())),
    "volume_slope": _after(I.volume_slope, "volume_slope"),
    "return_spread": _after(I.return_spread, "return_std"),
    "levels": _bars(lambda b: structure.levels(b).select("symbol", _r("price"), "touches", "kinds", _r("strength"))),
    "premium_discount": _bars(lambda b: structure.premium_discount(b).select("symbol", "high", "low", _r("pct"), "zone")),
    "scan": _bars(lambda b: scan.newest(b).select("symbol", "i", "c", *(_r(n) for n in ("bb_up", "bb_mid", "bb_low", "k", "roc10", "bull30")), "direction")),
}

_WITH = """WITH w AS (SELECT *, 5000000 + SUM(CAST(ROUND(value*100) AS BIGINT) - 5000) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS cents FROM events),
p AS (SELECT *, CAST(cents AS DOUBLE) / CAST(100.0 AS DOUBLE) AS price FROM w),
g AS (SELECT event_type AS symbol, CAST(date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS BIGINT) AS t, ARG_MIN(price, (ts, event_id)) AS o, MAX(price) AS h, MIN(price) AS l, ARG_MAX(price, (ts, event_id)) AS c, CAST(COUNT(*) AS DOUBLE) AS v FROM p GROUP BY ALL),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS INTEGER) AS i, (h + l + c) / 3.0::DOUBLE AS tp FROM g)"""
_S = "PARTITION BY symbol ORDER BY i"


def _w(n: int) -> str:
    return f"OVER ({_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _sql(columns: str, more: str = "") -> str:
    return f"{_WITH}{more} SELECT symbol, i, {columns}"


def _full(x: str, n: int, name: str) -> str:
    return f"CASE WHEN i >= {n - 1} THEN ROUND({x}, 6) END AS {name}"


_MIDPOINT = lambda n: f"CASE WHEN i >= {n - 1} THEN (MAX(h) {_w(n)} + MIN(l) {_w(n)}) / 2.0 END"
_K = f"CASE WHEN i >= 13 THEN CASE WHEN MAX(h) {_w(14)} = MIN(l) {_w(14)} THEN 50.0 ELSE (c - MIN(l) {_w(14)}) / (MAX(h) {_w(14)} - MIN(l) {_w(14)}) * 100.0 END END"
_PIVOT = f""", m AS (SELECT *, COUNT(*) OVER ({_S} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) = 2 AND COUNT(*) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) = 2 AS inside,
MAX(h) OVER ({_S} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS hb, MAX(h) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ha, MIN(l) OVER ({_S} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS lb, MIN(l) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS la FROM b),
f AS (SELECT symbol, i, 'high' AS kind, h AS price FROM m WHERE inside AND h > hb AND h >= ha UNION ALL SELECT symbol, i, 'low', l FROM m WHERE inside AND l < lb AND l <= la),
q AS (SELECT *, LAG(price) OVER (PARTITION BY symbol, kind ORDER BY i) AS p FROM f)"""
_PATTERN = f""", x AS (SELECT *, LAG(o) OVER ({_S}) o1, LAG(h) OVER ({_S}) h1, LAG(l) OVER ({_S}) l1, LAG(c) OVER ({_S}) c1, LAG(o, 2) OVER ({_S}) o2, LAG(c, 2) OVER ({_S}) c2, ABS(c - o) AS body, h - l AS span, h - GREATEST(o, c) AS up, LEAST(o, c) - l AS down FROM b),
y AS (SELECT symbol, i, concat_ws(',', CASE WHEN span > 0 AND body / span <= 0.05 THEN 'doji' END, CASE WHEN body <> 0 AND down >= 2 * body AND up <= body THEN 'hammer' END, CASE WHEN body <> 0 AND up >= 2 * body AND down <= body THEN 'invHammer' END,
CASE WHEN c1 < o1 AND c > o AND o <= c1 AND c >= o1 THEN 'bullEngulf' END, CASE WHEN c1 > o1 AND c < o AND o >= c1 AND c <= o1 THEN 'bearEngulf' END, CASE WHEN c1 < o1 AND c > o AND o >= c1 AND c <= o1 THEN 'bullHarami' END, CASE WHEN c1 > o1 AND c < o AND o <= c1 AND c >= o1 THEN 'bearHarami' END,
CASE WHEN c2 < o2 AND h1 <> l1 AND ABS(c1 - o1) <= 0.3 * (h1 - l1) AND c > o AND c > (o2 + c2) / 2 THEN 'morningStar' END, CASE WHEN c2 > o2 AND h1 <> l1 AND ABS(c1 - o1) <= 0.3 * (h1 - l1) AND c < o AND c < (o2 + c2) / 2 THEN 'eveningStar' END) AS patterns FROM x)"""

SQL: dict[str, str] = {
    "candles": _WITH + " SELECT symbol, i, t, o, h, l, c, v FROM b",
    "price_summary": _WITH + ", e AS (SELECT symbol, COUNT(*) AS bars, ARG_MIN(c, i) AS first_c, ARG_MAX(c, i) AS last_c FROM b GROUP BY symbol) SELECT *, CASE WHEN last_c > first_c THEN 'up' WHEN last_c < first_c THEN 'down' ELSE 'flat' END AS dir FROM e",
    "sma": _sql(_full(f"AVG(c) {_w(20)}", 20, "sma20") + ", " + _full(f"AVG(c) {_w(50)}", 50, "sma50") + " FROM b"),
    "wma": _sql("CASE WHEN i >= 9 THEN ROUND((" + " + ".join(f"LAG(c, {9 - k}) OVER ({_S}) * {k + 1}" for k in range(10)) + ") / 55.0::DOUBLE, 6) END AS wma10 FROM b"),
    "roc": _sql(f"ROUND((c - LAG(c, 10) OVER ({_S})) / LAG(c, 10) OVER ({_S}) * 100.0::DOUBLE, 6) AS roc10 FROM b"),
    "bollinger": _sql(_full(f"AVG(c) {_w(20)} + STDDEV_POP(c) {_w(20)} * 2", 20, "up") + ", " + _full(f"AVG(c) {_w(20)}", 20, "mid") + ", " + _full(f"AVG(c) {_w(20)} - STDDEV_POP(c) {_w(20)} * 2", 20, "low") + " FROM b"),
    "stochastic": f"{_WITH}, k AS (SELECT symbol, i, {_K} AS k FROM b) SELECT symbol, i, ROUND(k, 6) AS k, CASE WHEN i >= 15 THEN ROUND(AVG(k) {_w(3)}, 6) END AS d FROM k",
    "williams_r": _sql(_full(f"CASE WHEN MAX(h) {_w(14)} = MIN(l) {_w(14)} THEN -50.0 ELSE (MAX(h) {_w(14)} - c) / (MAX(h) {_w(14)} - MIN(l) {_w(14)}) * -100.0 END", 14, "wr14") + " FROM b"),
    "vwap": _sql(_full(f"SUM(tp * v) {_w(20)} / SUM(v) {_w(20)}", 20, "vwap20") + " FROM b"),
    "obv": f"{_WITH}, s AS (SELECT symbol, i, COALESCE(SIGN(c - LAG(c) OVER ({_S})) * v, 0) AS step FROM b) SELECT symbol, i, ROUND(SUM(step) OVER ({_S} ROWS UNBOUNDED PRECEDING), 6) AS obv FROM s",
    "cmf": f"{_WITH}, s AS (SELECT *, CASE WHEN h = l THEN 0.0 ELSE ((c - l) - (h - c)) / (h - l) END * v AS flow FROM b) SELECT symbol, i, {_full(f'SUM(flow) {_w(20)} / SUM(v) {_w(20)}', 20, 'cmf20')} FROM s",
    "mfi": f"{_WITH}, s AS (SELECT *, LAG(tp) OVER ({_S}) AS tb FROM b), u AS (SELECT symbol, i, CASE WHEN tp > tb THEN tp * v ELSE 0.0 END AS up, CASE WHEN tp < tb THEN tp * v ELSE 0.0 END AS down FROM s) SELECT symbol, i, {_full(f'CASE WHEN SUM(down) {_w(14)} = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + SUM(up) {_w(14)} / SUM(down) {_w(14)}) END', 15, 'mfi')} FROM u",
    "cci": f"{_WITH}, s AS (SELECT *, AVG(tp) {_w(20)} AS mean, LIST(tp) {_w(20)} AS a FROM b), d AS (SELECT *, list_sum(list_transform(a, lambda x: ABS(x - mean))) / 20 AS md FROM s) SELECT symbol, i, {_full('CASE WHEN md = 0 THEN 0.0 ELSE (tp - mean) / (0.015::DOUBLE * md) END', 20, 'cci')} FROM d",
    "ichimoku": f"{_WITH}, s AS (SELECT symbol, i, c, {_MIDPOINT(9)} AS tenkan, {_MIDPOINT(26)} AS kijun, {_MIDPOINT(52)} AS slow FROM b) SELECT symbol, i, ROUND(tenkan, 6) AS tenkan, ROUND(kijun, 6) AS kijun, ROUND(LAG((tenkan + kijun) / 2.0, 26) OVER ({_S}), 6) AS senkou_a, ROUND(LAG(slow, 26) OVER ({_S}), 6) AS senkou_b, ROUND(LEAD(c, 26) OVER ({_S}), 6) AS chikou FROM s",
    "ema": _WITH.replace("WITH w", "WITH RECURSIVE w") + ", e(symbol, i, e) AS (SELECT symbol, 19, SUM(c ORDER BY i) / 20 FROM b WHERE i < 20 GROUP BY symbol HAVING COUNT(*) = 20 UNION ALL SELECT b.symbol, b.i, (b.c - e.e) * (2.0::DOUBLE / 21) + e.e FROM e JOIN b ON b.symbol = e.symbol AND b.i = e.i + 1) SELECT b.symbol, b.i, ROUND(e.e, 6) AS ema20 FROM b LEFT JOIN e ON b.symbol = e.symbol AND b.i = e.i",
    "pivots": _WITH + _PIVOT + " SELECT symbol, i, kind, price, CASE WHEN kind = 'high' THEN CASE WHEN p IS NULL THEN 'H' WHEN price > p THEN 'HH' ELSE 'LH' END ELSE CASE WHEN p IS NULL THEN 'L' WHEN price > p THEN 'HL' ELSE 'LL' END END AS label FROM q",
    "gaps": f"{_WITH}, m AS (SELECT *, LAG(h, 2) OVER ({_S}) AS h2, LAG(l, 2) OVER ({_S}) AS l2 FROM b), f AS (SELECT symbol, i, 'bull' AS dir, h2 AS bottom, l AS top FROM m WHERE h2 < l UNION ALL SELECT symbol, i, 'bear', h, l2 FROM m WHERE l2 > h) SELECT f.symbol, f.i, dir, bottom, top, MIN(b.i) AS mitigated_at FROM f LEFT JOIN b ON b.symbol = f.symbol AND b.i > f.i AND b.l <= top AND b.h >= bottom GROUP BY ALL",
    "session_stats": _WITH + ", s AS (SELECT *, t % 24 AS x FROM b), y AS (SELECT *, CASE WHEN x >= 22 OR x < 2 THEN 'asia' WHEN x BETWEEN 7 AND 9 THEN 'london' WHEN x BETWEEN 12 AND 14 THEN 'ny-am' WHEN x = 15 THEN 'ny-pm' ELSE 'off-hours' END AS session FROM s) SELECT symbol, session, COUNT(*) AS bars, ROUND(AVG(h - l), 6) AS avg_range, ROUND(AVG(v), 6) AS avg_volume FROM y GROUP BY ALL",
    "candle_patterns": _WITH + _PATTERN + " SELECT * FROM y WHERE patterns <> ''",
    "volume_profile": _WITH + ", n AS (SELECT *, COUNT(*) OVER (PARTITION BY symbol) AS n FROM b), z AS (SELECT * FROM n WHERE i >= n - 200), e AS (SELECT symbol, MIN(l) AS lo, MAX(h) AS hi FROM z GROUP BY symbol HAVING MAX(h) > MIN(l)), s AS (SELECT z.symbol, GREATEST(0, LEAST(23, CAST(FLOOR((tp - lo) / ((hi - lo) / 24)) AS INTEGER))) AS bucket, SUM(v) AS volume, SUM(CASE WHEN c >= o THEN v ELSE 0.0 END) AS up, SUM(CASE WHEN c < o THEN v ELSE 0.0 END) AS down FROM z JOIN e ON z.symbol = e.symbol GROUP BY ALL) SELECT e.symbol, CAST(g.x AS INTEGER) AS bucket, COALESCE(volume, 0.0) AS volume, COALESCE(up, 0.0) AS up, COALESCE(down, 0.0) AS down FROM e CROSS JOIN range(24) g(x) LEFT JOIN s ON s.symbol = e.symbol AND s.bucket = g.x",
    "anchored_vwap": f"{_WITH}, s AS (SELECT *, t // 24 AS a FROM b) SELECT symbol, i, ROUND(SUM(tp * v) OVER (PARTITION BY symbol, a ORDER BY i ROWS UNBOUNDED PRECEDING) / SUM(v) OVER (PARTITION BY symbol, a ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS vwap_day FROM s",
    "bull_share": _sql(f"ROUND(AVG(CASE WHEN c > o THEN 100.0 ELSE 0.0 END) {_w(30)}, 6) AS bull30 FROM b"),
    "volume_slope": f"{_WITH}, s AS (SELECT symbol, i, AVG(v) {_w(20)} AS m FROM b), u AS (SELECT *, LAG(m, 20) OVER ({_S}) AS p FROM s) SELECT symbol, i, ROUND(CASE WHEN i >= 39 AND p > 0 THEN GREATEST(-1.0, LEAST(1.0, (m - p) / p)) ELSE 0.0 END, 6) AS volume_slope FROM u",
    "return_spread": f"{_WITH}, s AS (SELECT symbol, i, c, LN(c / LAG(c) OVER ({_S})) AS r FROM b) SELECT symbol, i, {_full(f'STDDEV_POP(r) {_w(20)} * c', 21, 'return_std')} FROM s",
    "levels": _WITH + _PIVOT + ", a AS (SELECT *, MAX(i) OVER (PARTITION BY symbol) - i AS age, COALESCE(CAST(price - LAG(price) OVER (PARTITION BY symbol ORDER BY price, i, kind) > 0.5 AS INTEGER), 0) AS apart FROM f), s AS (SELECT *, SUM(apart) OVER (PARTITION BY symbol ORDER BY price, i, kind ROWS UNBOUNDED PRECEDING) AS island FROM a) SELECT symbol, ROUND(MEDIAN(price), 6) AS price, COUNT(*) AS touches, CASE WHEN MIN(kind) <> MAX(kind) THEN 'both' WHEN MIN(kind) = 'high' THEN 'resistance' ELSE 'support' END AS kinds, ROUND(SUM(POW(0.5::DOUBLE, age / 500.0::DOUBLE)), 6) AS strength FROM s GROUP BY symbol, island",
    "premium_discount": _WITH + _PIVOT + ", e AS (SELECT symbol, ARG_MAX(price, i) FILTER (kind = 'high') AS high, ARG_MAX(price, i) FILTER (kind = 'low') AS low FROM f GROUP BY symbol), l AS (SELECT symbol, ARG_MAX(c, i) AS c FROM b GROUP BY symbol), z AS (SELECT e.symbol, high, low, (c - low) / (high - low) AS pct FROM e JOIN l ON e.symbol = l.symbol WHERE high > low) SELECT symbol, high, low, ROUND(pct, 6) AS pct, CASE WHEN pct < 0 OR pct > 1 THEN 'outside' WHEN pct < 0.45 THEN 'discount' WHEN pct <= 0.55 THEN 'equilibrium' ELSE 'premium' END AS zone FROM z",
    "scan": f"{_WITH}, s AS (SELECT symbol, i, c, AVG(c) {_w(20)} AS m, STDDEV_POP(c) {_w(20)} * 2 AS d, {_K} AS k, (c - LAG(c, 10) OVER ({_S})) / LAG(c, 10) OVER ({_S}) * 100.0::DOUBLE AS roc10, AVG(CASE WHEN c > o THEN 100.0 ELSE 0.0 END) {_w(30)} AS bull30 FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1) SELECT symbol, i, c, ROUND(m + d, 6) AS bb_up, ROUND(m, 6) AS bb_mid, ROUND(m - d, 6) AS bb_low, ROUND(k, 6) AS k, ROUND(roc10, 6) AS roc10, ROUND(bull30, 6) AS bull30, CASE WHEN c > m AND roc10 > 0 THEN 'long' WHEN c < m AND roc10 < 0 THEN 'short' ELSE 'neutral' END AS direction FROM s",
}
