"""Queries of what follows the bars: labels, splits, verdicts, mistakes, drift, lines, macro and backtest, each with
the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decisions import _REC, _rounded
from .functions import indicators as I
from .operators import labels, macro, structure, trendlines, validation
from .plans import backtest
from .queries import _PIVOT, _S, _WITH, _bars, _w
from .sources import candles
from .sources.candles import series

_HORIZON, _EMBARGO, _THRESHOLD = 12, 5, 2.0
#: Events within the span of the bars, besides the fixed ones.
_EVENTS = [("claims-2024-01-11", "2024-01-11 13:35", "low", 5), ("cpi-2024-01-11", "2024-01-11 13:30", "high", 5), ("retail-2024-01-17", "2024-01-17 13:30", "medium", 5), ("rates-2024-01-24", "2024-01-24 18:00", "high", 30)]


def _labels(bars: DataFrame) -> DataFrame:
    return labels.triple_barrier(I.return_spread(bars).withColumnRenamed("return_std", "sigma"), _HORIZON)


def _primary(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "i", (F.col("c") - F.lag("c").over(series())).alias("primary"))


def _verdicts(bars: DataFrame) -> DataFrame:
    return validation.validate(validation.sample_predictions(bars), bars)


def _mistakes(bars: DataFrame) -> DataFrame:
    return validation.mistakes(_verdicts(bars).join(I.recurrences(bars).select("symbol", "i", "atr14"), ["symbol", "i"]))


def _lines(bars: DataFrame, joined: bool) -> DataFrame:
    last = I.recurrences(bars).groupBy("symbol").agg(F.max_by(F.struct("i", "c", "atr14"), "i").alias("x")).select("symbol", "x.*")
    ends = last.select("symbol", "i", "c", F.coalesce("atr14", 0.005 * F.col("c")).alias("atr"))
    found = trendlines.lines(structure.pivots(bars), ends.select("symbol", (F.col("atr") * 0.5).alias("tolerance")))
    return trendlines.channels(found, ends) if joined else found


def _proxied(bars: DataFrame) -> DataFrame:
    """Bars whose symbols, in order of name, stand for the macro proxies."""
    names = bars.select("symbol").distinct().orderBy("symbol").limit(len(macro.PROXIES)).agg(F.sort_array(F.collect_list("symbol")).alias("names"))
    proxies = F.array(*(F.lit(p[0]) for p in macro.PROXIES))
    placed = bars.crossJoin(F.broadcast(names)).withColumn("symbol", F.get(proxies, (F.array_position("names", F.col("symbol")) - 1).cast("int")))
    return placed.where("symbol IS NOT NULL").drop("names")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.tagged(candles.load(spark, sf_dir), macro.calendar(spark, macro.EVENTS + _EVENTS))


def _query(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return _bars(lambda b: _rounded(f(b)))


_VERDICT = ("symbol", "i", "kind", "missing", "ok", "realized_dir", "realized", "hit", "abstain", "brier", "residual", "abs_error", "z_score", "covered", "width", "centre_residual", "set_size")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "triple_barrier": _query(_labels),
    "meta_labels": _query(lambda b: labels.meta_labels(_labels(b), _primary(b))),
    "uniqueness": _query(lambda b: labels.uniqueness(_labels(b))),
    "label_distribution": _query(lambda b: labels.distribution(_labels(b))),
    "walk_forward_split": _query(lambda b: labels.walk_forward(b, embargo=_EMBARGO)),
    "purged_folds": _query(lambda b: labels.purged_folds(_labels(b), embargo=_EMBARGO)),
    "vector_statistics": lambda spark, sf_dir: _rounded(labels.vector_statistics(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))),
    "verdicts": _query(lambda b: _verdicts(b).select(*_VERDICT)),
    "verdict_summary": _query(lambda b: validation.summarize(_verdicts(b), "symbol")),
    "mistakes": _query(lambda b: _mistakes(b).select("symbol", "i", "error_type", "error_mag")),
    "mistake_summary": _query(lambda b: validation.mistake_summary(_mistakes(b))),
    "drift": _query(lambda b: validation.drift(_verdicts(b), threshold=_THRESHOLD)),
    "trendlines": _query(lambda b: _lines(b, False)),
    "channels": _query(lambda b: _lines(b, True)),
    "macro_state": _query(lambda b: macro.macro_state(_proxied(b))),
    "event_tags": _tagged,
    "backtest_trades": _query(lambda b: backtest.trades(backtest.directed(b))),
    "backtest": _query(lambda b: backtest.measures(backtest.trades(backtest.directed(b)))),
}


def _of(*names: str) -> str:
    return ", ".join(f"ROUND({n}, 6) AS {n}" for n in names)


_TB = f""", s0 AS (SELECT *, LN(c / LAG(c) OVER ({_S})) AS r, LAG(c) OVER ({_S}) AS pc FROM b),
s1 AS (SELECT *, CASE WHEN i >= 20 THEN STDDEV_POP(r) {_w(20)} * c END AS sigma, MAX(i) OVER (PARTITION BY symbol) AS mi FROM s0),
s2 AS MATERIALIZED (SELECT *, c + sigma AS upper, c - sigma AS lower, LEAST(mi, i + {_HORIZON}) AS e FROM s1),
s3 AS (SELECT a.symbol, a.i, MIN(x.i) AS j FROM s2 a JOIN s2 x ON x.symbol = a.symbol AND x.i > a.i AND x.i <= a.e AND (x.h >= a.upper OR x.l <= a.lower) WHERE a.sigma > 0 GROUP BY ALL),
s4 AS (SELECT a.*, s3.j, x.h >= a.upper AS over, x.l <= a.lower AS under, ABS(x.pc - a.upper) <= ABS(x.pc - a.lower) AS nearer, z.c AS zc FROM s2 a LEFT JOIN s3 ON s3.symbol = a.symbol AND s3.i = a.i LEFT JOIN s2 x ON x.symbol = a.symbol AND x.i = s3.j LEFT JOIN s2 z ON z.symbol = a.symbol AND z.i = a.e),
s5 AS (SELECT *, CASE WHEN sigma IS NULL OR sigma <= 0 THEN 'nan' WHEN j IS NULL THEN 'time' WHEN over AND (NOT under OR nearer) THEN 'upper' ELSE 'lower' END AS touched FROM s4),
tb AS MATERIALIZED (SELECT symbol, i, pc, c, CASE WHEN touched <> 'nan' THEN COALESCE(j, e) END AS t1, CASE touched WHEN 'upper' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END AS side, touched, CASE touched WHEN 'upper' THEN (upper - c) / c WHEN 'lower' THEN (lower - c) / c WHEN 'time' THEN (zc - c) / c ELSE 0.0 END AS ret FROM s5)"""
_VD = """, pr AS (SELECT symbol, i, t, c AS ref, ['direction', 'return', 'interval', 'set'][i % 4 + 1] AS kind, CASE WHEN c > o THEN 'up' WHEN c < o THEN 'down' ELSE 'flat' END AS dir, 0.5::DOUBLE + (i % 40) / 100.0::DOUBLE AS prob, (i % 7 - 3) / 1000.0::DOUBLE AS yhat, CASE WHEN i % 5 <> 0 THEN 0.01::DOUBLE END AS sg, -0.001::DOUBLE AS lo, 0.001::DOUBLE * (1 + i % 3) AS hi, i % 3 AS m FROM b),
vj AS (SELECT pr.*, x.i IS NOT NULL AS ok, CASE WHEN ABS(x.c - x.o) <= ABS(x.o) * 0.0005::DOUBLE THEN 'flat' WHEN x.c > x.o THEN 'up' ELSE 'down' END AS rd, (x.c - ref) / ref AS re FROM pr LEFT JOIN b x ON x.symbol = pr.symbol AND x.t = pr.t + 1),
vd AS MATERIALIZED (SELECT symbol, i, t, ref, kind, NOT ok AS missing, ok, CASE WHEN ok AND kind IN ('direction', 'set') THEN rd END AS realized_dir, CASE WHEN ok AND kind IN ('return', 'interval') THEN re END AS realized,
CASE WHEN ok AND kind = 'direction' THEN dir <> 'flat' AND dir = rd END AS hit, CASE WHEN ok AND kind = 'direction' THEN dir = 'flat' WHEN ok AND kind = 'set' THEN m = 2 END AS abstain, CASE WHEN ok AND kind = 'direction' THEN POW(prob - CASE WHEN dir <> 'flat' AND dir = rd THEN 1 ELSE 0 END, 2) END AS brier,
CASE WHEN ok AND kind = 'return' THEN re - yhat END AS residual, CASE WHEN ok AND kind = 'return' THEN ABS(re - yhat) END AS abs_error, CASE WHEN ok AND kind = 'return' THEN (re - yhat) / sg END AS z_score, CASE WHEN ok AND kind = 'interval' THEN re >= lo AND re <= hi WHEN ok AND kind = 'set' THEN (rd = 'up' AND m < 2) OR (rd = 'down' AND m = 1) END AS covered,
CASE WHEN ok AND kind = 'interval' THEN hi - lo END AS width, CASE WHEN ok AND kind = 'interval' THEN re - (lo + hi) / 2 END AS centre_residual, CASE WHEN ok AND kind = 'set' THEN [1, 2, 0][m + 1] END AS set_size FROM vj)"""
_MS = """, w0 AS (SELECT vd.*, atr14 FROM vd JOIN rec ON rec.symbol = vd.symbol AND rec.i = vd.i WHERE ok AND NOT COALESCE(abstain, false)),
w1 AS (SELECT *, CASE WHEN kind = 'direction' AND NOT hit THEN 'direction' WHEN kind = 'interval' AND NOT covered THEN 'interval-miss' WHEN kind = 'return' AND abs_error > atr14 AND atr14 > 0 THEN 'magnitude' WHEN kind = 'set' AND NOT covered THEN 'set-miss' END AS error_type FROM w0),
ms AS (SELECT symbol, i, t, error_type, CASE error_type WHEN 'interval-miss' THEN ABS(centre_residual) WHEN 'magnitude' THEN abs_error / atr14 ELSE 1.0 END AS error_mag FROM w1 WHERE error_type IS NOT NULL)"""
_LINES = """, ends AS MATERIALIZED (SELECT symbol, i, c, COALESCE(atr14, 0.005::DOUBLE * c) AS atr FROM rec QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1),
t0 AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol, kind ORDER BY i DESC) <= 8), t1 AS (SELECT symbol, kind, COUNT(*) AS n, REGR_SLOPE(price, i) AS slope, REGR_INTERCEPT(price, i) AS intercept, REGR_SYY(price, i) AS syy FROM t0 GROUP BY ALL HAVING COUNT(*) >= 3),
t2 AS (SELECT t1.symbol, t1.kind, n, slope, intercept, syy, SUM(POW(price - slope * t0.i - intercept, 2)) AS sse, COUNT(*) FILTER (ABS(price - slope * t0.i - intercept) <= 0.5::DOUBLE * atr) AS touches FROM t1 JOIN t0 ON t0.symbol = t1.symbol AND t0.kind = t1.kind JOIN ends ON ends.symbol = t1.symbol GROUP BY ALL),
t3 AS (SELECT *, CASE WHEN syy > 0 THEN GREATEST(0.0, LEAST(1.0, 1 - sse / syy)) ELSE 0.0 END AS r2 FROM t2), ln AS MATERIALIZED (SELECT symbol, kind, slope, intercept, r2, touches, r2 * LEAST(1.0, touches / 4.0::DOUBLE) AS score, SQRT(sse / GREATEST(1, n - 2)) AS sigma FROM t3)"""
_BT = f""", s0 AS (SELECT *, AVG(c) {_w(20)} AS mid, (c - LAG(c, 10) OVER ({_S})) / LAG(c, 10) OVER ({_S}) AS roc, (LEAD(c) OVER ({_S}) - c) / c AS ret FROM b),
s1 AS (SELECT symbol, i, ret, CASE WHEN c > mid AND roc > 0 THEN 'long' WHEN c < mid AND roc < 0 THEN 'short' ELSE 'neutral' END AS direction, CASE WHEN ret > 0.0005::DOUBLE THEN 'up' WHEN ret < -0.0005::DOUBLE THEN 'down' ELSE 'flat' END AS realized FROM s0 WHERE i >= 200 AND ret IS NOT NULL),
bt AS MATERIALIZED (SELECT *, (direction = 'long' AND realized = 'up') OR (direction = 'short' AND realized = 'down') AS hit, CASE WHEN realized = 'flat' OR direction = 'neutral' THEN 0.0 WHEN direction = 'long' THEN ret ELSE -ret END AS pnl FROM s1)"""
_PROXY_ROWS = ", ".join(f"({k}, {w}::DOUBLE, {s})" for k, (_, w, s) in enumerate(macro.PROXIES, 1))
_EVENT_ROWS = ", ".join(f"('{e}', TIMESTAMP '{at}:00', {dict(high=3, medium=2).get(x, 1)}, {m})" for e, at, x, m in macro.EVENTS + _EVENTS)

SQL: dict[str, str] = {
    "triple_barrier": f"{_WITH}{_TB} SELECT symbol, i, t1, side, touched, ROUND(ret, 6) AS ret FROM tb",
    "meta_labels": f"{_WITH}{_TB} SELECT symbol, i, CASE WHEN side <> 0 AND SIGN(c - pc) = side THEN 1 ELSE 0 END AS label FROM tb",
    "uniqueness": f"{_WITH}{_TB}, n AS MATERIALIZED (SELECT b.symbol, b.i, COUNT(*) AS spans FROM b JOIN tb ON tb.symbol = b.symbol AND b.i BETWEEN tb.i AND tb.t1 GROUP BY ALL) SELECT tb.symbol, tb.i, ROUND(COALESCE(AVG(1.0::DOUBLE / spans), 0.0), 6) AS weight FROM tb LEFT JOIN n ON n.symbol = tb.symbol AND n.i BETWEEN tb.i AND tb.t1 GROUP BY ALL",
    "label_distribution": f"{_WITH}{_TB}, n AS (SELECT symbol, COUNT(*) AS total, COUNT(*) FILTER (side > 0) AS pos, COUNT(*) FILTER (side < 0) AS neg, COUNT(*) FILTER (side = 0) AS zero FROM tb GROUP BY symbol) SELECT *, ROUND(pos / total, 6) AS pos_pct, ROUND(neg / total, 6) AS neg_pct, ROUND(zero / total, 6) AS zero_pct, ROUND(ABS(pos - neg) / GREATEST(1, pos + neg), 6) AS imbalance FROM n",
    "walk_forward_split": f"{_WITH}, n AS (SELECT symbol, i, FLOOR(COUNT(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE) AS x, FLOOR(COUNT(*) OVER (PARTITION BY symbol) * (0.7::DOUBLE + 0.15::DOUBLE)) AS y FROM b), m AS (SELECT symbol, i, CASE WHEN i < x - {_EMBARGO} THEN 'train' WHEN i >= x AND i < y - {_EMBARGO} THEN 'val' WHEN i >= y THEN 'test' END AS part FROM n) SELECT * FROM m WHERE part IS NOT NULL",
    "purged_folds": f"{_WITH}{_TB}, r AS MATERIALIZED (SELECT symbol, i, COALESCE(t1, i) AS e, COUNT(*) OVER (PARTITION BY symbol) AS n FROM tb), x AS (SELECT DISTINCT symbol, n, CAST(k.k AS INTEGER) AS fold, k.k * (n // 5) AS lo, CASE WHEN k.k = 4 THEN n ELSE (k.k + 1) * (n // 5) END AS hi FROM r, range(5) k(k)), y AS (SELECT x.*, LEAST(n - 1, (SELECT MAX(e) FROM r WHERE r.symbol = x.symbol AND r.i >= lo AND r.i < hi) + {_EMBARGO}) AS until FROM x), z AS (SELECT y.symbol, fold, r.i, CASE WHEN r.i >= lo AND r.i < hi THEN 'test' WHEN (e < lo OR r.i >= hi) AND NOT (r.i >= hi AND r.i <= until) THEN 'train' END AS part FROM y JOIN r ON r.symbol = y.symbol) SELECT * FROM z WHERE part IS NOT NULL",
    "vector_statistics": "WITH v AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings) SELECT dim, ROUND(AVG(x), 6) AS mean, ROUND(CASE WHEN STDDEV_SAMP(x) >= 1e-12 THEN STDDEV_SAMP(x) ELSE 1.0 END, 6) AS std, ROUND(MIN(x), 6) AS low, ROUND(CASE WHEN MAX(x) = MIN(x) THEN MIN(x) + 1 ELSE MAX(x) END, 6) AS high FROM v GROUP BY dim",
    "verdicts": f"{_WITH}{_VD} SELECT symbol, i, kind, missing, ok, realized_dir, hit, abstain, covered, set_size, {_of('realized', 'brier', 'residual', 'abs_error', 'z_score', 'width', 'centre_residual')} FROM vd",
    "verdict_summary": f"{_WITH}{_VD} SELECT symbol, COUNT(*) AS n, COUNT(*) FILTER (ok AND kind = 'direction') AS dir_n, COUNT(*) FILTER (hit) AS hits, ROUND(AVG(CAST(hit AS INTEGER)) FILTER (NOT abstain), 6) AS accuracy, COUNT(*) FILTER (kind = 'direction' AND abstain) AS dir_abstain, COUNT(residual) AS ret_n, ROUND(AVG(abs_error), 6) AS mae, ROUND(SQRT(AVG(residual * residual)), 6) AS rmse, ROUND(AVG(residual), 6) AS mean_residual, COUNT(width) AS int_n, ROUND(AVG(CAST(covered AS INTEGER)) FILTER (kind = 'interval'), 6) AS int_coverage, ROUND(AVG(width), 6) AS mean_width, COUNT(set_size) AS set_n, ROUND(AVG(CAST(covered AS INTEGER)) FILTER (kind = 'set'), 6) AS set_coverage, ROUND(AVG(set_size), 6) AS mean_size, COUNT(*) FILTER (kind = 'set' AND abstain) AS set_abstain, ROUND(AVG(brier), 6) AS brier FROM vd GROUP BY symbol",
    "mistakes": f"{_REC}{_VD}{_MS} SELECT symbol, i, error_type, ROUND(error_mag, 6) AS error_mag FROM ms",
    "mistake_summary": f"{_REC}{_VD}{_MS} SELECT error_type, symbol, COUNT(*) AS n, MAX(t) AS last_t FROM ms GROUP BY GROUPING SETS ((error_type), (symbol), ())",
    "drift": f"{_WITH}{_VD}, x0 AS (SELECT symbol, i, CAST(hit AS DOUBLE) AS x FROM vd WHERE kind = 'direction' AND ok AND NOT abstain), x1 AS (SELECT *, (1 - x) - AVG(1 - x) OVER u - 0.005::DOUBLE AS step, AVG(x) OVER (PARTITION BY symbol ORDER BY i ROWS 99 PRECEDING) AS accuracy, LIST(x) OVER u AS xs FROM x0 WINDOW u AS (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)), x2 AS (SELECT *, SUM(step) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS moved FROM x1), x3 AS (SELECT *, moved - LEAST(0.0, MIN(moved) OVER ({_S} ROWS UNBOUNDED PRECEDING)) AS ph FROM x2) SELECT symbol, i, ROUND(accuracy, 6) AS accuracy, ROUND(ph, 6) AS page_hinkley, MAX(ph > {_THRESHOLD}) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS drifted, ROUND(list_reduce(xs, lambda a, v: 0.1::DOUBLE * v + 0.9::DOUBLE * a), 6) AS ewma FROM x3",
    "trendlines": f"{_REC}{_PIVOT}{_LINES} SELECT symbol, kind, touches, {_of('slope', 'intercept', 'r2', 'score', 'sigma')} FROM ln",
    "channels": f"{_REC}{_PIVOT}{_LINES}, ch AS (SELECT e.symbol, atr, (u.sigma + d.sigma) / 2 / atr AS w, u.slope AS us, d.slope AS ds, c - (u.slope * e.i + u.intercept) AS over, (d.slope * e.i + d.intercept) - c AS under FROM ends e LEFT JOIN ln u ON u.symbol = e.symbol AND u.kind = 'high' LEFT JOIN ln d ON d.symbol = e.symbol AND d.kind = 'low') SELECT symbol, ROUND(COALESCE(w, 0.0), 6) AS width_atr, COALESCE((ABS(us) < 1e-12 AND ABS(ds) < 1e-12) OR (us * ds > 0 AND LEAST(ABS(us), ABS(ds)) >= 0.75::DOUBLE * GREATEST(ABS(us), ABS(ds))), false) AS parallel, CASE WHEN over >= 0.5 * atr THEN 'up' WHEN under >= 0.5 * atr THEN 'down' END AS breakout, ROUND(CASE WHEN over >= 0.5 * atr THEN over / atr WHEN under >= 0.5 * atr THEN under / atr END, 6) AS distance_atr FROM ch",
    "macro_state": f"{_WITH}, n AS (SELECT *, dense_rank() OVER (ORDER BY symbol) AS k, COUNT(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS x FROM b), s AS (SELECT k, ARG_MAX(c, i) AS z, AVG(c) AS m FROM n WHERE x <= 20 AND n >= 3 GROUP BY k), pm AS (SELECT SUM(TANH((z - m) / m * 8) * sign * weight) / SUM(weight) AS score, SUM(weight) AS coverage FROM s JOIN (VALUES {_PROXY_ROWS}) q(k, weight, sign) ON q.k = s.k) SELECT ROUND(COALESCE(score, 0.0), 6) AS score, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.15 THEN 'risk-on' WHEN score <= -0.15 THEN 'risk-off' ELSE 'mixed' END AS label, ROUND(COALESCE(coverage, 0.0), 6) AS coverage FROM pm",
    "event_tags": f"{_WITH}, e AS (SELECT *, date_diff('minute', TIMESTAMP '1970-01-01', stamp) AS a FROM (VALUES {_EVENT_ROWS}) x(event, stamp, weight, minutes)), h AS (SELECT b.symbol, b.i, ARG_MIN({{'e': event, 'w': weight, 'p': CASE WHEN b.t * 60 >= a + minutes THEN 'post' WHEN b.t * 60 >= a THEN 'during' ELSE 'pre' END}}, (a, event)) AS x FROM b JOIN e ON b.t * 60 BETWEEN a - 5 AND a + minutes + 30 GROUP BY ALL) SELECT b.symbol, b.i, x.e AS event, COALESCE(x.w, 0) AS weight, x.p AS phase FROM b LEFT JOIN h ON h.symbol = b.symbol AND h.i = b.i",
    "backtest_trades": f"{_WITH}{_BT} SELECT symbol, i, direction, realized, hit, ROUND(ret, 6) AS ret, ROUND(pnl, 6) AS pnl FROM bt",
    "backtest": f"{_WITH}{_BT}, e AS (SELECT *, EXP(SUM(LN(1 + pnl)) OVER ({_S} ROWS UNBOUNDED PRECEDING)) AS equity, CASE direction WHEN 'long' THEN ret WHEN 'short' THEN -ret END AS own FROM bt), k AS (SELECT *, GREATEST(1.0, MAX(equity) OVER ({_S} ROWS UNBOUNDED PRECEDING)) AS peak FROM e) SELECT symbol, COUNT(*) AS trades, COUNT(*) FILTER (direction <> 'neutral' AND hit) AS hits, COUNT(*) FILTER (direction <> 'neutral' AND NOT hit) AS misses, COUNT(*) FILTER (direction = 'neutral') AS abstain, ROUND(ARG_MAX(equity, i) - 1, 6) AS final_return, ROUND(MAX((peak - equity) / peak), 6) AS max_drawdown, ROUND(CASE WHEN STDDEV_POP(own) > 0 THEN AVG(own) / STDDEV_POP(own) * SQRT(252) ELSE 0.0 END, 6) AS sharpe FROM k GROUP BY symbol",
}
