"""SQL of recurrences, structure and rolling features, which the queries' SQL is made of."""

from __future__ import annotations

from .queries import _PIVOT, _S, _WITH, SQL as _SERIES, _w


def _smooth(source: str, made: str, **columns: tuple[str, int, int, str]) -> str:
    """A chain of WITH parts: ``made`` is source with each column (x, n, first, gain) as an exponential average."""
    seeds = ", ".join(f"{x} AS x_{k}, AVG({x}) {_w(n)} AS s_{k}" for k, (x, n, _, _) in columns.items())
    start = ", ".join(f"CAST(NULL AS DOUBLE) AS {k}" for k in columns)
    step = ", ".join(f"CASE WHEN s.i > {n - 1 + first} THEN (s.x_{k} - r.{k}) * ({gain}) + r.{k} WHEN s.i = {n - 1 + first} THEN s.s_{k} END" for k, (_, n, first, gain) in columns.items())
    return f""", {made}_s AS MATERIALIZED (SELECT *, {seeds} FROM {source}),
{made}_r(symbol, i, {', '.join(columns)}) AS (SELECT symbol, i, {start} FROM {made}_s WHERE i = 0 UNION ALL SELECT s.symbol, s.i, {step} FROM {made}_r r JOIN {made}_s s ON s.symbol = r.symbol AND s.i = r.i + 1),
{made} AS MATERIALIZED (SELECT s.* EXCLUDE ({', '.join(f'x_{k}, s_{k}' for k in columns)}), {', '.join(f'r.{k}' for k in columns)} FROM {made}_s s JOIN {made}_r r ON s.symbol = r.symbol AND s.i = r.i)"""


_EMA = lambda n: f"2.0::DOUBLE / {n + 1}"
_WILDER = "1.0::DOUBLE / 14"
_REC = _WITH.replace("WITH w", "WITH RECURSIVE w") + f""", d0 AS MATERIALIZED (SELECT *, c - LAG(c) OVER ({_S}) AS dc, h - LAG(h) OVER ({_S}) AS dh, LAG(l) OVER ({_S}) - l AS dl, LAG(c) OVER ({_S}) AS pc FROM b),
d1 AS MATERIALIZED (SELECT *, GREATEST(h - l, ABS(h - pc), ABS(l - pc)) AS tr FROM d0)""" + _smooth(
    "d1",
    "e1",
    ema12=("c", 12, 0, _EMA(12)), ema26=("c", 26, 0, _EMA(26)), ema20=("c", 20, 0, _EMA(20)), ema50=("c", 50, 0, _EMA(50)), ema200=("c", 200, 0, _EMA(200)),
    gain=("GREATEST(dc, 0.0)", 14, 1, _WILDER), loss=("GREATEST(-dc, 0.0)", 14, 1, _WILDER), atr14=("tr", 14, 1, _WILDER),
    plus=("CASE WHEN dh > dl AND dh > 0 THEN dh ELSE 0.0 END", 14, 1, _WILDER), minus=("CASE WHEN dl > dh AND dl > 0 THEN dl ELSE 0.0 END", 14, 1, _WILDER),
) + """, f1 AS MATERIALIZED (SELECT *, ema12 - ema26 AS macd, 100.0 * plus / atr14 AS plus_di, 100.0 * minus / atr14 AS minus_di, CASE WHEN loss = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + gain / loss) END AS rsi14 FROM e1)""" + _smooth(
    "f1",
    "e2",
    two=("COALESCE(ema20, 0.0)", 20, 0, _EMA(20)), sig=("COALESCE(macd, 0.0)", 9, 0, _EMA(9)),
    adx14=("CASE WHEN plus_di + minus_di > 0 THEN 100.0 * ABS(plus_di - minus_di) / (plus_di + minus_di) ELSE 0.0 END", 14, 14, _WILDER),
) + _smooth("e2", "e3", three=("COALESCE(two, 0.0)", 20, 0, _EMA(20))) + ", rec AS MATERIALIZED (SELECT *, CASE WHEN i >= 33 THEN sig END AS macd_signal, CASE WHEN i >= 33 THEN macd - sig END AS macd_hist FROM e3)"


def _of(names: str, table: str = "rec") -> str:
    return f" SELECT symbol, i, {', '.join(f'ROUND({n}, 6) AS {n}' for n in names.split())} FROM {table}"


_MARKED = _PIVOT + ", k AS MATERIALIZED (SELECT *, CASE WHEN inside AND h > hb AND h >= ha THEN h END AS ph, CASE WHEN inside AND l < lb AND l <= la THEN l END AS pl FROM m)"
_TREND = """, t4 AS (SELECT * FROM (SELECT *, CASE WHEN kind = 'high' THEN CASE WHEN p IS NULL THEN 'H' WHEN price > p THEN 'HH' ELSE 'LH' END ELSE CASE WHEN p IS NULL THEN 'L' WHEN price > p THEN 'HL' ELSE 'LL' END END AS label, row_number() OVER (PARTITION BY symbol ORDER BY i DESC, kind DESC) AS n FROM q) WHERE n <= 4),
tr2 AS (SELECT symbol, ARG_MAX(label, i) FILTER (kind = 'high') AS hi, ARG_MAX(label, i) FILTER (kind = 'low') AS lo FROM t4 GROUP BY symbol),
swings AS (SELECT symbol, CASE WHEN hi IS NULL OR lo IS NULL THEN 'unknown' WHEN hi = 'HH' AND lo = 'HL' THEN 'up' WHEN hi = 'LH' AND lo = 'LL' THEN 'down' ELSE 'range' END AS trend FROM tr2)"""
_BREAKS = """, w1(symbol, i, hi, lo, side, ev, level) AS (SELECT symbol, -1, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0, 0, CAST(NULL AS DOUBLE) FROM k WHERE i = 0 UNION ALL
SELECT symbol, i, CASE WHEN ev = 1 THEN NULL ELSE nh END, CASE WHEN ev = -1 THEN NULL ELSE nl END, CASE WHEN ev = 0 THEN was ELSE ev END, CASE WHEN ev = 0 THEN 0 WHEN was = -ev THEN 2 * ev ELSE ev END, CASE ev WHEN 1 THEN nh WHEN -1 THEN nl END
FROM (SELECT *, CASE WHEN c > nh THEN 1 WHEN c < nl THEN -1 ELSE 0 END AS ev FROM (SELECT k.symbol, k.i, k.c, w1.side AS was, COALESCE(k.ph, w1.hi) AS nh, COALESCE(k.pl, w1.lo) AS nl FROM w1 JOIN k ON k.symbol = w1.symbol AND k.i = w1.i + 1))),
brk AS MATERIALIZED (SELECT symbol, i, CASE WHEN ABS(ev) = 2 THEN 'CHoCH' ELSE 'BoS' END AS type, CASE WHEN ev > 0 THEN 'up' ELSE 'down' END AS dir, level FROM w1 WHERE ev <> 0)"""
_BLOCKS = f""", o1 AS (SELECT k.*, r.atr14, MAX(k.h) OVER n3 AS ta, MIN(k.l) OVER n3 AS lw, COUNT(*) OVER n3 AS na, LAST_VALUE(ph IGNORE NULLS) OVER pr AS hp, LAST_VALUE(pl IGNORE NULLS) OVER pr AS lp FROM k JOIN rec r ON r.symbol = k.symbol AND r.i = k.i
WINDOW n3 AS (PARTITION BY k.symbol ORDER BY k.i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), pr AS (PARTITION BY k.symbol ORDER BY k.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o2 AS (SELECT symbol, i, CASE WHEN c < o AND ta - l >= 1.5 * atr14 AND ta > hp THEN 'bull' WHEN c > o AND h - lw >= 1.5 * atr14 AND lw < lp THEN 'bear' END AS dir, l AS bottom, h AS top FROM o1 WHERE i >= 1 AND na = 3 AND atr14 > 0),
obs AS MATERIALIZED (SELECT o2.symbol, o2.i, dir, bottom, top, MIN(b.i) AS mitigated_at FROM o2 LEFT JOIN b ON b.symbol = o2.symbol AND b.i > o2.i AND b.l <= top AND b.h >= bottom WHERE dir IS NOT NULL GROUP BY ALL)"""
_POOLS = """, l0 AS MATERIALIZED (SELECT f.symbol, kind, f.i, price, tolerance, row_number() OVER (PARTITION BY f.symbol, kind ORDER BY price, f.i) AS n FROM f JOIN tol ON tol.symbol = f.symbol WHERE tolerance > 0),
l1(symbol, kind, n, g, total, size, newest) AS (SELECT symbol, kind, n, 1, price, 1, i FROM l0 WHERE n = 1 UNION ALL SELECT symbol, kind, n, g + fresh, CASE WHEN fresh = 1 THEN price ELSE total + price END, CASE WHEN fresh = 1 THEN 1 ELSE size + 1 END, CASE WHEN fresh = 1 THEN i ELSE GREATEST(newest, i) END
FROM (SELECT l0.symbol, l0.kind, l0.n, l0.i, l0.price, g, total, size, newest, CASE WHEN ABS(price - total / size) <= tolerance THEN 0 ELSE 1 END AS fresh FROM l1 JOIN l0 ON l0.symbol = l1.symbol AND l0.kind = l1.kind AND l0.n = l1.n + 1)),
eq AS MATERIALIZED (SELECT symbol, kind, ARG_MAX(total / size, n) AS price, CAST(MAX(size) AS INTEGER) AS touches, ARG_MAX(newest, n) AS last_i FROM l1 GROUP BY symbol, kind, g HAVING MAX(size) >= 2),
swp AS MATERIALIZED (SELECT eq.*, MIN(b.i) AS swept_at FROM eq LEFT JOIN b ON b.symbol = eq.symbol AND b.i > last_i AND CASE WHEN kind = 'high' THEN b.h > price AND b.c < price ELSE b.l < price AND b.c > price END GROUP BY ALL)"""
_TOL = ", tol AS (SELECT symbol, ARG_MAX(c, i) * 0.25::DOUBLE / 100.0::DOUBLE AS tolerance FROM b GROUP BY symbol)"
_RECURSIVE = _WITH.replace("WITH w", "WITH RECURSIVE w")
_PROFILE = _SERIES["volume_profile"].replace("WITH w", "WITH RECURSIVE w").replace(" SELECT e.symbol, CAST(g.x", ", vp AS MATERIALIZED (SELECT e.symbol, CAST(g.x") + ")"
_SESSION = "CASE WHEN t % 24 >= 22 OR t % 24 < 2 THEN 'asia' WHEN t % 24 BETWEEN 7 AND 9 THEN 'london' WHEN t % 24 BETWEEN 12 AND 14 THEN 'ny-am' WHEN t % 24 = 15 THEN 'ny-pm' ELSE 'off-hours' END"


_FLOW = f""", g1 AS (SELECT *, COALESCE(SIGN(c - pc) * v, 0) AS ob, CASE WHEN h = l THEN 0.0 ELSE ((c - l) - (h - c)) / (h - l) END * v AS fl, AVG(c) {_w(20)} AS am, STDDEV_POP(c) {_w(20)} AS sd, AVG(v) {_w(20)} AS v20 FROM rec),
g2 AS (SELECT *, SUM(ob) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS obv, CASE WHEN i >= 19 THEN SUM(fl) {_w(20)} / SUM(v) {_w(20)} END AS cmf20, CASE WHEN i >= 19 THEN am END AS bb_mid, CASE WHEN i >= 19 THEN am + 2 * sd END AS bb_up, CASE WHEN i >= 19 THEN am - 2 * sd END AS bb_low,
(c - LAG(c, 10) OVER ({_S})) / LAG(c, 10) OVER ({_S}) * 100.0::DOUBLE AS roc10, AVG(CASE WHEN c > o THEN 100.0 ELSE 0.0 END) {_w(30)} AS bull30, AVG(v) OVER ({_S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v20_before, LAG(v20, 20) OVER ({_S}) AS vb, {_SESSION} AS session FROM g1),
g3 AS (SELECT *, CASE WHEN i >= 39 AND vb > 0 THEN GREATEST(-1.0, LEAST(1.0, (v20 - vb) / vb)) ELSE 0.0 END AS volume_slope, LAG(obv, 20) OVER ({_S}) AS obv20, macd_hist AS hist0, LAG(macd_hist) OVER ({_S}) AS hist1, LAG(macd_hist, 2) OVER ({_S}) AS hist2, (bb_up - bb_low) / bb_mid AS bw FROM g2),
feats AS MATERIALIZED (SELECT * EXCLUDE (bw), CASE WHEN COUNT(bw) {_w(50)} = 50 THEN AVG(bw) {_w(50)} END AS width50 FROM g3),
here AS MATERIALIZED (SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1),
tol AS (SELECT symbol, COALESCE(atr14 * 0.25::DOUBLE, c * 0.0025::DOUBLE) AS tolerance FROM here)"""
