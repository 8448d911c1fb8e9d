"""SQL of the chart patterns. Each side is written out by itself."""

from __future__ import annotations

_GRADE = "CASE WHEN score >= 0.75 THEN 0.85::DOUBLE WHEN score >= 0.45 THEN 0.6::DOUBLE WHEN score >= 0.2 THEN 0.35::DOUBLE END"
_HS = f""", hp AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i DESC, kind DESC) AS back FROM f),
h5 AS (SELECT symbol, kind k1, price p1, LEAD(kind) OVER w k2, LEAD(i) OVER w i2, LEAD(price) OVER w p2, LEAD(kind, 2) OVER w k3, LEAD(i, 2) OVER w i3, LEAD(price, 2) OVER w p3,
LEAD(kind, 3) OVER w k4, LEAD(i, 3) OVER w i4, LEAD(price, 3) OVER w p4, LEAD(kind, 4) OVER w k5, LEAD(i, 4) OVER w i5, LEAD(price, 4) OVER w p5 FROM hp WHERE back <= 12 WINDOW w AS (PARTITION BY symbol ORDER BY i, kind)),
h6 AS (SELECT *, (p4 - p2) / GREATEST(1, i4 - i2) AS m FROM h5 JOIN le USING (symbol) WHERE k1 = k3 AND k3 = k5 AND k2 = k4 AND k1 <> k2 AND ABS(p1 - p5) <= GREATEST(ABS(p1), ABS(p5)) * 0.04::DOUBLE),
h7 AS (SELECT *, p2 + m * (n - i2) AS nl FROM h6),
hs AS (SELECT symbol, 'Head & Shoulders' AS name, 'bearish' AS bias, nl - (p3 - (p2 + m * (i3 - i2))) AS target, p3 AS invalidation, i5 AS at_bar, n, z < nl - atr * 0.1::DOUBLE AS broken, nl AS neckline, 0 AS detector,
0.4::DOUBLE + (1 - ABS(p1 - p5) / GREATEST(p1, p5)) * 0.25::DOUBLE + CASE WHEN z < nl - atr * 0.1::DOUBLE THEN 0.25::DOUBLE ELSE 0 END + LEAST(0.1::DOUBLE, (p3 - GREATEST(p1, p5)) / atr * 0.05::DOUBLE) AS score FROM h7 WHERE k1 = 'high' AND p3 > p1 + atr * 0.3::DOUBLE AND p3 > p5 + atr * 0.3::DOUBLE
UNION ALL SELECT symbol, 'Inverse Head & Shoulders', 'bullish', nl + ((p2 + m * (i3 - i2)) - p3), p3, i5, n, z > nl + atr * 0.1::DOUBLE, nl, 0,
0.4::DOUBLE + (1 - ABS(p1 - p5) / GREATEST(p1, p5)) * 0.25::DOUBLE + CASE WHEN z > nl + atr * 0.1::DOUBLE THEN 0.25::DOUBLE ELSE 0 END + LEAST(0.1::DOUBLE, (LEAST(p1, p5) - p3) / atr * 0.05::DOUBLE) FROM h7 WHERE k1 = 'low' AND p3 < p1 - atr * 0.3::DOUBLE AND p3 < p5 - atr * 0.3::DOUBLE)"""


def _tops(kind: str, other: str, word: str, bias: str, least: str, less: str, sign: str, detector: int) -> str:
    """Triple and double tops (or bottoms) of one kind of pivots."""
    k = f"{kind}_"
    pair = lambda a, b: f"ABS(p{a} - p{b}) <= GREATEST(ABS(p{a}), ABS(p{b})) * 0.025::DOUBLE AND i{b} - i{a} >= 4"
    return f""", {k}1 AS (SELECT symbol, i, price, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS r FROM f WHERE kind = '{kind}'),
{k}2 AS (SELECT symbol, MAX(i) FILTER (r = 3) i1, MAX(price) FILTER (r = 3) p1, MAX(i) FILTER (r = 2) i2, MAX(price) FILTER (r = 2) p2, MAX(i) FILTER (r = 1) i3, MAX(price) FILTER (r = 1) p3 FROM {k}1 WHERE r <= 3 GROUP BY symbol HAVING MAX(r) >= 2),
{k}3 AS (SELECT symbol, ANY_VALUE(COLUMNS({k}2.* EXCLUDE (symbol))), {least}(f.price) FILTER (f.i > i1 AND f.i < i2) AS t1, {least}(f.price) FILTER (f.i > i2 AND f.i < i3) AS t2 FROM {k}2 JOIN f USING (symbol) WHERE f.kind = '{other}' GROUP BY symbol),
{k}4 AS (SELECT *, COALESCE(i1 IS NOT NULL AND {pair(1, 2)} AND {pair(2, 3)} AND {pair(1, 3)} AND t1 IS NOT NULL AND t2 IS NOT NULL, false) AS triple FROM {k}3 JOIN le USING (symbol)),
{k}5 AS (SELECT *, CASE WHEN triple THEN {'LEAST' if least == 'MIN' else 'GREATEST'}(t1, t2) ELSE t2 END AS nl, CASE WHEN triple THEN (p1 + p2 + p3) / 3 ELSE (p2 + p3) / 2 END AS head FROM {k}4 WHERE triple OR ({pair(2, 3)} AND t2 IS NOT NULL)),
{k}6 AS (SELECT *, z {less} nl {sign} atr * 0.1::DOUBLE AS broken FROM {k}5),
{k}7 AS (SELECT symbol, CASE WHEN triple THEN 'Triple {word}' ELSE 'Double {word}' END AS name, '{bias}' AS bias, nl - (head - nl) AS target, head AS invalidation, i3 AS at_bar, n, broken, nl AS neckline, {detector} AS detector,
CASE WHEN triple THEN 0.5::DOUBLE + (1 - ABS(p1 - p3) / GREATEST(p1, p3)) * 0.3::DOUBLE ELSE 0.45::DOUBLE + (1 - ABS(p2 - p3) / GREATEST(p2, p3)) * 0.3::DOUBLE END + CASE WHEN broken THEN 0.2::DOUBLE ELSE 0 END AS score FROM {k}6)"""


_TRI = """, tt AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY i DESC) AS r FROM f),
ts AS (SELECT symbol, kind, MAX(price) FILTER (r = 2) AS p1, MAX(price) FILTER (r = 1) AS p2, MAX(i) AS e, MIN(i) AS s, REGR_SLOPE(price, i) AS m FROM tt WHERE r <= 4 GROUP BY ALL HAVING COUNT(*) >= 2),
tq AS (SELECT x.symbol, x.p1 AS hp1, x.p2 AS hp2, x.e AS he, x.s AS hs, x.m AS hm, y.p1 AS lp1, y.p2 AS lp2, y.e AS le_, y.s AS ls, y.m AS lm, n, z, atr FROM ts x JOIN ts y ON x.symbol = y.symbol JOIN le ON le.symbol = x.symbol WHERE x.kind = 'high' AND y.kind = 'low'),
tr AS (SELECT symbol, 'Ascending Triangle' AS name, 'bullish' AS bias, (hp1 + hp2) / 2 + GREATEST(0, (hp1 + hp2) / 2 - lp2) AS target, lp2 AS invalidation, he AS at_bar, n, z > (hp1 + hp2) / 2 + atr * 0.1::DOUBLE AS broken, (hp1 + hp2) / 2 AS neckline, 3 AS detector,
0.45::DOUBLE + LEAST(0.25::DOUBLE, lm * (le_ - ls) / atr) + CASE WHEN z > (hp1 + hp2) / 2 + atr * 0.1::DOUBLE THEN 0.2::DOUBLE ELSE 0 END AS score FROM tq WHERE ABS(hp1 - hp2) <= GREATEST(ABS(hp1), ABS(hp2)) * 0.02::DOUBLE AND lm > 0
UNION ALL SELECT symbol, 'Descending Triangle', 'bearish', (lp1 + lp2) / 2 - GREATEST(0, hp2 - (lp1 + lp2) / 2), hp2, le_, n, z < (lp1 + lp2) / 2 - atr * 0.1::DOUBLE, (lp1 + lp2) / 2, 4,
0.45::DOUBLE + LEAST(0.25::DOUBLE, -hm * (he - hs) / atr) + CASE WHEN z < (lp1 + lp2) / 2 - atr * 0.1::DOUBLE THEN 0.2::DOUBLE ELSE 0 END FROM tq WHERE ABS(lp1 - lp2) <= GREATEST(ABS(lp1), ABS(lp2)) * 0.02::DOUBLE AND hm < 0)"""


#: hs, high_7, low_7 and tr, from the pivots f and the ends le (symbol, n, z, atr).
CHARTS = f"{_HS}{_tops('high', 'low', 'Top', 'bearish', 'MIN', '<', '-', 1)}{_tops('low', 'high', 'Bottom', 'bullish', 'MAX', '>', '+', 2)}{_TRI}"
ALL = "(SELECT * FROM hs UNION ALL SELECT * FROM high_7 UNION ALL SELECT * FROM low_7 UNION ALL SELECT * FROM tr)"
