"""SQL of what was known at a bar, and of the modules' votes on it, written for itself: it shares no rule with the
operators that it is held against. Breaks and pools are folds over lists here, one bar or price after the other."""

from __future__ import annotations

import re

from .charts_sql import _GRADE, ALL, CHARTS
from .decisions_sql import _BLOCKS, _FLOW, _MARKED, _REC
from .queries import _PATTERN, _S, _w

_LABELS = """, lab AS (SELECT symbol, i, kind, price, CASE WHEN p IS NULL THEN 'first' WHEN kind = 'high' THEN CASE WHEN price > p THEN 'HH' ELSE 'LH' END
    WHEN price > p THEN 'HL' ELSE 'LL' END AS label FROM q)"""

#: Breaks by walking each moment's bars with the pivots known by then.
_EVENTS = """, br0 AS (
    SELECT an.symbol, an.mt, LIST({'i': k.i, 'c': k.c, 'h': CASE WHEN k.i + 2 <= an.mt THEN k.ph END, 'l': CASE WHEN k.i + 2 <= an.mt THEN k.pl END} ORDER BY k.i) AS bars
    FROM an JOIN k ON k.symbol = an.symbol AND k.i <= an.mt GROUP BY an.symbol, an.mt),
br1 AS (
    SELECT symbol, mt, list_reduce(bars, lambda s, x: CASE
        WHEN x.c > COALESCE(x.h, s.hi) THEN {'hi': CAST(NULL AS DOUBLE), 'lo': COALESCE(x.l, s.lo), 'side': 1,
            'ev': list_append(s.ev, {'i': x.i, 'type': CASE WHEN s.side = -1 THEN 'CHoCH' ELSE 'BoS' END, 'dir': 'up', 'level': COALESCE(x.h, s.hi)})}
        WHEN x.c < COALESCE(x.l, s.lo) THEN {'hi': COALESCE(x.h, s.hi), 'lo': CAST(NULL AS DOUBLE), 'side': -1,
            'ev': list_append(s.ev, {'i': x.i, 'type': CASE WHEN s.side = 1 THEN 'CHoCH' ELSE 'BoS' END, 'dir': 'down', 'level': COALESCE(x.l, s.lo)})}
        ELSE {'hi': COALESCE(x.h, s.hi), 'lo': COALESCE(x.l, s.lo), 'side': s.side, 'ev': s.ev} END,
        {'hi': CAST(NULL AS DOUBLE), 'lo': CAST(NULL AS DOUBLE), 'side': 0, 'ev': CAST([] AS STRUCT(i INTEGER, "type" VARCHAR, dir VARCHAR, "level" DOUBLE)[])}).ev AS ev
    FROM br0),
ev AS MATERIALIZED (SELECT symbol, mt, UNNEST(ev, recursive := true) FROM br1),
lb AS (SELECT ev.symbol, mt, COUNT(*) AS breaks, ARG_MAX({'i': ev.i, 'type': type, 'dir': dir, 'v': f.v, 'mean': f.v20}, ev.i) AS b
    FROM ev JOIN feats f ON f.symbol = ev.symbol AND f.i = ev.i GROUP BY ev.symbol, mt)"""

_SWING = """, sw0 AS (SELECT an.symbol, an.mt, lab.kind, lab.label, lab.i FROM an JOIN lab ON lab.symbol = an.symbol AND lab.i + 2 <= an.mt
    QUALIFY row_number() OVER (PARTITION BY an.symbol, an.mt ORDER BY lab.i DESC, lab.kind DESC) <= 4),
sw1 AS (SELECT symbol, mt, ARG_MAX(label, i) FILTER (kind = 'high') AS h, ARG_MAX(label, i) FILTER (kind = 'low') AS l FROM sw0 GROUP BY ALL),
sw AS (SELECT symbol, mt, CASE WHEN h IS NULL OR l IS NULL THEN 'unknown' WHEN h = 'HH' AND l = 'HL' THEN 'up' WHEN h = 'LH' AND l = 'LL' THEN 'down' ELSE 'range' END AS swing FROM sw1)"""

_KNOWN = """, kn AS MATERIALIZED (SELECT an.symbol, an.mt, an.c, an.a, f.i, f.kind, f.price FROM an JOIN f ON f.symbol = an.symbol AND f.i + 2 <= an.mt)"""

_NEAR = """, lv0 AS (SELECT *, MAX(i) OVER (PARTITION BY symbol, mt) AS newest,
    CASE WHEN price - LAG(price) OVER (PARTITION BY symbol, mt ORDER BY price, i, kind) <= COALESCE(a * 0.5::DOUBLE, c * 0.005::DOUBLE) THEN 0 ELSE 1 END AS apart FROM kn),
lv1 AS (SELECT *, SUM(apart) OVER (PARTITION BY symbol, mt ORDER BY price, i, kind ROWS UNBOUNDED PRECEDING) AS island FROM lv0),
lv2 AS (SELECT symbol, mt, c, MEDIAN(price) AS price, SUM(POW(0.5::DOUBLE, (newest - i) / 500.0::DOUBLE)) AS strength FROM lv1 GROUP BY symbol, mt, c, island),
lv AS MATERIALIZED (SELECT * FROM lv2 QUALIFY row_number() OVER (PARTITION BY symbol, mt ORDER BY strength DESC, price) <= 20),
sr AS (SELECT symbol, mt, MAX(price) FILTER (price <= c) AS sp, ARG_MAX(strength, price) FILTER (price <= c) AS ss,
    MIN(price) FILTER (price >= c) AS rp, ARG_MIN(strength, price) FILTER (price >= c) AS rs FROM lv GROUP BY ALL),
rg0 AS (SELECT symbol, mt, c, ARG_MAX(price, i) FILTER (kind = 'high') AS h, ARG_MAX(price, i) FILTER (kind = 'low') AS l FROM kn GROUP BY ALL),
rg1 AS (SELECT an.symbol, an.mt, an.c, CASE WHEN h IS NULL OR l IS NULL THEN (SELECT MAX(b.h) FROM b WHERE b.symbol = an.symbol AND b.i <= an.mt) ELSE h END AS h,
    CASE WHEN h IS NULL OR l IS NULL THEN (SELECT MIN(b.l) FROM b WHERE b.symbol = an.symbol AND b.i <= an.mt) ELSE l END AS l
    FROM an LEFT JOIN rg0 USING (symbol, mt)),
pz AS (SELECT symbol, mt, (c - l) / (h - l) AS pct FROM rg1 WHERE h > l)"""

#: Pools by walking the prices upwards.
_POOL = """, po0 AS (SELECT symbol, mt, kind, LIST({'p': price, 'i': i, 't': COALESCE(a * 0.25::DOUBLE, c * 0.0025::DOUBLE)} ORDER BY price, i) AS ps FROM kn GROUP BY ALL),
po1 AS (SELECT symbol, mt, kind, list_reduce(ps, lambda g, x: CASE WHEN len(g) > 0 AND ABS(x.p - g[-1].s / g[-1].n) <= x.t
        THEN list_append(g[:-2], {'s': g[-1].s + x.p, 'n': g[-1].n + 1, 'j': GREATEST(g[-1].j, x.i)}) ELSE list_append(g, {'s': x.p, 'n': 1, 'j': x.i}) END,
        CAST([] AS STRUCT(s DOUBLE, n INTEGER, j INTEGER)[])) AS g FROM po0),
po AS MATERIALIZED (SELECT symbol, mt, kind, s / n AS price, n AS touches, j FROM (SELECT symbol, mt, kind, UNNEST(g, recursive := true) FROM po1) WHERE n >= 2),
sq AS MATERIALIZED (SELECT po.symbol, po.mt, po.kind, po.price, MIN(b.i) AS i FROM po JOIN b ON b.symbol = po.symbol AND b.i > po.j AND b.i <= po.mt
    AND CASE WHEN po.kind = 'high' THEN b.h > po.price AND b.c < po.price ELSE b.l < po.price AND b.c > po.price END GROUP BY ALL),
lq0 AS (SELECT symbol, mt, ARG_MAX({'k': kind, 'i': i}, (kind = 'low', price)) AS w FROM sq GROUP BY ALL),
lq1 AS (SELECT po.symbol, po.mt, MIN(price) FILTER (kind = 'high' AND price > c) AS up, ARG_MIN(touches, price) FILTER (kind = 'high' AND price > c) AS up_n,
    MAX(price) FILTER (kind = 'low' AND price < c) AS dn, ARG_MAX(touches, price) FILTER (kind = 'low' AND price < c) AS dn_n,
    COUNT(*) FILTER (kind = 'high') AS eqh, COUNT(*) FILTER (kind = 'low') AS eql FROM po JOIN an USING (symbol, mt) GROUP BY ALL)"""

_OB = """, ob0 AS (SELECT an.symbol, an.mt, an.c, COALESCE(an.a * 0.25::DOUBLE, an.c * 0.0025::DOUBLE) AS tol, obs.i, obs.dir, bottom, top,
    mitigated_at IS NULL OR mitigated_at > an.mt AS open FROM an JOIN obs ON obs.symbol = an.symbol AND obs.i + 3 <= an.mt),
ob1 AS (SELECT *, CASE WHEN c >= bottom - tol AND c <= top + tol THEN 0.0 ELSE LEAST(ABS(c - top), ABS(c - bottom)) END AS dist FROM ob0),
ob AS (SELECT symbol, mt, COUNT(*) AS n, COUNT(*) FILTER (open) AS n_open, COUNT(*) FILTER (open AND dir = 'bull') AS n_bull,
    ARG_MIN({'i': i, 'dir': dir, 'x': dist, 'tol': tol}, (dist, i)) FILTER (open AND dist < 2 * tol) AS blk FROM ob1 GROUP BY ALL)"""

_PAT = """, pt0 AS (SELECT an.symbol, an.mt, MAX(y.i) AS i, string_split(ARG_MAX(y.patterns, y.i), ',') AS names FROM an JOIN y ON y.symbol = an.symbol AND y.i <= an.mt WHERE y.patterns <> '' GROUP BY ALL),
pt1 AS (SELECT pt0.symbol, pt0.mt, pt0.i, swing, UNNEST(names) AS name, UNNEST(range(1, len(names) + 1)) AS n FROM pt0 LEFT JOIN sw USING (symbol, mt)),
pt2 AS (SELECT *, CASE WHEN name IN ('hammer', 'bullEngulf', 'morningStar') THEN 1 WHEN name IN ('shootingStar', 'bearEngulf', 'eveningStar') THEN -1 ELSE 0 END AS side FROM pt1),
pt3 AS (SELECT *, CASE side WHEN 0 THEN 0.2::DOUBLE ELSE CASE WHEN swing = CASE side WHEN 1 THEN 'down' ELSE 'up' END THEN 0.7::DOUBLE
    WHEN swing = 'range' THEN 0.45::DOUBLE ELSE 0.25::DOUBLE END END AS score FROM pt2),
pt AS (SELECT symbol, mt, i, ARG_MAX({'side': side, 'score': score}, (score, -n)) AS p FROM pt3 GROUP BY ALL)"""

_LINE = """, ln0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, mt, kind ORDER BY i DESC) AS r FROM kn),
ln1 AS (SELECT symbol, mt, kind, REGR_SLOPE(price, i) AS m, REGR_INTERCEPT(price, i) AS y0, COALESCE(REGR_R2(price, i), 0) AS r2, ANY_VALUE(COALESCE(a, GREATEST(1e-9, ABS(c) * 0.005::DOUBLE))) AS atr
    FROM ln0 WHERE r <= 8 GROUP BY ALL HAVING COUNT(*) >= 3),
ln AS (SELECT ln1.symbol, ln1.mt, ln1.kind, m, y0, r2, atr, COUNT(*) FILTER (ABS(price - (m * i + y0)) <= 0.5::DOUBLE * atr) AS touches FROM ln1 JOIN ln0 USING (symbol, mt, kind) WHERE r <= 8 GROUP BY ALL),
tl0 AS (SELECT an.symbol, an.mt, an.c, COALESCE(u.atr, d.atr) AS atr, u.m * an.mt + u.y0 AS yu, d.m * an.mt + d.y0 AS yd, u.r2 * LEAST(1.0, u.touches / 4.0::DOUBLE) AS su, d.r2 * LEAST(1.0, d.touches / 4.0::DOUBLE) AS sd,
    u.touches AS tu, d.touches AS td, u.m AS mu, d.m AS md FROM an LEFT JOIN ln u ON u.symbol = an.symbol AND u.mt = an.mt AND u.kind = 'high' LEFT JOIN ln d ON d.symbol = an.symbol AND d.mt = an.mt AND d.kind = 'low'),
tl AS (SELECT symbol, mt, CASE WHEN sd IS NULL OR su >= sd THEN su ELSE sd END AS score, CASE WHEN sd IS NULL OR su >= sd THEN tu ELSE td END AS touches, CASE WHEN sd IS NULL OR su >= sd THEN mu ELSE md END / atr AS lean,
    CASE WHEN c - yu >= 0.5::DOUBLE * atr THEN 1 WHEN yd - c >= 0.5::DOUBLE * atr THEN -1 ELSE 0 END AS beyond, CASE WHEN yu > yd THEN GREATEST(-1.0, LEAST(1.0, 2 * (c - yd) / (yu - yd) - 1)) ELSE 0 END AS place FROM tl0)"""


#: The chart patterns' SQL, with moments in the place of symbols.
_CHART = f""", kf AS (SELECT {{'s': symbol, 'mt': mt}} AS symbol, i, kind, price FROM kn),
le AS MATERIALIZED (SELECT {{'s': symbol, 'mt': mt}} AS symbol, mt AS n, c AS z, CASE WHEN a > 0 THEN a ELSE GREATEST(1e-9, ABS(c) * 0.005::DOUBLE) END AS atr FROM an WHERE mt >= 7)
{re.sub(r"\bf\b", "kf", CHARTS)}, cp AS (SELECT *, {_GRADE} AS confidence FROM {ALL} WHERE {_GRADE} IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY at_bar DESC, {_GRADE} DESC, detector) = 1)"""


#: Bars with what the four stages ask of them.
_STAGED = f""", ba0 AS (SELECT symbol, i, o, h, l, c, v, atr14, (bb_up - bb_low) / bb_mid AS bw, AVG(v) {_w(20)} AS mv, CASE WHEN COUNT(atr14) {_w(100)} = 100 THEN AVG(atr14) {_w(100)} END AS ma,
    ABS(c - o) AS body, h - GREATEST(o, c) AS uw, LEAST(o, c) - l AS lw, LAG(h, 2) OVER ({_S}) < l AS gu, LAG(l, 2) OVER ({_S}) > h AS gd FROM feats),
ba AS MATERIALIZED (SELECT *, COALESCE(atr14 < ma AND LAG(atr14) OVER ({_S}) < LAG(ma) OVER ({_S}) AND LAG(atr14, 2) OVER ({_S}) < LAG(ma, 2) OVER ({_S}) AND bw <= MIN(bw) {_w(50)}, false) AS squeezed,
    CASE WHEN i >= 19 THEN v / NULLIF(mv, 0) END AS vr, CASE WHEN uw <= 0 THEN 0.0 WHEN body <= 1e-12 THEN CAST('inf' AS DOUBLE) ELSE uw / body END AS ur,
    CASE WHEN lw <= 0 THEN 0.0 WHEN body <= 1e-12 THEN CAST('inf' AS DOUBLE) ELSE lw / body END AS lr FROM ba0)"""
_PIERCED = "CASE WHEN {kind} = 'high' THEN {b}.h > {level} AND {b}.c < {level} AND {b}.ur >= 1.5::DOUBLE ELSE {b}.l < {level} AND {b}.c > {level} AND {b}.lr >= 1.5::DOUBLE END"


def pierced(kind: str, b: str, level: str) -> str:
    return _PIERCED.format(kind=kind, b=b, level=level)


_SMALL = """, sm AS MATERIALIZED (SELECT ev.symbol, ev.mt, ev.i, ev.dir, ev.level, ABS(ba.c - ev.level) / ba.atr14 AS mag,
    CASE WHEN p.squeezed THEN ev.i - 1 WHEN ba.squeezed THEN ev.i END AS tight FROM ev JOIN ba ON ba.symbol = ev.symbol AND ba.i = ev.i LEFT JOIN ba p ON p.symbol = ev.symbol AND p.i = ev.i - 1
    WHERE ev.type = 'BoS' AND ba.atr14 > 0 AND ABS(ba.c - ev.level) < 1.5::DOUBLE * ba.atr14)"""
_CISD = f"""{_STAGED}{_SMALL},
c1 AS (SELECT e.symbol, e.mt, e.i AS k, e.dir, s.kind, s.price, s.i AS j FROM ev e JOIN sq s ON s.symbol = e.symbol AND s.mt = e.mt AND s.kind = CASE e.dir WHEN 'down' THEN 'high' ELSE 'low' END
    WHERE e.type = 'CHoCH' AND e.mt - e.i <= 80 AND s.i >= e.i - 6 AND s.i < e.i),
c2 AS (SELECT c1.*, ARG_MAX({{'i': sm.i, 'level': sm.level, 'tight': sm.tight}}, sm.i) AS m FROM c1 JOIN sm ON sm.symbol = c1.symbol AND sm.mt = c1.mt AND sm.dir <> c1.dir AND sm.i < j AND j - sm.i <= 5 GROUP BY ALL),
c3 AS (SELECT c2.symbol, c2.mt, k, dir, c2.kind, c2.price, j, m, ARG_MAX(s.i, s.price) AS first FROM c2 JOIN sq s ON s.symbol = c2.symbol AND s.mt = c2.mt AND s.kind = c2.kind AND s.i > m.i AND s.i <= LEAST(c2.mt, m.i + 5)
    JOIN ba ON ba.symbol = s.symbol AND ba.i = s.i AND {pierced('c2.kind', 'ba', 'c2.m.level')} WHERE m.tight IS NOT NULL GROUP BY ALL HAVING first = j),
c4 AS (SELECT c3.*, (SELECT MAX(e.i) FROM ev e WHERE e.symbol = c3.symbol AND e.mt = c3.mt AND e.type = 'CHoCH' AND e.dir = c3.dir AND e.i > j AND e.i <= LEAST(c3.mt, j + 6)) AS turn,
    EXISTS (SELECT 1 FROM ba g WHERE g.symbol = c3.symbol AND g.i BETWEEN j AND LEAST(c3.mt, j + 6) AND CASE c3.dir WHEN 'up' THEN g.gu ELSE g.gd END) AS gap FROM c3),
c5 AS (SELECT c4.*, w.vr, CASE c4.kind WHEN 'high' THEN s.ur ELSE s.lr END AS wick FROM c4 JOIN ba w ON w.symbol = c4.symbol AND w.i = k JOIN ba s ON s.symbol = c4.symbol AND s.i = j WHERE turn = k AND gap AND w.vr >= 1.5::DOUBLE),
c6 AS (SELECT * FROM c5 QUALIFY row_number() OVER (PARTITION BY symbol, mt ORDER BY k DESC, price DESC) = 1),
c7 AS (SELECT *, mt - k AS age, CASE WHEN mt = k THEN 1.0::DOUBLE WHEN mt - k <= 2 THEN 0.85::DOUBLE WHEN mt - k <= 5 THEN 0.65::DOUBLE ELSE 0.4::DOUBLE END AS fresh,
    LEAST(1.0, (wick - 1.5::DOUBLE) / 2) AS x, LEAST(1.0, (vr - 1.5::DOUBLE) / 2) AS z FROM c6),
cs AS MATERIALIZED (SELECT symbol, mt, k, age, CASE kind WHEN 'low' THEN 1 ELSE -1 END * GREATEST(0.4::DOUBLE, LEAST(1.0, 0.5::DOUBLE + 0.25::DOUBLE * fresh + 0.25::DOUBLE * (x * 0.5::DOUBLE + z * 0.5::DOUBLE))) AS sig,
    LEAST(1.0, 0.45::DOUBLE + 0.25::DOUBLE * fresh + 0.15::DOUBLE * x + 0.15::DOUBLE * z) AS conf FROM c7)"""

_JOINED = """, st0 AS MATERIALIZED (SELECT an.mt, g.*, COALESCE(sw.swing, 'unknown') AS swing, lb.breaks, lb.b, sp, ss, rp, rs, pct,
    CASE WHEN pct < 0 OR pct > 1 THEN 'outside' WHEN pct < 0.45::DOUBLE THEN 'discount' WHEN pct <= 0.55::DOUBLE THEN 'equilibrium' WHEN pct IS NOT NULL THEN 'premium' END AS zone,
    lq0.w, up, up_n, dn, dn_n, eqh, eql, ob.n AS n_ob, n_open, n_bull, blk, pt.i AS pat_i, pt.p AS pat, tl.score AS tl_score, tl.touches AS tl_touches, lean, beyond, place,
    cp.bias AS cp_bias, cp.confidence AS cp_conf, cp.broken AS cp_broken, cs.sig AS cs_sig, cs.conf AS cs_conf, cs.k AS cs_i, cs.age AS cs_age
    FROM an JOIN feats g ON g.symbol = an.symbol AND g.i = an.mt LEFT JOIN sw ON sw.symbol = an.symbol AND sw.mt = an.mt LEFT JOIN lb ON lb.symbol = an.symbol AND lb.mt = an.mt
    LEFT JOIN sr ON sr.symbol = an.symbol AND sr.mt = an.mt LEFT JOIN pz ON pz.symbol = an.symbol AND pz.mt = an.mt LEFT JOIN lq0 ON lq0.symbol = an.symbol AND lq0.mt = an.mt
    LEFT JOIN lq1 ON lq1.symbol = an.symbol AND lq1.mt = an.mt LEFT JOIN ob ON ob.symbol = an.symbol AND ob.mt = an.mt LEFT JOIN pt ON pt.symbol = an.symbol AND pt.mt = an.mt
    LEFT JOIN tl ON tl.symbol = an.symbol AND tl.mt = an.mt LEFT JOIN cp ON cp.symbol = {'s': an.symbol, 'mt': an.mt} LEFT JOIN cs ON cs.symbol = an.symbol AND cs.mt = an.mt)"""


def regime(source: str, made: str) -> str:
    """WITH parts: ``made`` is source with the regime's fields; source has swing and the last break b."""
    return f""", {made}0 AS (SELECT *, CASE WHEN adx14 >= 40 THEN 'strong' WHEN adx14 >= 25 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN c > 0 THEN atr14 / c END AS share,
    (bb_up - bb_low) / NULLIF(bb_mid, 0) AS band, CASE WHEN ema20 > ema50 AND ema50 > ema200 THEN 1 WHEN ema20 < ema50 AND ema50 < ema200 THEN -1 WHEN ema20 IS NOT NULL AND ema50 IS NOT NULL AND ema200 IS NOT NULL THEN 0 END AS stack,
    plus_di > minus_di AS rising, GREATEST(-1.0, LEAST(1.0, GREATEST(-1.0, LEAST(1.0, COALESCE(CASE WHEN c > 0 THEN macd_hist / c * 1000 END, 0))) + COALESCE((rsi14 - 50) / 50 * 0.5::DOUBLE, 0))) AS mom_score FROM {source}),
{made} AS MATERIALIZED (SELECT *, CASE WHEN stack IS NULL THEN 'flat' WHEN stack = 1 THEN 'bullish-stack' WHEN stack = -1 THEN 'bearish-stack' ELSE 'mixed' END AS alignment,
    CASE WHEN share IS NOT NULL THEN CASE WHEN share <= 0.003::DOUBLE THEN 'low' WHEN share >= 0.015::DOUBLE THEN 'high' ELSE 'normal' END WHEN band <= 0.02::DOUBLE THEN 'low' WHEN band >= 0.1::DOUBLE THEN 'high' ELSE 'normal' END AS volatility,
    CASE WHEN share IS NOT NULL THEN GREATEST(0.0, LEAST(1.0, (share - 0.003::DOUBLE) / 0.012::DOUBLE)) WHEN band IS NOT NULL THEN GREATEST(0.0, LEAST(1.0, (band - 0.02::DOUBLE) / 0.08::DOUBLE)) ELSE 0.0 END AS vol_score,
    CASE WHEN strength <> 'weak' AND rising IS NOT NULL THEN CASE WHEN rising THEN 'up' ELSE 'down' END WHEN swing IN ('up', 'down') THEN swing WHEN stack = 1 THEN 'up' WHEN stack = -1 THEN 'down' ELSE 'range' END AS trend,
    CASE WHEN strength <> 'weak' AND rising IS NOT NULL THEN CASE WHEN rising THEN 1 ELSE -1 END * ABS(plus_di - minus_di) / GREATEST(1.0, plus_di + minus_di) WHEN swing = 'up' THEN 0.4::DOUBLE WHEN swing = 'down' THEN -0.4::DOUBLE
        WHEN stack = 1 THEN 0.3::DOUBLE WHEN stack = -1 THEN -0.3::DOUBLE ELSE 0.0 END AS trend_score,
    CASE WHEN mom_score > 0.15::DOUBLE THEN 'up' WHEN mom_score < -0.15::DOUBLE THEN 'down' ELSE 'flat' END AS momentum, CASE WHEN i - b.i <= 10 THEN b.dir ELSE 'none' END AS breakout,
    CASE WHEN trend = 'range' THEN 'range' ELSE 'trending-' || trend END || '-' || strength || '-' || volatility || '-vol' AS regime,
    CASE WHEN stack = 1 AND adx14 >= 22 AND volume_slope >= 0 THEN 'markup' WHEN stack = -1 AND adx14 >= 22 AND volume_slope >= 0 THEN 'markdown'
        WHEN bull30 >= 62 AND (band IS NULL OR band >= 0.03::DOUBLE) THEN 'markup' WHEN bull30 <= 38 AND (band IS NULL OR band >= 0.03::DOUBLE) THEN 'markdown'
        WHEN stack = 1 AND volume_slope < 0 AND band <= 0.04::DOUBLE THEN 'distribution' WHEN stack = -1 AND volume_slope < 0 AND band <= 0.04::DOUBLE THEN 'accumulation'
        WHEN band <= 0.04::DOUBLE AND bull30 >= 50 THEN 'accumulation' WHEN band <= 0.04::DOUBLE THEN 'distribution' ELSE 'neutral' END AS phase FROM {made}0)"""


#: Votes, module by module: (name, weight, signal, confidence) over ``vo``.
_VOTES = [
    ("trend-follow", 1.2, """CASE WHEN ema20 IS NULL OR ema50 IS NULL OR ema200 IS NULL OR adx14 IS NULL OR stack = 0 THEN 0 WHEN adx14 < 20 THEN 0.15::DOUBLE * stack
        WHEN (stack = 1 AND plus_di > minus_di) OR (stack = -1 AND minus_di > plus_di) THEN stack * (0.4::DOUBLE + 0.6::DOUBLE * adx_sure) ELSE 0.2::DOUBLE * stack END""",
     """CASE WHEN ema20 IS NULL OR ema50 IS NULL OR ema200 IS NULL OR adx14 IS NULL THEN 0 WHEN stack = 0 THEN 0.1::DOUBLE WHEN adx14 < 20 THEN 0.15::DOUBLE
        WHEN (stack = 1 AND plus_di > minus_di) OR (stack = -1 AND minus_di > plus_di) THEN adx_sure ELSE 0.25::DOUBLE END"""),
    ("mean-reversion", 1.0, """CASE WHEN rsi14 IS NULL OR bb_mid IS NULL THEN 0 WHEN zz <= -1 AND rsi14 < 35 THEN calm * (0.4::DOUBLE + 0.4::DOUBLE * LEAST(1, ABS(zz) - 1) + 0.2::DOUBLE * GREATEST(0, (35 - rsi14) / 35))
        WHEN zz >= 1 AND rsi14 > 65 THEN -calm * (0.4::DOUBLE + 0.4::DOUBLE * LEAST(1, zz - 1) + 0.2::DOUBLE * GREATEST(0, (rsi14 - 65) / 35)) WHEN rsi14 < 30 THEN 0.15::DOUBLE * calm WHEN rsi14 > 70 THEN -0.15::DOUBLE * calm ELSE 0 END""",
     """CASE WHEN rsi14 IS NULL OR bb_mid IS NULL THEN 0 WHEN (zz <= -1 AND rsi14 < 35) OR (zz >= 1 AND rsi14 > 65) THEN 0.4::DOUBLE + 0.3::DOUBLE * (ABS(zz) - 1) + 0.3::DOUBLE * calm WHEN rsi14 < 30 OR rsi14 > 70 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END"""),
    ("momentum", 1.0, """CASE WHEN hist1 IS NULL OR hist0 IS NULL THEN 0 ELSE SIGN(hist0) * (0.3::DOUBLE + 0.7::DOUBLE * mag + CASE WHEN faster THEN 0.4::DOUBLE ELSE -0.1::DOUBLE END
        + CASE WHEN COALESCE(SIGN(roc10), 0) = SIGN(hist0) THEN 0.3::DOUBLE WHEN COALESCE(SIGN(roc10), 0) = 0 THEN 0 ELSE -0.2::DOUBLE END) END""",
     """CASE WHEN hist1 IS NULL OR hist0 IS NULL THEN 0 ELSE 0.5::DOUBLE * mag + CASE WHEN faster THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN faster AND before_faster THEN 0.1::DOUBLE ELSE 0 END
        + CASE WHEN COALESCE(SIGN(roc10), 0) = SIGN(hist0) THEN 0.15::DOUBLE ELSE 0 END END"""),
    ("breakout", 1.1, """CASE WHEN i - b.i <= 10 THEN CASE b.dir WHEN 'up' THEN 1 ELSE -1 END * LEAST(1.0, bk_base + bk_boost + bk_new) ELSE 0 END""",
     """CASE WHEN b IS NULL THEN 0 WHEN i - b.i <= 10 THEN LEAST(1.0, bk_base + bk_boost + 0.8::DOUBLE * bk_new) ELSE 0.05::DOUBLE END"""),
    ("support-resistance", 0.9, """CASE WHEN sp IS NULL AND rp IS NULL THEN 0 WHEN COALESCE(c - sp <= reach, false) AND NOT COALESCE(rp - c <= reach, false) THEN 0.4::DOUBLE + 0.4::DOUBLE * LEAST(1, ss / 5)
        WHEN COALESCE(rp - c <= reach, false) AND NOT COALESCE(c - sp <= reach, false) THEN -0.4::DOUBLE - 0.4::DOUBLE * LEAST(1, rs / 5)
        WHEN sp IS NULL OR rp IS NULL OR rp = sp THEN 0 ELSE 0.25::DOUBLE - 0.5::DOUBLE * (c - sp) / (rp - sp) END""",
     """CASE WHEN sp IS NULL AND rp IS NULL THEN 0 WHEN COALESCE(c - sp <= reach, false) AND NOT COALESCE(rp - c <= reach, false) THEN 0.4::DOUBLE + 0.3::DOUBLE * LEAST(1, ss / 5)
        WHEN COALESCE(rp - c <= reach, false) AND NOT COALESCE(c - sp <= reach, false) THEN 0.4::DOUBLE + 0.3::DOUBLE * LEAST(1, rs / 5)
        WHEN sp IS NULL OR rp IS NULL OR rp = sp THEN 0 ELSE 2 * ABS(0.25::DOUBLE - 0.5::DOUBLE * (c - sp) / (rp - sp)) END"""),
    ("volatility-regime", 0.7, "CASE WHEN band < 0.7::DOUBLE * width50 THEN 0.25::DOUBLE * COALESCE(SIGN(macd_hist), 0) ELSE 0 END",
     "CASE WHEN band IS NULL THEN 0 WHEN band < 0.7::DOUBLE * width50 THEN CASE WHEN macd_hist <> 0 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END WHEN band > 1.3::DOUBLE * width50 THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END"),
    ("volume-profile", 0.8, "CASE WHEN os <> 0 THEN os ELSE fs END * (0.3::DOUBLE + 0.5::DOUBLE * flow + CASE WHEN busy THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN os <> 0 AND os = fs THEN 0.1::DOUBLE ELSE 0 END)",
     "0.25::DOUBLE + 0.35::DOUBLE * flow + CASE WHEN os <> 0 AND os = fs THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN busy THEN 0.1::DOUBLE ELSE 0 END"),
    ("candle-patterns", 0.7, "CASE WHEN i - pat_i <= 3 THEN pat.side * LEAST(1.0, pat.score + CASE i - pat_i WHEN 0 THEN 0.15::DOUBLE WHEN 1 THEN 0.08::DOUBLE ELSE 0 END) ELSE 0 END",
     "CASE WHEN pat_i IS NULL THEN 0 WHEN i - pat_i > 3 THEN 0.05::DOUBLE WHEN pat.side = 0 THEN 0 ELSE LEAST(1.0, 0.9::DOUBLE * pat.score + CASE i - pat_i WHEN 0 THEN 0.15::DOUBLE WHEN 1 THEN 0.08::DOUBLE ELSE 0 END) END"),
    ("order-blocks", 0.9, "CASE WHEN blk IS NULL THEN 0 ELSE CASE blk.dir WHEN 'bull' THEN 1 ELSE -1 END * (0.3::DOUBLE + 0.7::DOUBLE * ob_sure) END",
     "CASE WHEN n_ob IS NULL THEN 0 WHEN n_open = 0 THEN 0.05::DOUBLE WHEN blk IS NULL THEN 0.08::DOUBLE ELSE ob_sure END"),
    ("liquidity", 0.9, """CASE WHEN i - w.i <= 5 THEN CASE w.k WHEN 'high' THEN 1 ELSE -1 END * (0.4::DOUBLE + 0.4::DOUBLE * sw_new) WHEN near_up THEN 0.15::DOUBLE + 0.2::DOUBLE * LEAST(1, up_n / 4.0::DOUBLE)
        WHEN near_dn THEN -0.15::DOUBLE - 0.2::DOUBLE * LEAST(1, dn_n / 4.0::DOUBLE) ELSE 0 END""",
     """CASE WHEN i - w.i <= 5 THEN 0.35::DOUBLE + 0.45::DOUBLE * sw_new WHEN near_up THEN 0.2::DOUBLE + 0.2::DOUBLE * LEAST(1, up_n / 4.0::DOUBLE)
        WHEN near_dn THEN 0.2::DOUBLE + 0.2::DOUBLE * LEAST(1, dn_n / 4.0::DOUBLE) ELSE 0.05::DOUBLE END"""),
    ("premium-discount", 0.7, "CASE zone WHEN 'discount' THEN 0.2::DOUBLE + 0.4::DOUBLE * (0.45::DOUBLE - pct) / 0.45::DOUBLE WHEN 'premium' THEN -0.2::DOUBLE - 0.4::DOUBLE * (pct - 0.55::DOUBLE) / 0.45::DOUBLE ELSE 0 END",
     "CASE zone WHEN 'discount' THEN 0.25::DOUBLE + 0.35::DOUBLE * (0.45::DOUBLE - pct) / 0.45::DOUBLE WHEN 'premium' THEN 0.25::DOUBLE + 0.35::DOUBLE * (pct - 0.55::DOUBLE) / 0.45::DOUBLE ELSE CASE WHEN pct IS NULL THEN 0 ELSE 0.1::DOUBLE END END"),
    ("session-calendar", 0.5, "0", "GREATEST(0.0, CASE session WHEN 'off-hours' THEN 0.1::DOUBLE WHEN 'london' THEN 0.25::DOUBLE WHEN 'ny-am' THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END - CASE WHEN in_event THEN 0.15::DOUBLE ELSE 0 END)"),
    ("cisd", 1.1, "COALESCE(cs_sig, 0)", "CASE WHEN i < 108 THEN 0 ELSE COALESCE(cs_conf, 0.05::DOUBLE) END"),
    ("trendline", 1.0, "CASE WHEN tl_score IS NULL OR tl_score < 0.3::DOUBLE OR tl_touches < 3 THEN 0 ELSE 0.5::DOUBLE * TANH(4 * lean) + 0.3::DOUBLE * beyond - 0.2::DOUBLE * place END",
     "CASE WHEN tl_score IS NULL THEN 0 WHEN tl_score < 0.3::DOUBLE OR tl_touches < 3 THEN LEAST(0.3::DOUBLE, tl_score) WHEN beyond <> 0 THEN tl_score ELSE 0.85::DOUBLE * tl_score END"),
    ("chart-patterns", 1.0, "CASE WHEN cp_conf IS NULL THEN 0 ELSE CASE cp_bias WHEN 'bullish' THEN cp_conf ELSE -cp_conf END * CASE WHEN cp_broken THEN 1 ELSE 0.6::DOUBLE END END", "COALESCE(cp_conf, 0)"),
]

_VOTED = """, vo AS MATERIALIZED (SELECT *, CASE WHEN adx14 < 20 THEN 0 WHEN adx14 < 25 THEN 0.2::DOUBLE WHEN adx14 < 40 THEN 0.2::DOUBLE + (adx14 - 25) / 15 * 0.7::DOUBLE ELSE LEAST(1.0, 0.9::DOUBLE + (adx14 - 40) / 400) END AS adx_sure,
    CASE WHEN bb_up <> bb_mid THEN (c - bb_mid) / (bb_up - bb_mid) ELSE 0 END AS zz, CASE WHEN adx14 IS NULL THEN 0.5::DOUBLE WHEN adx14 < 20 THEN 1 WHEN adx14 < 25 THEN 0.7::DOUBLE WHEN adx14 < 30 THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END AS calm,
    LEAST(1.0, ABS(hist0) / c * 2000) AS mag, CASE WHEN hist0 < 0 THEN hist0 < hist1 ELSE hist0 > hist1 END AS faster, CASE WHEN hist2 IS NULL THEN false WHEN hist0 < 0 THEN hist1 < hist2 ELSE hist1 > hist2 END AS before_faster,
    CASE b.type WHEN 'CHoCH' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS bk_base, CASE WHEN b.v >= 2 * b.mean THEN 0.3::DOUBLE WHEN b.v >= 1.5::DOUBLE * b.mean THEN 0.2::DOUBLE WHEN b.v >= 1.2::DOUBLE * b.mean THEN 0.1::DOUBLE ELSE 0 END AS bk_boost,
    CASE WHEN i - b.i <= 2 THEN 0.25::DOUBLE WHEN i - b.i <= 5 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END AS bk_new, COALESCE(0.5::DOUBLE * atr14, 0.005::DOUBLE * c) AS reach,
    CASE WHEN ABS(obv20) <= 1 OR obv20 IS NULL THEN 0 WHEN (obv - obv20) / ABS(obv20) > 0.005::DOUBLE THEN 1 WHEN (obv - obv20) / ABS(obv20) < -0.005::DOUBLE THEN -1 ELSE 0 END AS os,
    CASE WHEN cmf20 > 0.05::DOUBLE THEN 1 WHEN cmf20 < -0.05::DOUBLE THEN -1 ELSE 0 END AS fs,
    GREATEST(LEAST(1.0, 2 * ABS(COALESCE(cmf20, 0))), LEAST(1.0, CASE WHEN ABS(obv20) > 1 THEN 10 * ABS((obv - obv20) / obv20) ELSE 0 END)) AS flow, COALESCE(v >= 1.5::DOUBLE * v20_before AND v20_before > 0, false) AS busy,
    LEAST(1.0, 0.3::DOUBLE + 0.4::DOUBLE * CASE WHEN i - blk.i <= 5 THEN 1 WHEN i - blk.i <= 20 THEN 0.7::DOUBLE WHEN i - blk.i <= 50 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END + 0.3::DOUBLE * GREATEST(0, 1 - blk.x / (2 * blk.tol))) AS ob_sure,
    CASE WHEN i = w.i THEN 1 WHEN i - w.i <= 2 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS sw_new, 8 * COALESCE(NULLIF(atr14, 0), c * 0.005::DOUBLE) AS far,
    COALESCE(up - c < far AND (dn IS NULL OR up - c < c - dn), false) AS near_up, COALESCE(c - dn < far AND (up IS NULL OR c - dn < up - c), false) AS near_dn,
    CASE session WHEN 'off-hours' THEN 0.6::DOUBLE WHEN 'london' THEN 1.1::DOUBLE WHEN 'ny-am' THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN in_event THEN 0.4::DOUBLE ELSE 1 END AS mult FROM re)"""


def votes() -> str:
    """WITH parts: sg (symbol, at, module, weight, signal, confidence, applied, direction) and en, the ensemble by moment."""
    each = " UNION ALL ".join(f"SELECT symbol, mt, mult, '{name}' AS module, {weight}::DOUBLE AS weight, CAST({signal} AS DOUBLE) AS s, CAST({sure} AS DOUBLE) AS k FROM vo" for name, weight, signal, sure in _VOTES)
    return f"""{_VOTED}, sg0 AS ({each}),
sg1 AS (SELECT symbol, mt, mult, module, weight, GREATEST(-1.0, LEAST(1.0, s)) AS signal, GREATEST(0.0, LEAST(1.0, k)) AS confidence FROM sg0),
sg AS MATERIALIZED (SELECT symbol, mt, module, weight, signal, confidence, CASE WHEN module = 'session-calendar' THEN confidence ELSE LEAST(1.0, confidence * mult) END AS applied,
    CASE WHEN signal > 0.05::DOUBLE THEN 'long' WHEN signal < -0.05::DOUBLE THEN 'short' ELSE 'neutral' END AS direction FROM sg1),
en0 AS (SELECT symbol, mt, SUM(signal * applied * weight) / SUM(weight) AS raw_score, AVG(applied) AS confidence, COUNT(*) AS participating FROM sg WHERE NOT (applied < 0.05::DOUBLE AND ABS(signal) < 0.1::DOUBLE) GROUP BY ALL),
en1 AS (SELECT *, 1 / (1 + EXP(-3 * raw_score)) AS probability FROM en0),
en AS MATERIALIZED (SELECT *, CASE WHEN probability > 0.55::DOUBLE THEN 'long' WHEN probability < 0.45::DOUBLE THEN 'short' ELSE 'neutral' END AS direction FROM en1)"""


def states(chosen: str, in_event: str = "false") -> str:
    """WITH parts up to re: what was known at the bars of feats that ``chosen`` picks, with regime and phase."""
    marks = f", an AS MATERIALIZED (SELECT symbol, i AS mt, c, atr14 AS a FROM feats WHERE {chosen})"
    joined = _JOINED.replace("SELECT an.mt, g.*", f"SELECT an.mt, g.*, {in_event} AS in_event")
    return _REC + _MARKED + _PATTERN + _FLOW + _BLOCKS + marks + _LABELS + _EVENTS + _SWING + _KNOWN + _NEAR + _POOL + _OB + _PAT + _LINE + _CHART + _CISD + joined + regime("st0", "re")
