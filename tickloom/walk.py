"""Queries of what was known at each bar: regimes, stages, votes and the walk-forward backtest, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decisions import _NEWEST, _VOTED, _rounded
from .operators import cisd, learning, modules, regime
from .outcomes import _query
from .plans import asof, backtest
from .state_sql import pierced, states, votes
from .state_sql import regime as regime_sql

_FIELDS = ("strength", "volatility", "alignment", "trend", "momentum", "breakout", "regime", "phase", "vol_score", "trend_score", "mom_score")
_ONLY, _NOT = ["trend-follow", "momentum", "cisd", "trendline", "chart-patterns"], ["momentum"]


def _as_of(bars: DataFrame) -> DataFrame:
    """Regime of every bar from what was known then."""
    return asof.regimes(bars)


def _published(bars: DataFrame) -> DataFrame:
    """Regime of every bar with the newest bar's trend and breaks, of which those after the bar count too."""
    rows = asof.around(asof.histories(bars))
    last = rows.where("newer IS NULL").select("symbol", "swing", "break_i", "break_dir")
    return regime.classify(rows.drop("swing", "break_i", "break_dir").join(last, "symbol"))


def _keyed(bars: DataFrame) -> DataFrame:
    known = F.col("adx14").isNotNull() & F.col("atr14").isNotNull()
    return _as_of(bars).select("symbol", "i", F.when(known, F.concat_ws("/", "trend", "strength", "volatility")).alias("key"))


def _stages(bars: DataFrame) -> DataFrame:
    p = asof.parts(bars, lambda rows: rows.where("newer IS NULL"))
    rows = p["rows"].withColumnRenamed("symbol", "name")
    events = asof.events(p["rows"], p["at"], 1 << 30)
    found = cisd.stages(events, p["pools"].where("bar IS NOT NULL"), rows.select("name", "i", "h", "l", "c", "upper_wick", "lower_wick", "gap_up", "gap_down"))
    return found.select(F.col("symbol.symbol").alias("symbol"), F.col("j").alias("i"), F.col("j_dir").alias("dir"), F.col("j_level").alias("level"), "magnitude", "compression_i", "sweep_i", "wick_ratio", "choch_i", "volume_ratio")


def _compression(bars: DataFrame) -> DataFrame:
    return cisd.attributes(asof.features(bars)).select("symbol", "i", cisd.band_width().alias("band_width"), "compressed")


def _voted(bars: DataFrame) -> DataFrame:
    """CISD of every bar from the hundredth on, as it was known then, over a symbol's newest bars."""
    known = asof.states(backtest.newest_bars(bars, backtest.BARS), lambda rows: rows.where("i >= 100"))
    return known.select("symbol", "i", "cisd_signal", "cisd_confidence", "cisd_i", "cisd_age")


def _listed(bars: DataFrame) -> DataFrame:
    return modules.ensemble(modules.listed(modules.evaluate(asof.newest(bars)), _ONLY, _NOT))


def _calibrated(bars: DataFrame) -> DataFrame:
    return modules.ensemble(modules.evaluate(asof.newest(bars)), calibrated=lambda score: 0.5 + 3 * score)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "regime_as_of": _query(lambda b: _as_of(b).select("symbol", "i", *_FIELDS)),
    "regime_series": _query(lambda b: _published(b).select("symbol", "i", *_FIELDS)),
    "regime_states": _query(lambda b: learning.committed(_keyed(b))),
    "cisd_compression": _query(_compression),
    "cisd_stages": _query(_stages),
    "module_cisd": _query(_voted),
    "ensemble_listed": _query(_listed),
    "ensemble_calibrated": _query(_calibrated),
    "walk_forward_trades": _query(backtest.walk_forward),
    "walk_forward_backtest": _query(lambda b: backtest.measures(backtest.walk_forward(b))),
    "walk_forward_regimes": _query(lambda b: backtest.by_regime(backtest.walk_forward(b))),
}


def _cut(sql: str, most: int = backtest.BARS) -> str:
    """sql over each symbol's newest bars."""
    last = f"g AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= {most})"
    return sql.replace("g AS (SELECT event_type", "every AS (SELECT event_type").replace("GROUP BY ALL),", f"GROUP BY ALL),\n{last},", 1)


_ROUNDED = ", ".join(f"ROUND({x}, 6) AS {x}" if x.endswith("_score") else x for x in _FIELDS)
#: Every bar's state needs no more than trend, breaks and features.
_EVERY = states("true")
_EVERY = _EVERY[: _EVERY.index(", kn AS")] + """, st0 AS MATERIALIZED (SELECT g.*, COALESCE(sw.swing, 'unknown') AS swing, lb.b FROM feats g
    LEFT JOIN sw ON sw.symbol = g.symbol AND sw.mt = g.i LEFT JOIN lb ON lb.symbol = g.symbol AND lb.mt = g.i)""" + regime_sql("st0", "re")
_LAST = states(_NEWEST)
_LAST = _LAST[: _LAST.index(", kn AS")] + """, st0 AS MATERIALIZED (SELECT g.*, COALESCE(sw.swing, 'unknown') AS swing, lb.b FROM feats g
    LEFT JOIN sw ON sw.symbol = g.symbol LEFT JOIN lb ON lb.symbol = g.symbol)""" + regime_sql("st0", "re")
_COMMITTED = f"""{_EVERY}, rk AS MATERIALIZED (SELECT symbol, i, trend || '/' || strength || '/' || volatility AS key, row_number() OVER (PARTITION BY symbol ORDER BY i) AS n
    FROM re WHERE adx14 IS NOT NULL AND atr14 IS NOT NULL),
fs(symbol, n, cur, pend, waited) AS (SELECT symbol, n, key, CAST(NULL AS VARCHAR), 0 FROM rk WHERE n = 1 UNION ALL
SELECT rk.symbol, rk.n, CASE WHEN key <> cur AND key = pend AND waited = 2 THEN key ELSE cur END, CASE WHEN key = cur OR (key = pend AND waited = 2) THEN NULL ELSE key END,
    CASE WHEN key = cur OR (key = pend AND waited = 2) THEN 0 WHEN key = pend THEN waited + 1 ELSE 1 END
FROM fs JOIN rk ON rk.symbol = fs.symbol AND rk.n = fs.n + 1)
SELECT symbol, i, key, cur AS state, COALESCE(cur <> LAG(cur) OVER (PARTITION BY symbol ORDER BY i), true) AS entered FROM fs JOIN rk USING (symbol, n)"""
_STAGES = f"""{states(_NEWEST)}, in0 AS (SELECT sm.*, CASE dir WHEN 'up' THEN 'high' ELSE 'low' END AS kind FROM sm),
in1 AS (SELECT in0.symbol, in0.mt, in0.i, ARG_MAX({{'i': s.i, 'r': CASE in0.kind WHEN 'high' THEN ba.ur ELSE ba.lr END}}, s.price) AS x FROM in0 JOIN sq s ON s.symbol = in0.symbol AND s.mt = in0.mt AND s.kind = in0.kind
    AND s.i > in0.i AND s.i <= LEAST(in0.mt, in0.i + 5) JOIN ba ON ba.symbol = in0.symbol AND ba.i = s.i AND {pierced('in0.kind', 'ba', 'in0.level')} GROUP BY ALL),
in2 AS (SELECT in0.symbol, in0.mt, in0.i, ARG_MIN({{'i': ba.i, 'r': CASE in0.kind WHEN 'high' THEN ba.ur ELSE ba.lr END}}, ba.i) AS x FROM in0 JOIN ba ON ba.symbol = in0.symbol AND ba.i > in0.i
    AND ba.i <= LEAST(in0.mt, in0.i + 5) AND {pierced('in0.kind', 'ba', 'in0.level')} GROUP BY ALL),
in3 AS (SELECT in0.*, COALESCE(in1.x, in2.x) AS x FROM in0 LEFT JOIN in1 USING (symbol, mt, i) LEFT JOIN in2 USING (symbol, mt, i)),
in4 AS (SELECT in3.symbol, in3.i, MAX(e.i) AS k FROM in3 JOIN ev e ON e.symbol = in3.symbol AND e.type = 'CHoCH' AND e.dir <> in3.dir AND e.i > x.i AND e.i <= LEAST(in3.mt, x.i + 6) GROUP BY ALL),
in5 AS (SELECT in4.symbol, in4.i, k, ba.vr FROM in4 JOIN in3 USING (symbol, i) JOIN ba ON ba.symbol = in4.symbol AND ba.i = k WHERE ba.vr >= 1.5::DOUBLE AND EXISTS (SELECT 1 FROM ba y
    WHERE y.symbol = in4.symbol AND y.i BETWEEN x.i AND LEAST(in3.mt, x.i + 6) AND CASE in3.dir WHEN 'up' THEN y.gd ELSE y.gu END))
SELECT symbol, i, dir, ROUND(level, 6) AS level, ROUND(mag, 6) AS magnitude, tight AS compression_i, x.i AS sweep_i, ROUND(x.r, 6) AS wick_ratio, k AS choch_i, ROUND(vr, 6) AS volume_ratio
FROM in3 LEFT JOIN in5 USING (symbol, i)"""
_WALKED = _cut(states(f"i >= {backtest.WARMUP} AND i < (SELECT MAX(i) FROM b x WHERE x.symbol = feats.symbol) AND (SELECT COUNT(*) FROM b x WHERE x.symbol = feats.symbol) >= {backtest.LEAST}") + votes()) + """,
wf0 AS (SELECT re.symbol, re.i, COALESCE(direction, 'neutral') AS direction, COALESCE(probability, 0.5::DOUBLE) AS probability, trend || '-' || strength AS regime, (nx.c - re.c) / re.c AS ret
    FROM re JOIN b nx ON nx.symbol = re.symbol AND nx.i = re.i + 1 LEFT JOIN en ON en.symbol = re.symbol AND en.mt = re.i),
wf1 AS (SELECT *, CASE WHEN ret > 0.0005::DOUBLE THEN 'up' WHEN ret < -0.0005::DOUBLE THEN 'down' ELSE 'flat' END AS realized FROM wf0),
wf AS MATERIALIZED (SELECT *, (direction = 'long' AND realized = 'up') OR (direction = 'short' AND realized = 'down') AS hit,
    CASE WHEN realized = 'flat' OR direction = 'neutral' THEN 0.0 WHEN direction = 'long' THEN ret ELSE -ret END AS pnl FROM wf1)"""

SQL: dict[str, str] = {
    "regime_as_of": f"{_EVERY} SELECT symbol, i, {_ROUNDED} FROM re",
    "regime_series": f"{_LAST} SELECT symbol, i, {_ROUNDED} FROM re",
    "regime_states": _COMMITTED,
    "cisd_compression": f"{states(_NEWEST)} SELECT symbol, i, ROUND(bw, 6) AS band_width, squeezed AS compressed FROM ba",
    "cisd_stages": _STAGES,
    "module_cisd": _cut(states("i >= 100")) + """ SELECT symbol, i, ROUND(COALESCE(cs_sig, 0), 6) AS cisd_signal, ROUND(COALESCE(cs_conf, CASE WHEN i < 108 THEN 0.0 ELSE 0.05::DOUBLE END), 6) AS cisd_confidence,
    cs_i AS cisd_i, cs_age AS cisd_age FROM re""",
    "ensemble_listed": f"""{_VOTED} SELECT symbol, ROUND(SUM(signal * applied * weight) / SUM(weight), 6) AS raw_score, ROUND(AVG(applied), 6) AS confidence, COUNT(*) AS participating,
    ROUND(1 / (1 + EXP(-3 * SUM(signal * applied * weight) / SUM(weight))), 6) AS probability,
    CASE WHEN 1 / (1 + EXP(-3 * SUM(signal * applied * weight) / SUM(weight))) > 0.55 THEN 'long' WHEN 1 / (1 + EXP(-3 * SUM(signal * applied * weight) / SUM(weight))) < 0.45 THEN 'short' ELSE 'neutral' END AS direction
FROM sg WHERE module IN ('trend-follow', 'cisd', 'trendline', 'chart-patterns') AND (applied >= 0.05 OR ABS(signal) >= 0.1) GROUP BY symbol""",
    "ensemble_calibrated": f"""{_VOTED}, cl AS (SELECT *, LEAST(1.0, GREATEST(0.0, 0.5 + 3 * raw_score)) AS pr FROM en) SELECT symbol, ROUND(raw_score, 6) AS raw_score, ROUND(confidence, 6) AS confidence, participating,
    ROUND(pr, 6) AS probability, CASE WHEN pr > 0.55 THEN 'long' WHEN pr < 0.45 THEN 'short' ELSE 'neutral' END AS direction FROM cl""",
    "walk_forward_trades": f"{_WALKED} SELECT symbol, i, direction, realized, hit, ROUND(ret, 6) AS ret, ROUND(pnl, 6) AS pnl, ROUND(probability, 6) AS probability, regime FROM wf",
    "walk_forward_backtest": f"""{_WALKED}, wq AS (SELECT *, EXP(SUM(LN(1 + pnl)) OVER (PARTITION BY symbol ORDER BY i)) AS equity FROM wf),
wd AS (SELECT *, GREATEST(1.0, MAX(equity) OVER (PARTITION BY symbol ORDER BY i)) AS peak, CASE direction WHEN 'long' THEN ret WHEN 'short' THEN -ret END AS own FROM wq)
SELECT symbol, COUNT(*) AS trades, COUNT(*) FILTER (direction <> 'neutral' AND hit) AS hits, COUNT(*) FILTER (direction <> 'neutral' AND NOT hit) AS misses, COUNT(*) FILTER (direction = 'neutral') AS abstain,
    ROUND(ARG_MAX(equity, i) - 1, 6) AS final_return, ROUND(MAX((peak - equity) / peak), 6) AS max_drawdown, ROUND(CASE WHEN STDDEV_POP(own) > 0 THEN AVG(own) / STDDEV_POP(own) * SQRT(252) ELSE 0 END, 6) AS sharpe FROM wd GROUP BY symbol""",
    "walk_forward_regimes": f"{_WALKED} SELECT symbol, regime, COUNT(*) FILTER (direction <> 'neutral') AS total, COUNT(*) FILTER (direction <> 'neutral' AND hit) AS hits FROM wf GROUP BY symbol, regime",
}
