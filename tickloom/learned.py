"""Queries of the learning layer and of the scanner, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decisions import _REC, SQL as _DECISIONS, _rounded
from .functions import indicators as I
from .operators import chart_patterns, labels, learning, structure, trendlines
from .outcomes import _LINES, _query
from .plans import scanner
from .queries import _PIVOT, _S, _WITH
from .records import SQL as _RECORDS, _vectors
from .sources.candles import load, series

_BASELINE = 0.55


def _drawn(bars: DataFrame) -> DataFrame:
    rows = bars.select("symbol", "i", learning.hashed(F.col("symbol")).alias("hash"))
    u, v = (learning.draw(F.col("hash"), 2 * F.col("i") + k) for k in (1, 2))
    return rows.withColumns({"u": u, "v": v}).select("symbol", "i", "hash", "u", "v", learning.normal(F.col("u"), F.col("v")).alias("normal"))


def _models(bars: DataFrame) -> DataFrame:
    """Stands in for the store's models: one for every thirtieth bar."""
    n = (F.col("i") / 30).cast("int")
    role = F.when(n % 4 == 1, "challenger").when(n % 4 == 2, "retired").when(n % 4 == 3, "champion")
    kind = F.when(n % 3 == 0, "ensemble").otherwise("mlp")
    return bars.where("i % 30 = 0").select("symbol", F.col("t").alias("created_at"), F.concat(F.lit("v"), n.cast("string")).alias("version"), role.alias("role"), kind.alias("kind"))


def _guesses(bars: DataFrame) -> DataFrame:
    """A guess by the bar's own direction and what the next bar did."""
    label = F.signum(F.lead("c").over(series()) - F.col("c"))
    return bars.select("symbol", "i", (F.col("c") - F.col("o")).alias("predicted"), label.alias("label")).where("label IS NOT NULL")


def _decided(bars: DataFrame) -> DataFrame:
    return _guesses(bars).where("predicted <> 0").select("symbol", "i", F.when(F.col("predicted") * F.col("label") > 0, 1.0).otherwise(0.0).alias("correct"))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return _rounded(learning.scaled(vectors, labels.vector_statistics(vectors, "vector")))


def _pattern_signal(bars: DataFrame) -> DataFrame:
    """The newest chart pattern's side and confidence, less while it is not broken; 0 without one."""
    found = chart_patterns.newest(chart_patterns.chart_patterns(I.recurrences(bars)))
    side = F.when(F.col("bias") == "bullish", 1.0).otherwise(-1.0) * F.col("confidence") * F.when(F.col("broken"), 1.0).otherwise(0.6)
    rows = bars.select("symbol").distinct().join(found, "symbol", "left")
    return rows.select("symbol", F.coalesce(side, F.lit(0.0)).alias("signal"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def _line_signal(bars: DataFrame) -> DataFrame:
    last = I.recurrences(bars).groupBy("symbol").agg(F.max_by(F.struct("i", "c", "atr14"), "i").alias("x")).select("symbol", "x.*")
    ends = last.select("symbol", "i", "c", F.coalesce("atr14", 0.005 * F.col("c")).alias("atr"))
    found = trendlines.lines(structure.pivots(bars), ends.select("symbol", (F.col("atr") * 0.5).alias("tolerance")))
    return trendlines.line_signal(found, trendlines.channels(found, ends), ends)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "seeded_draws": _query(_drawn),
    "model_latest": _query(lambda b: learning.newest_model(_models(b), ["symbol", "kind"])),
    "model_champion": _query(lambda b: learning.newest_model(_models(b), ["symbol"], role="champion")),
    "model_challenger": _query(lambda b: learning.newest_model(_models(b), ["symbol"], role="challenger")),
    "sign_accuracy": _query(lambda b: learning.sign_accuracy(_guesses(b))),
    "champion_drift": _query(lambda b: learning.champion_drift(_decided(b), _BASELINE)),
    "module_chart_patterns": _query(_pattern_signal),
    "module_trendline": _query(_line_signal),
    "vectors_scaled": _scaled,
    "clusters": lambda spark, sf_dir: learning.clusters(_vectors(spark, sf_dir).select("vec_id", "vector")).select("vec_id", "cluster"),
    "scanner": lambda spark, sf_dir: _rounded(scanner.scanned(load(spark, sf_dir))),
}

def _times(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS HUGEINT) * CAST({b} AS HUGEINT)) % 4294967296 AS BIGINT)"


def _draw(name: str, step: str) -> str:
    """WITH parts: table ``name`` (symbol, i, x) of draws of every bar."""
    return f""", {name}1 AS (SELECT symbol, i, (hash + {_times(step, '1831565813')}) % 4294967296 AS a FROM hs),
{name}2 AS (SELECT symbol, i, {_times('xor(a, a >> 15)', '(a | 1)')} AS a FROM {name}1),
{name}3 AS (SELECT symbol, i, xor(a, (a + {_times('xor(a, a >> 7)', '(a | 61)')}) % 4294967296) AS a FROM {name}2),
{name} AS (SELECT symbol, i, xor(a, a >> 14) / 4294967296.0::DOUBLE AS x FROM {name}3)"""


_DRAWS = f"""{_WITH}, hs AS (SELECT symbol, i, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(symbol, ''), lambda s: CAST(ascii(s) AS BIGINT))),
lambda h, s: {_times('xor(h, s)', '16777619')}) AS hash FROM b){_draw('u', '2 * i + 1')}{_draw('v', '2 * i + 2')}
SELECT symbol, i, hash, ROUND(u.x, 6) AS u, ROUND(v.x, 6) AS v, ROUND(SQRT(-2 * LN(u.x)) * COS(2 * PI() * v.x), 6) AS normal FROM hs JOIN u USING (symbol, i) JOIN v USING (symbol, i)"""
_MODELS = f"""{_WITH}, md AS (SELECT symbol, t AS created_at, 'v' || (i // 30) AS version, CASE (i // 30) % 4 WHEN 1 THEN 'challenger' WHEN 2 THEN 'retired' ELSE 'champion' END AS role,
CASE WHEN (i // 30) % 3 = 0 THEN 'ensemble' ELSE 'mlp' END AS kind FROM b WHERE i % 30 = 0)"""
_GUESS = f"{_WITH}, gu AS (SELECT symbol, i, c - o AS predicted, LEAD(c) OVER ({_S}) - c AS moved FROM b QUALIFY moved IS NOT NULL)"
#: The scanner's bars are the newest 250, numbered anew.
_LAST = f"g AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= {scanner.BARS})"


def _newest(sql: str) -> str:
    return sql.replace("g AS (SELECT event_type", "every AS (SELECT event_type").replace("GROUP BY ALL),", f"GROUP BY ALL),\n{_LAST},", 1)


SQL: dict[str, str] = {
    "seeded_draws": _DRAWS,
    "model_latest": f"{_MODELS} SELECT symbol, kind, MAX(created_at) AS created_at, ARG_MAX(version, created_at) AS version FROM md GROUP BY symbol, kind",
    "model_champion": f"{_MODELS} SELECT symbol, created_at, version FROM md WHERE role = 'champion' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY created_at DESC) = 1",
    "model_challenger": f"{_MODELS} SELECT symbol, created_at, version FROM md WHERE role = 'challenger' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY created_at DESC) = 1",
    "sign_accuracy": f"{_GUESS} SELECT symbol, COUNT(*) FILTER (moved <> 0) AS evaluable, ROUND(COALESCE(AVG(CASE WHEN predicted > 0 AND moved > 0 OR predicted < 0 AND moved < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (moved <> 0), 0.0::DOUBLE), 6) AS accuracy FROM gu GROUP BY symbol",
    "champion_drift": f"""{_GUESS}, gd AS (SELECT symbol, i, CASE WHEN predicted > 0 AND moved > 0 OR predicted < 0 AND moved < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM gu WHERE predicted <> 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) <= 50),
ge AS (SELECT symbol, COUNT(*) AS n, CASE WHEN COUNT(*) >= 20 THEN list_reduce(LIST(x ORDER BY i), lambda a, v: 0.9::DOUBLE * a + 0.1::DOUBLE * v) END AS e FROM gd GROUP BY symbol)
SELECT symbol, n, ROUND(e, 6) AS ewma, COALESCE(e < {_BASELINE}::DOUBLE - 0.1::DOUBLE, false) AS drifted FROM ge""",
    "module_chart_patterns": f"""WITH np AS ({_RECORDS['chart_pattern_newest']})
SELECT s.event_type AS symbol, COALESCE(ROUND(CASE bias WHEN 'bullish' THEN confidence ELSE -confidence END * CASE WHEN broken THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END, 6), 0.0::DOUBLE) AS signal, COALESCE(confidence, 0.0::DOUBLE) AS confidence
FROM (SELECT DISTINCT event_type FROM events) s LEFT JOIN np ON np.symbol = s.event_type""",
    "module_trendline": f"""{_REC}{_PIVOT}{_LINES}, tb AS (SELECT e.symbol, e.c, atr, u.score AS us, d.score AS ds, u.touches AS ut, d.touches AS dt, u.slope AS um, d.slope AS dm,
u.slope * e.i + u.intercept AS y1, d.slope * e.i + d.intercept AS y0 FROM ends e LEFT JOIN ln u ON u.symbol = e.symbol AND u.kind = 'high' LEFT JOIN ln d ON d.symbol = e.symbol AND d.kind = 'low'),
tc AS (SELECT *, CASE WHEN ds IS NULL OR us >= ds THEN us ELSE ds END AS s, CASE WHEN ds IS NULL OR us >= ds THEN ut ELSE dt END AS n, CASE WHEN ds IS NULL OR us >= ds THEN um ELSE dm END AS m,
CASE WHEN y1 > y0 THEN (c - y0) / (y1 - y0) * 2 - 1 END AS pl, CASE WHEN c - y1 >= 0.5::DOUBLE * atr THEN 1 WHEN y0 - c >= 0.5::DOUBLE * atr THEN -1 ELSE 0 END AS way FROM tb),
td AS (SELECT *, EXP(8 * m / atr) AS e8 FROM tc)
SELECT symbol, ROUND(CASE WHEN pl > 2 THEN 2.0::DOUBLE WHEN pl < -2 THEN -2.0::DOUBLE ELSE pl END, 6) AS position,
ROUND(CASE WHEN s IS NULL OR s < 0.3::DOUBLE OR n < 3 THEN 0.0::DOUBLE ELSE GREATEST(-1.0::DOUBLE, LEAST(1.0::DOUBLE, 0.5::DOUBLE * (e8 - 1) / (e8 + 1) + 0.3::DOUBLE * way
- 0.2::DOUBLE * COALESCE(CASE WHEN pl > 1 THEN 1.0::DOUBLE WHEN pl < -1 THEN -1.0::DOUBLE ELSE pl END, 0.0::DOUBLE))) END, 6) AS signal,
ROUND(CASE WHEN s IS NULL THEN 0.0::DOUBLE WHEN s < 0.3::DOUBLE OR n < 3 THEN LEAST(0.3::DOUBLE, s) WHEN way <> 0 THEN s ELSE 0.85::DOUBLE * s END, 6) AS confidence FROM td""",
    "vectors_scaled": """WITH v AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT dim, AVG(x) AS mean, CASE WHEN STDDEV_SAMP(x) >= 1e-12 THEN STDDEV_SAMP(x) ELSE 1.0::DOUBLE END AS std, MIN(x) AS low, CASE WHEN MAX(x) = MIN(x) THEN MIN(x) + 1 ELSE MAX(x) END AS high FROM v GROUP BY dim)
SELECT vec_id, dim, ROUND(GREATEST(-5.0::DOUBLE, LEAST(5.0::DOUBLE, (x - mean) / std)), 6) AS z, ROUND(2 * (x - low) / (high - low) - 1, 6) AS unit FROM v JOIN s USING (dim)""",
    "scanner": f"""WITH e AS ({_newest(_DECISIONS['ensemble'])}), r AS ({_newest(_DECISIONS['regime'])}), b AS ({_newest(_WITH)} SELECT * FROM b),
z AS (SELECT symbol, COUNT(*) AS bars, ARG_MIN(c, i) AS first, ARG_MAX(c, i) AS price FROM b GROUP BY symbol)
SELECT symbol, bars >= 100 AS enough, CASE WHEN bars >= 100 THEN ROUND(price, 6) ELSE 0.0 END AS price, CASE WHEN bars >= 100 AND first <> 0 THEN ROUND((price - first) / first * 100, 6) ELSE 0.0 END AS change_pct,
CASE WHEN bars >= 100 THEN raw_score ELSE 0.0 END AS raw_score, CASE WHEN bars >= 100 THEN probability ELSE 0.5 END AS probability, CASE WHEN bars >= 100 THEN direction ELSE 'neutral' END AS direction,
CASE WHEN bars >= 100 THEN confidence ELSE 0.0 END AS confidence, CASE WHEN bars >= 100 THEN trend || '-' || strength ELSE '—' END AS regime, CASE WHEN bars >= 100 THEN phase ELSE '—' END AS wyckoff, CASE WHEN bars >= 100 THEN participating ELSE 0 END AS modules
FROM z LEFT JOIN e USING (symbol) LEFT JOIN r USING (symbol)""",
}
