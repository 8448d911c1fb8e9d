"""Queries of what the store does with rows, of ticks, and of seeded orders, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learned import _draw
from .operators import learning, macro, store
from .outcomes import _EVENTS, _query
from .queries import _WITH
from .sources import candles
from .streaming import ticks

_NOW = 473_700


def _raw(bars: DataFrame) -> DataFrame:
    """Predictions as they come in, some without what they need."""
    i = F.col("i")
    kind = F.when(i % 9 == 1, F.lit("magnitude")).when(i % 9 != 2, F.element_at(F.array(*map(F.lit, store.PREDICTIONS)), (i % 4 + 1).cast("int")))
    return bars.select(F.when(i % 13 != 0, F.col("symbol")).alias("symbol"), "i", F.when(i % 11 == 3, "").otherwise("1h").alias("tf"), "t", F.when(i % 17 != 4, F.col("t") + 1).alias("close_at"), kind.alias("kind"), F.when(i % 19 != 5, F.col("c")).alias("payload"), F.when(i % 2 == 0, "v1").alias("version"))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar of symbols' widest bars and the fixed events, after changes and removals made of other bars."""
    bars = candles.load(spark, sf_dir)
    fixed = macro.calendar(spark, macro.EVENTS + _EVENTS).select("event", "at", "impact", "minutes")
    own = bars.where("i % 50 = 0").select(F.concat_ws("-", "symbol", "i").alias("event"), F.when(F.col("i") % 100 == 0, F.col("t") * 60).alias("at"), F.lit("low").alias("impact"), F.lit(5).alias("minutes"))
    changes = bars.where("i % 100 = 0 AND i > 0").select(F.concat_ws("-", "symbol", F.col("i") - F.col("i") % 200).alias("event"), F.when(F.col("i") % 300 != 0, F.col("t") * 60 + 7).alias("at"), F.when(F.col("i") % 200 == 0, "high").alias("impact"), F.lit(None).cast("int").alias("minutes"), F.col("i").cast("long").alias("seq"))
    gone = bars.where("i % 400 = 0").select(F.concat_ws("-", "symbol", "i").alias("event"))
    return store.removed(store.upserted(store.calendar(fixed.union(own)), changes), gone)


def _news(bars: DataFrame) -> DataFrame:
    rows = bars.select("symbol", "i", (F.col("h") - F.col("l") > F.col("c") * 0.003).alias("high_impact"), F.when(F.col("i") % 3 == 0, "macro").otherwise("crypto").alias("category"))
    return store.news(rows, high_only=True, category="macro")


def _settings(bars: DataFrame) -> DataFrame:
    rows = bars.select(F.concat_ws(".", "symbol", (F.col("i") % 5).cast("string")).alias("key"), F.col("c").cast("string").alias("value"), F.col("t").alias("at")).where("i % 5 < 3")
    wanted = bars.select("symbol").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "symbol").select(F.concat_ws(".", "symbol", F.col("k").cast("string")).alias("key"), F.lit("none").alias("fallback"))
    return store.settings(rows, wanted)


def _ticks(bars: DataFrame) -> DataFrame:
    """Each bar's open as a tick within it, and its close."""
    both = F.explode(F.array(F.struct(F.col("o").alias("c"), F.lit(False).alias("closed")), F.struct("c", F.lit(True).alias("closed")))).alias("x")
    made = ticks.updates(bars.select("symbol", F.col("t").alias("at"), both).select("symbol", "at", "x.*"))
    return made.select("symbol", F.col("at").alias("t"), "closed", "price", "change", "change_pct", "dir")


def _sizes(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("seed", learning.hashed(F.col("symbol")))


def _gathered(bars: DataFrame) -> DataFrame:
    """Bars in drawn order, every third place again with the first of them."""
    order = learning.shuffled_index(_sizes(bars)).select("symbol", "place", "i")
    again = order.where("place % 3 = 0").select("symbol", (F.col("place") + 1_000_000).alias("place"), F.lit(0).alias("i"))
    return learning.gathered(bars.select("symbol", "i", "c"), order.union(again))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "predictions_saved": _query(lambda b: store.predictions(_raw(b), _NOW)),
    "predictions_taken": _query(lambda b: store.taken(store.predictions(_raw(b), _NOW)).groupBy("symbol", "kind").agg(F.count("*").alias("n"))),
    "calendar_kept": _changed,
    "news_filtered": _query(_news),
    "settings_read": _query(_settings),
    "price_updates": _query(_ticks),
    "shuffled_index": _query(lambda b: learning.shuffled_index(_sizes(b))),
    "gathered": _query(_gathered),
}

_RAW = f"""{_WITH}, rw AS (SELECT CASE WHEN i % 13 <> 0 THEN symbol END AS symbol, i, CASE WHEN i % 11 = 3 THEN '' ELSE '1h' END AS tf, t, CASE WHEN i % 17 <> 4 THEN t + 1 END AS close_at,
CASE i % 9 WHEN 1 THEN 'magnitude' WHEN 2 THEN 'direction' ELSE ['direction', 'return', 'interval', 'set'][i % 4 + 1] END AS kind, CASE WHEN i % 19 <> 5 THEN ROUND(c, 6) END AS payload, CASE WHEN i % 2 = 0 THEN 'v1' ELSE 'unknown' END AS version FROM b),
sv AS (SELECT *, CAST(NULL AS VARCHAR) AS regime, false AS validated, {_NOW} AS created_at, CASE WHEN symbol IS NULL THEN 'symbol required' WHEN tf = '' THEN 'tf required' WHEN close_at IS NULL THEN 'close_at required'
    WHEN kind = 'magnitude' THEN 'unknown kind' WHEN payload IS NULL THEN 'payload required' END AS error FROM rw)"""
_FIXED = ", ".join(f"('{event}', TIMESTAMP '{at}', '{impact}', {minutes})" for event, at, impact, minutes in macro.EVENTS + _EVENTS)
_ORDER = f"""{_WITH}, hs0 AS (SELECT symbol, COUNT(*) AS n, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(symbol, ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda h, s: CAST((CAST(xor(h, s) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT)) AS hash FROM b GROUP BY symbol),
hs AS (SELECT symbol, n, hash, i FROM hs0, range(1, n) r(i)){_draw('u', 'i')},
sw AS (SELECT symbol, ANY_VALUE(n) AS n, LIST({{'a': n - i, 'b': CAST(FLOOR(x * (n - i + 1)) AS BIGINT)}} ORDER BY i) AS steps FROM hs JOIN u USING (symbol, i) GROUP BY symbol),
od AS (SELECT symbol, n, list_reduce(steps, lambda l, s: list_transform(l, lambda e, k: CASE k - 1 WHEN s.a THEN l[s.b + 1] WHEN s.b THEN l[s.a + 1] ELSE e END), range(0, n)) AS l FROM sw),
ix AS MATERIALIZED (SELECT symbol, CAST(UNNEST(range(0, n)) AS INTEGER) AS place, CAST(UNNEST(l) AS INTEGER) AS i FROM od)"""

SQL: dict[str, str] = {
    "predictions_saved": f"{_RAW} SELECT * FROM sv",
    "predictions_taken": f"{_RAW} SELECT symbol, kind, COUNT(*) AS n FROM sv WHERE error IS NULL GROUP BY symbol, kind",
    "calendar_kept": f"""{_WITH}, ca AS (SELECT event, CAST(date_diff('minute', TIMESTAMP '1970-01-01', stamp) AS BIGINT) AS at_, impact, minutes, -1 AS seq FROM (VALUES {_FIXED}) x(event, stamp, impact, minutes)
UNION ALL SELECT symbol || '-' || i, t * 60, 'low', 5, -1 FROM b WHERE i % 100 = 0
UNION ALL SELECT symbol || '-' || (i - i % 200), t * 60 + 7, CASE WHEN i % 200 = 0 THEN 'high' END, NULL, i FROM b WHERE i % 100 = 0 AND i > 0 AND i % 300 <> 0),
cb AS (SELECT event, ARG_MAX(at_, seq) AS at_, ARG_MAX(impact, seq) AS impact, ARG_MAX(minutes, seq) AS minutes FROM ca GROUP BY event),
cc AS (SELECT * FROM cb WHERE event NOT IN (SELECT symbol || '-' || i FROM b WHERE i % 400 = 0))
SELECT event, at_ AS "at", impact, minutes, CAST(row_number() OVER (ORDER BY at_, event) AS INTEGER) AS place FROM cc""",
    "news_filtered": f"{_WITH} SELECT symbol, i, true AS high_impact, 'macro' AS category FROM b WHERE h - l > c * 0.003::DOUBLE AND i % 3 = 0",
    "settings_read": f"""{_WITH}, ky AS (SELECT DISTINCT symbol || '.' || k AS key FROM b, range(0, 5) r(k)), sn AS (SELECT symbol || '.' || (i % 5) AS key, ARG_MAX(c, t) AS c FROM b WHERE i % 5 < 3 GROUP BY ALL)
SELECT key, COALESCE(CAST(c AS VARCHAR), 'none') AS value FROM ky LEFT JOIN sn USING (key)""",
    "price_updates": f"""{_WITH}, tk AS (SELECT symbol, t, false AS closed, o AS price, LAG(c) OVER (PARTITION BY symbol ORDER BY i) AS p FROM b UNION ALL SELECT symbol, t, true, c, LAG(c) OVER (PARTITION BY symbol ORDER BY i) FROM b)
SELECT symbol, t, closed, ROUND(price, 6) AS price, ROUND(COALESCE(price - p, 0), 6) AS change, ROUND(COALESCE((price - p) / p * 100, 0), 6) AS change_pct, CASE WHEN price > p THEN 'up' WHEN price < p THEN 'down' ELSE 'flat' END AS dir FROM tk""",
    "shuffled_index": f"{_ORDER} SELECT * FROM ix",
    "gathered": f"""{_ORDER}, pk AS (SELECT * FROM ix UNION ALL SELECT symbol, place + 1000000, 0 FROM ix WHERE place % 3 = 0) SELECT pk.symbol, place, pk.i, ROUND(c, 6) AS c FROM pk JOIN b ON b.symbol = pk.symbol AND b.i = pk.i""",
}
