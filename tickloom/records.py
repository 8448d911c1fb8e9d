"""Queries of chart patterns, of the store's calls and of anti-patterns, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charts_sql import _GRADE, ALL, CHARTS
from .decisions import _REC, _rounded
from .functions import indicators as I
from .operators import chart_patterns, ledger, macro, structure, validation
from .outcomes import _EVENT_ROWS, _EVENTS, _MS, _VD, _mistakes, _query, _verdicts
from .queries import _PIVOT, _S, _WITH
from .sources import candles

#: A time within the span of the bars: hours since 1970.
_NOW = 473_700


_CALLED = ("symbol", "i", "t", "kind", "version", "regime", "validated", "close_at")


def _predictions(bars: DataFrame) -> DataFrame:
    """Stands in for the store's table: predictions by rule, with the columns that its calls look at."""
    i = F.col("i")
    made = validation.sample_predictions(bars)
    made = made.withColumns({"dir": F.when(F.col("i") % 8 != 0, F.col("dir")), "yhat": F.when(F.col("i") % 11 != 0, F.col("yhat")), "lo": F.when(F.col("i") % 10 == 2, F.lit(1.0)).otherwise(F.col("lo"))})
    return made.withColumns({"version": F.concat(F.lit("v"), (i % 2).cast("string")), "regime": F.when(i % 3 == 1, "trend").when(i % 3 == 2, "range"), "validated": i % 5 < 2, "close_at": F.col("t") + 1 + i % 3})


def _changes(bars: DataFrame) -> DataFrame:
    """Every seventh bar again with another close, every fourteenth twice, and a bar past the end of each symbol."""
    again = bars.where("i % 7 = 0").withColumns({"c": F.col("c") + 1, "seq": F.lit(0).cast("long")})
    twice = bars.where("i % 14 = 0").withColumns({"c": F.col("c") + 2, "seq": F.lit(1).cast("long")})
    ends = bars.groupBy("symbol").agg((F.max("t") + 1).alias("t"), F.max_by("c", "t").alias("c")).withColumn("seq", F.lit(2).cast("long"))
    return again.select("symbol", "t", "c", "seq").union(twice.select("symbol", "t", "c", "seq")).union(ends.select("symbol", "t", "c", "seq"))


def _levels(bars: DataFrame) -> DataFrame:
    """The strongest twenty levels of each symbol, half an ATR apart; the nearest resistance is the strongest one above the
    close, the nearest support the weakest one below."""
    last = I.recurrences(bars).groupBy("symbol").agg(F.max_by(F.struct("c", "atr14"), "i").alias("x")).select("symbol", "x.*")
    ends = last.select("symbol", "c", F.coalesce(0.5 * F.col("atr14"), 0.005 * F.col("c")).alias("tolerance"))
    found = structure.levels(bars, tolerances=ends.select("symbol", "tolerance"))
    strong = ledger.newest(found.withColumn("cheap", -F.col("price")), ["strength", "cheap"], 20, ["symbol"]).join(ends, "symbol")
    above, below = F.when(F.col("price") >= F.col("c"), F.struct("strength", "cheap")), F.when(F.col("price") <= F.col("c"), F.struct("strength", "price"))
    return strong.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("price", above).alias("nearest_resistance"), F.min_by("price", below).alias("nearest_support"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _anti(vectors: DataFrame) -> DataFrame:
    return ledger.anti_patterns(vectors, "label", F.when((F.col("vec_id") + F.col("label")) % 10 < F.col("label") % 8 + 2, 1.0).otherwise(0.0))


def _vetoed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    found = ledger.nearest(vectors, _anti(vectors), "label").withColumns({"raw": (F.col("vec_id") % 41 - 20) / 20.0, "sure": (F.col("vec_id") % 11) / 10.0})
    found = found.withColumns(ledger.veto(F.col("raw"), F.col("sure"), F.col("p.hit_rate"), F.col("in_radius")))
    return found.select("vec_id", F.col("p.pattern").alias("pattern"), F.col("p.d").alias("distance"), "in_radius", "veto", "signal", "confidence", "direction", "probability")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = macro.calendar(spark, macro.EVENTS + _EVENTS)
    rows = calendar.select("event", F.col("at").alias("minute"))
    return ledger.near_events(candles.load(spark, sf_dir).select("symbol", "i", "t"), rows, 180).select("symbol", "i", "event", "delta")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "chart_patterns": _query(lambda b: chart_patterns.chart_patterns(I.recurrences(b))),
    "chart_pattern_newest": _query(lambda b: chart_patterns.newest(chart_patterns.chart_patterns(I.recurrences(b)))),
    "predictions_matching": _query(lambda b: ledger.matching(_predictions(b).select(*_CALLED), kind="return", version="v1", regime=None, validated=False)),
    "predictions_due": _query(lambda b: ledger.due(_predictions(b).select(*_CALLED), _NOW, kind="direction")),
    "predictions_drained": _query(lambda b: ledger.drained(_predictions(b), b, _NOW).select("symbol", "i", "kind", "close_at", "missing", "ok", "hit", "covered", "abs_error", "state")),
    "validations_between": _query(lambda b: ledger.between(_verdicts(b), _NOW - 200, _NOW).where("NOT missing").select("symbol", "t", "kind", "hit")),
    "validations_recent": _query(lambda b: ledger.newest(_verdicts(b).where("NOT missing"), ["t"], 20, ["symbol"]).select("symbol", "t", "kind", "hit")),
    "mistakes_recent": _query(lambda b: ledger.newest(_mistakes(b), ["i"], 50, ["symbol"]).select("symbol", "i", "error_type")),
    "mistakes_by_kind": _query(lambda b: ledger.matching(_mistakes(b).select("symbol", "i", "error_type"), error_type="interval-miss")),
    "bars_between": _query(lambda b: ledger.newest(ledger.between(b, _NOW - 100, _NOW), ["t"], 30, ["symbol"]).select("symbol", "t", "c")),
    "bar_latest": _query(lambda b: ledger.between(b, None, _NOW).groupBy("symbol").agg(F.max("t").alias("t"), F.max_by("c", "t").alias("c"))),
    "bars_upserted": _query(lambda b: ledger.upserted(b.select("symbol", "t", "c"), _changes(b), ["symbol", "t"])),
    "bars_counted": _query(lambda b: b.join(_changes(b).where("seq = 1").select("symbol", "t"), ["symbol", "t"], "left_anti").groupBy("symbol").agg(F.count("*").alias("n"))),
    "predictions_marked": _query(lambda b: ledger.marked(_predictions(b).select(*_CALLED), ledger.drained(_predictions(b), b, _NOW), ["symbol", "i"])),
    "next_closes": _query(lambda b: b.select("symbol", "i", F.explode(F.array(*map(F.lit, [*ledger.TIMEFRAMES, "7m"]))).alias("tf"), "t").select("symbol", "i", "tf", ledger.next_close(F.col("t") * 3_600_000, F.col("tf")).alias("next_close"))),
    "profile_letters": _query(lambda b: b.select("symbol", "i", ledger.letters(F.col("i")).alias("letter"), ledger.letters(F.col("i") * 131, structure.session(F.pmod("t", F.lit(24)))).alias("in_session"))),
    "events_near": _near,
    "summary_levels": _query(_levels),
    "anti_patterns": lambda spark, sf_dir: _rounded(_anti(_vectors(spark, sf_dir)).drop("centre")),
    "vetoed_signals": lambda spark, sf_dir: _rounded(_vetoed(spark, sf_dir)),
}

_PR = f""", pd AS (SELECT symbol, i, t, ['direction', 'return', 'interval', 'set'][i % 4 + 1] AS kind, 'v' || (i % 2) AS version,
CASE i % 3 WHEN 1 THEN 'trend' WHEN 2 THEN 'range' END AS regime, i % 5 < 2 AS validated, t + 1 + i % 3 AS close_at FROM b)"""
#: Due predictions with their verdicts, kind by kind.
_DRAINED = f""", dn0 AS (SELECT pd.symbol, pd.i, pd.kind, close_at, s.o, s.c AS ref, n.o AS no, n.c AS nc, n.c IS NULL AS missing FROM pd JOIN b s ON s.symbol = pd.symbol AND s.i = pd.i
    LEFT JOIN b n ON n.symbol = pd.symbol AND n.t = close_at WHERE NOT validated AND close_at <= {_NOW}),
dn1 AS (SELECT *, CASE WHEN i % 8 = 0 THEN NULL WHEN ref > o THEN 'up' WHEN ref < o THEN 'down' ELSE 'flat' END AS dir, CASE WHEN ABS(nc - no) <= ABS(no) * 0.0005::DOUBLE THEN 'flat' WHEN nc > no THEN 'up' ELSE 'down' END AS way,
    (nc - ref) / ref AS r, CASE WHEN i % 11 <> 0 THEN (i % 7 - 3) / 1000.0::DOUBLE END AS yhat, CASE WHEN i % 10 = 2 THEN 1.0::DOUBLE ELSE -0.001::DOUBLE END AS lo, 0.001::DOUBLE * (1 + i % 3) AS hi,
    CASE i % 3 WHEN 0 THEN ['long'] WHEN 1 THEN ['long', 'short'] ELSE [] END AS classes FROM dn0),
dn2 AS (SELECT *, NOT missing AND CASE kind WHEN 'direction' THEN dir IS NOT NULL WHEN 'return' THEN yhat IS NOT NULL WHEN 'interval' THEN lo <= hi ELSE true END AS ok FROM dn1),
dn AS (SELECT *, CASE WHEN ok AND kind = 'direction' THEN dir <> 'flat' AND dir = way END AS hit,
    CASE WHEN NOT ok THEN NULL WHEN kind = 'interval' THEN r BETWEEN lo AND hi WHEN kind = 'set' THEN list_contains(classes, CASE way WHEN 'up' THEN 'long' WHEN 'down' THEN 'short' ELSE 'flat' END) END AS covered,
    CASE WHEN ok AND kind = 'return' THEN ABS(r - yhat) END AS abs_error FROM dn2)"""


def _letter(n: str) -> str:
    """Letters of a number, written out for up to five of them."""
    one = lambda x: f"chr(CAST(65 + ({x}) % 26 AS INTEGER))"
    parts, left = [], n
    for _ in range(5):
        parts.append(f"CASE WHEN {left} >= 0 THEN {one(left)} ELSE '' END")
        left = f"(CASE WHEN {left} >= 0 THEN ({left}) // 26 - 1 ELSE -1 END)"
    return " || ".join(reversed(parts))


_CHANGES = """, ch AS (SELECT symbol, t, c + 1 AS c, 0 AS seq FROM b WHERE i % 7 = 0 UNION ALL SELECT symbol, t, c + 2, 1 FROM b WHERE i % 14 = 0
UNION ALL SELECT symbol, MAX(t) + 1, ARG_MAX(c, t), 2 FROM b GROUP BY symbol)"""
_ENDS = ", le AS MATERIALIZED (SELECT symbol, i AS n, c AS z, CASE WHEN atr14 > 0 THEN atr14 ELSE GREATEST(1e-9, ABS(c) * 0.005::DOUBLE) END AS atr FROM rec WHERE i >= 7 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1)"
_CP = f"""{_REC}{_PIVOT}{_ENDS}{CHARTS}, cp AS (SELECT symbol, name, bias, {_GRADE} AS confidence, ROUND(target, 6) AS target,
ROUND(invalidation, 6) AS invalidation, at_bar, n - at_bar AS age, broken, ROUND(neckline, 6) AS neckline, detector FROM {ALL} WHERE {_GRADE} IS NOT NULL)"""
_VEC = """WITH v AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, dim, AVG(x) AS y FROM v GROUP BY ALL),
d AS (SELECT vec_id, v.label, m.label AS p, SUM((x - y) * (x - y)) AS d FROM v JOIN m ON m.dim = v.dim GROUP BY ALL),
o AS (SELECT vec_id, label, d, CASE WHEN (vec_id + label) % 10 < label % 8 + 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS miss, row_number() OVER (PARTITION BY label ORDER BY d) - 1 AS r, COUNT(*) OVER (PARTITION BY label) AS n FROM d WHERE p = label),
ap AS (SELECT label, COUNT(*) AS n, AVG(1 - miss) AS hit_rate, MAX(d) FILTER (r = FLOOR(0.9::DOUBLE * (n - 1))) AS radius FROM o GROUP BY label)"""

SQL: dict[str, str] = {
    "chart_patterns": f"{_CP} SELECT * FROM cp",
    "chart_pattern_newest": f"{_CP} SELECT symbol, name, bias, confidence, target, invalidation, broken, age FROM cp QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY at_bar DESC, confidence DESC, detector) = 1",
    "predictions_matching": f"{_WITH}{_PR} SELECT * FROM pd WHERE kind = 'return' AND version = 'v1' AND regime IS NULL AND NOT validated",
    "predictions_due": f"{_WITH}{_PR} SELECT * FROM pd WHERE kind = 'direction' AND NOT validated AND close_at <= {_NOW}",
    "predictions_drained": f"{_WITH}{_PR}{_DRAINED} SELECT symbol, i, kind, close_at, missing, ok, hit, covered, ROUND(abs_error, 6) AS abs_error, CASE WHEN ok THEN 'validated' ELSE 'pending' END AS state FROM dn",
    "predictions_marked": f"{_WITH}{_PR}{_DRAINED} SELECT pd.* EXCLUDE (validated), pd.validated OR COALESCE(ok, false) AS validated FROM pd LEFT JOIN dn USING (symbol, i)",
    "validations_between": f"{_WITH}{_VD} SELECT symbol, t, kind, hit FROM vd WHERE t BETWEEN {_NOW - 200} AND {_NOW} AND NOT missing",
    "validations_recent": f"{_WITH}{_VD} SELECT symbol, t, kind, hit FROM vd WHERE NOT missing QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= 20",
    "mistakes_recent": f"{_REC}{_VD}{_MS} SELECT symbol, i, error_type FROM ms QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) <= 50",
    "mistakes_by_kind": f"{_REC}{_VD}{_MS} SELECT symbol, i, error_type FROM ms WHERE error_type = 'interval-miss'",
    "bars_between": f"{_WITH} SELECT symbol, t, ROUND(c, 6) AS c FROM b WHERE t BETWEEN {_NOW - 100} AND {_NOW} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= 30",
    "bar_latest": f"{_WITH} SELECT symbol, MAX(t) AS t, ROUND(ARG_MAX(c, t), 6) AS c FROM b WHERE t <= {_NOW} GROUP BY symbol",
    "bars_upserted": f"{_WITH}{_CHANGES} SELECT symbol, t, ROUND(c, 6) AS c FROM (SELECT symbol, t, c, -1 AS seq FROM b UNION ALL SELECT * FROM ch) QUALIFY row_number() OVER (PARTITION BY symbol, t ORDER BY seq DESC) = 1",
    "bars_counted": f"{_WITH} SELECT symbol, COUNT(*) AS n FROM b WHERE i % 14 <> 0 GROUP BY symbol",
    "next_closes": f"{_WITH}, tf(tf, ms) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v})' for k, v in ledger.TIMEFRAMES.items())}, ('7m', NULL)) SELECT symbol, i, tf, CAST(t * 3600000 + 2 * ms + 4000 AS BIGINT) AS next_close FROM b CROSS JOIN tf",
    "profile_letters": f"""{_WITH}, tl AS (SELECT symbol, i, i * 131 AS n, CASE WHEN t % 24 >= 22 OR t % 24 < 2 THEN 'a' WHEN t % 24 BETWEEN 7 AND 9 THEN 'l' WHEN t % 24 BETWEEN 12 AND 15 THEN 'n' ELSE 'o' END AS s FROM b)
SELECT symbol, i, {_letter('i')} AS letter, s || {_letter('n')} AS in_session FROM tl""",
    "events_near": f"{_WITH}, e AS (SELECT event, CAST(date_diff('minute', TIMESTAMP '1970-01-01', stamp) AS BIGINT) AS a FROM (VALUES {_EVENT_ROWS}) x(event, stamp, weight, minutes)) SELECT symbol, i, event, ABS(a - t * 60) AS delta FROM b JOIN e ON a BETWEEN t * 60 - 180 AND t * 60 + 180",
    "summary_levels": f"""{_REC}{_PIVOT}, le AS MATERIALIZED (SELECT symbol, c, COALESCE(0.5::DOUBLE * atr14, 0.005::DOUBLE * c) AS tol FROM rec QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1),
la AS (SELECT f.*, tol, (SELECT MAX(i) FROM f g WHERE g.symbol = f.symbol) - i AS age, COALESCE(CAST(price - LAG(price) OVER (PARTITION BY f.symbol ORDER BY price, i, kind) > tol AS INTEGER), 0) AS apart FROM f JOIN le USING (symbol)),
ls AS (SELECT *, SUM(apart) OVER (PARTITION BY symbol ORDER BY price, i, kind ROWS UNBOUNDED PRECEDING) AS island FROM la), lv AS (SELECT symbol, MEDIAN(price) AS price, SUM(POW(0.5::DOUBLE, age / 500.0::DOUBLE)) AS strength FROM ls GROUP BY symbol, island),
lt AS (SELECT * FROM lv JOIN le USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY strength DESC, price) <= 20)
SELECT symbol, COUNT(*) AS n, ROUND(ARG_MAX(price, (strength, -price)) FILTER (price >= c), 6) AS nearest_resistance, ROUND(ARG_MIN(price, (strength, price)) FILTER (price <= c), 6) AS nearest_support FROM lt GROUP BY symbol""",
    "anti_patterns": f"{_VEC} SELECT label, n, ROUND(hit_rate, 6) AS hit_rate, ROUND(radius, 6) AS radius FROM ap",
    "vetoed_signals": f"""{_VEC}, nn AS (SELECT vec_id, ARG_MIN(p, (d, p)) AS p, MIN(d) AS d FROM d GROUP BY vec_id), s AS (SELECT vec_id, p, d, d <= radius AS near, hit_rate, (vec_id % 41 - 20) / 20.0::DOUBLE AS x, (vec_id % 11) / 10.0::DOUBLE AS y FROM nn JOIN ap ON ap.label = p),
q AS (SELECT *, CASE WHEN near AND hit_rate <= 0.25 THEN 'full' WHEN near AND hit_rate <= 0.4 THEN 'partial' ELSE 'pass' END AS veto FROM s), r AS (SELECT *, CASE veto WHEN 'full' THEN 0.0 WHEN 'partial' THEN x * 0.4::DOUBLE ELSE x END AS signal FROM q)
SELECT vec_id, p AS pattern, ROUND(d, 6) AS distance, near AS in_radius, veto, ROUND(signal, 6) AS signal, ROUND(CASE veto WHEN 'full' THEN 0.0 WHEN 'partial' THEN y * 0.5::DOUBLE ELSE y END, 6) AS confidence,
CASE WHEN ABS(signal) < 0.05 THEN 'neutral' WHEN signal > 0 THEN 'long' ELSE 'short' END AS direction, ROUND(0.5 + 0.5 * signal, 6) AS probability FROM r""",
}
