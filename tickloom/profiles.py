"""Queries of the volume profile of a session and of profiles in short, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import structure
from .queries import _WITH, _bars


def _day() -> Column:
    """When the UTC day of a symbol's newest bar began."""
    newest = F.max("t").over(Window.partitionBy("symbol"))
    return newest - F.pmod(newest, F.lit(24))


def _short(bars: DataFrame, session_start: Column | None, buckets: int) -> DataFrame:
    found = structure.profile_summary(bars, buckets, session_start=session_start)
    return found.withColumns({c: F.round(c, 6) for c in ("poc", "vah", "val", "vapct")})


QUERIES = {
    "session_profile": _bars(lambda b: structure.volume_profile(b, session_start=_day())),
    "session_profile_summary": _bars(lambda b: _short(b, _day(), 2)),
    "profile_summary": _bars(lambda b: _short(b, None, 24)),
}


def _profile(buckets: int, since: str) -> str:
    """vp (every bucket of every symbol) and e (their spans); since: the first bar of the session."""
    return f"""{_WITH.replace("WITH w", "WITH RECURSIVE w")},
n AS (SELECT *, COUNT(*) OVER (PARTITION BY symbol) AS n, MAX(t) OVER (PARTITION BY symbol) AS newest FROM b),
y AS (SELECT *, {since} AS since FROM n WHERE i >= n - 200),
z AS (SELECT * FROM y WHERE since IS NULL OR i >= since),
e AS MATERIALIZED (SELECT symbol, MIN(l) AS lo, MAX(h) AS hi, (MAX(h) - MIN(l)) / {buckets} AS step, COUNT(*) AS bars FROM z
  GROUP BY symbol HAVING MAX(h) > MIN(l) AND COUNT(*) >= 2),
placed AS (SELECT z.symbol, LEAST({buckets - 1}, GREATEST(0, CAST(FLOOR(((h + l + c) / 3.0::DOUBLE - lo) / step) AS INTEGER))) AS bucket,
  c >= o AS rose, v FROM z JOIN e ON e.symbol = z.symbol),
s AS (SELECT symbol, bucket, SUM(v) AS volume, SUM(v) FILTER (rose) AS up, SUM(v) FILTER (NOT rose) AS down FROM placed GROUP BY ALL),
vp AS MATERIALIZED (SELECT e.symbol, CAST(g.x AS INTEGER) AS bucket, COALESCE(volume, 0.0) AS volume, COALESCE(up, 0.0) AS up,
  COALESCE(down, 0.0) AS down FROM e CROSS JOIN range({buckets}) g(x) LEFT JOIN s ON s.symbol = e.symbol AND s.bucket = g.x)"""


def _in_short(buckets: int, since: str) -> str:
    return f"""{_profile(buckets, since)},
lists AS MATERIALIZED (SELECT symbol, list(volume ORDER BY bucket) AS vs, SUM(volume) AS total FROM vp GROUP BY symbol),
peak AS (SELECT *, list_position(vs, list_max(vs)) AS top FROM lists),
area(symbol, vs, total, top, a, z, held) AS (SELECT symbol, vs, total, top, top, top, vs[top] FROM peak
  UNION ALL SELECT symbol, vs, total, top, CASE WHEN rise THEN a ELSE a - 1 END, CASE WHEN rise THEN z + 1 ELSE z END,
    held + CASE WHEN rise THEN vs[z + 1] ELSE vs[a - 1] END
  FROM (SELECT *, a = 1 OR (z < {buckets} AND vs[z + 1] >= vs[a - 1]) AS rise FROM area
    WHERE held < 0.7::DOUBLE * total AND (a > 1 OR z < {buckets}))),
done AS (SELECT * FROM area QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY z - a DESC) = 1),
mid AS (SELECT symbol, list_sort(vs)[{buckets // 2 + 1}] AS m, list_avg(list_filter(vs, lambda x: x > 0)) AS filled FROM lists),
base AS (SELECT symbol, CASE WHEN m > 0 THEN m ELSE filled END AS base FROM mid),
cnt AS (SELECT vp.symbol, COUNT(*) FILTER (volume >= 1.5 * base) AS hvn,
  COUNT(*) FILTER (volume < 1.5 * base AND volume > 0 AND volume <= 0.4::DOUBLE * base) AS lvn
  FROM vp JOIN base ON base.symbol = vp.symbol GROUP BY vp.symbol)
SELECT e.symbol, ROUND(lo + step * (top - 0.5), 6) AS poc, ROUND(lo + step * z, 6) AS vah, ROUND(lo + step * (a - 1), 6) AS val,
  ROUND(held / total, 6) AS vapct, {buckets} AS buckets, bars, hvn, lvn
FROM e JOIN done ON done.symbol = e.symbol JOIN cnt ON cnt.symbol = e.symbol"""


_TODAY = "MIN(i) FILTER (t >= newest - newest % 24) OVER (PARTITION BY symbol)"

SQL = {
    "session_profile": _profile(24, _TODAY) + " SELECT * FROM vp",
    "session_profile_summary": _in_short(4, _TODAY),
    "profile_summary": _in_short(24, "NULL"),
}
