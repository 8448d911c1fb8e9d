"""Queries of the decision layer: its vector, pool, networks and champions, and the modules within events, with SQL where
it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decisions import _NEWEST
from .learned import _MODELS as _MODEL_ROWS
from .learned import _models
from .operators import antipatterns, champions, macro, meta, modules
from .outcomes import _EVENTS, _proxied, _query
from .outcomes import SQL as _OUTCOMES
from .plans import asof, backtest
from .plans.kept import kept
from .records import _vectors
from .sources import candles
from .state_sql import _VOTES, states, votes
from .walk import _cut

#: The hour of an event of high impact, in hours since 1970, and times at which cycles run: newest bars that they know.
_EVENT_HOUR = 473_922
_CUTS = (150, 60, 1)
_POOL = "symbol string, id string, t long, created_at long, vector array<float>, label int, pending boolean"


def _within_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = candles.load(spark, sf_dir).where(F.col("t") <= _EVENT_HOUR)
    newest = asof.newest(bars)
    high = macro.calendar(spark, macro.EVENTS + _EVENTS).where("weight = 3")
    tags = macro.tagged(newest.select("symbol", "i", "t"), high).select("symbol", F.col("event").isNotNull().alias("in_event"))
    made = modules.evaluate(newest.join(tags, "symbol"))
    return made.select("symbol", "module", *(F.round(F.col(x), 6).alias(x) for x in ("signal", "confidence", "applied")))


def _vector(bars: DataFrame) -> DataFrame:
    world = macro.macro_state(_proxied(bars)).select(F.col("score").alias("macro_score"), F.col("label").alias("macro_label"))
    state = meta.voted(asof.newest(bars)).join(F.broadcast(world))  # one row
    return meta.vectors(state).select("symbol", F.posexplode("vector").alias("slot", "value")).withColumn("value", F.col("value").cast("double"))


def _walked(bars: DataFrame) -> DataFrame:
    """States of the newest bars of each symbol from the two hundredth on, the newest one included."""
    return asof.states(backtest.newest_bars(bars, backtest.BARS), lambda rows: rows.where(F.col("i") >= backtest.WARMUP))


def _realized(bars: DataFrame) -> DataFrame:
    """(symbol, prediction, realized) of bars that another follows."""
    cut = backtest.newest_bars(bars, backtest.BARS)
    moved = backtest.trades(cut.withColumn("direction", F.lit("neutral")), backtest.WARMUP)
    return moved.select("symbol", F.col("i").alias("prediction"), "realized")


def _pool(bars: DataFrame) -> DataFrame:
    made = meta.vectors(meta.voted(_walked(bars))).select("symbol", F.col("i").alias("prediction"), "t", F.col("t").alias("created_at"), "vector")
    first = meta.labelled(meta.paired(bars.sparkSession.createDataFrame([], _POOL), made), _realized(bars))
    again = made.where("prediction % 2 = 0").select("symbol", "prediction", F.lit("down").alias("realized"))  # comes too late for rows that have a label
    return meta.labelled(first, again)


def _trained(bars: DataFrame) -> DataFrame:
    pool = _pool(bars)
    losses = F.posexplode(F.arrays_zip("losses", "held_out_losses")).alias("epoch", "x")
    return meta.train(pool).select("symbol", "rows", "accuracy", "parameters", losses).select("symbol", "rows", "accuracy", "parameters", "epoch", F.col("x.losses").alias("loss"), F.col("x.held_out_losses").alias("held_out_loss"))


def _decided(bars: DataFrame) -> DataFrame:
    """The newest bars' calls, by networks for all but the first symbol."""
    pool = kept(_pool(bars))
    newest = asof.newest(bars)
    models = meta.train(pool).where("trained AND symbol <> 'click'").select("symbol", "weights")
    rows = meta.vectors(meta.voted(newest)).select("symbol", "i", "vector")
    ruled = modules.ensemble(modules.evaluate(newest, ("symbol", "i")), ("symbol", "i"))
    return meta.decide(rows, models, ruled)


def _cycles(bars: DataFrame) -> DataFrame:
    """Three cycles over a pool that grows, each on the models that the one before has left."""
    pool = kept(_pool(bars))
    last = pool.groupBy("symbol").agg(F.max("t").alias("last"))
    models, made = bars.sparkSession.createDataFrame([], champions.MODELS), []
    for at, back in enumerate(_CUTS, 1):
        known = pool.join(last, "symbol").where(F.col("t") <= F.col("last") - back).drop("last")
        done = kept(champions.cycle(models, known, at))
        models = champions.models_after(done)
        made.append(champions.recorded(done, at))
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return champions.recent(out)


def _recovered(bars: DataFrame) -> DataFrame:
    drifted = bars.groupBy("symbol").agg((F.max("i") % 2 == 0).alias("drifted"))
    return champions.recovered(_models(bars), drifted).select("symbol", "created_at", "version", F.coalesce("role", F.lit("champion")).alias("role"))


def _assigned(bars: DataFrame) -> DataFrame:
    models = _models(bars)
    newest = models.groupBy("symbol").agg(F.max_by("version", "created_at").alias("version")).withColumn("role", F.lit("champion"))
    return champions.with_role(models, newest).select("symbol", "created_at", "version", F.coalesce("role", F.lit("champion")).alias("role"))


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as mistakes and as correct calls, by rule."""
    rows = _vectors(spark, sf_dir)
    i, label = F.col("vec_id"), F.col("label")
    right = ((i + label) % 3 == 0) | (label.isin(1, 5) & (i % 2 == 0))
    way, kind = F.when(i % 4 == 0, "short").otherwise("long"), F.concat(F.lit("r"), (label % 4).cast("string"))
    return rows.where(~right).select("vec_id", "vector", way.alias("direction"), kind.alias("regime")), rows.where(right).select("vector")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return antipatterns.discovered(*_calls(spark, sf_dir))


def _top_modules(bars: DataFrame) -> DataFrame:
    places = modules.registry(bars.sparkSession).select("module", F.col("place").alias("at"))
    return antipatterns.top_modules(modules.evaluate(asof.newest(bars)).join(F.broadcast(places), "module"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "modules_in_events": _within_events,
    "meta_vector": _query(_vector),
    "pool_rows": _query(lambda b: _pool(b).select("symbol", "id", "t", "label", "pending", F.size("vector").alias("slots"))),
    "pool_status": _query(lambda b: meta.status(_pool(b))),
    "pool_training": _query(lambda b: meta.training_rows(_pool(b), 250).select("symbol", "id", "place", "label")),
    "meta_training": _query(_trained),
    "meta_decisions": _query(_decided),
    "champion_cycles": _query(_cycles),
    "champion_recovered": _query(_recovered),
    "model_roles": _query(_assigned),
    "anti_patterns_found": lambda spark, sf_dir: _found(spark, sf_dir).drop("centre"),
    "anti_patterns_listed": lambda spark, sf_dir: antipatterns.listed(_found(spark, sf_dir), "r1", 2).select("id", "regime", "mistakes", "samples"),
    "mistake_modules": _query(_top_modules),
}

_IN_EVENT = states(_NEWEST, "EXISTS (SELECT 1 FROM (VALUES {rows}) x(stamp, minutes) WHERE g.t * 60 BETWEEN date_diff('minute', TIMESTAMP '1970-01-01', stamp) - 5 AND date_diff('minute', TIMESTAMP '1970-01-01', stamp) + minutes + 30)".format(
    rows=", ".join(f"(TIMESTAMP '{at}', {minutes})" for _, at, impact, minutes in macro.EVENTS + _EVENTS if impact == "high")))


def _until(sql: str, hour: int) -> str:
    """sql over bars up to an hour."""
    return sql.replace("g AS (SELECT event_type", "every AS (SELECT event_type").replace("GROUP BY ALL),", f"GROUP BY ALL),\ng AS (SELECT * FROM every WHERE t <= {hour}),", 1)


def _slot_sql() -> str:
    """A list of the eighty slots over re, its modules' votes vm and the macro state mc."""
    cl = lambda x, a, b: f"COALESCE(GREATEST({a}::DOUBLE, LEAST({b}::DOUBLE, CASE WHEN isfinite(CAST({x} AS DOUBLE)) THEN {x} END)), 0.0)"
    held = lambda x, a, b: f"CASE WHEN {x} IS NULL THEN 0.0 ELSE {cl(x, a, b)} END"
    out = []
    for k in range(len(_VOTES)):
        out += [f"s{k}", f"k{k}"]
    out += ["0.0"] * 7
    out += [f"CASE WHEN {k} = '{v}' THEN 1.0 ELSE 0.0 END" for k, v in (("trend", "up"), ("trend", "down"), ("trend", "range"), ("strength", "strong"), ("strength", "moderate"), ("strength", "weak"), ("volatility", "high"), ("phase", "markup"), ("phase", "markdown"), ("phase", "accumulation"), ("phase", "distribution"))]
    out += ["mc.score", "CASE mc.label WHEN 'risk-on' THEN 1.0 WHEN 'risk-off' THEN -1.0 ELSE 0.0 END"] + ["0.0"] * 12 + ["0.5"]
    out += [held(f"((c - past{n}) / past{n} * 50)", -1, 1) for n in (1, 5)]
    out += [f"GREATEST(-10.0, LEAST(0.0, LN(GREATEST(1e-9, (h - l) / c)))) / 10", "CASE WHEN h <> l THEN GREATEST(-1.0, LEAST(1.0, (c - o) / (h - l))) ELSE 0.0 END"]
    out += [f"10 * {held('(atr14 / c)', 0, 0.1)}", "COALESCE((rsi14 - 50) / 50, 0.0)", held("(macd_hist / c * 1000)", -1, 1), f"{held('((c - bb_mid) / NULLIF(bb_up - bb_mid, 0))', -3, 3)} / 3", f"5 * {held('((bb_up - bb_low) / NULLIF(bb_mid, 0))', 0, 0.2)}"]
    out += [held("(adx14 / 100)", 0, 1), held("((plus_di - minus_di) / 100)", -1, 1), f"{held('(v / NULLIF(v20, 0) - 1)', -1, 4)} / 4"]
    out += ["LEAST(1.0, COALESCE(gaps, 0) / 10.0::DOUBLE)", "LEAST(1.0, COALESCE(n_open, 0) / 10.0::DOUBLE)"]
    out += ["(t % 24) / 24.0::DOUBLE * 2 - 1", "((t // 24 + 4) % 7) / 6.0::DOUBLE * 2 - 1", "0.0"]
    return "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in out) + "]"


_VECTOR = f"""{states(_NEWEST)}{votes()}, mc AS MATERIALIZED ({_OUTCOMES['macro_state']}),
gp0 AS (SELECT symbol, i, LAG(h, 2) OVER (PARTITION BY symbol ORDER BY i) AS h2, LAG(l, 2) OVER (PARTITION BY symbol ORDER BY i) AS l2, h, l FROM b),
gp1 AS (SELECT symbol, i, h2 AS lo, l AS hi FROM gp0 WHERE h2 < l UNION ALL SELECT symbol, i, h, l2 FROM gp0 WHERE l2 > h),
gp AS MATERIALIZED (SELECT gp1.symbol, gp1.i, MIN(b.i) AS met FROM gp1 LEFT JOIN b ON b.symbol = gp1.symbol AND b.i > gp1.i AND b.l <= hi AND b.h >= lo GROUP BY ALL),
gn AS (SELECT symbol, COUNT(*) AS gaps FROM gp WHERE met IS NULL GROUP BY symbol),
lc AS MATERIALIZED (SELECT symbol, i, LAG(c) OVER (PARTITION BY symbol ORDER BY i) AS past1, LAG(c, 5) OVER (PARTITION BY symbol ORDER BY i) AS past5 FROM b),
vm AS MATERIALIZED (SELECT symbol, {', '.join(f"MAX(signal) FILTER (module = '{name}') AS s{k}, MAX(confidence) FILTER (module = '{name}') AS k{k}" for k, (name, *_) in enumerate(_VOTES))} FROM sg GROUP BY symbol),
vs AS (SELECT re.symbol, {_slot_sql()} AS v FROM re CROSS JOIN mc JOIN vm ON vm.symbol = re.symbol JOIN lc ON lc.symbol = re.symbol AND lc.i = re.i LEFT JOIN gn ON gn.symbol = re.symbol)
SELECT symbol, CAST(UNNEST(range(0, 80)) AS INTEGER) AS slot, ROUND(CAST(CAST(UNNEST(v) AS FLOAT) AS DOUBLE), 6) AS value FROM vs"""
_POOLED = f"""{_cut(_VECTOR[:0] + states('i >= 200'))}, pl0 AS (SELECT re.symbol, re.i, re.t, (nx.c - re.c) / re.c AS ret FROM re LEFT JOIN b nx ON nx.symbol = re.symbol AND nx.i = re.i + 1),
pl AS (SELECT symbol, 'mb-' || i AS id, t, CASE WHEN ret > 0.0005::DOUBLE THEN 1 WHEN ret < -0.0005::DOUBLE THEN -1 WHEN ret IS NOT NULL THEN 0 WHEN i % 2 = 0 THEN -1 END AS label, ret IS NULL AND i % 2 = 1 AS pending FROM pl0)"""



def clustered(rows: str, k: int = 8, rounds: int = 30) -> str:
    """WITH parts: v (vec_id, dim, x) of the query ``rows`` over embeddings, and cl (vec_id, cluster) after Lloyd's rounds."""
    near = "SELECT it, vec_id, ARG_MIN(c, (d, c)) AS c FROM (SELECT it, vec_id, km.c, SUM((v.x - km.x) * (v.x - km.x)) AS d FROM km JOIN v USING (dim) WHERE {when} GROUP BY it, vec_id, km.c) GROUP BY it, vec_id"
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM ({rows})),
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n, COUNT(*) OVER () AS total FROM (SELECT DISTINCT vec_id FROM v)),
c0 AS (SELECT CAST(k.k AS INTEGER) AS c, v.dim, v.x FROM range({k}) k(k) JOIN ids ON ids.n = k.k * total // {k} JOIN v USING (vec_id)),
km(it, c, dim, x) AS (SELECT 0, c, dim, x FROM c0 UNION ALL SELECT it + 1, a.c, v.dim, AVG(v.x) FROM ({near.format(when=f'it < {rounds}')}) a JOIN v USING (vec_id) GROUP BY it, a.c, v.dim),
cl AS MATERIALIZED (SELECT vec_id, c AS cluster FROM ({near.format(when=f'it = {rounds}')}))"""


_RIGHT = "((vec_id + label) % 3 = 0 OR (label IN (1, 5) AND vec_id % 2 = 0))"
_FOUND = f"""{clustered(f'SELECT * FROM embeddings WHERE NOT {_RIGHT}')}, cn AS (SELECT cluster, COUNT(*) AS n, COUNT(*) FILTER (vec_id % 4 <> 0) AS up, COUNT(*) FILTER (vec_id % 4 = 0) AS down FROM cl GROUP BY cluster HAVING COUNT(*) >= 20),
ce AS MATERIALIZED (SELECT cluster, dim, AVG(x) AS y FROM cl JOIN v USING (vec_id) GROUP BY ALL),
df AS (SELECT cluster, vec_id, SUM((x - y) * (x - y)) AS d FROM cl JOIN v USING (vec_id) JOIN ce USING (cluster, dim) GROUP BY ALL),
rd AS (SELECT cluster, d AS radius FROM df JOIN cn USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY d) - 1 = FLOOR(0.9::DOUBLE * (n - 1))),
w AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings WHERE {_RIGHT}),
nr AS (SELECT cluster, COUNT(*) AS hits FROM (SELECT cluster, vec_id, SUM((x - y) * (x - y)) AS d FROM w JOIN ce USING (dim) GROUP BY ALL) JOIN rd USING (cluster) WHERE d <= radius GROUP BY cluster),
rk AS (SELECT cluster, 'r' || label % 4 AS regime, COUNT(*) AS n, MIN(vec_id) AS first FROM cl JOIN embeddings USING (vec_id) GROUP BY ALL),
af AS (SELECT CAST(cluster AS INTEGER) AS id, (SELECT ARG_MAX(regime, (n, -first)) FROM rk WHERE rk.cluster = cn.cluster) AS regime, radius, COALESCE(hits, 0) / (n + COALESCE(hits, 0)) AS rate, n + COALESCE(hits, 0) AS samples, n AS mistakes,
    CASE WHEN up > 2 * down THEN 'long' WHEN down > 2 * up THEN 'short' ELSE 'mixed' END AS direction FROM cn JOIN rd USING (cluster) LEFT JOIN nr USING (cluster)),
ap AS (SELECT id, regime, ROUND(radius, 6) AS radius, ROUND(rate, 3) AS hit_rate, samples, mistakes, direction,
    direction || ' in ' || regime || ' · miss ' || mistakes || '/' || samples || ' (' || CAST(FLOOR(rate * 100 + 0.5) AS INTEGER) || '%)' AS label FROM af WHERE rate < 0.45)"""

SQL: dict[str, str] = {
    "clusters": f"{clustered('SELECT * FROM embeddings')} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM cl",
    "anti_patterns_found": f"{_FOUND} SELECT * FROM ap",
    "anti_patterns_listed": f"{_FOUND} SELECT id, regime, mistakes, samples FROM ap WHERE regime = 'r1' ORDER BY id LIMIT 2",
    "mistake_modules": f"""{states(_NEWEST)}{votes()}, od(module, at_) AS (VALUES {', '.join(f"('{name}', {k})" for k, (name, *_) in enumerate(_VOTES))})
SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ABS(signal * confidence) DESC, at_) AS INTEGER) AS place, module, ROUND(signal, 3) AS signal, ROUND(confidence, 3) AS confidence FROM sg JOIN od USING (module) QUALIFY place <= 4""",
    "modules_in_events": f"{_until(_IN_EVENT + votes(), _EVENT_HOUR)} SELECT symbol, module, ROUND(signal, 6) AS signal, ROUND(confidence, 6) AS confidence, ROUND(applied, 6) AS applied FROM sg",
    "meta_vector": _VECTOR,
    "pool_rows": f"{_POOLED} SELECT symbol, id, t, label, pending, 80 AS slots FROM pl",
    "pool_status": f"{_POOLED} SELECT symbol, COUNT(*) FILTER (NOT pending) AS ready, COUNT(*) FILTER (pending) AS pending FROM pl GROUP BY symbol",
    "pool_training": f"""{_POOLED}, pt9 AS (SELECT *, COUNT(*) OVER (PARTITION BY symbol) AS n FROM pl WHERE NOT pending)
SELECT symbol, id, CAST(row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN n > 250 THEN -t END, id) - 1 AS INTEGER) AS place, label FROM pt9 QUALIFY place < 250""",
    "champion_recovered": f"""{_MODEL_ROWS}, dr AS (SELECT symbol, MAX(i) % 2 = 0 AS drifted FROM b GROUP BY symbol),
mr AS (SELECT md.*, drifted, MAX(created_at) FILTER (role = 'retired') OVER (PARTITION BY symbol) AS back, MAX(created_at) FILTER (role = 'champion') OVER (PARTITION BY symbol) AS own FROM md JOIN dr USING (symbol))
SELECT symbol, created_at, version, CASE WHEN drifted AND back IS NOT NULL AND created_at = back THEN 'champion' WHEN drifted AND back IS NOT NULL AND created_at = own THEN 'rolled-back' ELSE role END AS role FROM mr""",
    "model_roles": f"""{_MODEL_ROWS} SELECT symbol, created_at, version, CASE WHEN created_at = MAX(created_at) OVER (PARTITION BY symbol) THEN 'champion' ELSE role END AS role FROM md""",
}
