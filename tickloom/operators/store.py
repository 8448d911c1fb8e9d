"""What the store does when rows come in or go: defaults, refused rows with their reason, a calendar kept by id, roles of
settings and news by filter. Tables are DataFrames; a changed table is a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds that the store takes, the first of each the default.
PREDICTIONS = ("direction", "return", "interval", "set")
MODELS = ("mlp", "ensemble")


def _refused(*rules: tuple[Column, str]) -> Column:
    """The first rule that does not hold, in words; null if all do."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in rules))


def predictions(rows: DataFrame, now: int) -> DataFrame:
    """rows as the store keeps them, with ``error`` where it refuses them: symbol, tf, t, close_at and payload must be there and
    the kind known; kind, version, validated and created_at have defaults. Columns not given count as null."""
    have = lambda name, kind: F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
    made = rows.withColumns({
        "kind": F.coalesce(have("kind", "string"), F.lit(PREDICTIONS[0])), "version": F.coalesce(have("version", "string"), F.lit("unknown")), "regime": have("regime", "string"),
        "validated": F.coalesce(have("validated", "boolean"), F.lit(False)), "created_at": F.coalesce(have("created_at", "long"), F.lit(now)),
    })
    given = lambda name: F.col(name).isNotNull() & (F.col(name) != "")
    error = _refused(
        (given("symbol"), "symbol required"), (given("tf"), "tf required"), (F.col("t").isNotNull(), "t required"), (F.col("close_at").isNotNull(), "close_at required"),
        (F.col("kind").isin(*PREDICTIONS), "unknown kind"), (F.col("payload").isNotNull(), "payload required"),
    )
    return made.withColumn("error", error)


def models(rows: DataFrame, now: int) -> DataFrame:
    """rows as the store keeps models, with ``error`` where it refuses them: weights must be there and the kind known."""
    made = rows.withColumns({"kind": F.coalesce("kind", F.lit(MODELS[0])), "version": F.coalesce("version", F.lit("unknown")), "created_at": F.coalesce("created_at", F.lit(now).cast("long"))})
    return made.withColumn("error", _refused((F.col("weights").isNotNull(), "weights required"), (F.col("kind").isin(*MODELS), "unknown kind")))


def taken(rows: DataFrame) -> DataFrame:
    """Rows that were not refused."""
    return rows.where("error IS NULL").drop("error")


def calendar(rows: DataFrame) -> DataFrame:
    """A calendar of rows (event, at, impact, minutes): those with a time, numbered by it in ``place``."""
    order = Window.orderBy("at", "event")  # a calendar has a row for each event, some hundreds a year
    return rows.where(F.col("at").isNotNull()).withColumn("place", F.row_number().over(order))


def upserted(events: DataFrame, changes: DataFrame) -> DataFrame:
    """events with changes put in by ``event``: what a change gives replaces what was there, what it leaves null stays, and of
    several the last by ``seq`` wins field by field. Changes without a time are refused whole."""
    names = [c for c in events.columns if c not in ("event", "place")]
    both = events.select("event", *names).withColumn("seq", F.lit(-1).cast("long")).unionByName(changes.where("at IS NOT NULL").select("event", *names, "seq"))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in names]
    return calendar(both.groupBy("event").agg(*last))


def removed(events: DataFrame, ids: DataFrame) -> DataFrame:
    """events without those of ids (event)."""
    return calendar(events.drop("place").join(ids.select("event").distinct(), "event", "left_anti"))


def news(rows: DataFrame, high_only: bool = False, category: str = "all") -> DataFrame:
    """News (high_impact, category, ...): of high impact only, of one category only."""
    rows = rows.where(F.coalesce("high_impact", F.lit(False))) if high_only else rows
    return rows if category == "all" else rows.where(F.col("category") == category)


def settings(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, fallback) with ``value``: the newest one set for the key, by ``at``, else the fallback."""
    newest = rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return wanted.join(newest, "key", "left").select("key", F.coalesce("value", "fallback").alias("value"))
