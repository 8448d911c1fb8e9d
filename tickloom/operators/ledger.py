"""The store's calls as DataFrame operations: filters, ranges, upserts, newest rows, draining of due predictions; and
anti-patterns with their veto."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import validation

#: Milliseconds of each time frame, and the grace after a bar's close.
TIMEFRAMES = {"1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "2h": 7_200_000, "4h": 14_400_000, "6h": 21_600_000, "8h": 28_800_000, "12h": 43_200_000, "1d": 86_400_000, "3d": 259_200_000, "1w": 604_800_000}
GRACE = 4000


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal all that is wanted; None asks for null."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), wanted.items(), rows)


def due(predictions: DataFrame, now: int, **wanted) -> DataFrame:
    """Predictions not yet validated whose bar has closed."""
    return matching(predictions, **wanted).where(~F.col("validated") & (F.col("close_at") <= now))


def between(rows: DataFrame, since: int | None = None, until: int | None = None, column: str = "t") -> DataFrame:
    """Rows of a closed range of ``column``; no bound where None."""
    rows = rows if since is None else rows.where(F.col(column) >= since)
    return rows if until is None else rows.where(F.col(column) <= until)


def newest(rows: DataFrame, by: list[str], n: int, within: list[str]) -> DataFrame:
    """The n last rows by ``by`` of each group; Spark keeps n rows of a partition before it shuffles."""
    order = Window.partitionBy(*within).orderBy(*map(F.desc, by))
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def upserted(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """rows with changes put in: by key the last change wins, by ``seq``. changes: the same columns and seq."""
    last = Window.partitionBy(*key).orderBy(F.desc("seq"))
    both = rows.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes)
    return both.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank", "seq")


def drained(predictions: DataFrame, bars: DataFrame, now: int) -> DataFrame:
    """Due predictions with the verdict by the bar at their close (see ``validation.validate``): validated, or pending while
    there is no such bar or the verdict is not usable. Bars are joined on symbol and time."""
    rows = validation.validate(due(predictions, now), bars, at="close_at")
    return rows.withColumn("state", F.when(F.col("ok"), "validated").otherwise("pending"))


def marked(predictions: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """predictions with ``validated`` set where ``drained`` has a verdict; they stay validated."""
    done = verdicts.where("state = 'validated'").select(*key, F.lit(True).alias("_done"))
    return predictions.join(done, key, "left").withColumn("validated", F.coalesce("_done", "validated")).drop("_done")


def frame_ms(frame: Column) -> Column:
    """Milliseconds of a time frame, null for one unknown."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in TIMEFRAMES.items() for x in kv)), frame)


def next_close(t: Column, frame: Column) -> Column:
    """When the bar after the one at t has closed for sure."""
    return t + 2 * frame_ms(frame) + GRACE


def letters(n: Column, session: Column | None = None) -> Column:
    """A to Z, then AA and so on, as many as are needed; nothing for a negative number. session: its first letter in lower case
    stands before them, if there is one."""
    begun = F.struct(n.cast("long").alias("left"), F.lit("").alias("text"))

    def more(so_far: Column, _: Column) -> Column:
        left = so_far["left"]
        longer = F.concat(F.char(65 + left % 26), so_far["text"])
        return F.when(left < 0, so_far).otherwise(F.struct((F.floor(left / 26) - 1).cast("long").alias("left"), longer.alias("text")))

    # 14 letters hold every number of 64 bits
    text = F.aggregate(F.sequence(F.lit(1), F.lit(14)), begun, more)["text"]
    return text if session is None else F.concat(F.coalesce(F.lower(F.substring(session, 1, 1)), F.lit("")), text)


def near_events(at: DataFrame, calendar: DataFrame, window: int) -> DataFrame:
    """at (its ``t`` in minutes) with each event no more than ``window`` minutes away. calendar: small and fixed."""
    return at.join(F.broadcast(calendar), F.abs(F.col("minute") - F.col("t") * 60) <= window).withColumn("delta", F.abs(F.col("minute") - F.col("t") * 60))


def squared(a: Column, b: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def anti_patterns(vectors: DataFrame, cluster: str, miss: Column) -> DataFrame:
    """(cluster, n, hit_rate, radius, centre): mean vector of each cluster's rows; radius is the squared distance that nine
    tenths of them stay within, by order statistic. vectors: id, vector array<double>."""
    spread = vectors.select(cluster, F.posexplode("vector").alias("dim", "x")).groupBy(cluster, "dim").agg(F.avg("x").alias("x"))
    centres = spread.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centre"))
    far = vectors.withColumn("miss", miss).join(F.broadcast(centres), cluster).withColumn("d", squared(F.col("vector"), F.col("centre")))
    ranked = far.withColumns({"rank": F.row_number().over(Window.partitionBy(cluster).orderBy("d")) - 1, "of": F.count("*").over(Window.partitionBy(cluster))})
    return ranked.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(1.0 - F.col("miss")).alias("hit_rate"), F.max(F.when(F.col("rank") == F.floor(0.9 * (F.col("of") - 1)), F.col("d"))).alias("radius"), F.first("centre").alias("centre"))


def nearest(vectors: DataFrame, patterns: DataFrame, cluster: str) -> DataFrame:
    """vectors with the anti-pattern of least squared distance (first by name on ties). patterns: a few rows, broadcast as
    one list."""
    listed = patterns.agg(F.collect_list(F.struct(F.col(cluster).alias("pattern"), "hit_rate", "radius", "centre")).alias("all"))
    each = F.transform("all", lambda p: F.struct(squared(F.col("vector"), p["centre"]).alias("d"), p["pattern"].alias("pattern"), p["hit_rate"].alias("hit_rate"), p["radius"].alias("radius")))
    found = vectors.join(F.broadcast(listed)).withColumn("p", F.array_min(each)).drop("all")
    return found.withColumn("in_radius", F.col("p.d") <= F.col("p.radius"))


def veto(signal: Column, confidence: Column, hit_rate: Column, in_radius: Column) -> dict[str, Column]:
    """What is left of a signal: none of it by an anti-pattern that seldom hits, a part by one that hits a little more."""
    full, part = in_radius & (hit_rate <= 0.25), in_radius & (hit_rate <= 0.4)
    left = F.when(full, 0.0).when(part, signal * 0.4).otherwise(signal)
    sure = F.when(full, 0.0).when(part, confidence * 0.5).otherwise(confidence)
    return {"veto": F.when(full, "full").when(part, "partial").otherwise("pass"), "signal": left, "confidence": sure, "direction": F.when(F.abs(left) < 0.05, "neutral").when(left > 0, "long").otherwise("short"), "probability": 0.5 + 0.5 * left}
