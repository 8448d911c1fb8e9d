"""Lines through the newest pivots of each kind, the channel between them and the close beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(pivots: DataFrame, tolerances: DataFrame, lookback: int = 8, least: int = 3) -> DataFrame:
    """(symbol, kind, slope, intercept, r2, touches, score, sigma): least squares through a symbol's last
    ``lookback`` pivots of a kind, if there are ``least``. touches: points within the symbol's tolerance of the line;
    score: r2 by touches, full at four. pivots: (symbol, i, kind, price); tolerances: (symbol, tolerance)."""
    of_kind = Window.partitionBy("symbol", "kind")
    rank = F.row_number().over(of_kind.orderBy(F.desc("i")))
    points = pivots.withColumn("rank", rank).where(F.col("rank") <= lookback).withColumn("i", F.col("i").cast("double"))
    means = points.withColumns({"mx": F.avg("i").over(of_kind), "my": F.avg("price").over(of_kind), "n": F.count("*").over(of_kind)}).where(F.col("n") >= least)
    dx, dy = F.col("i") - F.col("mx"), F.col("price") - F.col("my")
    sums = means.withColumns({"sxx": F.sum(dx * dx).over(of_kind), "sxy": F.sum(dx * dy).over(of_kind), "syy": F.sum(dy * dy).over(of_kind)})
    fitted = sums.withColumn("slope", F.col("sxy") / F.col("sxx")).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    away = F.col("price") - (F.col("slope") * F.col("i") + F.col("intercept"))
    line = fitted.withColumn("e", away).join(tolerances, "symbol").groupBy("symbol", "kind", "slope", "intercept", "syy", "n").agg(F.sum(F.col("e") * F.col("e")).alias("sse"), F.count_if(F.abs("e") <= F.col("tolerance")).alias("touches"))
    r2 = F.when(F.col("syy") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("sse") / F.when(F.col("syy") > 0, F.col("syy"))))).otherwise(0.0)
    line = line.withColumn("r2", r2)
    return line.select("symbol", "kind", "slope", "intercept", "r2", "touches", (F.col("r2") * F.least(F.lit(1.0), F.col("touches") / 4.0)).alias("score"), F.sqrt(F.col("sse") / F.greatest(F.lit(1), F.col("n") - 2)).alias("sigma"))


def channels(found: DataFrame, ends: DataFrame, beyond: float = 0.5, alike: float = 0.75) -> DataFrame:
    """(symbol, width_atr, parallel, breakout, distance_atr): both lines of a symbol together. breakout: the side on
    which the last close is ``beyond`` mean ranges past a line, up before down. ends: (symbol, i, c, atr)."""
    side = lambda kind, x: F.max(F.when(F.col("kind") == kind, F.col(x)))
    both = found.groupBy("symbol").agg(*(side(k, x).alias(f"{k}_{x}") for k in ("high", "low") for x in ("slope", "intercept", "sigma")))
    rows = ends.join(both, "symbol", "left")
    c, atr, up, down = F.col("c"), F.col("atr"), F.col("high_slope"), F.col("low_slope")
    over, under = c - (up * F.col("i") + F.col("high_intercept")), (down * F.col("i") + F.col("low_intercept")) - c
    flat = (F.abs(up) < 1e-12) & (F.abs(down) < 1e-12)
    same = (up * down > 0) & (F.least(F.abs(up), F.abs(down)) >= alike * F.greatest(F.abs(up), F.abs(down)))
    rows = rows.withColumns({"width_atr": F.coalesce((F.col("high_sigma") + F.col("low_sigma")) / 2.0 / atr, F.lit(0.0)), "parallel": F.coalesce(flat | same, F.lit(False)), "over": over, "under": under})
    breakout = F.when(F.col("over") >= beyond * atr, "up").when(F.col("under") >= beyond * atr, "down")
    rows = rows.withColumn("breakout", breakout)
    return rows.select("symbol", "width_atr", "parallel", "breakout", F.when(F.col("breakout") == "up", F.col("over") / atr).when(F.col("breakout") == "down", F.col("under") / atr).alias("distance_atr"))


def line_signal(found: DataFrame, joined: DataFrame, ends: DataFrame) -> DataFrame:
    """(symbol, position, signal, confidence): the better line's slope in mean ranges, a breakout of the channel, and where the
    close lies between the lines, from -2 to 2. A line that fits badly (score under 0.3, fewer than three touches) gives no
    signal, a symbol without a line nothing. joined: ``channels`` of found; ends: (symbol, i, c, atr)."""
    side = lambda kind, x: F.max(F.when(F.col("kind") == kind, F.col(x)))
    names = ("slope", "intercept", "score", "touches")
    both = found.groupBy("symbol").agg(*(side(k, x).alias(f"{k}_{x}") for k in ("high", "low") for x in names))
    rows = ends.join(both, "symbol", "left").join(joined.select("symbol", "breakout"), "symbol", "left")
    upper = F.col("low_score").isNull() | (F.col("high_score") >= F.col("low_score"))
    best = {x: F.when(upper, F.col(f"high_{x}")).otherwise(F.col(f"low_{x}")) for x in ("slope", "score", "touches")}
    over, under = (F.col(f"{k}_slope") * F.col("i") + F.col(f"{k}_intercept") for k in ("high", "low"))
    place = F.when(over > under, 2.0 * (F.col("c") - under) / (over - under) - 1.0)
    rows = rows.withColumns({**best, "position": F.when(place.isNotNull(), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), place)))})
    way = F.when(F.col("breakout") == "up", 0.3).when(F.col("breakout") == "down", -0.3).otherwise(0.0)
    held = F.when(F.col("position") > 1, 1.0).when(F.col("position") < -1, -1.0).otherwise(F.col("position"))
    inside = F.coalesce(-0.2 * held, F.lit(0.0))
    weak = (F.col("score") < 0.3) | (F.col("touches") < 3)
    signal = F.when(weak, 0.0).otherwise(0.5 * F.tanh(4.0 * F.col("slope") / F.col("atr")) + way + inside)
    sure = F.when(weak, F.least(F.lit(0.3), "score")).otherwise(F.col("score") * F.when(F.col("breakout").isNull(), 0.85).otherwise(1.0))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), signal))
    none = F.col("score").isNull()
    return rows.select("symbol", "position", F.when(none, 0.0).otherwise(bounded).alias("signal"), F.when(none, 0.0).otherwise(sure).alias("confidence"))
