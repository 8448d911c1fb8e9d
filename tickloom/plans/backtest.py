"""A direction for every bar held against the next close: trades and their measures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import indicators as I
from ..operators import modules
from ..sources.candles import series
from . import asof

#: Bars that are walked, bars before the first call, and bars that a symbol needs.
BARS, WARMUP, LEAST = 500, 200, 250


def directed(candles: DataFrame) -> DataFrame:
    """candles with direction: the scan's rule at every bar, from that bar and those before only."""
    bars = candles.withColumns({"mid": F.avg("c").over(I.rows(20)), "roc10": I.roc(F.col("c"), 10)})
    direction = F.when((F.col("c") > F.col("mid")) & (F.col("roc10") > 0), "long").when((F.col("c") < F.col("mid")) & (F.col("roc10") < 0), "short").otherwise("neutral")
    return bars.withColumn("direction", direction)


def trades(bars: DataFrame, warmup: int = 200, band: float = 0.0005) -> DataFrame:
    """(symbol, i, direction, realized, hit, ret, pnl) from bar ``warmup`` to the one before the last. A call that
    the next close, within the band, neither meets nor opposes is a miss without profit or loss."""
    ret = F.when(F.col("c") != 0, (F.lead("c").over(series()) - F.col("c")) / F.col("c")).otherwise(0.0)
    rows = bars.withColumns({"ret": ret, "more": F.lead("i").over(series())}).where((F.col("i") >= warmup) & F.col("more").isNotNull())
    rows = rows.withColumn("realized", F.when(F.col("ret") > band, "up").when(F.col("ret") < -band, "down").otherwise("flat"))
    side = F.when(F.col("direction") == "long", 1).when(F.col("direction") == "short", -1).otherwise(0)
    way = F.when(F.col("realized") == "up", 1).when(F.col("realized") == "down", -1).otherwise(0)
    return rows.select("symbol", "i", "direction", "realized", ((side != 0) & (side == way)).alias("hit"), "ret", F.when(way != 0, side * F.col("ret")).otherwise(0.0).alias("pnl"))


def measures(made: DataFrame) -> DataFrame:
    """(symbol, trades, hits, misses, abstain, final_return, max_drawdown, sharpe); equity starts at 1, and there is none (NaN) from
    a trade on that loses more than all."""
    pnl = F.col("pnl")
    grown = F.when(pnl > -1, F.log1p(pnl)).otherwise(I.logarithm(1.0 + pnl))
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    equity = made.withColumn("equity", F.exp(F.sum(grown).over(so_far)))
    peaks = equity.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(so_far)))
    called = F.col("direction") != "neutral"
    own = F.when(F.col("direction") == "long", F.col("ret")).when(F.col("direction") == "short", -F.col("ret"))
    sums = peaks.groupBy("symbol").agg(
        F.count("*").alias("trades"),
        F.count_if(called & F.col("hit")).alias("hits"),
        F.count_if(called & ~F.col("hit")).alias("misses"),
        F.count_if(~called).alias("abstain"),
        (F.max_by("equity", "i") - 1.0).alias("final_return"),
        F.max((F.col("peak") - F.col("equity")) / F.col("peak")).alias("max_drawdown"),
        F.avg(own).alias("mean"),
        F.stddev_pop(own).alias("spread"),
    )
    return sums.withColumn("sharpe", F.when(F.col("spread") > 0, F.col("mean") / F.when(F.col("spread") > 0, F.col("spread")) * math.sqrt(252)).otherwise(0.0)).drop("mean", "spread")


def newest_bars(candles: DataFrame, most: int) -> DataFrame:
    """Each symbol's newest ``most`` bars, numbered anew."""
    cut = candles.withColumn("cut", F.greatest(F.lit(0), F.max("i").over(Window.partitionBy("symbol")) + 1 - most))
    return cut.where("i >= cut").withColumn("i", (F.col("i") - F.col("cut")).cast("int")).drop("cut")


def walk_forward(candles: DataFrame, most: int = BARS, warmup: int = WARMUP, least: int = LEAST) -> DataFrame:
    """(symbol, i, direction, probability, realized, hit, ret, pnl, regime): the ensemble's call at every bar from ``warmup``
    to the one before the last, made from what was known then (see ``asof``) and held against the next close. The reach is the
    feature's own: a walk is over a symbol's newest ``most`` bars, and symbols with fewer than ``least`` have none."""
    enough = newest_bars(candles, most).withColumn("bars", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("bars") >= least).drop("bars")
    known = asof.states(enough, lambda rows: rows.where((F.col("i") >= warmup) & F.col("newer").isNotNull()))
    keys = ("symbol", "i")
    called = modules.ensemble(modules.evaluate(known, keys), keys).select(*keys, "direction", "probability")
    named = known.select(*keys, F.concat_ws("-", "trend", "strength").alias("regime"))
    bars = enough.join(called, list(keys), "left").withColumn("direction", F.coalesce("direction", F.lit("neutral")))
    rated = F.coalesce("probability", F.lit(0.5)).alias("probability")
    return trades(bars, warmup).join(called.select(*keys, rated), list(keys), "left").join(named, list(keys))


def by_regime(made: DataFrame) -> DataFrame:
    """(symbol, regime, total, hits): calls that take a side, by the regime they were made in."""
    called = F.col("direction") != "neutral"
    return made.groupBy("symbol", "regime").agg(F.count_if(called).alias("total"), F.count_if(called & F.col("hit")).alias("hits"))
