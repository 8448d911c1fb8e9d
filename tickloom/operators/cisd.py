"""Compression, inducement, sweep, displacement: four stages that have to follow one another within few bars.

Everything is judged as of a moment, (symbol, at): ``moments`` are such pairs, and events and sweeps carry the moment
that they are known in as ``symbol``, so any number of moments is judged in one pass. What a stage needs of a bar travels with the
bar (``attributes``), so stages meet by moment alone, within windows of five, six and eighty bars.

A mean over 100 mean ranges counts from where all of them are known. A running sum that takes in the unknown values of the
warm-up stays unknown for good, and with it compression; ``known_only=False`` gives that reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import indicators as I
from ..sources.candles import series

#: Bars of the means and runs, windows between stages, and least ratios.
RANGE_MEAN, RUN, WIDTH = 100, 3, 50
SMALL, SWEEP_BARS, WICK, SHIFT_BARS, VOLUME_MEAN, SPIKE, LOOKBACK = 1.5, 5, 1.5, 6, 20, 1.5, 80
#: Bars that a symbol needs to be judged.
LEAST = RANGE_MEAN + RUN + SHIFT_BARS


def band_width() -> Column:
    return (F.col("bb_up") - F.col("bb_low")) / F.when(F.col("bb_mid") != 0, F.col("bb_mid"))


def attributes(features: DataFrame, known_only: bool = True) -> DataFrame:
    """Bars with ``compressed``, ``volume_ratio``, ``upper_wick`` and ``lower_wick`` (against the body; infinite without
    one), and the next bar within six at which a gap up or down is complete."""
    known = F.count("atr14").over(I.rows(RANGE_MEAN)) == RANGE_MEAN
    mean = F.when(known if known_only else F.lit(False), F.avg("atr14").over(I.rows(RANGE_MEAN)))
    bars = features.withColumns({"_below": F.coalesce(F.col("atr14") < mean, F.lit(False)).cast("int"), "_width": band_width()})
    tight = F.col("_width") <= F.min("_width").over(I.rows(WIDTH))
    body, volume = F.abs(F.col("c") - F.col("o")), F.avg("v").over(I.rows(VOLUME_MEAN))

    def wick(size: Column) -> Column:
        return F.when(~(size > 0), 0.0).when(body <= 1e-12, float("inf")).otherwise(size / F.when(body > 1e-12, body))

    ahead = series().rowsBetween(0, SHIFT_BARS)
    h2, l2 = F.lag("h", 2).over(series()), F.lag("l", 2).over(series())
    bars = bars.withColumns({"_bull": F.when(h2 < F.col("l"), F.col("i")), "_bear": F.when(l2 > F.col("h"), F.col("i"))})
    return bars.withColumns({
        "compressed": F.coalesce((F.sum("_below").over(I.rows(RUN)) == RUN) & tight, F.lit(False)),
        "volume_ratio": F.when((F.col("i") >= VOLUME_MEAN - 1) & (volume > 0), F.col("v") / F.when(volume > 0, volume)),
        "upper_wick": wick(F.col("h") - F.greatest("o", "c")), "lower_wick": wick(F.least("o", "c") - F.col("l")),
        "gap_up": F.min("_bull").over(ahead), "gap_down": F.min("_bear").over(ahead),
    }).drop("_below", "_width", "_bull", "_bear")


def bar() -> Column:
    """What the stages need of a bar that breaks a level."""
    return F.struct("i", "c", "v", "v20", "atr14", "volume_ratio", "compressed", F.lag("compressed").over(series()).alias("compressed_before"))


def inducements(events: DataFrame) -> DataFrame:
    """Small breaks of structure: (symbol, at, j, j_dir, level, magnitude, compression_i). events: (symbol, at, type, dir,
    level, bar) of each moment."""
    b = F.col("bar")
    size = F.abs(b["c"] - F.col("level"))
    compression = F.when(b["compressed_before"], b["i"] - 1).when(b["compressed"], b["i"])
    small = events.where((F.col("type") == "BoS") & (b["atr14"] > 0) & (size < SMALL * b["atr14"]))
    return small.select("symbol", "at", b["i"].alias("j"), F.col("dir").alias("j_dir"), F.col("level").alias("j_level"), (size / b["atr14"]).alias("magnitude"), compression.alias("compression_i"))


def pierced(kind: Column, level: Column) -> Column:
    """Whether a bar's wick passes the level and its close does not, with a long enough wick on that side."""
    above = (F.col("h") > level) & (F.col("c") < level) & (F.col("upper_wick") >= WICK)
    below = (F.col("l") < level) & (F.col("c") > level) & (F.col("lower_wick") >= WICK)
    return F.when(kind == "high", above).otherwise(below)


def swept(found: DataFrame, sweeps: DataFrame, bars: DataFrame) -> DataFrame:
    """Inducements with their sweep: sweep_i, wick_ratio. Of the known sweeps (symbol, kind, price, bar) within five bars the
    one of the highest level, else the first bar there that pierces the inducement's level. bars: of the underlying symbols,
    (name, i, ...) where moments are (name, ...)."""
    side = F.when(F.col("j_dir") == "up", "high").otherwise("low")
    rows = found.withColumn("kind", side)
    end = F.least(F.col("at"), F.col("j") + SWEEP_BARS)
    known = rows.join(sweeps.select("symbol", "kind", "price", F.col("bar").alias("s")), ["symbol", "kind"]).select(*rows.columns, "price", "s.*")
    wick = F.when(F.col("kind") == "high", F.col("upper_wick")).otherwise(F.col("lower_wick"))
    inside = (F.col("i") > F.col("j")) & (F.col("i") <= end) & pierced(F.col("kind"), F.col("j_level"))
    listed = known.where(inside).groupBy("symbol", "j").agg(F.max_by(F.struct("i", wick.alias("wick")), "price").alias("listed"))
    any_bar = rows.withColumn("name", F.col("symbol.symbol")).join(bars, "name").where(inside)
    first = any_bar.groupBy("symbol", "j").agg(F.min(F.struct("i", wick.alias("wick"))).alias("first"))
    hit = F.coalesce("listed", "first")
    return rows.join(listed, ["symbol", "j"], "left").join(first, ["symbol", "j"], "left").select(*rows.columns, hit["i"].alias("sweep_i"), hit["wick"].alias("wick_ratio"))


def displaced(found: DataFrame, events: DataFrame, bars: DataFrame) -> DataFrame:
    """Swept inducements with choch_i and volume_ratio: the newest change of character within six bars of the sweep, the other
    way, with a gap that way from the sweep on and a spike in volume."""
    ahead = bars.select("name", F.col("i").alias("sweep_i"), "gap_up", "gap_down")
    way = F.when(F.col("kind") == "high", "down").otherwise("up")
    rows = found.withColumns({"name": F.col("symbol.symbol"), "way": way}).join(ahead, ["name", "sweep_i"], "left")
    end = F.least(F.col("at"), F.col("sweep_i") + SHIFT_BARS)
    turns = events.where("type = 'CHoCH'").select("symbol", F.col("dir").alias("way"), F.col("bar.i").alias("k"), F.col("bar.volume_ratio").alias("ratio"))
    newest = rows.join(turns, ["symbol", "way"]).where((F.col("k") > F.col("sweep_i")) & (F.col("k") <= end)).groupBy("symbol", "j").agg(F.max(F.struct("k", "ratio")).alias("turn"))
    gap = F.when(F.col("way") == "up", F.col("gap_up")).otherwise(F.col("gap_down")) <= end
    good = gap & (F.col("turn.ratio") >= SPIKE)
    return rows.join(newest, ["symbol", "j"], "left").select(*found.columns, F.when(good, F.col("turn.k")).alias("choch_i"), F.when(good, F.col("turn.ratio")).alias("volume_ratio"))


def stages(events: DataFrame, sweeps: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, at, j, j_dir, j_level, magnitude, compression_i, kind, sweep_i, wick_ratio, choch_i, volume_ratio): how far
    each inducement of each moment came."""
    return displaced(swept(inducements(events), sweeps, bars), events, bars)


def sequences(moments: DataFrame, events: DataFrame, sweeps: DataFrame) -> DataFrame:
    """(symbol, cisd_signal, cisd_confidence, cisd_i, cisd_age) of every moment: the newest change of character for which all
    stages link, tried with its sweeps from the highest level down. moments: (symbol, at)."""
    turns = events.where((F.col("type") == "CHoCH") & (F.col("at") - F.col("bar.i") <= LOOKBACK)).select("symbol", "at", F.col("bar.i").alias("k"), "dir", F.col("bar.volume_ratio").alias("ratio"))
    turns = turns.withColumn("kind", F.when(F.col("dir") == "down", "high").otherwise("low"))
    known = sweeps.select("symbol", "kind", "price", F.col("bar").alias("s"))
    near = turns.join(known, ["symbol", "kind"]).where((F.col("s.i") >= F.col("k") - SHIFT_BARS) & (F.col("s.i") < F.col("k")))
    made = inducements(events).select("symbol", "j", "j_dir", "j_level", "compression_i")
    linked = near.join(made, "symbol").where((F.col("j_dir") != F.col("dir")) & (F.col("j") < F.col("s.i")) & (F.col("s.i") - F.col("j") <= SWEEP_BARS))
    keys = ["symbol", "at", "k", "dir", "kind", "ratio", "price", "s"]
    newest = linked.groupBy(*keys).agg(F.max(F.struct("j", "j_level", "compression_i")).alias("x")).select(*keys, "x.*").where("compression_i IS NOT NULL")
    # the sweep itself pierces the inducement's level, and no listed one of a higher level does so elsewhere
    own = newest.select("*", "s.*").where(pierced(F.col("kind"), F.col("j_level"))).select(*newest.columns)
    other = known.select("symbol", "kind", F.col("price").alias("other_price"), F.col("s").alias("o"))
    rivals = own.join(other, ["symbol", "kind"]).where("other_price > price AND o.i <> s.i").select(*own.columns, "other_price", "o.*")
    end = F.least(F.col("at"), F.col("j") + SWEEP_BARS)
    beaten = rivals.where((F.col("i") > F.col("j")) & (F.col("i") <= end) & pierced(F.col("kind"), F.col("j_level")))
    # ... unless one of a still higher level is at the sweep's own bar again
    same = own.join(other, ["symbol", "kind"]).where("o.i = s.i AND other_price >= price").groupBy("symbol", "k", "j", "price").agg(F.max("other_price").alias("top"))
    worst = beaten.groupBy("symbol", "k", "j", "price").agg(F.max("other_price").alias("rival"))
    kept = own.join(same, ["symbol", "k", "j", "price"]).join(worst, ["symbol", "k", "j", "price"], "left").where("rival IS NULL OR rival < top")
    limit = F.least(F.col("at"), F.col("s.i") + SHIFT_BARS)
    later = turns.select("symbol", "dir", F.col("k").alias("later"))
    last = kept.join(later, ["symbol", "dir"]).where((F.col("later") > F.col("s.i")) & (F.col("later") <= limit)).groupBy("symbol", "k", "j", "price").agg(F.max("later").alias("last"))
    gap = F.when(F.col("dir") == "up", F.col("s.gap_up")).otherwise(F.col("s.gap_down")) <= limit
    full = kept.join(last, ["symbol", "k", "j", "price"]).where((F.col("last") == F.col("k")) & gap & (F.col("ratio") >= SPIKE))
    order = Window.partitionBy("symbol").orderBy(F.desc("k"), F.desc("price"))
    best = full.withColumn("n", F.row_number().over(order)).where("n = 1")
    wick = F.when(F.col("kind") == "high", F.col("s.upper_wick")).otherwise(F.col("s.lower_wick"))
    best = best.select("symbol", "k", "kind", wick.alias("wick"), "ratio")

    age = F.col("at") - F.col("k")
    fresh = F.when(age == 0, 1.0).when(age <= 2, 0.85).when(age <= 5, 0.65).otherwise(0.4)
    longer, louder = F.least(F.lit(1.0), (F.col("wick") - WICK) / 2), F.least(F.lit(1.0), (F.col("ratio") - SPIKE) / 2)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 + 0.25 * fresh + 0.15 * longer + 0.15 * louder))
    force = F.greatest(F.lit(0.4), F.least(F.lit(1.0), 0.5 + 0.25 * fresh + 0.25 * (longer * 0.5 + louder * 0.5)))
    side = F.when(F.col("kind") == "low", 1.0).otherwise(-1.0)
    short = F.col("at") + 1 < LEAST
    none = short | F.col("k").isNull()
    return moments.join(best, "symbol", "left").select(
        "symbol", F.when(none, 0.0).otherwise(side * force).alias("cisd_signal"), F.when(short, 0.0).when(none, 0.05).otherwise(sure).alias("cisd_confidence"),
        F.when(~none, F.col("k")).alias("cisd_i"), F.when(~none, age).alias("cisd_age"),
    )
