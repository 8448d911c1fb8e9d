"""Price structure: pivots, gaps, sessions and candle patterns as window expressions and joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.candles import series


def marked(candles: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """candles with pivot_high and pivot_low: the price of a bar above (below) all of ``left`` before and none of
    ``right`` after, else null."""
    before, after = series().rowsBetween(-left, -1), series().rowsBetween(1, right)
    inside = (F.count("*").over(before) == left) & (F.count("*").over(after) == right)
    high = inside & (F.col("h") > F.max("h").over(before)) & (F.col("h") >= F.max("h").over(after))
    low = inside & (F.col("l") < F.min("l").over(before)) & (F.col("l") <= F.min("l").over(after))
    return candles.withColumns({"pivot_high": F.when(high, F.col("h")), "pivot_low": F.when(low, F.col("l"))})


def pivots(candles: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """(symbol, i, kind, price, label): pivots, labelled against the same kind's last one (HH, LH, HL, LL; H and L
    first)."""
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"pivot_{k}").alias("price")) for k in ("high", "low")))).alias("p")
    found = marked(candles, left, right).where("pivot_high IS NOT NULL OR pivot_low IS NOT NULL").select("symbol", "i", ends).select("symbol", "i", "p.*").where("price IS NOT NULL")
    last = F.lag("price").over(Window.partitionBy("symbol", "kind").orderBy("i"))
    high = F.when(last.isNull(), "H").when(F.col("price") > last, "HH").otherwise("LH")
    low = F.when(last.isNull(), "L").when(F.col("price") > last, "HL").otherwise("LL")
    return found.withColumn("label", F.when(F.col("kind") == "high", high).otherwise(low))


def trend(candles: DataFrame) -> DataFrame:
    """(symbol, trend): up, down or range by the newest high and low of the last four pivots, unknown without both."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("i"), F.desc("kind"))
    last = pivots(candles).withColumn("n", F.row_number().over(newest)).where("n <= 4")
    label = {k: F.max_by("label", F.when(F.col("kind") == k, F.col("i"))) for k in ("high", "low")}
    both = last.groupBy("symbol").agg(label["high"].alias("hi"), label["low"].alias("lo"))
    named = F.when(F.col("hi").isNull() | F.col("lo").isNull(), "unknown").when((F.col("hi") == "HH") & (F.col("lo") == "HL"), "up").when((F.col("hi") == "LH") & (F.col("lo") == "LL"), "down").otherwise("range")
    return both.select("symbol", named.alias("trend"))


def broken(candles: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """candles with what each bar breaks and what is left to be broken after it: pivot_high and pivot_low, high_left
    and low_left (the newest pivot of a kind, unless broken), side (1 or -1 at a bar whose close is beyond one), was
    (the side of the last break before) and level.

    A pivot is broken by the first close beyond it before the next pivot of its kind, so counts of such closes since the pivot
    tell; one window over the symbol's bars serves them all. A close beyond both breaks the high one only."""
    upto, before = series().rowsBetween(Window.unboundedPreceding, 0), series().rowsBetween(Window.unboundedPreceding, -1)
    rows = marked(candles, left, right).withColumns({"_high": F.last("pivot_high", True).over(upto), "_low": F.last("pivot_low", True).over(upto)})

    def first_beyond(rows: DataFrame, kind: str, beyond: Column) -> DataFrame:
        """_up or _down: how many closes were beyond the newest pivot since it stood there."""
        name, pivot = ("_up", "pivot_high") if kind == "high" else ("_down", "pivot_low")
        rows = rows.withColumn("_hit", F.coalesce(beyond, F.lit(False)).cast("int")).withColumn("_hits", F.sum("_hit").over(upto))
        since = F.col("_hits") - F.last(F.when(F.col(pivot).isNotNull(), F.col("_hits") - F.col("_hit")), True).over(upto)
        return rows.withColumns({name: since, f"{name}_now": (F.col("_hit") == 1) & (since == 1)}).drop("_hit", "_hits")

    rows = first_beyond(rows, "high", F.col("c") > F.col("_high"))
    rows = first_beyond(rows, "low", (F.col("c") < F.col("_low")) & ~F.coalesce("_up_now", F.lit(False)))
    rows = rows.withColumn("side", F.when(F.col("_up_now"), 1).when(F.col("_down_now"), -1))
    made = {"was": F.last("side", True).over(before), "level": F.when(F.col("side") == 1, F.col("_high")).when(F.col("side") == -1, F.col("_low"))}
    left_over = {"high_left": F.when(F.col("_up") == 0, F.col("_high")), "low_left": F.when(F.col("_down") == 0, F.col("_low"))}
    return rows.withColumns({**made, **left_over}).drop("_high", "_low", "_up", "_down", "_up_now", "_down_now")


def breaks(candles: DataFrame) -> DataFrame:
    """(symbol, i, type, dir, level): closes beyond the newest unbroken pivot; CHoCH against the last break's
    direction, else BoS. One event a bar, upward first; a broken pivot is used up."""
    kind = F.when(F.col("was") == -F.col("side"), "CHoCH").otherwise("BoS")
    return broken(candles).where("side IS NOT NULL").select("symbol", "i", kind.alias("type"), F.when(F.col("side") == 1, "up").otherwise("down").alias("dir"), "level")


def _first_overlap(zones: DataFrame, candles: DataFrame) -> DataFrame:
    """zones (symbol, i, dir, bottom, top) with mitigated_at: the first later bar that overlaps them."""
    later = candles.select("symbol", F.col("i").alias("j"), "h", "l")
    hit = zones.join(later, (zones["symbol"] == later["symbol"]) & (F.col("j") > F.col("i")) & (F.col("l") <= F.col("top")) & (F.col("h") >= F.col("bottom")), "left").select(zones["*"], "j")
    return hit.groupBy("symbol", "i", "dir", "bottom", "top").agg(F.min("j").alias("mitigated_at"))


def order_blocks(recurrent: DataFrame, impulse: float = 1.5, ahead: int = 3) -> DataFrame:
    """(symbol, i, dir, bottom, top, mitigated_at): bars against which price moved ``impulse`` mean ranges within
    ``ahead`` bars, past the newest earlier pivot. Takes bars with atr14."""
    later, earlier = series().rowsBetween(1, ahead), series().rowsBetween(Window.unboundedPreceding, -1)
    seen = marked(recurrent).withColumns({"top_after": F.max("h").over(later), "low_after": F.min("l").over(later), "after": F.count("*").over(later), "high_before": F.last("pivot_high", True).over(earlier), "low_before": F.last("pivot_low", True).over(earlier)})
    move = impulse * F.col("atr14")
    usable = seen.where((F.col("i") >= 1) & (F.col("after") == ahead) & (F.col("atr14") > 0))
    bull = (F.col("c") < F.col("o")) & (F.col("top_after") - F.col("l") >= move) & (F.col("top_after") > F.col("high_before"))
    bear = (F.col("c") > F.col("o")) & (F.col("h") - F.col("low_after") >= move) & (F.col("low_after") < F.col("low_before"))
    zones = usable.withColumn("dir", F.when(bull, "bull").when(bear, "bear")).where("dir IS NOT NULL").select("symbol", "i", "dir", F.col("l").alias("bottom"), F.col("h").alias("top"))
    return _first_overlap(zones, recurrent)


def pools(found: DataFrame, touches: int = 2) -> DataFrame:
    """(symbol, kind, price, touches, last_i): pivots of a kind by price, joined to a level while within the
    tolerance of its mean so far; levels with enough touches. found: (symbol, kind, i, price, tolerance).

    A mean never exceeds the prices that made it, so prices further apart than the tolerance never join: only runs without such a
    step are walked one by one."""
    by_price = Window.partitionBy("symbol", "kind").orderBy("price", "i")
    apart = F.coalesce((F.col("price") - F.lag("price").over(by_price) > F.col("tolerance")).cast("int"), F.lit(0))
    runs = found.where("tolerance > 0").withColumn("apart", apart).withColumn("run", F.sum("apart").over(by_price.rowsBetween(Window.unboundedPreceding, 0)))
    points = runs.groupBy("symbol", "kind", "run").agg(F.array_sort(F.collect_list(F.struct("price", "i", "tolerance"))).alias("points"))

    def level(total: Column, n: Column, last: Column) -> Column:
        return F.array(F.struct((total / n).alias("price"), n.alias("touches"), last.alias("last_i")))

    def join(so_far: Column, p: Column) -> Column:
        total, n, last = so_far["total"], so_far["n"], so_far["last"]
        near = F.abs(p["price"] - total / n) <= p["tolerance"]
        grown = F.struct(so_far["done"].alias("done"), (total + p["price"]).alias("total"), (n + 1).alias("n"), F.greatest(last, p["i"]).alias("last"))
        fresh = F.struct(F.concat(so_far["done"], level(total, n, last)).alias("done"), p["price"].alias("total"), F.lit(1).alias("n"), p["i"].alias("last"))
        return F.when(near, grown).otherwise(fresh)

    one = F.col("points")[0]
    none = F.slice(level(one["price"], F.lit(1), one["i"]), 1, 0)
    begun = F.struct(none.alias("done"), one["price"].alias("total"), F.lit(1).alias("n"), one["i"].alias("last"))
    walked = F.aggregate(F.slice("points", 2, F.size("points")), begun, join, lambda x: F.concat(x["done"], level(x["total"], x["n"], x["last"])))
    return points.select("symbol", "kind", F.inline(walked)).where(F.col("touches") >= touches)


def equal_levels(candles: DataFrame, tolerances: DataFrame, touches: int = 2) -> DataFrame:
    """``pools`` of the symbols' pivots. tolerances: (symbol, tolerance)."""
    return pools(pivots(candles).join(tolerances, "symbol"), touches)


def sweeps(candles: DataFrame, levels: DataFrame) -> DataFrame:
    """levels with swept_at: the first bar after the last touch whose wick passes the level and whose close stays
    inside; null if none."""
    bars = candles.select(F.col("symbol").alias("s"), F.col("i").alias("j"), "h", "l", "c")
    price, high = F.col("price"), F.col("kind") == "high"
    beyond = F.when(high, (F.col("h") > price) & (F.col("c") < price)).otherwise((F.col("l") < price) & (F.col("c") > price))
    hit = levels.join(bars, (F.col("s") == F.col("symbol")) & (F.col("j") > F.col("last_i")) & beyond, "left")
    return hit.groupBy(*levels.columns).agg(F.min("j").alias("swept_at"))


def gaps(candles: DataFrame) -> DataFrame:
    """(symbol, i, dir, bottom, top, mitigated_at): gaps between a bar and the one two before, and the first later
    bar that overlaps them."""
    h2, l2 = F.lag("h", 2).over(series()), F.lag("l", 2).over(series())
    marked = candles.withColumns({"h2": h2, "l2": l2})
    bull = marked.where("h2 < l").select("symbol", "i", F.lit("bull").alias("dir"), F.col("h2").alias("bottom"), F.col("l").alias("top"))
    bear = marked.where("l2 > h").select("symbol", "i", F.lit("bear").alias("dir"), F.col("h").alias("bottom"), F.col("l2").alias("top"))
    return _first_overlap(bull.union(bear), candles)


def session(hour: Column) -> Column:
    """Trading session of a UTC hour; the first that holds it."""
    return F.when((hour >= 22) | (hour < 2), "asia").when(hour.between(7, 9), "london").when(hour.between(12, 14), "ny-am").when(hour == 15, "ny-pm").otherwise("off-hours")


def session_stats(candles: DataFrame) -> DataFrame:
    tagged = candles.withColumn("session", session(F.pmod("t", F.lit(24))))
    return tagged.groupBy("symbol", "session").agg(F.count("*").alias("bars"), F.avg(F.col("h") - F.col("l")).alias("avg_range"), F.avg("v").alias("avg_volume"))


def patterned(candles: DataFrame) -> DataFrame:
    """candles with patterns: names of the patterns that end at each bar, in a fixed order, comma-joined."""
    p = {k: F.lag(k, 1).over(series()) for k in "ohlc"}
    q = {k: F.lag(k, 2).over(series()) for k in "ohlc"}
    bars = candles.withColumns({f"{k}1": p[k] for k in "ohlc"} | {f"{k}2": q[k] for k in "ohlc"})
    c = F.col
    body, span = F.abs(c("c") - c("o")), c("h") - c("l")
    up, down = c("h") - F.greatest("o", "c"), F.least("o", "c") - c("l")
    bull, bear, bull1, bear1 = c("c") > c("o"), c("c") < c("o"), c("c1") > c("o1"), c("c1") < c("o1")
    small1 = (c("h1") != c("l1")) & (F.abs(c("c1") - c("o1")) <= 0.3 * (c("h1") - c("l1")))
    rules = {
        "doji": (span > 0) & (body / F.when(span > 0, span) <= 0.05),
        "hammer": (body != 0) & (down >= 2 * body) & (up <= body),
        "invHammer": (body != 0) & (up >= 2 * body) & (down <= body),
        "bullEngulf": bear1 & bull & (c("o") <= c("c1")) & (c("c") >= c("o1")),
        "bearEngulf": bull1 & bear & (c("o") >= c("c1")) & (c("c") <= c("o1")),
        "bullHarami": bear1 & bull & (c("o") >= c("c1")) & (c("c") <= c("o1")),
        "bearHarami": bull1 & bear & (c("o") <= c("c1")) & (c("c") >= c("o1")),
        "morningStar": (c("c2") < c("o2")) & small1 & bull & (c("c") > (c("o2") + c("c2")) / 2),
        "eveningStar": (c("c2") > c("o2")) & small1 & bear & (c("c") < (c("o2") + c("c2")) / 2),
    }
    names = F.array_join(F.array(*(F.when(rule, name) for name, rule in rules.items())), ",")
    return bars.select(*candles.columns, names.alias("patterns"))


def candle_patterns(candles: DataFrame) -> DataFrame:
    """(symbol, i, patterns): bars at which any pattern ends."""
    return patterned(candles).select("symbol", "i", "patterns").where("patterns <> ''")


def profiled(candles: DataFrame, lookback: int = 200, session_start: Column | None = None) -> DataFrame:
    """The last ``lookback`` bars of each symbol (all, if 0), from the first of them at or after session_start on where one is."""
    own = Window.partitionBy("symbol")
    last = candles.withColumn("n", F.count("*").over(own)).where((F.lit(lookback) <= 0) | (F.col("i") >= F.col("n") - lookback)).drop("n")
    if session_start is None:
        return last
    begun = last.withColumn("_start", session_start).withColumn("_first", F.min(F.when(F.col("t") >= F.col("_start"), F.col("i"))).over(own))
    return begun.where(F.col("_first").isNull() | (F.col("i") >= F.col("_first"))).drop("_start", "_first")


def _span(last: DataFrame) -> DataFrame:
    return last.groupBy("symbol").agg(F.min("l").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("bars")).where("hi > lo AND bars > 1")


def _clamped(buckets: int) -> int:
    """A profile has 4 to 256 buckets (fixed values)."""
    return max(4, min(256, buckets))


def volume_profile(candles: DataFrame, buckets: int = 24, lookback: int = 200, session_start: Column | None = None) -> DataFrame:
    """(symbol, bucket, volume, up, down): whole bars' volume by bucket of typical price over ``profiled`` bars; empty
    buckets included. Symbols with one bar or no range have no profile; volumes that are null or below 0 count as 0."""
    buckets, last = _clamped(buckets), profiled(candles, lookback, session_start)
    edges = _span(last).drop("bars")
    at = F.floor(((F.col("h") + F.col("l") + F.col("c")) / 3.0 - F.col("lo")) / ((F.col("hi") - F.col("lo")) / buckets))
    placed = last.join(edges, "symbol").withColumns({"bucket": F.greatest(F.lit(0), F.least(F.lit(buckets - 1), at)).cast("int"), "v": F.when(F.col("v") > 0, F.col("v")).otherwise(0.0)})
    sums = placed.groupBy("symbol", "bucket").agg(F.sum("v").alias("volume"), F.sum(F.when(F.col("c") >= F.col("o"), F.col("v")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("c") < F.col("o"), F.col("v")).otherwise(0.0)).alias("down"))
    grid = edges.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return grid.join(sums, ["symbol", "bucket"], "left").fillna(0.0, ["volume", "up", "down"])


def profile_summary(candles: DataFrame, buckets: int = 24, lookback: int = 200, session_start: Column | None = None, share: float = 0.7) -> DataFrame:
    """(symbol, poc, vah, val, vapct, buckets, bars, hvn, lvn): the middle of the fullest bucket, the edges of the value area and its
    share of the volume (null where there is none), and how many buckets are high and low nodes."""
    buckets = _clamped(buckets)
    profile = volume_profile(candles, buckets, lookback, session_start)
    nodes = volume_nodes(profile).groupBy("symbol").agg(F.sum("volume").alias("total"), F.count_if(F.col("node") == "HVN").alias("hvn"), F.count_if(F.col("node") == "LVN").alias("lvn"))
    found = value_area(profile, share).join(nodes, "symbol").join(_span(profiled(candles, lookback, session_start)), "symbol")
    price = lambda at: F.col("lo") + (F.col("hi") - F.col("lo")) / buckets * at
    held = F.when(F.col("total") > 0, F.col("covered") / F.col("total"))
    return found.select("symbol", price(F.col("poc") + 0.5).alias("poc"), price(F.col("last") + 1).alias("vah"), price(F.col("first")).alias("val"), held.alias("vapct"), F.lit(buckets).alias("buckets"), "bars", "hvn", "lvn")


def clustered(found: DataFrame, half_life: int = 500) -> DataFrame:
    """(symbol, price, touches, kinds, strength): pivots clustered where the next price is within the tolerance; the median
    price, and touches that halve in weight every half_life bars of age. found: (symbol, i, kind, price, tolerance)."""
    newest = F.max("i").over(Window.partitionBy("symbol"))
    by_price = Window.partitionBy("symbol").orderBy("price", "i", "kind")
    apart = F.coalesce((F.col("price") - F.lag("price").over(by_price) > F.col("tolerance")).cast("int"), F.lit(0))
    islands = found.withColumns({"age": newest - F.col("i"), "apart": apart}).withColumn("island", F.sum("apart").over(by_price.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = F.when(F.min("kind") != F.max("kind"), "both").when(F.min("kind") == "high", "resistance").otherwise("support")
    return islands.groupBy("symbol", "island").agg(F.median("price").alias("price"), F.count("*").alias("touches"), kinds.alias("kinds"), F.sum(F.pow(F.lit(0.5), F.col("age") / half_life)).alias("strength")).drop("island")


def levels(candles: DataFrame, tolerance: float = 0.5, half_life: int = 500, tolerances: DataFrame | None = None) -> DataFrame:
    """``clustered`` pivots, ``tolerance`` apart (or as far as the symbol's in tolerances)."""
    found = pivots(candles)
    found = found.withColumn("tolerance", F.lit(tolerance)) if tolerances is None else found.join(tolerances, "symbol")
    return clustered(found, half_life)


def strongest(found: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` levels of each symbol of the greatest strength, the cheaper of equals."""
    order = Window.partitionBy("symbol").orderBy(F.desc("strength"), "price")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def premium_discount(candles: DataFrame) -> DataFrame:
    """(symbol, high, low, pct, zone): where the last close lies between the newest high and low pivots."""
    ends = pivots(candles).groupBy("symbol").agg(F.max_by("price", F.when(F.col("kind") == "high", F.col("i"))).alias("high"), F.max_by("price", F.when(F.col("kind") == "low", F.col("i"))).alias("low"))
    last = candles.groupBy("symbol").agg(F.max_by("c", "i").alias("c"))
    found = ends.where("high > low").join(last, "symbol").withColumn("pct", (F.col("c") - F.col("low")) / (F.col("high") - F.col("low")))
    pct = F.col("pct")
    return found.select("symbol", "high", "low", "pct", F.when((pct < 0) | (pct > 1), "outside").when(pct < 0.45, "discount").when(pct <= 0.55, "equilibrium").otherwise("premium").alias("zone"))


def value_area(profile: DataFrame, share: float = 0.7) -> DataFrame:
    """(symbol, poc, first, last, covered): the fullest bucket (lowest of equals) and the buckets around it, grown
    towards the fuller neighbour (upwards if equal) until they hold ``share`` of the volume."""

    def each(buckets: pd.DataFrame) -> pd.DataFrame:
        v = buckets.sort_values("bucket")["volume"].to_numpy(float)
        first = last = poc = int(v.argmax())
        held = v[poc]
        while held < share * v.sum() and (first > 0 or last < len(v) - 1):
            below, above = v[first - 1] if first > 0 else -1.0, v[last + 1] if last < len(v) - 1 else -1.0
            first, last = (first, last + 1) if above >= below else (first - 1, last)
            held += max(above, below)
        return pd.DataFrame([(buckets["symbol"].iloc[0], poc, first, last, held)], columns=["symbol", "poc", "first", "last", "covered"])

    return profile.select("symbol", "bucket", "volume").groupBy("symbol").applyInPandas(each, "symbol string, poc int, first int, last int, covered double")


def volume_nodes(profile: DataFrame, high: float = 1.5, low: float = 0.4) -> DataFrame:
    """profile with node: HVN and LVN by the symbol's upper median volume (mean of the filled buckets if that is 0)."""
    volumes = F.sort_array(F.collect_list("volume").over(Window.partitionBy("symbol")))
    middle = F.get(volumes, F.floor(F.size(volumes) / 2).cast("int"))
    filled = F.avg(F.when(F.col("volume") > 0, F.col("volume"))).over(Window.partitionBy("symbol"))
    based = profile.withColumn("base", F.when(middle > 0, middle).otherwise(filled))
    node = F.when(F.col("volume") >= high * F.col("base"), "HVN").when((F.col("volume") > 0) & (F.col("volume") <= low * F.col("base")), "LVN")
    return based.withColumn("node", node).drop("base")
