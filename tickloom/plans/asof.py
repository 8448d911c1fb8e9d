"""What was known at a bar: one row of features and surrounding structure for any number of bars, each from the bars up
to it alone.

Most of it is carried forward by windows over the symbol's bars. A pivot needs two bars more to be one, so at bar j
only pivots up to j - 2 are known: what follows from pivots (trend, zone, breaks) is the state two bars before, and
the closes of the last two bars are held against the levels left then. What depends on the bar's own mean range (levels, pools and their
sweeps, lines, chart patterns, open blocks) is made from the pivots known at each bar, by the functions that serve
whole symbols: a moment, (symbol, bar), is a series of its own to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import indicators as I
from ..operators import chart_patterns, cisd, regime, structure, trendlines
from ..sources.candles import series
from .kept import kept

#: Patterns that a module reads as a side.
BULLISH = ("bullEngulf", "hammer", "morningStar")
BEARISH = ("bearEngulf", "eveningStar")
#: Bars after which a pivot is known.
RIGHT = 2


def features(candles: DataFrame) -> DataFrame:
    """Bars with recurrences and rolling indicators; one shuffle by symbol, its order kept by all windows."""
    w = series()
    up, mid, low = I.bollinger(F.col("c"))
    bars = I.volume_slope(I.obv(I.recurrences(candles)))
    bars = bars.withColumns({"bb_up": up, "bb_mid": mid, "bb_low": low, "roc10": I.roc(F.col("c"), 10), "cmf20": I.cmf(), "bull30": I.bull_share(), "v20": F.avg("v").over(I.rows(20)), "v20_before": F.avg("v").over(w.rowsBetween(-20, -1)), "session": structure.session(F.pmod("t", F.lit(24)))})
    lagged = {"obv20": F.lag("obv", 20).over(w), "hist0": F.col("macd_hist"), "hist1": F.lag("macd_hist", 1).over(w), "hist2": F.lag("macd_hist", 2).over(w), "c1": F.lag("c", 1).over(w), "c5": F.lag("c", 5).over(w)}
    bars = bars.withColumns({"bw": cisd.band_width(), **lagged})
    return bars.withColumn("width50", F.when(F.count("bw").over(I.rows(50)) == 50, F.avg("bw").over(I.rows(50)))).drop("bw")


def _upto(x: Column) -> Column:
    """The newest value of x that is known, up to each bar."""
    return F.last(x, True).over(series().rowsBetween(Window.unboundedPreceding, 0))


def _step(state: dict[str, Column], bar: Column) -> tuple[dict[str, Column], Column]:
    """The state after one more bar without a new pivot, and what it breaks."""
    up = F.coalesce(bar["c"] > state["high"], F.lit(False))
    down = ~up & F.coalesce(bar["c"] < state["low"], F.lit(False))
    side = F.when(up, 1).when(down, -1)
    event = F.when(side.isNotNull(), _event(side, state["side"], F.when(up, state["high"]).otherwise(state["low"]), bar))
    return {"high": F.when(~up, state["high"]), "low": F.when(~down, state["low"]), "side": F.coalesce(side, state["side"])}, event


def _event(side: Column, was: Column, level: Column, bar: Column) -> Column:
    return F.struct(F.when(was == -side, "CHoCH").otherwise("BoS").alias("type"), F.when(side == 1, "up").otherwise("down").alias("dir"), level.alias("level"), bar.alias("bar"))


def histories(candles: DataFrame) -> DataFrame:
    """features with, as of each bar: swing (trend of the last four pivots), the range between the newest pivots of both kinds,
    break1 and break2 (what the bar before and the bar itself break), last_break and breaks, and the newest candle
    patterns. ``event`` is what a bar breaks once all pivots up to it are known; see ``events``."""
    w, upto = series(), series().rowsBetween(Window.unboundedPreceding, 0)
    rows = structure.broken(structure.patterned(cisd.attributes(features(candles))))
    high, low = F.col("pivot_high").isNotNull(), F.col("pivot_low").isNotNull()
    earlier = series().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "bar": cisd.bar(), "_n": F.sum(high.cast("int") + low.cast("int")).over(upto),
        "_high_before": F.last("pivot_high", True).over(earlier), "_low_before": F.last("pivot_low", True).over(earlier),
    })
    # the newest label of a kind counts while its pivot is among the last four, a bar's high one before its low one
    rising = F.when(high, F.struct((F.col("pivot_high") > F.col("_high_before")).alias("higher"), F.col("_high_before").isNull().alias("first"), (F.col("_n") - low.cast("int")).alias("rank")))
    falling = F.when(low, F.struct((F.col("pivot_low") > F.col("_low_before")).alias("higher"), F.col("_low_before").isNull().alias("first"), F.col("_n").alias("rank")))
    rows = rows.withColumns({"_hi": _upto(rising), "_lo": _upto(falling)})
    recent = (F.col("_n") - F.col("_hi.rank") < 4) & (F.col("_n") - F.col("_lo.rank") < 4)
    hi, lo = F.col("_hi"), F.col("_lo")
    swing = F.when(~F.coalesce(recent, F.lit(False)), "unknown").when(hi["first"] | lo["first"], "range").when(hi["higher"] & lo["higher"], "up").when(~hi["higher"] & ~lo["higher"], "down").otherwise("range")
    event = F.when(F.col("side").isNotNull(), _event(F.col("side"), F.col("was"), F.col("level"), F.col("bar")))
    rows = rows.withColumns({"event": event, "_swing": swing})
    settled = F.struct(F.col("high_left").alias("high"), F.col("low_left").alias("low"), _upto(F.col("side")).alias("side"), _upto(F.col("event")).alias("event"), F.count("event").over(upto).alias("n"), F.col("_swing").alias("swing"), _upto(F.col("pivot_high")).alias("top"), _upto(F.col("pivot_low")).alias("bottom"))
    rows = rows.withColumn("_settled", settled)
    rows = rows.withColumns({"_state": F.lag("_settled", RIGHT).over(w), "_bar1": F.lag("bar").over(w)})
    s = F.col("_state")
    state, first = _step({"high": s["high"], "low": s["low"], "side": s["side"]}, F.col("_bar1"))
    rows = rows.withColumns({"break1": first, **{f"_{k}": v for k, v in state.items()}})
    _, second = _step({k: F.col(f"_{k}") for k in state}, F.col("bar"))
    rows = rows.withColumn("break2", second)
    whole = F.struct(F.max("h").over(upto).alias("top"), F.min("l").over(upto).alias("bottom"))
    both = s["top"].isNotNull() & s["bottom"].isNotNull()
    found = F.when(F.col("patterns") != "", F.struct("i", "patterns"))
    rows = rows.withColumns({
        "swing": F.coalesce(s["swing"], F.lit("unknown")), "top": F.when(both, s["top"]).otherwise(whole["top"]), "bottom": F.when(both, s["bottom"]).otherwise(whole["bottom"]),
        "last_break": F.coalesce("break2", "break1", s["event"]), "breaks": F.coalesce(s["n"], F.lit(0)) + F.col("break1").isNotNull().cast("int") + F.col("break2").isNotNull().cast("int"),
        "newest_patterns": _upto(found), "newer": F.lead("i").over(w),
    })
    return rows.drop(*(c for c in rows.columns if c.startswith("_")), "was", "level", "side", "high_left", "low_left")


def around(rows: DataFrame) -> DataFrame:
    """Histories with the columns that regime and modules read of breaks, patterns and zone."""
    b, p = F.col("last_break"), F.col("newest_patterns")
    pct = (F.col("c") - F.col("bottom")) / F.when(F.col("top") > F.col("bottom"), F.col("top") - F.col("bottom"))
    rows = rows.withColumns({"break_i": b["bar"]["i"], "break_type": b["type"], "break_dir": b["dir"], "break_v": b["bar"]["v"], "break_v20": b["bar"]["v20"], "pat_i": p["i"], "_p": F.split(p["patterns"], ","), "pct": pct})
    first = lambda names: F.array_min(F.filter(F.array(*(F.array_position("_p", n) for n in names)), lambda k: k > 0))
    rows = rows.withColumns({"bull_at": first(BULLISH), "bear_at": first(BEARISH)})
    marks = {"pat_bull": F.col("bull_at").isNotNull().cast("int"), "pat_bear": F.col("bear_at").isNotNull().cast("int")}
    zone = F.when((pct < 0) | (pct > 1), "outside").when(pct < 0.45, "discount").when(pct <= 0.55, "equilibrium").when(pct.isNotNull(), "premium")
    return rows.withColumns({**marks, "zone": zone}).drop("_p")


def known_pivots(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """(symbol, i, kind, price, close, range) of the pivots known at each moment; symbol is the moment (symbol, at)."""
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"pivot_{k}").alias("price")) for k in ("high", "low")))).alias("p")
    found = rows.where("pivot_high IS NOT NULL OR pivot_low IS NOT NULL").select("symbol", "i", ends).where("p.price IS NOT NULL").select("symbol", "i", "p.*")
    seen = moments.join(found, "symbol").where(F.col("i") + RIGHT <= F.col("at"))
    return seen.select(F.struct("symbol", "at").alias("symbol"), "i", "kind", "price", "close", "range")


def events(rows: DataFrame, moments: DataFrame, back: int) -> DataFrame:
    """(symbol, at, type, dir, level, bar) of the breaks of the last ``back`` bars, as they stood at each moment."""
    settled = rows.where("event IS NOT NULL").select("symbol", F.col("i").alias("j"), "event")
    old = moments.join(settled, "symbol").where((F.col("j") <= F.col("at") - RIGHT) & (F.col("j") >= F.col("at") - back)).select("symbol", "at", "event")
    last = moments.select("symbol", "at", F.explode(F.array("break1", "break2")).alias("event")).where("event IS NOT NULL")
    return old.union(last).select(F.struct("symbol", "at").alias("symbol"), "at", "event.*")


def _sweeps(rows: DataFrame, pools: DataFrame) -> DataFrame:
    """pools with bar: the first bar after the last touch, up to the moment, that sweeps the level; null if none."""
    bars = rows.select(F.col("symbol").alias("name"), F.struct("i", "h", "l", "c", "upper_wick", "lower_wick", "gap_up", "gap_down").alias("b"))
    price, b = F.col("price"), F.col("b")
    beyond = F.when(F.col("kind") == "high", (b["h"] > price) & (b["c"] < price)).otherwise((b["l"] < price) & (b["c"] > price))
    near = pools.withColumn("name", F.col("symbol.symbol")).join(bars, "name").where((b["i"] > F.col("last_i")) & (b["i"] <= F.col("symbol.at")) & beyond)
    first = near.groupBy("symbol", "kind", "price").agg(F.min("b").alias("bar"))
    return pools.join(first, ["symbol", "kind", "price"], "left")


def _levels(seen: DataFrame, moments: DataFrame) -> DataFrame:
    """The nearest levels below and above the close among the twenty strongest."""
    found = structure.strongest(structure.clustered(seen.withColumn("tolerance", F.coalesce(F.col("range") * 0.5, F.col("close") * 0.005))))
    c = F.col("symbol.close")
    keyed = found.join(moments, "symbol")
    c = F.col("close")
    below, above = F.when(F.col("price") <= c, F.struct("price", "strength")), F.when(F.col("price") >= c, F.struct("price", "strength"))
    ends = keyed.groupBy("symbol").agg(F.max(below).alias("s"), F.min(above).alias("r"))
    return ends.select("symbol", F.col("s.price").alias("support"), F.col("s.strength").alias("support_strength"), F.col("r.price").alias("resistance"), F.col("r.strength").alias("resistance_strength"))


def _blocks(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """The nearest open order block in reach, and how many there are. A block is known three bars after its own."""
    zones = structure.order_blocks(rows).where("i IS NOT NULL")
    near = moments.join(zones, "symbol").where((F.col("i") + 3 <= F.col("at")) & (F.col("at") >= 18))
    near = near.withColumn("block_tol", F.coalesce(F.col("range") * 0.25, F.col("close") * 0.0025))
    c, tol, bottom, top = F.col("close"), F.col("block_tol"), F.col("bottom"), F.col("top")
    away = F.when((c >= bottom - tol) & (c <= top + tol), 0.0).otherwise(F.least(F.abs(c - top), F.abs(c - bottom)))
    unmet = F.col("mitigated_at").isNull() | (F.col("mitigated_at") > F.col("at"))
    near = near.withColumn("block_dist", away).withColumn("in_reach", unmet & (F.col("block_dist") < 2 * tol))
    best = F.min_by(F.struct("dir", "i", "block_dist"), F.when(F.col("in_reach"), F.struct("block_dist", "i")))
    sums = near.groupBy(F.struct("symbol", "at").alias("symbol")).agg(best.alias("b"), F.count("*").alias("blocks"), F.count_if(unmet).alias("open_blocks"), F.max("block_tol").alias("block_tol"))
    return sums.select("symbol", F.col("b.dir").alias("block_dir"), F.col("b.i").alias("block_i"), F.col("b.block_dist").alias("block_dist"), "block_tol", "blocks", "open_blocks")


def _gaps(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """How many gaps were open."""
    found = structure.gaps(rows).select("symbol", "i", "mitigated_at")
    known = moments.join(found, "symbol").where((F.col("i") <= F.col("at")) & (F.col("mitigated_at").isNull() | (F.col("mitigated_at") > F.col("at"))))
    return known.groupBy(F.struct("symbol", "at").alias("symbol")).agg(F.count("*").alias("open_gaps"))


def _liquidity(pools: DataFrame, moments: DataFrame) -> DataFrame:
    """The sweep that is listed last (lows behind highs, by price), and the nearest pools on both sides."""
    keyed = pools.join(moments, "symbol")
    c = F.col("close")
    swept = F.max_by(F.struct("kind", F.col("bar.i").alias("i")), F.when(F.col("bar").isNotNull(), F.struct(F.col("kind") == "low", F.col("price"))))
    over, under = F.when((F.col("kind") == "high") & (F.col("price") > c), F.col("price")), F.when((F.col("kind") == "low") & (F.col("price") < c), F.col("price"))
    sums = keyed.groupBy("symbol").agg(swept.alias("w"), F.min(over).alias("pool_high"), F.min_by("touches", over).alias("high_touches"), F.max(under).alias("pool_low"), F.max_by("touches", under).alias("low_touches"), F.count_if(F.col("kind") == "high").alias("pools_high"), F.count_if(F.col("kind") == "low").alias("pools_low"))
    return sums.select("symbol", F.col("w.kind").alias("swept_kind"), F.col("w.i").alias("swept_i"), "pool_high", "high_touches", "pool_low", "low_touches", "pools_high", "pools_low")


def _lines(seen: DataFrame, ends: DataFrame) -> DataFrame:
    tolerances = ends.select("symbol", (F.col("atr") * 0.5).alias("tolerance"))
    found = trendlines.lines(seen.select("symbol", "i", "kind", "price"), tolerances)
    signal = trendlines.line_signal(found, trendlines.channels(found, ends), ends)
    return signal.select("symbol", F.col("position").alias("line_position"), F.col("signal").alias("line_signal"), F.col("confidence").alias("line_confidence"))


def _chart(seen: DataFrame, ends: DataFrame) -> DataFrame:
    newest = chart_patterns.newest(chart_patterns.detected(seen.select("symbol", "i", "kind", "price"), ends.select("symbol", F.col("i").alias("last_i"), F.col("c").alias("last_c"), "atr")))
    side = F.when(F.col("bias") == "bullish", 1.0).otherwise(-1.0) * F.col("confidence") * F.when(F.col("broken"), 1.0).otherwise(0.6)
    return newest.select("symbol", F.col("name").alias("chart_name"), side.alias("chart_signal"), F.col("confidence").alias("chart_confidence"))


def parts(candles: DataFrame, chosen: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """What ``states`` is joined from: rows (of all bars), here (of the chosen ones), and by moment moments, pivots, events,
    pools."""
    rows = kept(around(histories(candles)))
    here = chosen(rows)
    at = here.select("symbol", F.col("i").alias("at"), F.col("c").alias("close"), F.col("atr14").alias("range"), "break1", "break2")
    seen = known_pivots(rows, at.drop("break1", "break2"))
    found = structure.pools(seen.withColumn("tolerance", F.coalesce(F.col("range") * 0.25, F.col("close") * 0.0025)))
    moments = at.select(F.struct("symbol", "at").alias("symbol"), "at", "close", "range")
    back = cisd.LOOKBACK + cisd.SHIFT_BARS + cisd.SWEEP_BARS
    return {"rows": rows, "here": here, "at": at, "moments": moments, "pivots": seen, "events": events(rows, at, back), "pools": kept(_sweeps(rows, found))}


def states(candles: DataFrame, chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row for each chosen bar (symbol, i): its features and all around it as it was known then, with regime and phase.
    chosen picks bars from ``histories``; ``newer`` is null at a symbol's newest bar."""
    p = parts(candles, chosen)
    moments = p["moments"]
    ends = moments.select("symbol", F.col("at").alias("i"), F.col("close").alias("c"), F.when(F.col("range") > 0, F.col("range")).otherwise(F.greatest(F.lit(1e-9), F.abs("close") * 0.005)).alias("atr"))
    pools = p["pools"]
    made = [
        _levels(p["pivots"], moments), _blocks(p["rows"], p["at"]), _gaps(p["rows"], p["at"]), _liquidity(pools, moments), _lines(p["pivots"], ends), _chart(p["pivots"], ends),
        cisd.sequences(moments.select("symbol", "at"), p["events"], pools.where("bar IS NOT NULL")),
    ]
    out = p["here"].withColumn("moment", F.struct("symbol", F.col("i").alias("at")))
    for part in made:
        out = out.join(part.withColumnRenamed("symbol", "moment"), "moment", "left")
    # nor what is known of a bar only later
    gone = ("moment", "bar", "event", "break1", "break2", "last_break", "newest_patterns", "pivot_high", "pivot_low", "gap_up", "gap_down", "newer")
    plain = [c for c in out.columns if c not in gone]
    return regime.classify(out.select(*plain))


def regimes(candles: DataFrame) -> DataFrame:
    """Every bar's features, breaks, patterns and zone as they were known then, with regime and phase: what needs no more than
    windows over the symbol's bars. ``newer`` is null at the newest."""
    return regime.classify(around(histories(candles)))


def newest(candles: DataFrame) -> DataFrame:
    """The state of each symbol's newest bar."""
    return states(candles, lambda rows: rows.where("newer IS NULL"))
