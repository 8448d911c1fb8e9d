"""Chart patterns over pivots: head and shoulders, double and triple tops and bottoms, triangles.

Bottoms are tops of the mirrored series, so every detector runs once for both sides with prices times ``s`` (1 or -1).
Each works on a bounded tail of a symbol's pivots: the last twelve, three or four."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import structure

COLUMNS = ("symbol", "name", "bias", "confidence", "target", "invalidation", "at_bar", "age", "broken", "neckline", "detector")


def confidence(score: Column) -> Column:
    """Three grades of confidence; lower scores are no pattern."""
    return F.when(score >= 0.75, 0.85).when(score >= 0.45, 0.6).when(score >= 0.2, 0.35)


def within(a: Column, b: Column, share: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * share


def _alike(a: Column, b: Column) -> Column:
    return 1 - F.abs(a - b) / F.greatest(a, b)


def _shown(rows: DataFrame, names: tuple[str, str], biases: tuple[str, str], detector: Column) -> DataFrame:
    side = lambda pair: F.when(F.col("s") > 0, pair[0]).otherwise(pair[1])
    rows = rows.withColumn("confidence", confidence(F.col("score"))).where("confidence IS NOT NULL")
    return rows.withColumns({"name": side(names), "bias": side(biases), "age": F.col("last_i") - F.col("at_bar"), "detector": detector}).select(*COLUMNS)


def _shoulders(pivots: DataFrame, ends: DataFrame) -> DataFrame:
    order = Window.partitionBy("symbol").orderBy("i", "kind")
    tail = pivots.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i"), F.desc("kind")))).where("back <= 12")
    five = {x: F.lead(F.struct("i", "kind", "price"), k).over(order) for k, x in enumerate("bcde", 1)}
    five = tail.withColumns({"a": F.struct("i", "kind", "price"), **five}).where("e IS NOT NULL AND a.kind = c.kind AND c.kind = e.kind AND b.kind = d.kind AND a.kind <> b.kind")
    rows = five.join(ends, "symbol").withColumn("s", F.when(F.col("a.kind") == "high", 1).otherwise(-1))
    s, a, c, e = F.col("s"), F.col("a.price"), F.col("c.price"), F.col("e.price")
    slope = (F.col("d.price") - F.col("b.price")) / F.greatest(F.lit(1), F.col("d.i") - F.col("b.i"))
    rows = rows.withColumns({"slope": slope, "shoulder": F.greatest(s * a, s * e)}).where((s * c > F.col("shoulder") + F.col("atr") * 0.3) & within(a, e, 0.04))
    line = lambda at: F.col("b.price") + F.col("slope") * (at - F.col("b.i"))
    rows = rows.withColumn("neckline", line(F.col("last_i"))).withColumn("broken", s * F.col("last_c") < s * F.col("neckline") - F.col("atr") * 0.1)
    score = 0.4 + _alike(a, e) * 0.25 + F.when(F.col("broken"), 0.25).otherwise(0.0) + F.least(F.lit(0.1), (s * c - F.col("shoulder")) / F.greatest("atr", F.lit(1e-9)) * 0.05)
    rows = rows.withColumns({"score": score, "target": F.col("neckline") - (c - line(F.col("c.i"))), "invalidation": c, "at_bar": F.col("e.i")})
    return _shown(rows, ("Head & Shoulders", "Inverse Head & Shoulders"), ("bearish", "bullish"), F.lit(0))


def _tops(pivots: DataFrame, ends: DataFrame) -> DataFrame:
    """Triple where three match with a trough between each, else double of the last two."""
    by_kind = Window.partitionBy("symbol", "kind").orderBy(F.desc("i"))
    last = pivots.withColumn("back", F.row_number().over(by_kind)).where("back <= 3").groupBy("symbol", "kind")
    last = last.agg(*(F.max(F.when(F.col("back") == k, F.struct("i", "price"))).alias(x) for k, x in ((3, "a"), (2, "b"), (1, "c")))).where("b IS NOT NULL")
    rows = last.join(ends, "symbol").withColumn("s", F.when(F.col("kind") == "high", 1).otherwise(-1))
    other = pivots.select("symbol", F.when(F.col("kind") == "high", "low").otherwise("high").alias("kind"), F.col("i").alias("x"), F.col("price").alias("y"))
    between = rows.select("symbol", "kind", "s", "a", "b", "c").join(other, ["symbol", "kind"]).where("x < c.i AND x > coalesce(a.i, b.i)")
    trough = lambda on: F.min(F.when(F.expr(on), F.col("s") * F.col("y")))
    troughs = between.groupBy("symbol", "kind").agg(trough("x < b.i").alias("first"), trough("x > b.i").alias("second"))
    rows = rows.join(troughs, ["symbol", "kind"])
    p, s = {x: F.col(f"{x}.price") for x in "abc"}, F.col("s")
    match = lambda x, y: within(p[x], p[y], 0.025) & (F.abs(F.col(f"{x}.i") - F.col(f"{y}.i")) >= 4)
    triple = F.col("a").isNotNull() & match("a", "b") & match("b", "c") & match("a", "c") & F.col("first").isNotNull() & F.col("second").isNotNull()
    rows = rows.withColumn("triple", F.coalesce(triple, F.lit(False))).where(F.col("triple") | (match("b", "c") & F.col("second").isNotNull()))
    rows = rows.withColumn("neckline", s * F.when(F.col("triple"), F.least("first", "second")).otherwise(F.col("second")))
    rows = rows.withColumns({"broken": s * F.col("last_c") < s * F.col("neckline") - F.col("atr") * 0.1, "invalidation": F.when(F.col("triple"), (p["a"] + p["b"] + p["c"]) / 3).otherwise((p["b"] + p["c"]) / 2)})
    score = F.when(F.col("triple"), 0.5 + _alike(p["a"], p["c"]) * 0.3).otherwise(0.45 + _alike(p["b"], p["c"]) * 0.3) + F.when(F.col("broken"), 0.2).otherwise(0.0)
    rows = rows.withColumns({"score": score, "target": 2 * F.col("neckline") - F.col("invalidation"), "at_bar": F.col("c.i")})
    shown = _shown(rows.where("triple"), ("Triple Top", "Triple Bottom"), ("bearish", "bullish"), F.when(s > 0, 1).otherwise(2))
    return shown.union(_shown(rows.where("NOT triple"), ("Double Top", "Double Bottom"), ("bearish", "bullish"), F.when(s > 0, 1).otherwise(2)))


def _triangles(pivots: DataFrame, ends: DataFrame) -> DataFrame:
    tail = pivots.withColumn("back", F.row_number().over(Window.partitionBy("symbol", "kind").orderBy(F.desc("i")))).where("back <= 4")
    one = lambda k, x: F.max(F.when(F.col("back") == k, F.col(x)))
    sides = tail.groupBy("symbol", "kind").agg(one(2, "price").alias("before"), one(1, "price").alias("price"), one(1, "i").alias("i"), F.min("i").alias("begin"), F.regr_slope("price", "i").alias("slope")).where("before IS NOT NULL")
    flat = sides.select("symbol", "kind", F.col("before").alias("one"), F.col("price").alias("two"), F.col("i").alias("at_bar"))
    lean = sides.select("symbol", F.when(F.col("kind") == "high", "low").otherwise("high").alias("kind"), "price", "i", "begin", "slope")
    rows = flat.join(lean, ["symbol", "kind"]).join(ends, "symbol").withColumn("s", F.when(F.col("kind") == "high", 1).otherwise(-1))
    s = F.col("s")
    rows = rows.where(within(F.col("one"), F.col("two"), 0.02) & (s * F.col("slope") > 0)).withColumn("neckline", (F.col("one") + F.col("two")) / 2)
    rows = rows.withColumn("broken", s * F.col("last_c") > s * F.col("neckline") + F.col("atr") * 0.1)
    score = 0.45 + F.least(F.lit(0.25), s * F.col("slope") * (F.col("i") - F.col("begin")) / F.greatest("atr", F.lit(1e-9))) + F.when(F.col("broken"), 0.2).otherwise(0.0)
    target = F.col("neckline") + s * F.greatest(F.lit(0.0), s * (F.col("neckline") - F.col("price")))
    rows = rows.withColumns({"score": score, "target": target, "invalidation": F.col("price")})
    return _shown(rows, ("Ascending Triangle", "Descending Triangle"), ("bullish", "bearish"), F.when(s > 0, 3).otherwise(4))


def detected(pivots: DataFrame, ends: DataFrame) -> DataFrame:
    """COLUMNS of every pattern against each symbol's end. pivots: (symbol, i, kind, price); ends: (symbol, last_i, last_c,
    atr), of symbols with eight bars or more; atr null or 0: half a percent of the close."""
    usable = F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.greatest(F.lit(1e-9), F.abs("last_c") * 0.005))
    ends = ends.where("last_i >= 7").withColumn("atr", usable)
    return _shoulders(pivots, ends).union(_tops(pivots, ends)).union(_triangles(pivots, ends))


def chart_patterns(recurrent: DataFrame) -> DataFrame:
    """``detected`` against each symbol's newest bar and its mean range. Takes bars with atr14."""
    ends = recurrent.groupBy("symbol").agg(F.max("i").alias("last_i"), F.max_by("c", "i").alias("last_c"), F.max_by("atr14", "i").alias("atr"))
    return detected(structure.pivots(recurrent).select("symbol", "i", "kind", "price"), ends)


def newest(patterns: DataFrame) -> DataFrame:
    """The pattern that comes first in each symbol: newest, then surest, then by detector."""
    order = Window.partitionBy("symbol").orderBy(F.desc("at_bar"), F.desc("confidence"), "detector")
    return patterns.withColumn("n", F.row_number().over(order)).where("n = 1").select("symbol", "name", "bias", "confidence", "target", "invalidation", "broken", "age")
