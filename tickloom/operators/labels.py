"""Labels of bars for training (barriers, uniqueness), splits by time and statistics of feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.indicators import quotient
from ..sources.candles import series


def triple_barrier(bars: DataFrame, horizon: int = 12, up: float = 1.0, down: float = 1.0, least: float = 0.0) -> DataFrame:
    """(symbol, i, t1, side, touched, ret): which of two barriers, ``up`` and ``down`` sigmas from the close, the next
    ``horizon`` bars reach first; 'time' at the end of the horizon or series. A bar that reaches both counts for the
    one nearer to the close before it (upper if equal). Without a positive sigma: 'nan'. Takes bars with sigma; one that is no number
    (NaN) stands above all numbers, as it does in SQL, so the next bar lies under its lower barrier and ret is none either.

    Each row holds its horizon, which is bounded; there is one shuffle by symbol and no join."""
    c, upper, lower = F.col("c"), F.col("upper"), F.col("lower")
    seen = bars.withColumn("before", F.lag("c").over(series()))
    ahead = F.collect_list(F.struct("i", "h", "l", "c", "before")).over(series().rowsBetween(1, horizon))
    seen = seen.withColumns({"ahead": ahead, "known": F.coalesce(F.col("sigma") > 0, F.lit(False)), "upper": c + up * F.col("sigma"), "lower": c - down * F.col("sigma")})
    seen = seen.withColumns({"hit": F.get(F.filter("ahead", lambda x: (x["h"] >= upper) | (x["l"] <= lower)), 0), "end": F.get("ahead", F.size("ahead") - 1)})
    above, below = F.col("hit.h") >= upper, F.col("hit.l") <= lower
    nearer = F.when(F.abs(F.col("hit.before") - upper) <= F.abs(F.col("hit.before") - lower), "upper").otherwise("lower")
    touched = F.when(~F.col("known"), "nan").when(F.col("hit").isNull(), "time").when(above & below, nearer).when(above, "upper").otherwise("lower")
    seen = seen.withColumn("touched", touched)
    at = F.col("touched")
    reached = F.when(at == "upper", upper).when(at == "lower", lower).otherwise(F.coalesce(F.col("end.c"), c))
    ret = F.when(at != "nan", quotient(reached - c, c)).otherwise(0.0)
    side = F.when(F.abs("ret") < least, 0).when(at == "upper", 1).when(at == "lower", -1).otherwise(0)
    t1 = F.when(at != "nan", F.coalesce(F.col("hit.i"), F.col("end.i"), F.col("i")))
    return seen.withColumn("ret", ret).select("symbol", "i", t1.alias("t1"), side.alias("side"), "touched", "ret")


def meta_labels(labels: DataFrame, primary: DataFrame) -> DataFrame:
    """(symbol, i, label): 1 where the primary signal (symbol, i, primary) has a sign and it is the label's side."""
    sign = F.signum(F.coalesce(F.col("primary"), F.lit(0.0)))
    return labels.join(primary, ["symbol", "i"]).select("symbol", "i", F.when((sign != 0) & (sign == F.col("side")), 1).otherwise(0).alias("label"))


def uniqueness(labels: DataFrame) -> DataFrame:
    """(symbol, i, weight): the mean over a label's bars i..t1 of one by the number of labels that span the bar; 0
    without t1. Spans are counted by running sums of starts and ends, so no label is spread over its bars."""
    running = series().rowsBetween(Window.unboundedPreceding, 0)
    ends = labels.where("t1 IS NOT NULL").groupBy("symbol", (F.col("t1") + 1).alias("i")).agg(F.count("*").alias("ended"))
    step = F.col("t1").isNotNull().cast("int") - F.coalesce(F.col("ended"), F.lit(0))
    spans = labels.join(ends, ["symbol", "i"], "left").withColumn("spans", F.sum(step).over(running))
    share = F.when(F.col("spans") > 0, 1.0 / F.when(F.col("spans") > 0, F.col("spans"))).otherwise(0.0)
    sums = spans.withColumn("share", share).withColumn("total", F.sum("share").over(running))
    till = sums.select("symbol", F.col("i").alias("t1"), F.col("total").alias("till"))
    mean = (F.col("till") - F.col("total") + F.col("share")) / (F.col("t1") - F.col("i") + 1)
    return sums.join(till, ["symbol", "t1"], "left").select("symbol", "i", F.coalesce(mean, F.lit(0.0)).alias("weight"))


def distribution(labels: DataFrame) -> DataFrame:
    """(symbol, total, pos, neg, zero, pos_pct, neg_pct, zero_pct, imbalance)."""
    n = labels.groupBy("symbol").agg(F.count("*").alias("total"), F.count_if(F.col("side") > 0).alias("pos"), F.count_if(F.col("side") < 0).alias("neg"), F.count_if(F.col("side") == 0).alias("zero"))
    shares = {f"{k}_pct": F.col(k) / F.col("total") for k in ("pos", "neg", "zero")}
    return n.withColumns(shares | {"imbalance": F.abs(F.col("pos") - F.col("neg")) / F.greatest(F.lit(1), F.col("pos") + F.col("neg"))})


def _length() -> Column:
    return F.count("*").over(Window.partitionBy("symbol"))


def walk_forward(bars: DataFrame, train: float = 0.7, validation: float = 0.15, embargo: int = 0) -> DataFrame:
    """(symbol, i, part): train, val and test in order of time; ``embargo`` bars before val and test are left out."""
    sized = bars.withColumn("n", _length())
    first, second, i = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + validation)), F.col("i")
    part = F.when(i < first - embargo, "train").when((i >= first) & (i < second - embargo), "val").when(i >= second, "test")
    return sized.select("symbol", "i", part.alias("part")).where("part IS NOT NULL")


def purged_folds(labels: DataFrame, k: int = 5, embargo: int = 0) -> DataFrame:
    """(symbol, fold, i, part): k test stretches; train is what neither overlaps a fold's stretch by its own span
    i..t1 nor starts within ``embargo`` bars after the longest test label. Each label meets its symbol's k folds."""
    size = F.floor(F.col("n") / k)
    fold = F.least(F.lit(k - 1), F.floor(F.col("i") / F.greatest(F.lit(1), size))).cast("int")
    rows = labels.select("symbol", "i", F.coalesce("t1", "i").alias("end"), _length().alias("n")).withColumn("own", fold)
    folds = rows.groupBy("symbol", F.col("own").alias("fold")).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.least(F.max("n") - 1, F.max("end") + embargo).alias("until"))
    each = rows.join(folds, "symbol")
    i, first, last = F.col("i"), F.col("first"), F.col("last")
    part = F.when(F.col("own") == F.col("fold"), "test").when((F.col("end") < first) | ((i > last) & (i > F.col("until"))), "train")
    return each.select("symbol", "fold", "i", part.alias("part")).where("part IS NOT NULL")


def vector_statistics(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(dim, mean, std, low, high): by dimension; a deviation (sample) under 1e-12 is 1, an empty range one wide."""
    values = vectors.select(F.posexplode(column).alias("dim", "x")).select("dim", F.col("x").cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    sums = values.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))
    return sums.withColumns({"std": F.when(F.col("std") >= 1e-12, F.col("std")).otherwise(1.0), "high": F.when(F.col("high") == F.col("low"), F.col("low") + 1.0).otherwise(F.col("high"))})
