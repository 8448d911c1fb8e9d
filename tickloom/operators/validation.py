"""Predictions held against the bars that followed: verdicts, their summary, mistakes and drift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("direction", "return", "interval", "set")


def sample_predictions(bars: DataFrame) -> DataFrame:
    """Predictions made of bars by rule, one for each, of the four kinds in turn; stands in for a table of them."""
    i, c, o = F.col("i"), F.col("c"), F.col("o")
    classes = F.when(i % 3 == 0, F.array(F.lit("long"))).when(i % 3 == 1, F.array(F.lit("long"), F.lit("short"))).otherwise(F.array().cast("array<string>"))
    columns = {
        "kind": F.element_at(F.array(*map(F.lit, KINDS)), (i % 4 + 1).cast("int")),
        "dir": F.when(c > o, "up").when(c < o, "down").otherwise("flat"),
        "prob": 0.5 + (i % 40) / 100.0,
        "ref_price": c,
        "yhat": (i % 7 - 3) / 1000.0,
        "sigma": F.when(i % 5 != 0, 0.01),
        "lo": F.lit(-0.001),
        "hi": 0.001 * (1 + i % 3),
        "classes": classes,
    }
    return bars.select("symbol", "i", "t", *(x.alias(k) for k, x in columns.items()))


def realized_direction(o: Column, c: Column, band: float) -> Column:
    return F.when(o.isNull() | c.isNull() | ((F.lit(band) > 0) & (F.abs(c - o) <= F.abs(o) * band)), "flat").when(c > o, "up").when(c < o, "down").otherwise("flat")


def validate(predictions: DataFrame, bars: DataFrame, band: float = 0.0005, ahead: int = 1, at: str | None = None) -> DataFrame:
    """predictions with the verdict by the bar ``ahead`` time units later, or by that of the time in column ``at`` (an
    equi-join on symbol and time). missing:
    no such bar; ok: the payload is usable. Fields that a kind does not have are null."""
    when = (F.col("t") - ahead).alias("t") if at is None else F.col("t").alias(at)
    later = bars.select("symbol", when, F.col("o").alias("next_o"), F.col("c").alias("next_c"), F.lit(True).alias("found"))
    rows = predictions.join(later, ["symbol", at or "t"], "left").withColumn("missing", F.col("found").isNull())
    kind = {k: (F.col("kind") == k) & ~F.col("missing") for k in KINDS}
    way = realized_direction(F.col("next_o"), F.col("next_c"), band)
    ref = F.coalesce(F.col("ref_price"), F.col("next_o"))
    rows = rows.withColumns({"realized_dir": F.when(kind["direction"] | kind["set"], way), "realized": F.when(kind["return"] | kind["interval"], (F.col("next_c") - ref) / F.when(ref != 0, ref))})
    usable = F.when(kind["direction"], F.col("dir").isin("up", "down", "flat")).when(kind["return"], F.col("yhat").isNotNull() & F.col("realized").isNotNull()).when(kind["interval"], (F.col("lo") <= F.col("hi")) & F.col("realized").isNotNull()).when(kind["set"], True)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    kind = {k: kind[k] & F.col("ok") for k in KINDS}
    named = F.when(F.col("realized_dir") == "up", "long").when(F.col("realized_dir") == "down", "short").otherwise(F.col("realized_dir"))
    rows = rows.withColumns({
        "abstain": F.when(kind["direction"], F.col("dir") == "flat").when(kind["set"], F.size("classes") == 0),
        "residual": F.when(kind["return"], F.col("realized") - F.col("yhat")),
        "covered": F.when(kind["interval"], F.col("realized").between(F.col("lo"), F.col("hi"))).when(kind["set"], F.array_contains("classes", named) | F.array_contains("classes", F.col("realized_dir"))),
        "width": F.when(kind["interval"], F.col("hi") - F.col("lo")),
        "centre_residual": F.when(kind["interval"], F.col("realized") - (F.col("lo") + F.col("hi")) / 2.0),
        "set_size": F.when(kind["set"], F.size("classes")),
    })
    rows = rows.withColumns({"hit": F.when(kind["direction"], ~F.col("abstain") & (F.col("dir") == F.col("realized_dir"))), "abs_error": F.abs("residual"), "z_score": F.col("residual") / F.when(F.col("sigma") > 0, F.col("sigma"))})
    brier = F.pow(F.col("prob") - F.when(F.col("hit"), 1.0).otherwise(0.0), F.lit(2))
    return rows.withColumn("brier", F.when(kind["direction"], brier)).drop("next_o", "next_c", "found")


def summarize(verdicts: DataFrame, *by: str) -> DataFrame:
    """One row for each group: counts and means over each kind's usable verdicts; one pass, summed map-side."""
    ok = {k: (F.col("kind") == k) & F.col("ok") for k in KINDS}
    mean = lambda k, x: F.avg(F.when(ok[k], x))
    decided = ok["direction"] & ~F.col("abstain")
    one = lambda x: F.when(F.col(x), 1.0).otherwise(0.0)
    return verdicts.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(ok["direction"]).alias("dir_n"),
        F.count_if(ok["direction"] & F.col("hit")).alias("hits"),
        F.avg(F.when(decided, one("hit"))).alias("accuracy"),
        F.count_if(ok["direction"] & F.col("abstain")).alias("dir_abstain"),
        F.count_if(ok["return"]).alias("ret_n"),
        mean("return", F.col("abs_error")).alias("mae"),
        F.sqrt(mean("return", F.col("residual") * F.col("residual"))).alias("rmse"),
        mean("return", F.col("residual")).alias("mean_residual"),
        F.count_if(ok["interval"]).alias("int_n"),
        mean("interval", one("covered")).alias("int_coverage"),
        mean("interval", F.col("width")).alias("mean_width"),
        F.count_if(ok["set"]).alias("set_n"),
        mean("set", one("covered")).alias("set_coverage"),
        mean("set", F.col("set_size")).alias("mean_size"),
        F.count_if(ok["set"] & F.col("abstain")).alias("set_abstain"),
        F.avg("brier").alias("brier"),
    )


def mistakes(verdicts: DataFrame) -> DataFrame:
    """verdicts that are mistakes, with error_type and error_mag: a wrong direction (the move in mean ranges, or
    the return, or 1 if unknown), an interval or set that missed, a return further off than the mean range. Takes
    verdicts with atr14."""
    wrong = F.col("ok") & ~F.coalesce(F.col("abstain"), F.lit(False))
    kind, atr = F.col("kind"), F.when(F.col("atr14") > 0, F.col("atr14"))
    error = F.when((kind == "direction") & ~F.col("hit"), "direction").when((kind == "interval") & ~F.col("covered"), "interval-miss").when((kind == "return") & (F.col("abs_error") > atr), "magnitude").when((kind == "set") & ~F.col("covered"), "set-miss")
    moved = F.abs("realized")
    size = F.when(F.col("error_type") == "direction", F.coalesce(moved * F.coalesce("ref_price", F.lit(1.0)) / atr, moved)).when(F.col("error_type") == "interval-miss", F.abs("centre_residual")).when(F.col("error_type") == "magnitude", F.col("abs_error") / atr)
    return verdicts.where(wrong).withColumn("error_type", error).where("error_type IS NOT NULL").withColumn("error_mag", F.coalesce(size, F.lit(1.0)))


def mistake_summary(found: DataFrame, by: str = "symbol") -> DataFrame:
    """(error_type, by, n, last_t): counts by type, by group and in all, in one pass of grouping sets."""
    return found.groupingSets([["error_type"], [by], []], "error_type", by).agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


def drift(verdicts: DataFrame, delta: float = 0.005, threshold: float = 50.0, window: int = 100, alpha: float = 0.1) -> DataFrame:
    """(symbol, i, accuracy, page_hinkley, drifted, ewma) over decided directions in order: accuracy of the last
    ``window``, Page-Hinkley statistic of the errors, whether it has passed its threshold, and the exponential mean.
    All windows share one sort by symbol."""
    w = Window.partitionBy("symbol").orderBy("i")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = verdicts.where("kind = 'direction' AND ok AND NOT abstain").select("symbol", "i", F.col("hit").cast("double").alias("x"))
    rows = rows.withColumn("step", (1.0 - F.col("x")) - F.avg(1.0 - F.col("x")).over(running) - delta)
    rows = rows.withColumn("moved", F.sum("step").over(running))
    rows = rows.withColumn("page_hinkley", F.col("moved") - F.least(F.lit(0.0), F.min("moved").over(running)))
    # values further back than span weigh less than a double can hold beside the newest
    span = int(36.8 / -math.log(1 - alpha)) + 2
    recent = F.reverse(F.collect_list("x").over(w.rowsBetween(1 - span, 0)))
    rows = rows.withColumns({"recent": recent, "seeded": F.row_number().over(w) <= span})
    weight = lambda v, k: v * F.pow(F.lit(1 - alpha), k) * F.when(F.col("seeded") & (k == F.size("recent") - 1), 1.0).otherwise(alpha)
    ewma = F.aggregate(F.transform("recent", weight), F.lit(0.0), lambda a, x: a + x)
    return rows.select("symbol", "i", F.avg("x").over(w.rowsBetween(1 - window, 0)).alias("accuracy"), "page_hinkley", F.max(F.col("page_hinkley") > threshold).over(running).alias("drifted"), ewma.alias("ewma"))
