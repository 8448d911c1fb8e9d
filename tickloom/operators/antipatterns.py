"""Anti-patterns: clusters of mistakes in which calls seldom hit, found from the mistakes' vectors and the correct calls
that fall among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import learning
from .ledger import squared

#: Mistakes that a cluster and the whole need, hit rate under which it counts, and the share within its radius.
LEAST, BAD, SHARE = 20, 0.45, 0.9
BINS = 1024


def order_statistic(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """(by, value): of each group the value at place floor(share * (n - 1)), from 0, in order. Two passes: counts of BINS ranges
    tell the range that holds the place, then only that range's distinct values are put in order. Values are finite."""
    ends = rows.groupBy(by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_n"))
    width = F.col("_high") - F.col("_low")
    part = F.least(F.lit(BINS - 1), F.floor((F.col(value) - F.col("_low")) / F.when(width > 0, width) * BINS)).cast("int")
    binned = rows.select(by, value).join(ends, by).withColumns({"_bin": F.coalesce(part, F.lit(0)), "_goal": F.floor(share * (F.col("_n") - 1))})
    upto = Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy(by, "_goal", "_bin").agg(F.count("*").alias("_c")).withColumn("_till", F.sum("_c").over(upto))
    held = counts.where((F.col("_till") > F.col("_goal")) & (F.col("_till") - F.col("_c") <= F.col("_goal"))).select(by, "_bin", (F.col("_till") - F.col("_c")).alias("_before"))
    inside = binned.join(held, [by, "_bin"]).groupBy(by, "_goal", "_before", value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("_till", F.col("_before") + F.sum("_c").over(order)).where(F.col("_till") > F.col("_goal"))
    return found.groupBy(by).agg(F.min(value).alias(value))


def means(rows: DataFrame, by: str) -> DataFrame:
    """(by, centre): mean vector of each group's rows."""
    sums = rows.select(by, F.posexplode("vector").alias("dim", "x")).groupBy(by, "dim").agg(F.avg("x").alias("x"))
    return sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centre"))


def discovered(mistakes: DataFrame, corrects: DataFrame, k: int = 8, least: int = LEAST, bad: float = BAD) -> DataFrame:
    """(id, regime, centre, radius, hit_rate, samples, mistakes, direction, label): clusters of ``least`` mistakes or more whose
    hit rate, the correct calls within the radius by all there, stays under ``bad``. With fewer mistakes in all there are none.
    mistakes: (vec_id, vector, direction, regime), rows without a vector left out; corrects: (vector).

    regime is the most frequent one (the first by vec_id on ties), direction one that stands twice as often as the other."""
    usable = mistakes.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    placed = learning.clusters(usable, k)
    enough = placed.withColumn("_all", F.count("*").over(Window.partitionBy("cluster"))).where(F.col("_all") >= least).drop("_all")
    centres = F.broadcast(means(enough, "cluster"))  # k rows
    far = enough.join(centres, "cluster").select("cluster", squared(F.col("vector"), F.col("centre")).alias("radius"))
    radii = order_statistic(far, "cluster", "radius", SHARE)
    zones = F.broadcast(centres.join(radii, "cluster"))
    near = corrects.where(F.col("vector").isNotNull()).join(zones, squared(F.col("vector"), F.col("centre")) <= F.col("radius")).groupBy("cluster").agg(F.count("*").alias("hits"))

    way = lambda x: F.count_if(F.col("direction") == x)
    told = enough.groupBy("cluster").agg(F.count("*").alias("mistakes"), way("long").alias("_long"), way("short").alias("_short"))
    kinds = enough.withColumn("regime", F.coalesce("regime", F.lit("unknown"))).groupBy("cluster", "regime").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    common = kinds.groupBy("cluster").agg(F.max_by("regime", F.struct("n", -F.col("first"))).alias("regime"))
    rows = told.join(zones, "cluster").join(common, "cluster").join(near, "cluster", "left")
    hits = F.coalesce("hits", F.lit(0))
    rows = rows.withColumns({"samples": F.col("mistakes") + hits, "_rate": hits / (F.col("mistakes") + hits)}).where(F.col("_rate") < bad)
    side = F.when(F.col("_long") > 2 * F.col("_short"), "long").when(F.col("_short") > 2 * F.col("_long"), "short").otherwise("mixed")
    label = F.concat(F.col("direction"), F.lit(" in "), F.col("regime"), F.lit(" · miss "), F.col("mistakes"), F.lit("/"), F.col("samples"), F.lit(" ("), F.floor(F.col("_rate") * 100 + 0.5), F.lit("%)"))
    rows = rows.withColumn("direction", side)
    return rows.select(F.col("cluster").alias("id"), "regime", "centre", F.round("radius", 6).alias("radius"), F.round("_rate", 3).alias("hit_rate"), "samples", "mistakes", "direction", label.alias("label"))


def listed(patterns: DataFrame, regime: str | None = None, most: int = 100) -> DataFrame:
    """The first ``most`` patterns by id, of one regime or of all."""
    rows = patterns if regime is None else patterns.where(F.col("regime") == regime)
    return rows.orderBy("id").limit(most)


def top_modules(signals: DataFrame, keys: tuple[str, ...] = ("symbol",), most: int = 4) -> DataFrame:
    """signals with ``place`` 1 to ``most``: a mistake's context, the modules of the greatest signal times confidence, rounded;
    equal ones in the registry's order (``at``)."""
    force: Column = F.abs(F.col("signal") * F.col("confidence"))
    order = Window.partitionBy(*keys).orderBy(force.desc(), "at")
    rows = signals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return rows.select(*keys, "place", "module", F.round("signal", 3).alias("signal"), F.round("confidence", 3).alias("confidence"))
