"""Pieces of the learning layer as columns and grouped passes: regime states with hysteresis, seeded draws, scaling, clusters,
models by role and the drift of a champion."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.kept import kept
from .network import Draws

_MASK = 0xFFFFFFFF


def committed(rows: DataFrame, key: str = "key", confirm: int = 3) -> DataFrame:
    """rows (symbol, i, key) with ``state``, and ``entered`` where it changes. A state holds until another key has stood
    for ``confirm`` rows in a row; rows without a key are passed over.

    A key that has stood that long is the state whatever was before, and a shorter run never is, so no fold is needed: the
    state is the newest such key, or the first key of the symbol."""
    w = Window.partitionBy("symbol").orderBy("i")
    same = [F.coalesce(F.lag(key, back).over(w) == F.col(key), F.lit(False)) for back in range(1, confirm)]
    stood = (F.col("_n") == 1) | reduce(lambda x, y: x & y, same, F.lit(True))
    seen = rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w))
    held = seen.withColumn("_held", F.when(stood, F.col(key)))
    made = held.withColumn("state", F.last("_held", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return made.withColumn("entered", ~F.col("state").eqNullSafe(F.lag("state").over(w))).drop("_n", "_held")


def _product(a: Column, b: Column) -> Column:
    """Low 32 bits of the product of two unsigned 32-bit numbers; no part of it overflows a long."""
    high = F.shiftrightunsigned(a, 16) * b
    return (a.bitwiseAND(0xFFFF) * b + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(_MASK)


def draw(seed: Column, step: Column) -> Column:
    """The step-th number (from 1) within 0 and 1 of the sequence of a 32-bit seed; any step at once, as the generator's
    state only counts up."""
    start = F.when(seed == 0, F.lit(1)).otherwise(seed).cast("long")
    # Increment, shifts and bits of the generator.
    t = (start + _product(step.cast("long"), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(_MASK)
    t = _product(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(1).cast("long")))
    more = t + _product(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))
    t = t.bitwiseXOR(more.bitwiseAND(_MASK))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / float(1 << 32)


def normal(u: Column, v: Column) -> Column:
    """A draw from the normal distribution by two uniform ones."""
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def hashed(text: Column) -> Column:
    """32-bit hash of a text of ASCII characters, one after the other."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    # First state and factor.
    step = lambda h, c: _product(h.bitwiseXOR(c), F.lit(0x01000193).cast("long"))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), step)


def scaled(vectors: DataFrame, statistics: DataFrame, most: float = 5.0) -> DataFrame:
    """(vec_id, dim, z, unit): deviations from the mean within ``most``, and places within the range from -1 to 1.
    statistics: a row for each dimension, so broadcast."""
    values = vectors.select("vec_id", F.posexplode("vector").alias("dim", "x"))
    rows = values.join(F.broadcast(statistics), "dim")
    z = (F.col("x") - F.col("mean")) / F.col("std")
    unit = 2.0 * (F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) - 1.0
    return rows.select("vec_id", "dim", F.greatest(F.lit(-most), F.least(F.lit(most), z)).alias("z"), unit.alias("unit"))


def _placed(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, part, row) in order of id, kept once with the places: a partition has no number that two plans over the
    same sort share, as each deals its rows by the size of the columns that it reads."""
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return kept(vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).sort("vec_id").select("*", F.spark_partition_id().alias("part"), row.alias("row")))


def _at(placed: DataFrame, k: int) -> list[list[float]]:
    """Vectors of the rows floor(i * n / k) in order of id: counts of the parts, then k rows."""
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    n, before, wanted = sum(counts.values()), 0, []
    goals = [i * n // k for i in range(min(k, n))]
    for part in sorted(counts):
        wanted += [(part, g - before) for g in goals if before <= g < before + counts[part]]
        before += counts[part]
    chosen = F.struct("part", "row").isin([F.struct(F.lit(p), F.lit(r).cast("long")) for p, r in wanted])
    return [r["vector"] for r in placed.where(chosen).sort("vec_id").collect()]


def nearest_centre(vector: Column, centres: list[list[float]]) -> Column:
    """Number of the centre of least squared distance, the first of equals."""
    off = [F.aggregate(F.zip_with(vector, F.lit(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) for c in centres]
    return F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(j).alias("cluster")) for j, d in enumerate(off))))["cluster"]


def _sums(stored: DataFrame, centres: np.ndarray) -> dict[int, np.ndarray]:
    """Mean vector of each cluster that has rows: blocks of rows against all centres at once, sums by cluster and
    dimension added up by Spark, k times the dimensions of them to the driver."""
    k, width = centres.shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width)), np.zeros(k)
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            for begin in range(0, len(rows), 1024):
                block = rows[begin : begin + 1024]
                label = ((block[:, None] - centres[None]) ** 2).sum(2).argmin(1)
                np.add.at(sums, label, block)
                counts += np.bincount(label, minlength=k)
        at = np.flatnonzero(np.repeat(counts, width))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.reshape(-1)[at]), pa.array(np.repeat(counts, width)[at])], names=["at", "sum", "n"])

    found = stored.select("vector").mapInArrow(each, "at long, sum double, n double").groupBy("at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).collect()
    means: dict[int, np.ndarray] = {}
    for r in found:
        means.setdefault(r["at"] // width, np.zeros(width))[r["at"] % width] = r["sum"] / r["n"]
    return means


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 30) -> DataFrame:
    """vectors (vec_id, vector of one length) with cluster: Lloyd's rounds from evenly spaced rows, until no centre moves. The
    vectors are kept once for all rounds. A cluster left empty keeps its centre."""
    stored = _placed(vectors)
    centres = np.array(_at(stored, k))
    if not len(centres):
        return vectors.withColumn("cluster", F.lit(None).cast("int"))
    for _ in range(rounds):
        moved = centres.copy()
        for j, mean in _sums(stored, centres).items():
            moved[j] = mean
        if (np.abs(moved - centres) <= 1e-12).all():
            break
        centres = moved
    return vectors.withColumn("cluster", nearest_centre(F.col("vector"), centres.tolist()))


def newest_model(models: DataFrame, within: list[str], **wanted) -> DataFrame:
    """The newest model of each group that has all that is wanted; a model without a role is a champion."""
    rows = models.withColumn("role", F.coalesce("role", F.lit("champion")))
    for name, value in wanted.items():
        rows = rows.where(F.col(name) == value)
    return rows.groupBy(*within).agg(F.max("created_at").alias("created_at"), F.max_by("version", "created_at").alias("version"))


def sign_accuracy(rows: DataFrame) -> DataFrame:
    """(symbol, evaluable, accuracy): share of predictions on the label's side, labels of 0 left out; 0 if there are none."""
    right, told = F.col("predicted") * F.col("label") > 0, F.abs("label") >= 1e-6
    counts = rows.groupBy("symbol").agg(F.count_if(told).alias("evaluable"), F.count_if(told & right).alias("n"))
    return counts.select("symbol", "evaluable", F.coalesce(F.try_divide("n", "evaluable"), F.lit(0.0)).alias("accuracy"))


def champion_drift(decided: DataFrame, baseline: float, window: int = 50, least: int = 20) -> DataFrame:
    """(symbol, n, ewma, drifted) of the newest ``window`` decisions (symbol, i, correct): their exponential mean, and whether
    it lies a tenth under the baseline. Fewer than ``least`` have neither."""
    last = Window.partitionBy("symbol").orderBy(F.desc("i"))
    tail = decided.withColumn("back", F.row_number().over(last)).where(F.col("back") <= window)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "correct"))), lambda s: s["correct"])
    rows = tail.groupBy("symbol").agg(F.count("*").alias("n"), listed.alias("xs"))
    mean = F.aggregate(F.slice("xs", 2, window), F.element_at("xs", 1), lambda a, x: 0.9 * a + 0.1 * x)
    rows = rows.withColumn("ewma", F.when(F.col("n") >= least, mean))
    return rows.select("symbol", "n", "ewma", F.coalesce(F.col("ewma") < baseline - 0.1, F.lit(False)).alias("drifted"))


def shuffled_index(sizes: DataFrame) -> DataFrame:
    """(symbol, place, i): 0 to n - 1 of each symbol in the order that its seed draws. sizes: (symbol, n, seed). Each place is
    changed with one drawn before it, so an order is made in one task; it holds numbers only, never rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for symbol, n, seed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                order = Draws(seed or 1).shuffled(n)
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(order.astype(np.int32))], names=["symbol", "place", "i"])

    return sizes.select("symbol", "n", "seed").mapInArrow(each, "symbol string, place int, i int")


def gathered(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """The rows (symbol, i, ...) that picks (symbol, place, i) name, with their place; a row may be named several times."""
    return picks.join(rows, ["symbol", "i"])
