"""Exact top-k search by integer inner product over vectors sorted by length.

Components become floor(256 * x). Vectors are sorted by descending length over the whole table and cut into blocks of
BLOCK rows. A query first meets the block of the longest vectors; its k-th best score there is a floor t that the rest
has to reach. By Cauchy-Schwarz a block whose longest vector is shorter than t / |q| cannot, so only the blocks before
that are joined with the query, in groups of queries with like floors. Inside a pair of blocks, chunks are taken by descending
length, and products are summed in the axes of the table's own SVD, largest first: after each part of the axes a
candidate leaves as soon as its sum so far plus the product of both remainders' lengths stays under the floor, which rises as better
candidates come in. What is left is multiplied out in whole numbers, so pruning never changes a result.

Defined results: vectors that are null or hold a null or non-finite component (before or after scaling) take no part, nor
do rows without vec_id; shorter vectors count as if filled with zeros; an empty vector scores 0 with all; rows that share
a vec_id are one candidate and one query with the best score of any of them, and never each other's candidates; scores outside 64 bits
become the nearest 64-bit value; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_batch

#: Rows of a block of vectors (a power of two: its exponent), queries of a group (likewise), columns taken at once.
BLOCK_BITS, GROUP_BITS, CHUNK = 12, 10, 512
#: Axes that are rotated, at most; further ones follow as they are.
ROTATED = 512
#: Shares of the axes after which bounds are looked at.
PARTS = (1 / 8, 1 / 4, 1 / 2)
_SCHEMA = "query_id long, vec_id long, score long, asked long"
_EXACT = float(1 << 53)
_NONE = -(1 << 63)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros up to width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    full = np.zeros((len(sizes), width))
    full[np.arange(width) < sizes[:, None]] = values
    return full


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow on the way."""
    top = np.abs(rows).max(axis=1, initial=0.0)
    scale = np.where(top > 0, top, 1.0)
    return scale * np.sqrt(((rows / scale[:, None]) ** 2).sum(axis=1))


def prepared(table: DataFrame) -> DataFrame:
    """vec_id, vector (whole numbers) and length of the rows that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * 256 < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & whole)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors = batch.column(1)
        sizes = np.diff(vectors.offsets.to_numpy())
        scaled = np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        made = pa.ListArray.from_arrays(offsets, pa.array(scaled))
        yield pa.RecordBatch.from_arrays([batch.column(0), made, pa.array(lengths(matrix(made, int(sizes.max()))))], names=["vec_id", "vector", "length"])

    return by_batch(rows, each, "vec_id long, vector array<double>, length double")


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all rows' directions, largest first: from the sums of their outer products, of
    which each task gives one and the driver gets ROTATED * (ROTATED + 1) / 2 numbers at most."""
    n = min(width, ROTATED)
    rows, columns = np.triu_indices(n)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch.column(0), width)
                own = own[:, :n] / np.maximum(lengths(own), 1e-300)[:, None]
                total += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(total[rows, columns])], names=["at", "sum"])

    sums = np.zeros((n, n))
    for r in vectors.select("vector").mapInArrow(each, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():
        sums[rows[r["at"]], columns[r["at"]]] = sums[columns[r["at"]], rows[r["at"]]] = r["sum"]
    return np.linalg.eigh(sums)[1][:, ::-1] if n else sums


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of whole-numbered rows, exact, as 64-bit integers."""
    if a.shape[1] * np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) < _EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], dtype=object) @ np.array([[int(x) for x in r] for r in b], dtype=object).T
    return np.clip(exact, _NONE, (1 << 63) - 1).astype(np.int64)


class Rows:
    """Vectors with their lengths, turned into the rotated axes, and what is left of them after each part of the axes."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray):
        self.whole, n, width = vectors, len(axes), vectors.shape[1]
        self.turned = np.hstack([vectors[:, :n] @ axes, vectors[:, n:]])
        self.length = lengths(vectors)
        self.parts = sorted({max(1, int(width * p)) for p in PARTS}) if width else []
        self.rest = {h: lengths(self.turned[:, h:]) for h in self.parts}


def top_products(q: Rows, query_ids: np.ndarray, floors: np.ndarray, c: Rows, ids: np.ndarray, k: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each query row the k best (score, id) among c that reach its floor, equal scores by smaller id."""
    floors = floors.copy()
    bars = np.where(floors == _NONE, -np.inf, floors)  # for comparisons with bounds
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    by_length = np.lexsort((ids, -c.length))
    for begin in range(0, len(ids), CHUNK):
        columns = by_length[begin : begin + CHUNK]
        with np.errstate(over="ignore", invalid="ignore"):
            live = np.flatnonzero(~(q.length * c.length[columns[0]] * (1 + 1e-9) < bars))
            if not len(live):
                break  # all that follow are shorter still
            kept = np.ones((len(live), len(columns)), dtype=bool)
            sums, done = np.zeros(kept.shape), 0
            for h in q.parts:
                sums += q.turned[live, done:h] @ c.turned[columns, done:h].T
                slack = 1e-9 * q.length[live][:, None] * c.length[columns][None, :] + 1e-6
                kept &= ~(sums + q.rest[h][live][:, None] * c.rest[h][columns][None, :] + slack < bars[live][:, None])
                rows, cols = kept.any(axis=1), kept.any(axis=0)
                live, columns, done = live[rows], columns[cols], h
                kept, sums = kept[rows][:, cols], sums[rows][:, cols]
                if not len(live):
                    break
        if not len(live):
            continue
        scores = whole_products(q.whole[live], c.whole[columns])
        kept &= (ids[columns][None, :] != query_ids[live][:, None]) & (scores >= floors[live][:, None])
        for row, i in enumerate(live):
            at = np.flatnonzero(kept[row])
            if not len(at):
                continue
            found: dict[int, int] = {}
            for score, x in sorted([*best[i], *zip(scores[row, at].tolist(), ids[columns[at]].tolist(), strict=True)], key=lambda p: (-p[0], p[1])):
                found.setdefault(x, score)
                if len(found) == k:
                    break
            best[i] = [(score, x) for x, score in found.items()]
            if len(best[i]) == k:
                floors[i] = max(floors[i], best[i][-1][0])
                bars[i] = floors[i] if floors[i] > _NONE else -np.inf
    return [(i, b) for i, b in enumerate(best) if b]


def searched(asked: DataFrame, candidates: DataFrame, axes: np.ndarray, width: int, k: int) -> DataFrame:
    """Both sides met by (block, group): query_id, vec_id, score, asked (the query's row)."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            query_ids, rows, floors = (left.column(x).to_numpy() for x in ("query_id", "asked", "floor"))
            q, c = (Rows(matrix(t.column("vector"), width), axes) for t in (left, right))
            found = top_products(q, query_ids, floors, c, right.column("vec_id").to_numpy(), k)
            out = [(int(query_ids[i]), x, score, int(rows[i])) for i, best in found for score, x in best]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score", "asked"])

    keys = ("block", "group")
    return asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(each, _SCHEMA)


def level(length: Column) -> Column:
    """Lengths in some thousands of steps at most, rising."""
    return F.floor(8 * F.log2(1 + length)).cast("int")


def nearest(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each vec_id divisible by ``every``."""
    spark = table.sparkSession
    kept = Scratch(spark)
    vectors = prepared(table)
    width = vectors.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    axes = rotation(vectors, width)
    order = [F.col("length").desc(), F.col("vec_id")]
    ordered = kept.keep(vectors.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.shiftright("row", BLOCK_BITS)))
    blocks = ordered.groupBy("block").agg(F.max("length").alias("top"))
    first, longest = blocks.agg(F.min("block"), F.max("top")).first()

    queries = ordered.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector", "length", F.col("row").alias("asked"))
    groups = max(1, -(-queries.count() >> GROUP_BITS))
    dealt = queries.select("*", F.lit(first).cast("long").alias("block"), F.pmod(F.xxhash64("asked"), F.lit(groups)).alias("group"), F.lit(_NONE).cast("long").alias("floor"))
    head = ordered.where(F.col("block") == first).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    early = kept.keep(searched(dealt, head, axes, width, k))

    # floors: the k-th best of the longest vectors, where there are so many
    floors = early.groupBy("asked").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    bar = F.coalesce("floor", F.lit(_NONE).cast("long"))
    need = F.when((bar > 0) & (F.col("length") > 0), bar / F.col("length")).otherwise(0.0)
    raised = queries.join(floors, "asked", "left").select("query_id", "vector", "asked", bar.alias("floor"), need.alias("need"))
    raised = kept.keep(raised.withColumn("level", level(F.col("need"))))
    # a group holds queries of one level, a level as many groups as it has queries for
    shares = raised.groupBy("level").agg(F.ceil(F.count("*") / (1 << GROUP_BITS)).alias("shares"))
    group = F.shiftleft(F.col("level").cast("long"), 40) + F.pmod(F.xxhash64("asked"), F.col("shares"))
    late = kept.keep(raised.join(shares, "level").select("query_id", "vector", "asked", "floor", "need", group.alias("group")))
    wants = late.groupBy("group").agg(F.min("need").alias("need"))
    top = int(np.floor(8 * np.log2(1 + longest))) + 1
    wanted = wants.withColumn("level", F.explode(F.sequence(F.least(level(F.col("need")), F.lit(top)), F.lit(top))))
    pairs = kept.keep(
        blocks.where(F.col("block") != first).withColumn("level", level(F.col("top"))).join(wanted, "level")
        .where(~(F.col("top") * (1 + 1e-9) < F.col("need"))).select("block", "group")
    )
    rest = searched(late.join(pairs, "group"), ordered.join(pairs, "block"), axes, width, k)

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = early.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id query_id, c.vec_id, max(CAST(list_dot_product(q.e, c.e) AS BIGINT)) score
    FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""
