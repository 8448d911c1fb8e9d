"""Ranked lexical search over a clustered index of documents.

Documents are reordered by recursive graph bisection (``bisection``): its cuts are fitted on SAMPLE documents (about) and send every
document to one of 2^DEPTH leaves, whose documents are dealt to shards of about SHARD. A shard holds its postings by
term, and for each item a bound: the sum of the largest contribution that each of the item's terms makes in the shard. Items visit the
shards of their largest bounds first; the score of the last place that these fill is a floor, and only shards whose
bound reaches it are visited after that. A bound equal to the floor still counts, as documents of one score rank by doc_id, to which
the order in the index is mapped back. Stopping is therefore exact.

The index holds the terms of the items asked for, with statistics over all documents. Items come in blocks of about TERMS
distinct terms (one item's own at least), so that a block's vocabulary and cuts have a bounded size whatever the number of items.

Defined results: null texts and texts without a term are no documents and do not count in N; each repeated row is a document
of its own, and documents without doc_id rank behind all others of their score; rows of one item_id are one item with the terms
of all its texts, and so are those without; items without terms, and items no document answers, give no rows; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling as R
from .bisection import Cuts, bisect
from .common import Scratch, by_batch, full_text, sampled

#: Fixed values of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K1, B = 1000, 90
#: Documents that the cuts are fitted on, postings of each at most, and levels.
SAMPLE, POSTINGS, DEPTH = 4096, 512, 6
#: Documents of a shard (about), shards that each item visits first, terms of a block of items (about).
SHARD, FIRST, TERMS = 1024, 2, 1 << 15
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_INDEX = "doc_id long, n long, leaf int, terms array<int>, tfs array<int>"
_PACKED = "shard long, ids array<long>, terms array<int>, starts array<int>, docs array<int>, parts array<long>, bounds array<long>"


class Vocabulary:
    """A block's terms by number, and its items' terms."""

    def __init__(self, asked: list[tuple[int, bytes]]):
        self.terms = sorted({t for _, t in asked})
        number = {t: k for k, t in enumerate(self.terms)}
        self.items = np.array([i for i, _ in asked], dtype=np.int64)
        self.of_items = np.array([number[t] for _, t in asked], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(self.terms), dtype=np.uint8)
        self.end = np.cumsum([len(t) for t in self.terms])
        self.start = self.end - [len(t) for t in self.terms]
        hashes = R.word_symbols(self.bytes, self.start, self.end)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, term): the words that are terms, found by hash and compared byte by byte."""
        hashes = R.word_symbols(data, start, end)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        term = self.by_hash[at]
        which = np.flatnonzero((self.hashes[at] == hashes) & (self.end[term] - self.start[term] == end - start))
        term, sizes = term[which], (end - start)[which]
        if not len(which):
            return which, term
        first = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        other = data[np.repeat(start[which], sizes) + step] != self.bytes[np.repeat(self.start[term], sizes) + step]
        same = np.add.reduceat(other, first) == 0
        return which[same], term[same]


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def indexed(docs: DataFrame, words: Vocabulary, cuts: Cuts | None = None) -> DataFrame:
    """doc_id, n (terms with repeats), leaf, and the distinct terms of the vocabulary with their counts."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in R.slices(batch):
            data = R.lower_ascii(data)
            start, end, first = R.words(data, offsets, _GAP)
            n, size = np.diff(first), len(offsets) - 1
            which, term = words.find(data, start, end)
            keys, tfs = np.unique(R.rows_of(first)[which] * len(words.terms) + term, return_counts=True)
            row, terms = keys // len(words.terms), keys % len(words.terms)
            leaf = np.zeros(size, dtype=np.int64) if cuts is None else cuts.leaves(row, terms, size)
            each_row = np.bincount(row, minlength=size)
            made = pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), pa.array(leaf.astype(np.int32)), _lists(terms, each_row, pa.int32()), _lists(tfs, each_row, pa.int32())], names=["doc_id", "n", "leaf", "terms", "tfs"])
            yield made.filter(pa.array(n > 0))

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text")), each, _INDEX)


def fitted(docs: DataFrame, words: Vocabulary, sample: int = SAMPLE, depth: int = DEPTH) -> Cuts:
    """Cuts over about ``sample`` documents, of each POSTINGS terms at most (those of the smallest hash)."""
    drawn = F.slice(F.transform(F.array_sort(F.transform("terms", lambda t: F.struct(F.xxhash64(t).alias("hash"), t.alias("term")))), lambda s: s["term"]), 1, POSTINGS)
    found = [r["terms"] for r in indexed(sampled(docs.select("doc_id", "text"), sample), words).select(drawn.alias("terms")).collect()]
    rows = np.repeat(np.arange(len(found)), [len(t) for t in found])
    terms = np.array([t for own in found for t in own], dtype=np.int64)
    return bisect(rows, terms, len(found), len(words.terms), min(depth, max(len(found), 1).bit_length() - 1))


def packed(index: DataFrame, words: Vocabulary, weights: np.ndarray, documents: int, total: int) -> DataFrame:
    """One row for each shard: its documents, its postings by term, and each item's bound."""
    shares = {r["leaf"]: -(-r["count"] // SHARD) for r in index.groupBy("leaf").count().collect()}  # a row for each leaf
    of_leaf = F.element_at(F.array(*(F.lit(max(1, shares.get(k, 1))) for k in range(max(shares, default=0) + 1))), F.col("leaf") + 1)
    shard = F.shiftleft(F.col("leaf").cast("long"), 40) + F.pmod(F.monotonically_increasing_id(), of_leaf)
    n_items = int(words.items.max()) + 1

    def each(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        lists = rows.column("terms").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        terms, tfs = lists.flatten().to_numpy().astype(np.int64), rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        docs = np.repeat(np.arange(len(n)), sizes)
        m = 100 - B + (B * n * documents) // total
        parts = weights[terms] * ((1_000_000_000 * tfs) // (K1 * tfs + 8 * m[docs]))
        order = np.argsort(terms, kind="stable")
        terms, docs, parts = terms[order], docs[order], parts[order]
        held, starts = np.unique(terms, return_index=True)
        most = np.zeros(len(words.terms), dtype=np.int64)
        most[held] = np.maximum.reduceat(parts, starts)
        bounds = np.zeros(n_items, dtype=np.int64)
        np.add.at(bounds, words.items, most[words.of_items])
        ids = rows.column("doc_id").combine_chunks()
        one = lambda a, kind: pa.array([a.astype(kind.to_pandas_dtype())], pa.list_(kind))
        return pa.Table.from_arrays([
            pa.array([key[0].as_py()]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(held, pa.int32()),
            one(np.append(starts, len(terms)), pa.int32()), one(docs, pa.int32()), one(parts, pa.int64()), one(bounds, pa.int64()),
        ], names=["shard", "ids", "terms", "starts", "docs", "parts", "bounds"])

    rows = index.where(F.size("terms") > 0).withColumn("shard", shard)
    return rows.groupBy("shard").applyInArrow(each, _PACKED)


def visited(shards: DataFrame, visits: DataFrame, words: Vocabulary, k: int) -> DataFrame:
    """item, doc_id, score: the k best documents of each shard for the items that visit it, from their floors on.

    visits: shard, item, floor."""
    of_item = {int(i): words.of_items[words.items == i] for i in np.unique(words.items)}

    def each(rows: pa.Table) -> pa.Table:
        shard = {x: rows.column(x).combine_chunks().flatten() for x in ("ids", "terms", "starts", "docs", "parts")}
        terms, starts, docs, parts = (shard[x].to_numpy() for x in ("terms", "starts", "docs", "parts"))
        unnamed = shard["ids"].is_null().to_numpy(zero_copy_only=False)
        ids = shard["ids"].fill_null(0).to_numpy()
        items, at, scores = [], [], []
        for visit in rows.column("visits").combine_chunks().flatten().to_pylist():
            wanted = of_item[visit["item"]]
            place = np.searchsorted(terms, wanted)
            place = place[(place < len(terms)) & (terms[np.minimum(place, len(terms) - 1)] == wanted)]
            spans = [slice(starts[p], starts[p + 1]) for p in place]
            if not spans:
                continue
            own, values = np.concatenate([docs[s] for s in spans]), np.concatenate([parts[s] for s in spans])
            # exact: both halves of the numbers stay far below 2^53 when summed
            total = (np.bincount(own, values >> 20).astype(np.int64) << 20) + np.bincount(own, values & 0xFFFFF).astype(np.int64)
            found = np.flatnonzero(total >= max(1, visit["floor"]))
            if len(found) > k:
                found = found[total[found] >= np.partition(total[found], -k)[-k]]
            found = found[np.lexsort((ids[found], unnamed[found], -total[found]))][:k]
            items += [visit["item"]] * len(found)
            at += found.tolist()
            scores += total[found].tolist()
        return pa.Table.from_arrays([pa.array(items, pa.int32()), shard["ids"].take(pa.array(at, pa.int64())), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    grouped = visits.groupBy("shard").agg(F.collect_list(F.struct("item", "floor")).alias("visits"))  # no more than there are items in the block
    return shards.drop("bounds").join(grouped, "shard").groupBy("shard").applyInArrow(each, "item int, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _block(docs: DataFrame, asked: list[tuple[int, bytes]], k: int, kept: Scratch) -> DataFrame:
    """item, rank, doc_id, score for one block of items."""
    words = Vocabulary(asked)
    index = kept.keep(indexed(docs, words, fitted(docs, words)))
    documents, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(words.terms), dtype=np.int64)
    for r in held.select("term", weight.alias("weight")).collect():  # a row for each term of the block
        weights[r["term"]] = r["weight"]
    shards = kept.keep(packed(index, words, weights, documents, total), **{"parquet.block.size": str(16 << 20)})
    bounds = shards.select("shard", F.posexplode("bounds").alias("item", "bound")).where("bound > 0")

    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "shard")
    first = kept.keep(bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST).select("shard", "item", F.lit(1).cast("long").alias("floor")))
    early = kept.keep(visited(shards, first, words, k))
    floors = _best(early, k).groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    later = (
        bounds.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1))).where(F.col("bound") >= F.col("floor"))
        .join(first.select("shard", "item"), ["shard", "item"], "left_anti").select("shard", "item", "floor")
    )
    return _best(early.unionByName(visited(shards, later, words, k)), k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each item."""
    spark = docs.sparkSession
    kept = Scratch(spark)
    lower = F.translate(full_text(), string.ascii_uppercase, string.ascii_lowercase)
    terms = kept.keep(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct())
    blocks = max(1, -(-terms.count() // TERMS))
    results = []
    for b in range(blocks):
        asked = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about TERMS rows
        if not asked:
            continue
        ids = sorted({r["item_id"] for r in asked}, key=lambda x: (x is None, x))
        number = {x: i for i, x in enumerate(ids)}
        found = _block(docs, [(number[r["item_id"]], r["term"].encode()) for r in asked], k, kept)
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        results.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""WITH t AS (
    SELECT row_number() OVER () r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w
    FROM documents),
i AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
    FROM benchmark),
c AS (SELECT count(*) docs, CAST(sum(len(w)) AS BIGINT) total FROM t WHERE len(w) > 0),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * docs) // total m FROM t, c WHERE len(w) > 0),
u AS (SELECT r, unnest(w) term FROM t),
p AS (SELECT r, term, count(*) tf FROM u WHERE term IN (SELECT term FROM i) GROUP BY ALL),
d AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) w FROM (SELECT term, count(*) df FROM p GROUP BY term), c),
s AS (
    SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) score
    FROM p JOIN d USING (term) JOIN i USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""
