"""Substring dedup over words: a compacted de Bruijn graph of token k-mers.

Edges are runs of 35 words (the window), nodes the 34 words that two edges share. The graph is built where it can
repeat: edges meet by the eight-word gram that their content picks (``repeats``), edges whose gram stands once in the
corpus are left out, and runs of equal words are one with the sum of their counts. Rows of the edge table are
(key, lead, e): gram, distance of the edge's start to it, hash of its 35 words, with the edge before and after.

An edge that is read twice or more is repeated. Two edges in a row are one path where nothing branches: all
readings of the first go on to the second and all of the second come from the first. Paths compact by joins of the
edge table with itself, each edge's pointer to the one before doubling its reach; as edges of one gram differ in
lead, a path is WINDOW - GRAM + 1 edges long at most and needs no more than five rounds.

A path's readings are spans of source texts. Each is confirmed by its words at (text, offset): a span stays
only if another reading of its path has the same digest of all its words.

Defined results: a null or empty text has no words; a text shorter than the window keeps all words; rows
that repeat a text count as further places, so their windows repeat, whatever their ids; other columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import Scratch, by_batch, spread_join
from .repeats import Windows, columns_of, distinct_texts, flattened, listed, removed, repeated_windows, rows_with, unpacked, with_places

WINDOW = Windows("word", 35, 8)
EDGE = ["key", "lead", "e"]


def edges(texts: DataFrame, found: DataFrame, w: Windows) -> DataFrame:
    """(key, lead, e, before, after, n, bid, hi): every edge of each body, 0 for no edge before or after."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in R.slices(batch):
            symbols, first = w.symbols(data, offsets)
            hashes = R.Hashes(symbols).windows(w.window).view(np.int64)
            row, (key, bid, n, place) = flattened(rows.column(1), 4)
            start, count, lead = unpacked(place)
            i = np.repeat(np.arange(len(row)), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            e = hashes[first[row[i]] + start[i] + j]
            before, after = np.zeros_like(e), np.zeros_like(e)
            before[1:], after[:-1] = e[:-1], e[1:]
            before[j == 0] = 0
            after[j == count[i] - 1] = 0
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[i], lead[i] - j, e, before, after, n[i], bid[i], lead[i])], names=[*EDGE, "before", "after", "n", "bid", "hi"])

    asked = found.groupBy("rid").agg(F.collect_list(F.struct("key", "bid", "n", "place")).alias("asked"))
    return by_batch(texts.join(asked.hint("shuffle_hash"), "rid").select("text", "asked"), each, "key long, lead long, e long, before long, after long, n long, bid long, hi long")


def compacted(graph: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """(key, lead, e, head, back): each edge's path, by its first edge and the edges back to it. graph: repeated edges
    with the only edge before and after, null where there are several or none."""
    # a link holds if both of its edges name each other
    named = graph.where("after IS NOT NULL").select("key", (F.col("lead") - 1).alias("lead"), F.col("after").alias("e"), F.col("e").alias("before"), F.lit(True).alias("linked"))
    paths = graph.join(named, [*EDGE, "before"], "left")
    paths = scratch.keep(paths.select(*EDGE, F.when(F.col("linked"), F.col("before")).otherwise(F.col("e")).alias("head"), F.when(F.col("linked"), 1).otherwise(0).cast("long").alias("back")))
    for _ in range(rounds):
        to = paths.select("key", F.col("lead").alias("at"), F.col("e").alias("head"), F.col("head").alias("further"), F.col("back").alias("more")).where("more > 0")
        moved = paths.withColumn("at", F.col("lead") + F.col("back")).join(to, ["key", "at", "head"], "left")
        longer = scratch.keep(moved.select(*EDGE, F.coalesce("further", "head").alias("head"), (F.col("back") + F.coalesce("more", F.lit(0))).alias("back")))
        scratch.drop(paths)
        paths = longer
    return paths


def solver(w: Windows):
    """Repeated windows of the bodies that share a key, as readings of compacted paths."""
    rounds = (w.window - w.gram).bit_length()

    def walk(texts: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
        read = scratch.keep(edges(texts, found, w))
        only = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c)).alias(c)
        graph = scratch.keep(read.groupBy(*EDGE).agg(F.sum("n").alias("times"), F.count("*").alias("n"), only("before"), only("after")).where("times > 1").drop("times"))
        paths = compacted(graph.select(*EDGE, "before", "after"), rounds, scratch)
        along = spread_join(read.select(*EDGE, "bid", "hi"), paths, EDGE, graph.select(*EDGE, "n"))
        spans = along.groupBy("bid", "key", "head", (F.col("lead") + F.col("back")).alias("top")).agg((F.min("hi") - F.max("lead")).alias("lo"), F.count("*").alias("cnt"))
        return spans.select("bid", "lo", "cnt", F.xxhash64("key", "head", "top").alias("path"))

    return walk


def _digested(texts: DataFrame, places: DataFrame, w: Windows) -> DataFrame:
    """Results of every text, with path and digest of the words of each of its spans."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, cut, paths, digests = [], [0], [], []
        for t, p in zip(batch.column(4).cast(pa.large_binary()), columns_of(batch.column(5), 3), strict=True):
            words = t.as_py().split()
            n, gone = len(words), 0
            if p is not None:
                start, count, path = p
                paths.append(path)
                end = start + count - 1 + w.window
                digests += [int.from_bytes(hashlib.blake2b(b" ".join(words[a:b]), digest_size=8).digest(), "little", signed=True) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                mask = removed(start, count, w.window, n)
                gone = int(mask.sum())
                words = [x for x, m in zip(words, mask.tolist(), strict=True) if not m]
            cut.append(len(digests))
            out.append((n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(paths) if paths else [], pa.int64()), pa.array(digests, pa.int64())], names=["path", "digest"])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(list(c)) for c in zip(*out, strict=True)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans)], names=["rid", "n", "k1", "k2", "n_words", "n_removed", "kept_sha256", "spans"])

    return by_batch(with_places(texts, listed(places)).select("rid", "n", "k1", "k2", "text", "places"), each, "rid long, n long, k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, spans array<struct<path: long, digest: long>>")


def dedup_words(docs: DataFrame, w: Windows = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    scratch = Scratch(docs.sparkSession)
    texts = distinct_texts(docs, scratch)
    places = scratch.keep(repeated_windows(texts, w, solver(w), scratch).select("rid", "place", "lo", "cnt", "path"))
    while True:
        results = scratch.keep(_digested(texts, places, w))
        spans = results.select("rid", "n", F.inline("spans"))
        alone = spans.groupBy("path", "digest").agg(F.sum("n").alias("n")).where("n < 2").select("path", "digest")
        if alone.isEmpty():
            break
        # hashes of unlike words met: their spans go
        false = scratch.keep(spans.join(alone, ["path", "digest"]).select("rid", "path").distinct())
        places = places.join(false, ["rid", "path"], "left_anti")
        scratch.drop(results)
    columns = results.select("k1", "k2", "n_words", "n_removed", "kept_sha256")
    return rows_with(docs, texts, columns, {"n_words": 0, "n_removed": 0, "kept_sha256": hashlib.sha256(b"").hexdigest()})
