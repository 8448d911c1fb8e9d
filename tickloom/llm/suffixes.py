"""Substring dedup over bytes: a depth-limited radix sort of suffixes.

Only suffixes that can repeat are sorted. A 200-byte window owns one 64-byte gram that its content picks, and
windows whose gram stands once in the corpus leave before the sort (``repeats``); runs of windows of equal bytes
count as one. The suffixes of the runs that are left meet by gram and by the gram's distance from their
start, and are ordered by their bytes in most-significant-digit passes: each pass orders every bucket by the next
eight bytes, splits it where they differ and lets single suffixes go. After 200 bytes the buckets are
exactly the repeated windows; nothing is read beyond that depth.

A gram's runs are sorted in one task while they are LIMIT at most. Hot grams are split first: into blocks
of 16 suffixes by the 185 bytes that a block shares, each sorted by itself; blocks that are still hot into
blocks of 4, and those into single windows, which are counted by 128 bits of their content.

Defined results: a null or empty text has no bytes; a text shorter than the window keeps all bytes; rows
that repeat a text count as further places, whatever their ids; other columns are not read by ``dedup_bytes``.
``strip`` keeps every row and column: what is left of a text's bytes, without characters that lost some of
their bytes, is the new text and its length the new n_chars; a null text stays null. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import Scratch, by_batch
from .repeats import RUNS, Windows, bodies, columns_of, distinct_texts, flattened, given_to_rows, listed, packed, removed, repeated_windows, rows_with, solved, unpacked, with_places

WINDOW = Windows("byte", 200, 64)
#: Bodies of one gram that are sorted in one task.
LIMIT = 256
#: Suffixes of the blocks that hot grams are split into, step by step.
BLOCKS = (16, 4, 1)
DIGIT = 8
#: Suffixes that a task sorts at a time, about.
SORTED = 1 << 20
_U = np.uint64


def radix(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the suffixes, data from at on, that share their first ``depth`` bytes with another one of
    their bucket; in the order of those bytes within a bucket."""
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
    digits = np.zeros(len(data), dtype=_U)
    for k in range(DIGIT):
        digits = (digits << _U(8)) | padded[k : k + len(data)]
    alive = np.argsort(bucket, kind="stable")
    own = bucket[alive]
    new = np.append(True, own[1:] != own[:-1])
    for d in range(0, depth, DIGIT):
        # buckets of one suffix leave
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(alive)))
        alive, first = alive[np.repeat(size > 1, size)], size[size > 1]
        if not len(alive):
            break
        size, first = first, np.append(0, np.cumsum(first)[:-1])
        digit = digits[at[alive] + d]
        if depth - d < DIGIT:
            digit = digit >> _U(8 * (DIGIT - depth + d))
        # only buckets whose digits differ need ordering
        mixed = np.repeat(np.add.reduceat((digit != np.repeat(digit[first], size)).astype(np.int64), first) > 0, size)
        new = np.zeros(len(alive), dtype=bool)
        new[first] = True
        if mixed.any():
            place = np.flatnonzero(mixed)
            own = np.cumsum(new)[place]
            order = np.lexsort((digit[place], own))
            alive[place], digit[place] = alive[place[order]], digit[place[order]]
            new[1:] |= digit[1:] != digit[:-1]
    else:
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(alive)))
        alive = alive[np.repeat(size > 1, size)]
    return alive


def _sorted(rows: pa.Table, depth: int) -> pa.RecordBatch:
    """(bid, lo, cnt, path) for whole keys' rows: key, bid, n, place, data."""
    rows = rows.combine_chunks()
    text = rows["data"].chunk(0).cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    key, bid, n = (rows[c].to_numpy() for c in ("key", "bid", "n"))
    _, count, lead = unpacked(rows["place"].to_numpy())
    run = np.repeat(np.arange(len(count)), count)
    edge = np.concatenate([[0], np.cumsum(count)])
    j = np.arange(len(run)) - edge[run]
    group = np.cumsum(np.append(False, key[1:] != key[:-1]))
    again = np.repeat(n > 1, count)
    found = radix(data, (offsets[:-1] - offsets[0])[run] + j, (group[run].astype(np.int64) << 12) | (lead[run] - j), depth)
    again[found] = True
    # runs of repeated windows within each body
    begin = again & np.append(True, ~again[:-1] | (run[1:] != run[:-1]))
    end = again & np.append(~again[1:] | (run[1:] != run[:-1]), True)
    a, b = np.flatnonzero(begin), np.flatnonzero(end)
    return pa.RecordBatch.from_arrays([pa.array(bid[run[a]]), pa.array(j[a]), pa.array(b - a + 1), pa.array(np.zeros(len(a), np.int64))], names=["bid", "lo", "cnt", "path"])


def _bytes_of(texts: DataFrame, found: DataFrame, w: Windows) -> DataFrame:
    """(key, bid, n, place, data): the bytes under the windows of each body."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in R.slices(batch):
            row, (key, bid, n, place) = flattened(rows.column(1), 4)
            start, count, _ = unpacked(place)
            begin = offsets[row] + start
            size = count - 1 + w.window
            edge = np.concatenate([[0], np.cumsum(size)])
            taken = data[np.repeat(begin - edge[:-1], size) + np.arange(edge[-1])]
            out = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(taken.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*map(pa.array, (key, bid, n, place)), out], names=["key", "bid", "n", "place", "data"])

    asked = found.groupBy("rid").agg(F.collect_list(F.struct("key", "bid", "n", "place")).alias("asked"))
    return by_batch(texts.join(asked.hint("shuffle_hash"), "rid").select("text", "asked"), each, "key long, bid long, n long, place long, data binary")


def _blocks(texts: DataFrame, found: DataFrame, w: Windows, block: int) -> DataFrame:
    """Runs (and their owner's bid) of the windows of each body in blocks by their distance to the gram; a block's
    key is what all its windows share."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in R.slices(batch):
            symbols, first = w.symbols(data, offsets)
            hashes = R.Hashes(symbols)
            row, (bid, n, place) = flattened(rows.column(2), 3)
            start, count, lead = unpacked(place)
            near = lead - count + 1  # distances from a window's start to the gram run from lead down to near
            blocks = lead // block - near // block + 1
            i = np.repeat(np.arange(len(row)), blocks)
            number = near[i] // block + (np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            low, high = np.maximum(near[i], number * block), np.minimum(lead[i], number * block + block - 1)
            gram = first[row[i]] + start[i] + lead[i]
            key = hashes.spans(gram - number * block, gram - (number * block + block - 1) + w.window)
            key = R.mix(key ^ ((number + 1).astype(_U) * _U(0xD1B54A32D192ED03)))
            b1, b2 = bodies(hashes, gram - high, gram - low + w.window, high)
            where = packed(start[i] + lead[i] - high, high - low + 1, high)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row[i])), pa.array(n[i]), *(pa.array(x.view(np.int64)) for x in (where, key, b1, b2)), pa.array(bid[i]), pa.array(lead[i] - high)], names=["rid", "n", "place", "key", "b1", "b2", "owner", "shift"])

    asked = found.groupBy("rid").agg(F.collect_list(F.struct("bid", "n", "place")).alias("asked"))
    return by_batch(texts.join(asked.hint("shuffle_hash"), "rid").select("rid", "text", "asked"), each, RUNS + ", owner long, shift long")


def solver(w: Windows, limit: int = LIMIT, blocks: tuple[int, ...] = BLOCKS):
    """Repeated windows of the bodies that share a key: sorted where they are ``limit`` at most, else split."""

    def sort(texts: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
        if not blocks:
            # single windows: a body is a window whole
            return found.where("n > 1").select("bid", F.lit(0).cast("long").alias("lo"), F.expr("(place >> 12) & 4095").alias("cnt"), F.lit(0).cast("long").alias("path"))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                size += int(unpacked(batch.column(3).to_numpy())[1].sum())
                if size >= SORTED:
                    rows = pa.Table.from_batches(held)
                    # the last key may go on in the next batch
                    last = int(np.searchsorted(rows["key"].to_numpy(), batch.column(0)[-1].as_py()))
                    if last:
                        yield _sorted(rows.slice(0, last), w.window)
                    held = rows.slice(last).to_batches()
                    size = sum(int(unpacked(b.column(3).to_numpy())[1].sum()) for b in held)
            if held:
                yield _sorted(pa.Table.from_batches(held), w.window)

        few = _bytes_of(texts, found.where(F.col("m") <= limit), w).repartition("key").sortWithinPartitions("key")
        made = few.mapInArrow(each, "bid long, lo long, cnt long, path long")
        hot = found.where(F.col("m") > limit)
        if hot.isEmpty():
            return made
        runs = scratch.keep(_blocks(texts, hot, w, blocks[0]))
        finer = solved(texts, runs, solver(w, limit, blocks[1:]), scratch)
        return made.union(finer.select(F.col("owner").alias("bid"), (F.col("shift") + F.col("lo")).alias("lo"), "cnt", "path"))

    return sort


def _kept(text: bytes, places: list[np.ndarray] | None, w: Windows) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs of them)"""
    if places is None:
        return text, 0, 0
    mask = removed(places[0], places[1], w.window, len(text))
    runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
    return np.frombuffer(text, dtype=np.uint8)[~mask].tobytes(), int(mask.sum()), runs


def _placed(docs: DataFrame, w: Windows, limit: int) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession)
    texts = distinct_texts(docs, scratch)
    places = scratch.keep(repeated_windows(texts, w, solver(w, limit), scratch).select("rid", "place", "lo", "cnt", "path"))
    scratch.drop_all_but(texts, places)
    return texts, listed(places)


def dedup_bytes(docs: DataFrame, w: Windows = WINDOW, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts, places = _placed(docs, w, limit)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for t, p in zip(batch.column(2).cast(pa.large_binary()), columns_of(batch.column(3), 3), strict=True):
            text = t.as_py()
            left, gone, runs = _kept(text, p, w)
            out.append((len(text), gone, runs, hashlib.sha256(left).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c)) for c in zip(*out, strict=True))], names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    results = by_batch(with_places(texts, places).select("k1", "k2", "text", "places"), each, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return rows_with(docs, texts, results, {"n_bytes": 0, "n_removed": 0, "n_spans": 0, "kept_sha256": hashlib.sha256(b"").hexdigest()})


def strip(docs: DataFrame, w: Windows = WINDOW, limit: int = LIMIT) -> DataFrame:
    """docs without their repeated 200-byte strings."""
    texts, places = _placed(docs, w, limit)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left = [_kept(t.as_py(), p, w)[0].decode("utf-8", "ignore") for t, p in zip(batch.column(2).cast(pa.large_binary()), columns_of(batch.column(3), 3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(left, pa.string())], names=["k1", "k2", "left"])

    results = by_batch(with_places(texts, places).select("k1", "k2", "text", "places"), each, "k1 long, k2 long, left string")
    # a row travels as one struct, so that no name of its columns can clash
    others = [c for c in docs.columns if c != "text"]
    row = {"row": F.struct(*(F.col(f"`{c}`") for c in others)), "none": F.col("text").isNull()}
    own = docs.select(*(c.alias(k) for k, c in row.items()), F.col("text"))
    joined = given_to_rows(own, texts, results, {"left": ""}, {"row": F.col("row"), "none": F.col("none")})
    text = F.when(~F.col("none"), F.col("left"))
    types = dict(docs.dtypes)
    made = {"text": text, "n_chars": F.char_length(text).cast(types.get("n_chars", "long"))}
    return joined.select(*(made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in docs.columns))
