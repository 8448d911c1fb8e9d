"""What the two operators on repeated windows share: whole texts once, runs of windows, places and results.

Texts are told apart by 128 bits of their content, never by id, so rows without an id or with an id that other
texts have keep their own results. Each distinct text is written once with a number and the count of its
rows, and what is found out for it goes to all its rows.

Every window of W symbols owns one gram of it, the smallest-hashed (see ``rolling.anchors``), and equal windows own
equal grams at equal places. Windows in a row that own one gram are a run: (text, start, count), with the gram's
hash as key and 128 bits of its symbols as body. A window can repeat only if its run's key does, so all other
runs leave at once; and runs of equal body are one, with the sum of their counts. What is left, keys with
several bodies, goes to the operator's own method (``Solver``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import Scratch, by_batch, content, content_or_own, doc_id, full_text, spread_join

RUNS = "rid long, n long, place long, key long, b1 long, b2 long"
_U = np.uint64


@dataclass(frozen=True)
class Windows:
    """What is a symbol ('word' or 'byte') and how long windows and grams are."""

    unit: str
    window: int
    gram: int

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.unit == "byte":
            return R.byte_symbols(data), offsets
        start, end, first = R.words(data, offsets)
        return R.word_symbols(data, start, end), first


def packed(start: np.ndarray, count: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """One number for ``count`` windows from ``start`` on, whose gram stands ``lead`` symbols after start."""
    return (start.astype(np.int64) << 24) | (count.astype(np.int64) << 12) | lead.astype(np.int64)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, (place >> 12) & 0xFFF, place & 0xFFF


def bodies(hashes: R.Hashes, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the symbols from start to end and of where their gram stands."""
    lead = lead.astype(_U)
    return R.mix(hashes.spans(start, end) ^ (lead * _U(0xA0761D6478BD642F))), R.mix(hashes.seconds(start, end) ^ (lead * _U(0x8CB92BA72F3D8DD7)))


def distinct_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(rid, n, first, k1, k2, text): each distinct text that is not empty, how many rows have it and the smallest
    of their ids."""
    own = docs.select(doc_id(), full_text().alias("text")).where("text <> ''").withColumns(content(F.col("text")))
    once = own.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return scratch.keep(once.select(F.monotonically_increasing_id().alias("rid"), "n", "first", "k1", "k2", "text"))


def _keys(texts: DataFrame, w: Windows) -> DataFrame:
    """(key, n): grams of windows that stand in more than one place."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in R.slices(batch):
            symbols, first = w.symbols(data, offsets)
            row, _, key, _, _ = R.anchors(symbols, first, w.window, w.gram)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), rows.column(0).take(pa.array(row))], names=["key", "n"])

    return by_batch(texts.select("n", "text"), each, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n > 1")


def _runs(texts: DataFrame, w: Windows) -> DataFrame:
    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in R.slices(batch):
            symbols, first = w.symbols(data, offsets)
            row, at, key, runs, hashes = R.anchors(symbols, first, w.window, w.gram)
            b1, b2 = bodies(hashes, runs[:, 0], runs[:, 1] + w.window, at - runs[:, 0])
            place = packed(runs[:, 0] - first[row], runs[:, 1] - runs[:, 0] + 1, at - runs[:, 0])
            ids = pa.array(row)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(ids), rows.column(1).take(ids), *(pa.array(x.view(np.int64)) for x in (place, key, b1, b2))], names=["rid", "n", "place", "key", "b1", "b2"])

    return by_batch(texts.select("rid", "n", "text"), each, RUNS)


#: Repeated windows within bodies, (bid, lo, cnt, path): cnt windows from the lo-th on, found as one piece ``path``.
#: Gets the texts and (bid, key, n, rid, place, m): the bodies of keys that have several, m of them.
Solver = Callable[[DataFrame, DataFrame, Scratch], DataFrame]


def solved(texts: DataFrame, runs: DataFrame, solver: Solver, scratch: Scratch) -> DataFrame:
    """(rid, n, place, lo, cnt, path): the repeated windows of all runs. runs: a kept table of RUNS; columns
    besides stay."""
    body = ["key", "b1", "b2"]
    same = runs.groupBy(*body).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(F.struct("rid", "place")).alias("at"))
    same = scratch.keep(same.select(F.monotonically_increasing_id().alias("bid"), *body, "n", "rows", "at.rid", "at.place"))
    # of a key's bodies one goes on alone only if its rows are several
    keys = scratch.keep(same.groupBy("key").agg(F.sum("n").alias("sum"), F.count("*").alias("n")).where("sum > 1").drop("sum"))
    graded = scratch.keep(spread_join(same, keys.select("key", F.col("n").alias("m")), ["key"], keys))
    scratch.drop(same, keys)
    whole = graded.where("m = 1").select("bid", F.lit(0).cast("long").alias("lo"), F.expr("(place >> 12) & 4095").alias("cnt"), F.col("b1").alias("path"))
    found = scratch.keep(whole.union(solver(texts, graded.where("m > 1"), scratch)))
    named = graded.select("bid", *body).join(found, "bid").groupBy(*body).agg(F.collect_list(F.struct("lo", "cnt", "path")).alias("pieces"))  # no more than a run has windows
    joined = spread_join(runs, named, body, graded.select(*body, F.col("rows").alias("n")))
    return joined.select(*(c for c in runs.columns if c not in body), F.inline("pieces"))


def repeated_windows(texts: DataFrame, w: Windows, solver: Solver, scratch: Scratch) -> DataFrame:
    """(rid, n, place, lo, cnt, path) for all texts."""
    keys = scratch.keep(_keys(texts, w))
    counts = keys.select("key", F.col("rows").alias("n"))
    runs = scratch.keep(spread_join(_runs(texts, w), keys.select("key"), ["key"], counts))
    scratch.drop(keys)
    return solved(texts, runs, solver, scratch)


def listed(places: DataFrame) -> DataFrame:
    """(rid, places): starts, counts and paths of each text's repeated windows."""
    start = (F.shiftright("place", 24) + F.col("lo")).alias("start")
    # at most as many as the text has symbols
    return places.groupBy("rid").agg(F.collect_list(F.struct(start, "cnt", "path")).alias("places"))


def removed(start: np.ndarray, count: np.ndarray, window: int, n: int) -> np.ndarray:
    """Mask of a text's n symbols that stand in the windows from start on."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def with_places(texts: DataFrame, places: DataFrame) -> DataFrame:
    """texts with their places, null where a text has none."""
    return texts.join(places.hint("shuffle_hash"), "rid", "left")


def columns_of(lists: pa.Array, fields: int) -> Iterator[list[np.ndarray] | None]:
    """The fields of each row's list of structs as arrays, None where the list is null or empty."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    edge = np.concatenate([[0], np.cumsum(lengths)])
    flat = lists.flatten()
    whole = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(fields)]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield [x[a:b] for x in whole] if b > a else None


def flattened(lists: pa.Array, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct in a batch's lists, and their fields."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), lengths), [flat.field(k).to_numpy(zero_copy_only=False) for k in range(fields)]


def given_to_rows(docs: DataFrame, texts: DataFrame, results: DataFrame, empty: dict, columns: dict) -> DataFrame:
    """results (k1, k2 and its own columns) for all rows of docs, ``empty`` for those without text. columns: of docs,
    what goes with them."""
    own = docs.select(*(c.alias(k) for k, c in columns.items()), *(c.alias(k) for k, c in content_or_own().items()))
    joined = spread_join(own, results, ["k1", "k2"], texts.select("k1", "k2", "n"), "left")
    names = [c for c in results.columns if c not in ("k1", "k2")]
    return joined.select(*columns, *(F.coalesce(F.col(c), F.lit(empty[c])).alias(c) if c in empty else F.col(c) for c in names))


def rows_with(docs: DataFrame, texts: DataFrame, results: DataFrame, empty: dict) -> DataFrame:
    return given_to_rows(docs, texts, results, empty, {"doc_id": doc_id()})
