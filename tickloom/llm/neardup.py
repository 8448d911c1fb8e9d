"""MinHash near-dedup with HyperMinHash sketches.

A document is the set of its distinct five-word shingles (A-Z lower-cased). Each set has REGISTERS
registers; a shingle's hash picks one and the smallest rest there is kept as its leading-zero count and ten
mantissa bits. Bands of registers are keys (each empty register takes the value of a filled one that its
own order of all registers names first, so small sets agree register by register as often as large ones). Bands are
sized by the percentage, so that a pair at it shares none with probability MISSED at most where registers
agree independently.

Equal texts are one text, equal sets one set, whatever ids their rows have. Only sets that share a band are
compared. First each set with a hub, the smallest set of a band: with the hub that most of its bands have, then with
the others that it is not yet connected with; registers before texts, by the
collision-corrected estimate, and texts only for pairs whose estimate is not clearly too low. What is linked
so far makes components; most bands then hold one component and are done. In every other band the sets of unlike
components are compared in cells of bounded size, block against block, so a band of any size
is compared whole: registers first, full sets where the estimate allows a link, each pair in the first of the
bands that it shares. Sets that are connected already are never compared.

Defined results: a null text or one without words has an empty set, linked with nothing; one with fewer
than five words is one shingle. A component is named by its smallest id; rows without an id never name one, and
where no row has an id the name is null. ``kept`` is whether a row's id is that name; in a component without ids, whether it
has the component's first text by content hash. ``dedup`` keeps one row of each component (smallest id, then content) and all rows
without words. An empty table gives no rows. Other columns are not read by ``near_duplicates``; ``dedup`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import Scratch, by_batch, content, content_or_own, doc_id, spread_join
from .repeats import distinct_texts, given_to_rows

SHINGLE = 5
PERCENT = 85
REGISTERS = 320
#: Chance that a pair just linked shares no band.
MISSED = 4e-6
#: Sets and shingles of a band in a block of a cell, about; and partners of a set that are compared with it in one task.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
PARTNERS = 64
_REST = 40
_MANTISSA = 10
_EMPTY = np.uint16(65535)
#: Up to so many filled registers the first of an order is looked up by rank, else by steps along the order.
FEW = 18
#: Each register's order of all registers, and each register's rank in it.
_ORDERS = np.random.default_rng(20240915).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)
_RANKS = _ORDERS.argsort(axis=1).astype(np.uint16)
#: Chance that registers of unlike shingles agree: equal leading zeros (1/3), equal mantissas.
_COLLISION = 2.0**-_MANTISSA / 3
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by both."""
    data = R.lower_ascii(data)
    start, end, first = R.words(data, offsets)
    symbols, row = R.word_symbols(data, start, end), R.rows_of(first)
    hashes = R.Hashes(symbols)
    found = hashes.windows(size)
    inside = np.flatnonzero(row[: len(found)] == row[size - 1 :]) if len(found) else np.zeros(0, np.int64)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < size))
    rows = np.concatenate([row[inside], short])
    found = np.concatenate([found[inside], hashes.spans(first[short], first[short + 1])])
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[new], found[new]


def registers(rows: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS compressed registers; empty ones are 65535."""
    x = R.mix(found ^ _U(0x5851F42D4C957F2D))
    rest = np.full(n * REGISTERS, 1 << _REST, dtype=np.int64)
    np.minimum.at(rest, rows * REGISTERS + ((x >> _U(_REST)) % _U(REGISTERS)).astype(np.int64), (x & _U((1 << _REST) - 1)).astype(np.int64))
    zeros = _REST - np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    empty = rest == 1 << _REST
    zeros[empty] = 0
    mantissa = ((rest << zeros) >> (_REST - 1 - _MANTISSA)) & ((1 << _MANTISSA) - 1)
    packed = ((zeros << _MANTISSA) | mantissa).astype(np.uint16)
    packed[empty] = _EMPTY
    return packed.reshape(n, REGISTERS)


def filled(m: np.ndarray) -> np.ndarray:
    """m with each empty register taken from the first filled one in that register's own fixed order of all
    registers (optimal densification); only rows without any stay empty. The orders are independent, so a
    shingle that only one of two sets has spoils registers here and there and no run of them."""
    out = m.copy()
    full = m != _EMPTY
    count = full.sum(1)
    for k in np.unique(count[(count > 0) & (count <= FEW)]):
        same = np.flatnonzero(count == k)
        for rows in np.split(same, range(512, len(same), 512)):
            held = np.nonzero(full[rows])[1].reshape(-1, k)
            first = _RANKS[:, held].argmin(axis=2).T
            out[rows] = np.where(full[rows], m[rows], m[rows[:, None], np.take_along_axis(held, first, axis=1)])
    row, register = np.nonzero(~full & (count > FEW)[:, None])
    for step in _ORDERS.T:
        if not len(row):
            break
        source = step[register]
        got = full[row, source]
        out[row[got], register[got]] = m[row[got], source[got]]
        row, register = row[~got], register[~got]
    return out


def bands_for(percent: int) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a pair at percent no more often than MISSED: 8 and 40 at 85,
    6 and 53 at 80; single registers where none are short enough."""
    good = [r for r in range(1, REGISTERS + 1) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISSED]
    r = max(good, default=1)
    return r, REGISTERS // r


def band_keys(m: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band."""
    r, bands = bands_for(percent)
    parts = filled(m)[:, : r * bands].reshape(len(m), r, bands).transpose(0, 2, 1)
    weights = R._WEIGHTS[np.arange(r) % len(R._WEIGHTS)]
    keys = R.mix((parts.astype(_U) * weights).sum(axis=2) + np.arange(1, bands + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
    row, band = np.nonzero((parts != _EMPTY).any(axis=2))
    return row, keys[row, band]


def sketches(texts: DataFrame, percent: int) -> DataFrame:
    """(rid, size, s1, s2, bands, registers): set size, a 128-bit content hash of the set, its band keys and registers."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in R.slices(batch):
            n = rows.num_rows
            row, found = shingles(data, offsets)
            size = np.bincount(row, minlength=n)
            sums = []
            for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                total = np.zeros(len(row) + 1, dtype=_U)
                np.cumsum(R.mix(found ^ _U(salt)), out=total[1:])
                edge = np.concatenate([[0], np.cumsum(size)])
                sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
            m = registers(row, found, n)
            at, keys = band_keys(m, percent)
            cut = np.searchsorted(at, np.arange(n + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists, pa.array([x.tobytes() for x in m], pa.binary())], names=["rid", "size", "s1", "s2", "bands", "registers"])

    return by_batch(texts.select("rid", "text"), each, "rid long, size long, s1 long, s2 long, bands array<long>, registers binary")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label): the smallest id that each linked id can reach, by alternating star contraction. Links: a, b.

    Rows are two numbers, so even a component of a third of all sets is small until AQE splits it."""
    pairs = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    print_of = lambda p: tuple(p.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = print_of(pairs)
    while seen[0]:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(pairs)
        pairs, now = after, print_of(after)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("label")).union(pairs.select("v", "v").distinct())


def merged(label: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """label (id, label) after further links. Both are kept tables. Only the components' names are linked anew, so
    that sets which are connected already are not walked again."""
    left, right = (label.select(F.col("id").alias(c), F.col("label").alias(f"{c}_of")) for c in ("a", "b"))
    ends = spread_join(scratch.keep(links.select("a", "b").join(right, "b", "left")), left, ["a"], how="left")
    tops = scratch.keep(components(ends.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")), scratch))
    moved = spread_join(label, tops.select(F.col("id").alias("label"), F.col("label").alias("top")), ["label"], how="left")
    alone = tops.join(label.select("id"), "id", "left_anti")
    return scratch.keep(moved.select("id", F.coalesce("top", "label").alias("label")).union(alone.select("id", "label")))


def estimates(m: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate of each row of registers with ``one``, and the registers it rests on."""
    full = m != _EMPTY
    either = (full | (one != _EMPTY)).sum(1)
    agree = ((m == one) & full).sum(1)
    return (agree / np.maximum(either, 1) - _COLLISION) / (1 - _COLLISION), either


def plausible(m: np.ndarray, size: np.ndarray, one: np.ndarray, own: int, percent: int) -> np.ndarray:
    """Which sets may be linked with one: sizes allow it and the estimate is not five deviations too low."""
    share = percent / 100
    sized = (100 * np.minimum(size, own) >= percent * np.maximum(size, own)) & (np.minimum(size, own) > 0)
    estimate, either = estimates(m, one)
    return sized & (estimate >= share - 5 * np.sqrt(share * (1 - share) / np.maximum(either, 1)))


def _stars(pairs: DataFrame, payload: DataFrame, judge, scratch: Scratch) -> DataFrame:
    """(a, b) of the pairs (a kept table) that judge accepts. payload: rid and what is compared; a's partners come in cells
    of about PARTNERS. judge(rows of a cell, a's own row first): mask of the others."""
    of = pairs.groupBy("a").agg(F.count("*").alias("n"))
    shared = spread_join(pairs, of.select("a", F.ceil(F.col("n") / PARTNERS).alias("cells")), ["a"], of)
    shared = shared.select("a", F.pmod(F.xxhash64("b"), "cells").alias("cell"), F.col("b").alias("rid"))
    rows = scratch.keep(shared.union(shared.select("a", "cell", F.col("a").alias("rid")).distinct()))
    names = [c for c in payload.columns if c != "rid"]

    def each(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        rid, a = cell["rid"].to_numpy(), cell["a"][0].as_py()
        order = np.argsort(rid != a, kind="stable")
        cell, rid = cell.take(pa.array(order)), rid[order]
        partners = rid[1:][judge(cell)]
        return pa.table({"a": pa.array(np.full(len(partners), a), pa.int64()), "b": pa.array(partners, pa.int64())})

    # a set stands in one row for each of its hubs and each cell of its own: no key is hot
    cells = rows.join(payload, "rid").select("a", "cell", "rid", *names)
    return cells.groupBy("a", "cell").applyInArrow(each, "a long, b long")


def _registers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.uint16).reshape(-1, REGISTERS)


def linked(pairs: DataFrame, sets: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) of the pairs (a kept table) whose full sets are alike enough: registers first, then texts."""

    def alike(cell: pa.Table) -> np.ndarray:
        m, size = _registers(cell["registers"]), cell["size"].to_numpy()
        return plausible(m[1:], size[1:], m[0], int(size[0]), percent)

    def equal(cell: pa.Table) -> np.ndarray:
        raw = [t.as_py() for t in cell["text"].cast(pa.large_binary())]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        row, found = shingles(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
        edge = np.searchsorted(row, np.arange(len(raw) + 1))
        own = found[: edge[1]]
        if not len(own):
            return np.zeros(len(raw) - 1, dtype=bool)
        at = np.minimum(np.searchsorted(own, found[edge[1] :]), len(own) - 1)
        sums = np.concatenate([[0], np.cumsum(own[at] == found[edge[1] :])])
        both = sums[edge[2:] - edge[1]] - sums[edge[1:-1] - edge[1]]
        return 100 * both >= percent * (len(own) + np.diff(edge)[1:] - both)

    near = scratch.keep(_stars(pairs, sets.select("rid", "size", "registers"), alike, scratch))
    return scratch.keep(_stars(near, texts.select("rid", "text"), equal, scratch))


def _between(texts: list[bytes], rid: np.ndarray, of: np.ndarray, block: np.ndarray, within: bool, band: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked in one cell of a band; not within: only between its two blocks. of: the
    component of each set so far. A pair is compared in the first of the bands that it shares, and only while its
    components are apart."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(texts)
    row, found = shingles(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    edge = np.searchsorted(row, np.arange(n + 1))
    size = np.diff(edge)
    m = registers(row, found, n)
    at, keys = band_keys(m, percent)
    keys = keys.view(np.int64).reshape(n, -1)
    links, of = [], of.copy()
    for i in range(n - 1):
        j = i + 1 + np.flatnonzero(of[i + 1 :] != of[i])
        if not within:
            j = j[block[j] != block[i]]
        j = j[plausible(m[j], size[j], m[i], int(size[i]), percent)] if len(j) else j
        same = keys[j] == keys[i]
        j = j[keys[j, same.argmax(1)] == band] if len(j) else j
        if not len(j):
            continue
        own = found[edge[i] : edge[i + 1]]
        spans = np.repeat(edge[j] - np.concatenate([[0], np.cumsum(size[j])[:-1]]), size[j]) + np.arange(size[j].sum())
        theirs = found[spans]
        common = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        both = np.add.reduceat(common, np.concatenate([[0], np.cumsum(size[j])[:-1]]), dtype=np.int64)
        for k in j[100 * both >= percent * (size[j] + size[i] - both)].tolist():
            if of[k] != of[i]:
                links.append((int(rid[i]), int(rid[k])))
                of[of == of[k]] = of[i]
    return links


def across(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between unlike components within a band. members: a kept table of band, rid, component, size."""
    sized = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    blocks = sized.select("band", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = spread_join(members, blocks, ["band"], sized).withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("band", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rid", "component")
    whole = texts.select("rid", "text").join(members.select("rid").distinct(), "rid", "left_semi")
    cells = placed.join(whole.hint("shuffle_hash"), "rid")

    def each(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        raw = [t.as_py() for t in cell["text"].cast(pa.large_binary())]
        within = cell["one"][0].as_py() == cell["two"][0].as_py()
        found = _between(raw, *(cell[c].to_numpy() for c in ("rid", "component", "block")), within, cell["band"][0].as_py(), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return cells.groupBy("band", "one", "two").applyInArrow(each, "a long, b long")


def connected(sets: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(id, label): the smallest set that each linked set can reach. sets: a kept table of one row for each set."""
    keys = scratch.keep(sets.select("rid", F.explode("bands").alias("band")))
    hubs = scratch.keep(keys.groupBy("band").agg(F.min("rid").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    met = scratch.keep(spread_join(keys, hubs.select("band", "hub", F.col("n").alias("of")), ["band"], hubs).where("rid <> hub"))
    scratch.drop(keys)
    # each set first with the hub that it meets most often, then with its other hubs where that left them apart
    pairs = scratch.keep(met.groupBy(F.col("hub").alias("a"), F.col("rid").alias("b")).agg(F.count("*").alias("times")))
    best = scratch.keep(pairs.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b"))
    first = linked(best, sets, texts, percent, scratch)
    label = scratch.keep(components(first, scratch))
    left, right = (label.select(F.col("id").alias(c), F.col("label").alias(f"{c}_of")) for c in ("a", "b"))
    apart = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(right, "b", "left")
    apart = spread_join(scratch.keep(apart), left, ["a"], how="left").where(F.coalesce("a_of", "a") != F.coalesce("b_of", "b"))
    more = linked(scratch.keep(apart.select("a", "b")), sets, texts, percent, scratch)
    label = merged(label, more, scratch)
    # what is left of bands with three sets or more: those whose sets besides the hub are not all connected
    rest = met.where("of > 2").join(label.withColumnRenamed("id", "rid"), "rid", "left").select("band", "rid", F.coalesce("label", "rid").alias("component"))
    rest = scratch.keep(rest)
    mixed = rest.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high")
    members = scratch.keep(spread_join(rest, mixed.select("band"), ["band"], rest.groupBy("band").agg(F.count("*").alias("n"))))
    members = scratch.keep(spread_join(members, sets.select("rid", "size"), ["rid"]))
    return merged(label, scratch.keep(across(members, texts, percent)), scratch)


def labelled(docs: DataFrame, percent: int) -> DataFrame:
    """(k1, k2, n, n_shingles, head) of every distinct text; n: its rows, head: its component's first row: none, id, k1, k2.
    The only table of the run that stays."""
    scratch = Scratch(docs.sparkSession)
    texts = distinct_texts(docs, scratch)
    drawn = scratch.keep(sketches(texts, percent))
    kin = ["s1", "s2", "size"]
    of = scratch.keep(drawn.where("size > 0").groupBy(*kin).agg(F.min("rid").alias("set")))
    member = scratch.keep(spread_join(drawn.select("rid", *kin), of.select(*kin, "set"), kin))
    sets = scratch.keep(drawn.join(of.select(F.col("set").alias("rid")), "rid"))
    scratch.drop(drawn)
    label = connected(sets, texts, percent, scratch)
    named = member.select("rid", "size", "set").join(label.withColumnRenamed("id", "set"), "set", "left").select("rid", "size", F.coalesce("label", "set").alias("component"))
    row = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), "k1", "k2")
    own = scratch.keep(texts.select("rid", "k1", "k2", F.col("n").alias("of"), row.alias("me")).join(named, "rid"))
    heads = own.groupBy("component").agg(F.min("me").alias("head"), F.count("*").alias("n"))
    found = spread_join(own, heads.select("component", "head"), ["component"], heads)
    result = scratch.keep(found.select("k1", "k2", F.col("of").alias("n"), F.col("size").alias("n_shingles"), "head"))
    scratch.drop_all_but(result)
    return result


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links where 100 * intersection >= percent * union."""
    texts = labelled(docs, percent)
    found = texts.select("k1", "k2", "n_shingles", F.col("head.id").alias("component_id"), F.col("head.none").alias("nameless"), ((F.col("head.k1") == F.col("k1")) & (F.col("head.k2") == F.col("k2"))).alias("leads"))
    rows = given_to_rows(docs, texts, found, {"n_shingles": 0}, {"doc_id": doc_id()})
    named = F.when(F.col("nameless").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))  # no words: itself
    kept = F.when(F.col("nameless"), F.col("leads")).otherwise(F.coalesce(F.col("doc_id") == named, F.col("nameless").isNull()))
    return rows.select("doc_id", "n_shingles", named.alias("component_id"), kept.alias("kept"))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, the first, and all rows without words."""
    texts = labelled(docs, percent)
    found = texts.select("k1", "k2", "n_shingles", F.struct("head.id", "head.k1", "head.k2").alias("head"))
    # a row travels as one struct, so that no name of its columns can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc_id().alias("id"), *(c.alias(k) for k, c in content_or_own().items()))
    rows = spread_join(rows, found, ["k1", "k2"], texts.select("k1", "k2", "n"), "left")
    wordless = rows.where("n_shingles IS NULL").select("row")
    first = rows.where(F.col("head").eqNullSafe(F.struct("id", "k1", "k2")) & F.col("n_shingles").isNotNull())
    twice = docs.groupBy(doc_id().alias("id"), *(c.alias(k) for k, c in content().items())).count().where("count > 1")
    if not twice.isEmpty():
        first = first.dropDuplicates(["id", "k1", "k2"])
    return first.select("row").union(wordless).select("row.*")
