"""Best-fit packing of tokenized documents into sequences, after Martello-Toth dominance reduction.

Pieces are rows and stay in Spark. What the packing needs to know of them is how many there are of each
length, a table of at most ``capacity`` rows at any input size; the plan made from it gives, for runs of
equal pieces, their sequences and offsets in closed form, so it is bounded as well and is broadcast.

Defined results: a null text is empty and gives its end token alone; a null doc_id stays null; repeated rows
are packed as often as they occur; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, settle
from .vocabulary import LATIN_LETTERS, LATIN_NUMBERS, Kept, byte_letters, is_latin

CAPACITY = 4096
END = 1
#: Pieces whose ids a Python worker keeps; beyond it, it starts anew.
KEPT_WORDS = 400_000
SALT_ROWS = 2000


class Ids(Kept):
    """ids of the tokenizer's pieces as little-endian 32-bit bytes; what is asked for is kept.

    The tokenizer never joins across white space or its pieces' borders, so a text's ids are those of its
    pieces in order. Texts of characters that lower-casing alone normalizes are cut here; of others each
    word between ASCII white space goes through the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(KEPT_WORDS)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^\t-\r\x20\x85\xa0{LATIN_LETTERS}{LATIN_NUMBERS}]+")
        self.letters = byte_letters()
        self.words: dict[bytes, bytes] = {}

    def make(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def word(self, word: bytes) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
            if len(self.words) >= KEPT_WORDS // 4:
                self.words.clear()
            self.words[word] = found
        return found

    def of(self, text: str) -> bytes:
        if "<|" not in text and is_latin(text):
            return b"".join(map(self.__getitem__, self.cut.findall(text.lower())))
        return b"".join(map(self.word, text.encode().split()))


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each run of at most capacity ids of each document."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = _ids(vocabulary)
        tail = b"" if end is None else np.array([end], dtype="<u4").tobytes()
        row, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            data = ids.of(text.as_py() or "") + tail
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                own = data[at : at + 4 * capacity]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(own) // 4)
                crc.append(zlib.crc32(own))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _fixed(j: int, left: list[int], capacity: int, count: np.ndarray) -> tuple[int, ...] | None:
    """A set with one piece of length j that dominates every other feasible set with it, or None.

    left: lengths that remain, ascending; count: how many of each. The cases are those of Martello and
    Toth's reduction: nothing fits beside j; one piece at most fits; a piece fills the rest exactly; two
    at most fit and the largest one outweighs the best two, or the best two lead with that largest one."""
    room = capacity - j
    own = lambda x: int(count[x]) - (x == j)
    small = [x for x in left if own(x)][:3]
    if not small or small[0] > room:
        return (j,)
    k = int(np.searchsorted(left, room, side="right")) - 1
    while k >= 0 and not own(left[k]):
        k -= 1
    best = left[k]
    least: list[int] = []
    for x in small:
        least += [x] * min(own(x), 3 - len(least))
        if len(least) == 3:
            break
    if best == room or len(least) < 2 or least[0] + least[1] > room:
        return (j, best)
    if len(least) == 3 and sum(least) <= room:
        return None
    # two at most fit: the best two, by two pointers
    low, high, pair = 0, k, (0, 0)
    while low <= high:
        a, b = left[low], left[high]
        usable = own(a) and own(b) and (a != b or own(a) > 1)
        if a + b > room:
            high -= 1
        else:
            if usable and a + b > sum(pair):
                pair = (b, a)
            low += 1
    if best >= sum(pair):
        return (j, best)
    if pair[0] == best:
        # dominating if no feasible pair has both pieces longer than the second
        longer: list[int] = []
        for x in left[int(np.searchsorted(left, pair[1], side="right")) :]:
            longer += [x] * min(own(x), 2 - len(longer))
            if len(longer) == 2:
                break
        if len(longer) < 2 or sum(longer) > room:
            return (j, *pair)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(how many sequences, {length: pieces of it in each})], at most a few for every distinct length."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        count[length] = n
    made: list[tuple[int, dict[int, int]]] = []
    # reduction, from the longest on: fixed sets leave the instance for good, as often as their pieces allow
    for j in sorted((x for x in counts if count[x]), reverse=True):
        while count[j]:
            found = _fixed(j, np.flatnonzero(count).tolist(), capacity, count)
            if found is None:
                break
            each: dict[int, int] = defaultdict(int)
            for x in found:
                each[x] += 1
            times = min(int(count[x]) // n for x, n in each.items())
            made.append((times, dict(each)))
            for x, n in each.items():
                count[x] -= n * times
    # best fit decreasing over what is left, in groups of equal sequences
    open_groups: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    rooms: np.ndarray = np.zeros(capacity + 1, dtype=bool)
    for length in np.flatnonzero(count)[::-1].tolist():
        n = int(count[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                times, each = open_groups[room].pop()
                rooms[room] = bool(open_groups[room])
            else:
                room, each = capacity, {}
                times = max(1, n // (capacity // length))
            most = room // length
            if n >= most:
                used, put = min(times, n // most), most
            else:
                used, put = 1, n
            n -= used * put
            if used < times and each:
                open_groups[room].append((times - used, each))
                rooms[room] = True
            rest = room - put * length
            open_groups[rest].append((used, each | {length: put}))
            rooms[rest] = rest > 0
    made += [g for groups in open_groups.values() for g in groups]
    return made


def slots(made: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces in each sequence, first sequence, offset) of runs of equal pieces."""
    rows, rank, sequence = [], defaultdict(int), 0
    for times, each in made:
        offset = 0
        for length, n in each.items():
            rows.append((length, rank[length], times * n, n, sequence, offset))
            rank[length] += times * n
            offset += n * length
        sequence += times
    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """One row for each piece of each document with its sequence_id and offset."""
    pieces = tokenized_pieces(docs, vocabulary, capacity, end)
    pieces = settle(pieces.withColumn("row", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length at most
    spark = docs.sparkSession
    made = slots(plan(counts, capacity))
    # a piece's rank among those of its length: within salted shares, after the shares before its own
    shares = max(16, sum(counts.values()) // SALT_ROWS)
    pieces = pieces.withColumn("share", F.pmod("row", F.lit(shares)))
    ahead = pieces.groupBy("length", "share").agg(F.count("*").alias("n"))
    ahead = ahead.select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("ahead"))
    ranked = pieces.join(ahead, ["length", "share"]).withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy("length", "share").orderBy("row")) - 1)
    runs = defaultdict(list)
    for length, *run in made:
        runs[length].append(tuple(run))
    by_length = spark.createDataFrame(list(runs.items()), "length long, runs array<struct<first:long,ranks:long,each:long,sequence:long,place:long>>")
    ranked = ranked.join(F.broadcast(by_length), "length")
    run = F.filter("runs", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["ranks"]))[0]
    ranked = ranked.withColumn("run", run)
    t = F.col("rank") - F.col("run.first")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.sequence") + F.floor(t / F.col("run.each"))).alias("sequence_id"), (F.col("run.place") + (t % F.col("run.each")) * F.col("length")).alias("offset"))
