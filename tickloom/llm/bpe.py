"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

For every prefix of a piece there is one right encoding, and its last token is the only vocabulary token
that ends there and can follow the encoding of what stands before it. Whether two tokens may stand side by
side is a property of the merge list alone. So the state after a prefix is the last token of each of the
prefixes within reach, and the reach is the longest token: a sufficient lookahead that the merge list gives.
A token is emitted once all states within reach agree on it, after which nothing read later can change it.

Decoding joins token bytes and feeds them to an incremental UTF-8 automaton, which holds back at most the
three bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch
from .vocabulary import LATIN_LETTERS, LATIN_NUMBERS, Kept, byte_letters, is_latin

#: Pieces and half as many pairs that a Python worker keeps; beyond it, it starts anew.
KEPT = 400_000
#: Pieces that are encoded at a time, whatever the text's length.
BLOCK = 8192
#: White space of Unicode.
_WS = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_FAR = 1 << 60


class Merges:
    """A vocabulary file's tokens and merges as bytes and ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*vocabulary.values(), *self.added.values()]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}  # two tokens: rank and token of their merge
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank and halves of the merge that makes it
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, ab = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.pairs.setdefault((a, b), (rank, ab))
            self.parts.setdefault(ab, (rank, a, b))
        self.tokens = {self.bytes[i]: i for t, i in vocabulary.items() if self._made(i)}
        #: No token is longer, so a prefix further back cannot begin the token that ends here.
        self.lookahead = max(map(len, self.tokens))
        self.size = [len(x) for x in self.bytes]
        self.known: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for data, i in self.tokens.items():
            self.automaton.add_word(data.decode("latin-1"), i)
        self.automaton.make_automaton()

    def _made(self, token: int) -> bool:
        """Whether merging this token's own bytes yields it. Its halves may stand side by side only until
        their merge, and each half must come about by itself."""
        if token not in self.parts:
            return len(self.bytes[token]) == 1
        seen = self.plain(self.bytes[token])
        return seen == [token]

    def plain(self, data: bytes) -> list[int]:
        """The merges applied one after the other; for single tokens while tables are built."""
        row = [self._single[b] for b in data]
        while len(row) > 1:
            best = min(range(len(row) - 1), key=lambda i: self.pairs.get((row[i], row[i + 1]), (_FAR, 0))[0])
            found = self.pairs.get((row[best], row[best + 1]))
            if found is None:
                break
            row[best : best + 2] = [found[1]]
        return row

    @property
    def _single(self) -> dict[int, int]:
        if "_one" not in self.__dict__:
            self._one = {x[0]: i for i, x in enumerate(self.bytes) if len(x) == 1 and i not in self.parts}
        return self._one

    def beside(self, left: int, right: int) -> bool:
        """Whether two tokens may be neighbours: no merge across their border comes before the merges that
        complete the border tokens. Kept for each pair."""
        key = left << 20 | right
        if key not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[key] = self._holds(left, right)
        return self.known[key]

    def _holds(self, left: int, right: int) -> bool:
        # Undo the merges on both sides of the border, latest first, and look at each pair that stood there
        # for a time. A pair merges across if its rank comes before the merge that takes one of its tokens
        # away; with equal ranks the left place goes first.
        rank = lambda t: self.parts[t][0] if t in self.parts else -1
        until_left, until_right = _FAR, _FAR
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across[0] < until_left and across[0] <= until_right:
                # the right token's own merge stands to the right, so at equal rank the border goes first
                if across[0] < until_right or until_right == across[0]:
                    return False
            a, b = rank(left), rank(right)
            if a < 0 and b < 0:
                return True
            if a > b or (a == b and a >= 0):
                until_left, left = a, self.parts[left][2]
            else:
                until_right, right = b, self.parts[right][1]


class Transducer:
    """Encodes one piece fed in parts; ``emit`` gets tokens in order as soon as they are settled.

    A token automaton names the tokens that end at each byte; its state runs on from part to part."""

    def __init__(self, merges: Merges, emit):
        self.m, self.emit = merges, emit
        self.matches = merges.automaton.iter("")
        self.base = 0  # so many bytes are encoded and emitted
        self.last: list[int] = [-1]  # last[i]: last token of the encoding of the first base + i bytes

    def feed(self, part: bytes) -> None:
        m, last, base = self.m, self.last, self.base
        size, known, add = m.size, m.known.get, last.append
        done = base + len(last) - 1  # bytes whose state is known
        matches = self.matches
        matches.set(part.decode("latin-1"))
        ahead = 1 - base
        for end, t in matches:
            if end >= done:
                p = last[end + ahead - size[t]]
                if p >= 0:
                    holds = known(p << 20 | t)
                    if not (m.beside(p, t) if holds is None else holds):
                        continue
                add(t)
                done += 1
        if len(last) > 4 * m.lookahead:
            self._settle()

    def _way(self, i: int) -> list[int]:
        way, size, last = [], self.m.size, self.last
        while i > 0:
            way.append(i)
            i -= size[last[i]]
        return way[::-1]

    def _settle(self) -> None:
        """Emits what the encodings of all prefixes within reach have in common."""
        n = len(self.last) - 1
        ways = [self._way(i) for i in range(n - self.m.lookahead + 1, n + 1)]
        same = 0
        while all(len(w) > same for w in ways) and len({w[same] for w in ways}) == 1:
            same += 1
        if same:
            for end in ways[0][:same]:
                self.emit(self.last[end])
            cut = ways[0][same - 1]
            self.base += cut
            self.last = self.last[cut:]

    def finish(self) -> None:
        emit, last = self.emit, self.last
        for end in self._way(len(last) - 1):
            emit(last[end])


def _cutter(engine, space: str, letter: str, number: str):
    return engine.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Codec(Kept):
    """ids of the pre-tokenizer's pieces as bytes; what is asked for is kept."""

    def __init__(self, path: str):
        import regex

        super().__init__(KEPT)
        self.merges = Merges(path)
        self.any = _cutter(regex, _WS, r"\p{L}", r"\p{N}")
        self.latin = _cutter(re, "\\t-\\r\\x20\\x85\\xa0", LATIN_LETTERS, LATIN_NUMBERS)  # the same for the first 256 characters, faster

    def make(self, text: str) -> bytes:
        out: list[int] = []
        t = Transducer(self.merges, out.append)
        data = text.encode()
        for at in range(0, len(data), 4096):
            t.feed(data[at : at + 4096])
        t.finish()
        return array("I", out).tobytes()

    def blocks(self, text: str) -> Iterator[bytes]:
        """The text's ids as little-endian 32-bit numbers, some thousands of pieces at a time."""
        added = self.merges.added
        parts = re.split("(" + "|".join(map(re.escape, added)) + ")", text) if any(x in text for x in added) else [text]
        cut = self.latin if is_latin(text) else self.any
        for part in parts:
            if part in added:
                yield array("I", [added[part]]).tobytes()
            elif len(part) <= 1 << 16:
                yield b"".join(map(self.__getitem__, cut.findall(part)))
            else:
                pieces = (x.group() for x in cut.finditer(part))
                while block := list(islice(pieces, BLOCK)):
                    yield b"".join(map(self.__getitem__, block))

    def decoded(self, blocks: Iterator[bytes]) -> Iterator[str]:
        """Text of ids given in blocks; bytes that are no UTF-8 become U+FFFD."""
        automaton, token = codecs.getincrementaldecoder("utf-8")("replace"), self.merges.bytes.__getitem__
        for block in blocks:
            yield automaton.decode(b"".join(map(token, np.frombuffer(block, dtype="<u4").tolist())))
        yield automaton.decode(b"", final=True)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text encoded and decoded again.

    A null text is empty (no ids); repeated rows give repeated rows; other columns are not read."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        n, ids, text = [], [], []
        for value in batch.column(1):
            total, seen, said = 0, hashlib.sha256(), hashlib.sha256()

            def counted(blocks: Iterator[bytes]) -> Iterator[bytes]:
                nonlocal total
                for b in blocks:
                    total += len(b) // 4
                    seen.update(b)
                    yield b

            for part in c.decoded(counted(c.blocks(value.as_py() or ""))):
                said.update(part.encode())
            n.append(total)
            ids.append(seen.hexdigest())
            text.append(said.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids array<int> of every text."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        rows = [np.frombuffer(b"".join(c.blocks(x.as_py() or "")), dtype="<u4").astype(np.int32) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of every row of ids (null ids: empty text)."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        rows = ["".join(c.decoded(iter([np.array(x.as_py() or [], dtype="<u4").tobytes()]))) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], names=["doc_id", "text"])

    return by_batch(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), each, "doc_id long, text string")
