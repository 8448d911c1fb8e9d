"""Quality rules as a short-circuit cascade ordered by measured rejection per cost.

A text is kept if no rule rejects it. Rules run one after the other and each sees only the texts that the
ones before have left, so the order changes what they cost and nothing else. Cost and selectivity of each
rule are measured over those rows of a sample (SAMPLE rows, about) that pass the base rules, as it will see no others.
The counts that every row of the result has are made for all texts; rules that need more read the texts left.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged each
by itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import by_batch, sampled

#: Rows (about) of the sample that orders the rules.
SAMPLE = 512
SHINGLE = 8
_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Texts:
    """One slice of texts with the counts that every row of the result has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.start, self.end, self.first = R.words(data, offsets)
        self.row = R.rows_of(self.first)
        n = len(offsets) - 1
        self.n_words = np.diff(self.first)
        lead = (data & 0xC0) != 0x80  # bytes that begin a code point
        self.word_chars = self._by_row(lead & ~R._SPACE[data])
        self.n_symbols = self._by_row(_SYMBOLS[data])
        self.n_dup_lines, self.n_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
        whole = data.tobytes()
        self.lines: list[list[bytes]] = []
        for i in range(n):
            lines = [x for x in whole[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
            self.lines.append(lines)
            self.n_lines[i] = len(lines)
            self.n_dup_lines[i] = len(lines) - len(set(lines))
        self.n_repeat_words = self._repeats()

    def failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)

    def _by_row(self, per_byte: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(per_byte, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def _repeats(self) -> np.ndarray:
        """Words under a window of SHINGLE words that stands twice or more in its text."""
        n = len(self.offsets) - 1
        if len(self.start) < SHINGLE:
            return np.zeros(n, np.int64)
        hashes = R.Hashes(R.word_symbols(self.data, self.start, self.end)).windows(SHINGLE)
        at = np.flatnonzero(self.row[: len(hashes)] == self.row[SHINGLE - 1 :])
        keys = R.mix(hashes[at] ^ (self.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        under = R.covered(at[twice], SHINGLE, len(self.start))
        return np.bincount(self.row[under], minlength=n)


#: A rule gives True for the texts it rejects, out of those numbered.
Rule = Callable[[Texts, np.ndarray], np.ndarray]


def _mean_length(t: Texts, i: np.ndarray) -> np.ndarray:
    mean = t.word_chars[i] / np.maximum(t.n_words[i], 1)
    return (mean < 2) | (mean > 25)


def _symbols(t: Texts, i: np.ndarray) -> np.ndarray:
    return t.n_symbols[i] > 0.1 * t.n_words[i]


def _repeated_lines(t: Texts, i: np.ndarray) -> np.ndarray:
    return t.n_dup_lines[i] > 0.3 * t.n_lines[i]


def _letters(t: Texts, i: np.ndarray) -> np.ndarray:
    """Fewer than half of the words hold a letter. Reads the bytes of the texts left and no others."""
    sizes = t.offsets[i + 1] - t.offsets[i]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(t.offsets[i] - ends + sizes, sizes)
    sums = np.concatenate([[0], np.cumsum(_LETTER[t.data[at]])])
    counts = t.n_words[i]
    last = np.cumsum(counts)
    word = np.arange(last[-1]) + np.repeat(t.first[i] - last + counts, counts)
    moved = np.repeat(ends - sizes - t.offsets[i], counts)
    held = sums[t.end[word] + moved] > sums[t.start[word] + moved]
    return np.bincount(np.repeat(np.arange(len(i)), counts)[held], minlength=len(i)) < 0.5 * counts


def _bullets(t: Texts, i: np.ndarray) -> np.ndarray:
    """More than nine tenths of at least five lines begin as list items."""
    marks = (b"- ", b"* ", b"+ ", "•".encode())
    return np.array([len(x) >= 5 and sum(y.lstrip().startswith(marks) for y in x) > 0.9 * len(x) for x in (t.lines[k] for k in i)], dtype=bool)


def _ellipses(t: Texts, i: np.ndarray) -> np.ndarray:
    """More than half of at least five lines break off."""
    return np.array([len(x) >= 5 and sum(y.rstrip().endswith((b"...", "…".encode())) for y in x) > 0.5 * len(x) for x in (t.lines[k] for k in i)], dtype=bool)


RULES: dict[str, Rule] = {"mean_length": _mean_length, "symbols": _symbols, "repeated_lines": _repeated_lines, "letters": _letters, "bullets": _bullets, "ellipses": _ellipses}


def order_rules(docs: DataFrame, rules: dict[str, Rule] = RULES, sample: int = SAMPLE) -> list[str]:
    """Rule names by rejections per second over about ``sample`` rows, ties by name."""
    names = sorted(rules)

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in R.slices(batch):
            t = Texts(data, offsets)
            left = np.flatnonzero(~t.failed())
            out = []
            for name in names:
                began = time.perf_counter()
                rejected = int(rules[name](t, left).sum()) if len(left) else 0
                out.append((name, rejected, time.perf_counter() - began))
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], names=["rule", "rejected", "seconds"])

    measured = by_batch(sampled(docs, sample).select(F.col("text").cast("string").alias("text")), measure, "rule string, rejected long, seconds double")
    rate = {r["rule"]: (r["rejected"] + 0.5) / (r["seconds"] + 1e-6) for r in measured.groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()}  # a row for each rule
    return sorted(names, key=lambda x: (-rate.get(x, 0.0), x))


def judge(docs: DataFrame, rules: dict[str, Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row."""
    order = order_rules(docs, rules) if order is None else order

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in R.slices(batch):
            t = Texts(data, offsets)
            failed = t.failed()
            kept = ~failed
            for name in order:
                left = np.flatnonzero(kept)
                if not len(left):
                    break
                kept[left] = ~rules[name](t, left)
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, (t.n_words.astype(np.int64), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words.astype(np.int64), failed, kept))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), each, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
