"""Secret scans: fixed patterns, and tokens that a character Markov model finds random.

Two first-order models over characters are trained from labelled samples: random strings (seeded
draws from the alphabets that keys are written in) and ordinary identifiers (runs of the characters that keys
are written in from a bounded sample of the documents, outside the patterns' finds, their snake_case,
camelCase, dashed and path joins, joins with seeded dates and numbers, and names as code writes them: UPPER_SNAKE,
camelCase with acronyms, versions between words, bases of a sequence, one character over and over). A candidate is a run of
MIN_LENGTH or more such characters; it is a find if its mean log-likelihood ratio per character is above THRESHOLD, unless it has
the form of a UUID, which no model of neighbouring characters tells from a key in hex.

Defined results: a null or empty text has no finds; repeated rows are scanned each by itself; an empty
table gives no rows (and a model of random strings against nothing, which is not used); other columns are
not read. Places are code points, ends exclusive; an assign find is its whole match, name included.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, full_text, sampled

#: Documents (about), runs of each (those of the smallest hashes) and random strings in the labelled samples.
SAMPLE_DOCS = 256
SAMPLE_WORDS = 400
SAMPLE_RANDOM = 4000
#: Names of each kind that are made of one document's words.
SAMPLE_NAMES = 20
MIN_LENGTH = 20
THRESHOLD = 0.6
#: The patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_NAMES = ("passw", "secret", "token", "api")
_ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", "0123456789abcdef", string.ascii_uppercase + string.digits)
_CLASSES = "\x00" + string.ascii_letters + string.digits + "+/_=-"
_CODE = np.zeros(128, dtype=np.int64)
for _i, _c in enumerate(_CLASSES):
    _CODE[ord(_c)] = _i


def base_finds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' finds, by start, then kind."""
    found = []
    lower = text.lower() if any(x in text for x in "=:") else ""
    if any(x in lower for x in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


KINDS = ("assign", "access", "hex", "markov")


def spelled(found: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in found])


def _counts(samples: list[str]) -> np.ndarray:
    n = len(_CLASSES)
    counts = np.zeros((n, n), dtype=np.int64)
    for s in samples:
        code = _CODE[np.frombuffer(("\x00" + s).encode("ascii"), dtype=np.uint8)]
        np.add.at(counts, (code[:-1], code[1:]), 1)
    return counts


def random_samples(n: int = SAMPLE_RANDOM, seed: int = 7) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices(draw.choice(_ALPHABETS), k=draw.randint(20, 44))) for _ in range(n)]


def identifiers(text: str, most: int = SAMPLE_WORDS) -> list[str]:
    """Ordinary identifiers of a text: ``most`` of its distinct runs outside finds, alone and joined, also with
    dates and numbers drawn by the runs themselves, and rules and numerals."""
    for a, _, b in reversed(base_finds(text)):
        text = text[:a] + " " + text[b:]
    # runs as long as candidates may be keys themselves, so they teach nothing; the joins stand for them
    runs = list(dict.fromkeys(r for r in RUN.findall(text) if len(r) < MIN_LENGTH))
    if len(runs) > most:
        taken = set(sorted(runs, key=lambda r: (zlib.crc32(r.encode()), r))[:most])
        runs = [r for r in runs if r in taken]
    pairs = list(zip(runs[::2], runs[1::2], strict=False))
    joined = [f"{a}_{b}" for a, b in pairs[:20]] + [a + b.capitalize() for a, b in pairs[20:40]] + [f"{a}-{b}" for a, b in pairs[40:60]] + [f"{a}/{b}" for a, b in pairs[60:80]]
    draw = random.Random(" ".join(runs[:20]))
    words = [w for w in runs if w.isalpha()]
    for _ in range(20 if words else 0):
        a, b, c = draw.choices(words, k=3)
        date = [str(draw.randint(1990, 2035)), f"{draw.randint(1, 12):02}", f"{draw.randint(1, 28):02}"]
        n = str(draw.randint(0, draw.choice((9, 99, 999))))
        joined.append(draw.choice("-_/").join(draw.choice(([a, b, *date], [a, *date, b], [*date, a, b], [a, b, c, date[0]], [a + n, b, c], [a + n, b + str(draw.randint(1, 9)), c]))))
    if words:
        joined += [draw.choice("-_=+/") * MIN_LENGTH, str(draw.randrange(10**19, 10**20))]
    return runs + joined + code_names([w.lower() for w in words if len(w) > 1], draw)


def code_names(words: list[str], draw: random.Random, most: int = SAMPLE_NAMES) -> list[str]:
    """Names as code writes them, made of words: ``most`` of each kind; and sequences of bases and of one character."""
    if not words:
        return []
    made = []
    for _ in range(most):
        made.append("_".join(w.upper() for w in draw.choices(words, k=draw.randint(3, 6))))
        made.append("".join(w[: draw.randint(2, 4)].upper() if draw.random() < 0.25 else w.capitalize() for w in draw.choices(words, k=draw.randint(3, 6))))
        version = draw.choice("abcvx") + str(draw.randint(1, 99))
        made.append(draw.choice("-_").join([*draw.choices(words, k=draw.randint(1, 2)), version, *draw.choices(words, k=draw.randint(2, 3))]))
    return [*made, *("".join(draw.choices(bases, k=2 * MIN_LENGTH)) for bases in ("ACGT", "acgt")), draw.choice(string.ascii_letters + string.digits) * MIN_LENGTH]


def _likelihood(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood of each character after each, drawn towards the characters' own frequencies where a
    predecessor is rare."""
    alone = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * len(counts))
    return np.log((counts + 8.0 * alone) / (counts.sum(1, keepdims=True) + 8.0))


def log_ratio(ordinary: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio, random against ordinary."""
    return _likelihood(drawn) - _likelihood(ordinary)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Table of log ratios, from about sample_docs documents."""
    sample = sampled(docs, sample_docs).select(full_text().alias("text"))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = _counts([w for t in batch.column(0) for w in identifiers(t.as_py())])
        a, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(counts[a, b])], names=["a", "b", "n"])

    ordinary = np.zeros((len(_CLASSES), len(_CLASSES)), dtype=np.int64)
    for r in by_batch(sample, each, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most the square of the classes
        ordinary[r["a"], r["b"]] = r["n"]
    return log_ratio(ordinary, _counts(random_samples()))


def markov_finds(text: str, table: np.ndarray, base: list[tuple[int, int, int]], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if UUID.fullmatch(s) or any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        code = _CODE[np.frombuffer(("\x00" + s).encode("ascii"), dtype=np.uint8)]
        if table[code[:-1], code[1:]].mean() > threshold:
            found.append((m.start(), 3, m.end()))
    return found


def scan(docs: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for every row."""
    table = train(docs) if table is None else table

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_finds(text)
            more = markov_finds(text, table, base)
            kinds = [k for _, k, _ in base]
            out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(sorted(base + more)), len(more)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), each, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def redact(docs: DataFrame, table: np.ndarray | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with every find in text replaced by ``mark``; null texts stay null, other columns as they are."""
    table = train(docs) if table is None else table
    columns = docs.columns
    place = columns.index("text")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for value in batch.column(place):
            text = value.as_py()
            if text:
                base = base_finds(text)
                joined: list[list[int]] = []
                for a, _, b in sorted(base + markov_finds(text, table, base)):
                    if joined and a < joined[-1][1]:
                        joined[-1][1] = max(b, joined[-1][1])
                    else:
                        joined.append([a, b])
                for a, b in reversed(joined):
                    text = text[:a] + mark + text[b:]
            texts.append(text)
        yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return by_batch(docs, each, docs.schema)
