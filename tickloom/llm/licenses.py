"""License scans: phrases, and templates with optional and replaceable regions as token automata.

A template is a license's wording in words, ``[ ... ]`` around a region that may be left out and ``{n}``
for a replaceable region of at most n words. It compiles into an automaton over words; a text is accepted
where some run of its words takes the automaton from start to end, so all mandatory wording is there, word
for word and in order. Automata start only at places of a template's first mandatory word.

Defined results: a null or empty text has no words and no labels; repeated rows are scanned each by
itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch
from .wordings import TEMPLATES

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Automaton:
    """States in a row; ``steps[s]`` are the words read there, ``skips[s]`` the states reached unread."""

    def __init__(self, template: str):
        self.words: list[bytes | None] = []  # the word read from state s to s + 1; None: any
        self.skips: dict[int, list[int]] = {}
        self.mandatory: list[bool] = []
        opened: list[int] = []
        for part in re.findall(r"\[|\]|\{\d+\}|[^\[\]{}\s]+", template):
            if part == "[":
                opened.append(len(self.words))
            elif part == "]":
                self.skips.setdefault(opened.pop(), []).append(len(self.words))
            elif part.startswith("{"):
                begin = len(self.words)
                for i in range(int(part[1:-1])):
                    self.words.append(None)
                    self.mandatory.append(False)
                for s in range(begin, len(self.words)):
                    self.skips.setdefault(s, []).append(len(self.words))
            else:
                read = part.encode().translate(_WORD).split()
                self.words += read
                self.mandatory += [not opened] * len(read)
        self.needed = sum(self.mandatory)
        self.begin = self.mandatory.index(True)  # what is optional before the first mandatory word needs no reading
        #: The first mandatory word, and the next if it must follow at once.
        self.pivot = tuple(w for w, m in zip(self.words[self.begin : self.begin + 2], self.mandatory[self.begin :]) if m)  # noqa: B905

    def _closed(self, states: dict[int, int]) -> dict[int, int]:
        queue = list(states)
        while queue:
            s = queue.pop()
            for to in self.skips.get(s, ()):
                if states.get(to, -1) < states[s]:
                    states[to] = states[s]
                    queue.append(to)
        return states

    def run(self, words: list[bytes], at: int) -> tuple[bool, int]:
        """Whether the wording from words[at] on is accepted, and how many mandatory words were met."""
        states, best = self._closed({self.begin: 0}), 0
        for i in range(at, len(words) + 1):
            if len(self.words) in states:
                return True, self.needed
            if i == len(words):
                break
            after: dict[int, int] = {}
            for s, met in states.items():
                if s < len(self.words) and self.words[s] in (None, words[i]):
                    met += self.mandatory[s]
                    after[s + 1] = max(after.get(s + 1, 0), met)
                    best = max(best, met)
            if not after:
                break
            states = self._closed(after)
        return False, best


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    found, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == phrase:
                found.append(at)
    except ValueError:
        return found


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    score: 1 if a template accepts, else the largest share of a template's mandatory words met in a run
    from its first on, if two words or more; a base phrase gives 0.5 at least."""
    wanted = [(k.split(), label) for k, label in phrases.items()]

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        automata = [(label, Automaton(t)) for label, t in templates]
        pivots = {a.pivot for _, a in automata}
        listed = [([w.encode() for w in ws], label) for ws, label in wanted]
        out: list[tuple] = []
        for value in batch.column(1).cast(pa.large_binary()):
            words = (value.as_py() or b"").translate(_WORD).split()
            known = set(words)
            places, base, labels, score = [], set(), set(), 0.0
            for phrase, label in listed:
                if known.issuperset(phrase) and (found := _places(words, phrase)):
                    places += found
                    base.add(label)
                    score = 0.5
            starts = {pivot: _places(words, list(pivot)) if known.issuperset(pivot) else [] for pivot in pivots}
            for label, a in automata:
                for at in starts[a.pivot]:
                    accepted, met = a.run(words, at)
                    if met > 1:
                        score = max(score, met / a.needed if not accepted else 1.0)
                    if accepted:
                        labels.add(label)
                        break
            out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), each, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
