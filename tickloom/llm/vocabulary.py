"""What the tokenizing operators share: character classes, byte letters and a bounded memory."""

from __future__ import annotations

#: Letters and numbers among the first 256 characters, as inside a character class.
LATIN_LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
LATIN_NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"


def is_latin(text: str) -> bool:
    """Whether all characters are among the first 256."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else one past 255."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(prints))}
    return [chr(others.get(b, b)) for b in range(256)]


class Kept(dict):
    """A memory of ``make`` in two generations: when the younger is full it becomes the elder, and what is
    asked for again moves back. Long keys are not kept."""

    def __init__(self, most: int):
        self.most, self.elder = most // 2, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.elder.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > 64:
                return found
        if len(self) >= self.most:
            self.elder = dict(self)
            self.clear()
        self[key] = found
        return found
