"""Texts as numbers of known words: exact, as equal numbers are equal words, and quick, as most words are unknown."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_CACHE = 200_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: str) -> str:
    """A word in lower case without what isn't a letter or digit at its ends; may be empty."""
    low = word.lower()
    if low.isalnum():
        return low
    return low[:-1] if low[-1] in ".,;:!?" and low[:-1].isalnum() else _EDGES.sub("", low)


class Lexicon(dict):
    """Raw word to number: 0 and up for known words, below -2 (by a hash) for others, -2 for words without letters and
    digits."""

    def __init__(self, texts):
        super().__init__()
        self.known: dict[str, int] = {}
        for t in texts:
            for w in t.split():
                if n := normal(w):
                    self.known.setdefault(n, len(self.known))

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        n = normal(word)
        out = self.known.get(n) if n else -2
        self[word] = out = -3 - (xxhash.xxh64_intdigest(n) >> 2) if out is None else out
        return out

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, places) of the words with letters or digits; places count all words divided by white space."""
        words = text.split()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        places = np.flatnonzero(numbers != -2)
        return numbers[places], places


class Members:
    """A fixed set of codes. A table over 16 bits of a code rules most others out before the search."""

    def __init__(self, codes):
        self.codes = np.array(sorted(codes), np.uint64)
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.codes >> np.uint64(40)) & np.uint64(0xFFFF)] = True

    def where(self, codes: np.ndarray) -> np.ndarray:
        """Places of the codes that are in the set."""
        places = np.flatnonzero(self.table[(codes >> np.uint64(40)) & np.uint64(0xFFFF)])
        if not len(places) or not len(self.codes):
            return places[:0]
        asked = codes[places]
        at = np.minimum(np.searchsorted(self.codes, asked), len(self.codes) - 1)
        return places[self.codes[at] == asked]


def runs(numbers: np.ndarray, k: int, unknown: bool = False) -> np.ndarray:
    """A 64-bit code for each run of k words; 0 where a word is unknown, unless those are asked for too."""
    n = len(numbers) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    with np.errstate(over="ignore"):
        for i in range(k):
            part = numbers[i : i + n]
            known &= part >= 0
            code = (code ^ (part + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
    code |= np.uint64(1)
    return code if unknown else np.where(known, code, np.uint64(0))
