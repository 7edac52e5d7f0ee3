"""Words, lines and shingles of a block of texts as numpy arrays, without a Python step per word.

A word is a longest run of bytes other than space and the controls 9 to 13. Words, lines and shingles are known by
64-bit hashes of their bytes. The hash of a stretch is a polynomial in a random odd base modulo 2**64, taken from
running sums, so any stretch of a block costs the same; a mixing step follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import bytes_of

_BASE = np.uint64(0x9E6F3C52D1B7A4E5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[i] = table
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers in which every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """The texts of one piece of a batch. `lower` makes A-Z equal to a-z in every hash; `cut` parts a word between an
    ASCII letter or digit and a stop or comma of any kind after it."""

    def __init__(self, texts: pa.Array, lower: bool = False, cut: bool = False):
        self.data, self.offsets = bytes_of(texts)
        self.texts = len(self.offsets) - 1
        self._values = _LOWERED if lower else _VALUES
        self._sums = None
        space = _SPACE[self.data]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        begins[inner] = ~space[inner]
        ends[inner - 1] = ~space[inner - 1]
        if cut:
            parted = _ASCII_WORD[self.data[:-1]] & _STOP[self.data[1:]]
            begins[1:] |= parted
            ends[:-1] |= parted
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # words before each text; one more at the end
        self.n_words = np.diff(self.first)
        self.space = space

    def stretch_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = _power_tables(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(self._values[self.data] * up[:len(self.data)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts])

    def word_hashes(self) -> np.ndarray:
        return self.stretch_hashes(self.starts, self.ends)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.n_words)

    def windows(self, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows, in order, and where those of each text begin (one more at the end).

        With `whole`, a text of fewer than k words, but at least one, has its whole sequence as its only window.
        """
        words = self.word_hashes()
        n, counts = len(words), np.maximum(self.n_words - k + 1, 0)
        folded = np.zeros(n, np.uint64)
        for j in range(k):
            folded[:max(n - j, 0)] = folded[:max(n - j, 0)] * np.uint64(0xD6E8FEB86659FD93) + words[j:]
        text = self.text_of_words()
        keep = np.arange(n) + k <= self.first[1:][text]
        short = (self.n_words > 0) & (self.n_words < k) if whole else np.zeros(self.texts, bool)
        for t in np.flatnonzero(short):
            h = np.uint64(self.n_words[t])
            with np.errstate(over="ignore"):
                for w in words[self.first[t]:self.first[t + 1]]:
                    h = h * np.uint64(0xA24BAED4963EE407) + w
            folded[self.first[t]] = h
            keep[self.first[t]] = True
            counts[t] = 1
        return mix(folded[keep]), np.concatenate([[0], np.cumsum(counts)])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text number and whether it has a word, of every line between line feeds."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], feeds + 1]))
        text = np.searchsorted(self.offsets, starts, side="right") - 1
        # A text that ends in a line feed ends with an empty line, which begins where the next text does.
        ends = np.sort(np.concatenate([feeds, self.offsets[1:]]))
        has_word = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        return self.stretch_hashes(starts, ends), np.minimum(text, self.texts - 1), has_word

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def repeated(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its key occurs more than once in its group, and whether it did so before."""
    joint = mix(keys + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(joint, kind="stable")
    same = joint[order][1:] == joint[order][:-1]
    often, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    return often, again
