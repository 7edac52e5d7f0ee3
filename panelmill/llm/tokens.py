"""Token ids of whole texts by a tokenizer file of the `tokenizers` library, word by word.

The tokenizer drops white space and never joins what white space parts, so the ids of a text are those of its words,
one after the other. Every process keeps a bounded table of the words it has met; a word that is new to it, and is
made of printable ASCII and the letters of Latin-1, is split by the tokenizer's own pattern and each piece goes to
the tokenizer's BPE model. Any other word goes through the whole tokenizer. Both give the same ids; the first way
costs about a quarter.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .words import Block

KNOWN_WORDS, KNOWN_PIECES = 600_000, 100_000
# Half of what other operators take: with the table of words beside it, a block sets what a packing task needs.
BLOCK = 1 << 19
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# The pattern of the tokenizer file, for the characters of _PLAIN in lower case.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next above 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b], more = chr(more), more + 1
    return [letters[b] for b in range(256)]


def _block(texts: pa.Array) -> Block:
    """Words in lower case, which the tokenizer makes them anyway, without the stops after them, which it always parts.

    Only the strings of special tokens tell cases apart; where one might stand, cases count for the whole block.
    """
    block = Block(texts, lower=True, cut=True)
    begins = block.data[:-1] == ord("<")
    return Block(texts, cut=True) if (begins & (block.data[1:] == ord("|"))).any() else block


class WordTokens:
    """Encodes blocks of texts; one instance per process and tokenizer file, see `of`."""

    _made: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        self._letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)  # of the known words, in order, and the slot of each
        self._slot_of = np.zeros(0, np.int64)
        self._pieces: dict[str, bytes] = {}
        self._flat, self._lengths, self._starts = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._used = 0

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            if len(self._pieces) >= KNOWN_PIECES:
                self._pieces.clear()
            tokens = self._model.tokenize("".join([self._letters[b] for b in piece.encode()]))
            ids = self._pieces[piece] = array("i", [t.id for t in tokens]).tobytes()
        return ids

    def word(self, word: str) -> np.ndarray:
        if "<|" in word or not _PLAIN.fullmatch(word):
            return np.array(self._whole.encode(word, add_special_tokens=False).ids, np.int32)
        return np.frombuffer(b"".join([self._piece(p) for p in _PIECES.findall(word.lower())]), np.int32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add new words; `hashes` are in order."""
        first, known = len(self._hashes), [self.word(w) for w in words]
        lengths = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.concatenate(known) if known else np.zeros(0, np.int32)
        starts = self._used + np.cumsum(lengths) - lengths
        self._starts = np.concatenate([self._starts[:first], starts])
        self._lengths = np.concatenate([self._lengths[:first], lengths])
        while self._used + len(flat) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._used:self._used + len(flat)] = flat
        self._used += len(flat)
        at = np.searchsorted(self._hashes, hashes)
        self._slot_of = np.insert(self._slot_of, at, first + np.arange(len(hashes)))
        self._hashes = np.insert(self._hashes, at, hashes)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._hashes, hashes)
        there = at < len(self._hashes)
        there[there] = self._hashes[at[there]] == hashes[there]
        return at, there

    def _slots(self, block: Block) -> np.ndarray:
        """The slot of every word of a block."""
        hashes, first, back = np.unique(block.word_hashes(), return_index=True, return_inverse=True)
        if len(self._hashes) > KNOWN_WORDS:
            self._forget()
        new = np.flatnonzero(~self._find(hashes)[1])
        if len(new):
            raw = block.data.tobytes()
            places = zip(block.starts[first[new]].tolist(), block.ends[first[new]].tolist())
            self._learn(hashes[new], [raw[a:b].decode() for a, b in places])
        return self._slot_of[self._find(hashes)[0]][back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and where those of each text begin (one more at the end)."""
        block = _block(texts)
        if not len(block.starts):
            return np.zeros(0, np.int32), np.zeros(block.texts + 1, np.int64)
        slots = self._slots(block)
        lengths = self._lengths[slots]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = self._flat[np.repeat(self._starts[slots] - ends[:-1], lengths) + np.arange(ends[-1])]
        return flat, ends[block.first]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text of a block has."""
        block = _block(texts)
        if not len(block.starts):
            return np.zeros(block.texts, np.int64)
        slots = self._slots(block)
        ends = np.concatenate([[0], np.cumsum(self._lengths[slots])])
        return np.diff(ends[block.first])
