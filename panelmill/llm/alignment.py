"""Two tokenizers over the same texts: which tokens cover the same bytes.

Tokenizer A is a byte-level BPE file of the `tokenizers` library, B a BPE model of `sentencepiece` with byte fallback; A
reads a space before the text, as B puts one there itself. Every token is an interval of bytes. Interval coalescing: the
tokens of both are sorted together by start, the running maximum of their ends is taken, and a group ends where a start
reaches that maximum. Inside a group, each A token meets the B tokens its interval overlaps; a link is a pair of them that
ends at the same byte.

All of it runs on many units at once. A unit is a stretch of a text that both tokenizers encode on its own: a run of
spaces and line feeds with the letters up to the next stop or blank, where A's pattern always parts and no piece of B
reaches across (`Aligner` checks B's pieces). Every process keeps a bounded table of units it has met, so most of a text is
looked up. A text with other controls or blanks, the space sign of B, or a very long unit is one unit of its own.

Counts of linked id pairs are kept per task and added up in one shuffle. The bytes of a linked pair end together, so one
token is a suffix of the other: there are at most as many pairs as the two vocabularies have bytes, whatever the corpus,
and the table of counts goes to every task in a second pass over the texts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, text_of
from .words import Block

# Fixed value: the pattern by which a byte-level tokenizer parts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_UNITS, LONGEST_UNIT, TOKENS_AT_ONCE = 400_000, 200, 1 << 20
# Blanks and controls but space and line feed, where the two tokenizers part differently; and B's sign for a space.
_ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\x9f\xa0  -‏ -  　▁﻿]")
_BLANK, _WORD, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[32, 10]] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP[[ord(c) for c in ".,;:!?"]] = True
# A piece of B that would reach over a cut between units: a blank after something else, or a stop after a letter or digit.
_ACROSS = re.compile(r"[^▁]▁|[A-Za-z0-9][.,;:!?]|\n.|.\n")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Side:
    """One tokenizer: the bytes of every id, one after the other, and where each begins."""

    data: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Side:
        return cls(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64))

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.starts[ids + 1] - self.starts[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens in a row."""
        lengths = self.lengths(ids)
        ends = np.cumsum(lengths)
        return self.data[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


@dataclass
class Units:
    """What is known of some units: counts, linked pairs (a * 2**32 + b) one after the other, and the groups as text."""

    clean: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    texts: list[bytes]


def coalesce(a_ends: np.ndarray, a_lengths: np.ndarray, b_ends: np.ndarray, b_lengths: np.ndarray):
    """The group number of every A and every B token, and the overlapping pairs as positions in A and B.

    Both are in order of bytes and each covers its bytes without gaps.
    """
    n, starts = len(a_ends), np.concatenate([a_ends - a_lengths, b_ends - b_lengths])
    order = np.lexsort((np.concatenate([a_ends, b_ends]), starts))
    reached = np.maximum.accumulate(np.concatenate([a_ends, b_ends])[order]) if len(order) else order
    group = np.zeros(len(order), np.int64)
    group[order[1:]] = np.cumsum(starts[order][1:] >= reached[:-1])
    low = np.searchsorted(b_ends, starts[:n], side="right")
    many = np.searchsorted(starts[n:], a_ends, side="left") - low
    ends = np.cumsum(many)
    left = np.repeat(np.arange(n), many)
    right = np.arange(ends[-1] if n else 0) + np.repeat(low - ends + many, many)
    return group[:n], group[n:], left, right


class Aligner:
    """Aligns blocks of texts; one instance per process and pair of tokenizers, see `of`."""

    _made: dict[tuple[str, str], Aligner] = {}

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._made:
            cls._made[path_a, path_b] = cls(path_a, path_b)
        return cls._made[path_a, path_b]

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        from .tokens import _byte_letters

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        if not isinstance(self._a.pre_tokenizer, ByteLevel) or self._a.normalizer is not None:
            raise ValueError(f"{path_a} is not a plain byte-level tokenizer")
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of_letter = {letter: b for b, letter in enumerate(_byte_letters())}
        ids = self._a.get_vocab(with_added_tokens=True)
        names = [""] * (max(ids.values()) + 1)
        for name, i in ids.items():
            names[i] = name
        self._side_a = Side.of([bytes([of_letter[c] for c in n]) if all(c in of_letter for c in n) else n.encode() for n in names])
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        is_byte = [self._b.is_byte(i) for i in range(len(pieces))]
        self._side_b = Side.of([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, is_byte)])
        regular = {bytes([of_letter[c] for c in n]): i for n, i in self._a.get_vocab(with_added_tokens=False).items() if all(c in of_letter for c in n)}
        self._ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=regular, special_tokens={})
        self._feed = regular[b"\n"]
        self._digits = Side.of([b"%d," % i for i in range(max(len(names), len(pieces)))])
        self._cuts = not any(_ACROSS.search(p) for p in pieces)
        self.generation = 0
        self.forget()

    @property
    def most_pairs(self) -> int:
        """No corpus has more different linked pairs: one token is a suffix of the other."""
        return len(self._side_a.data) + len(self._side_b.data)

    def forget(self) -> None:
        self.generation += 1
        self._hashes, self._slot_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        none = np.zeros(0, np.int64)
        self.known = Units(np.zeros(0, bool), none, none, none, none, none, [])

    def align(self, units: list[str], texts: bool = True, plain: bool = False) -> Units:
        """The alignment of every unit on its own. A unit whose joined tokens are not its bytes is not clean and has nothing.

        `plain` units have no line feed and no blank but one in front.
        """
        flat_a, counts_a = self._encode_plain(units) if plain else _flat([e.ids for e in self._a.encode_batch_fast(units, add_special_tokens=False)])
        flat_b, counts_b = _flat(self._encode_b(units))
        raw = [u.encode() for u in units]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        clean = sizes > 0
        for side, flat, counts in ((self._side_a, flat_a, counts_a), (self._side_b, flat_b, counts_b)):
            until = np.concatenate([[0], np.cumsum(side.lengths(flat))])[np.concatenate([[0], np.cumsum(counts)])]
            spelled = side.joined(flat).tobytes()
            clean &= np.diff(until) == sizes
            if spelled != b"".join(raw):
                clean &= [spelled[until[i]:until[i + 1]] == raw[i] for i in range(len(raw))]
        if not clean.all():
            flat_a, flat_b = flat_a[np.repeat(clean, counts_a)], flat_b[np.repeat(clean, counts_b)]
            counts_a, counts_b = counts_a * clean, counts_b * clean
        size_a, size_b = self._side_a.lengths(flat_a), self._side_b.lengths(flat_b)
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        group_a, group_b, left, right = coalesce(ends_a, size_a, ends_b, size_b)
        together = ends_a[left] == ends_b[right]
        left, right = left[together], right[together]
        unit_of = np.repeat(np.arange(len(units)), counts_a)
        first = np.ones(len(group_a), bool)
        first[1:] = group_a[1:] != group_a[:-1]
        count = lambda rows: np.bincount(rows, minlength=len(units))
        return Units(clean, counts_a, counts_b, count(unit_of[first]), count(unit_of[left]), (flat_a[left] << 32) + flat_b[right],
                     self._spell(flat_a, group_a, flat_b, group_b, counts_a + counts_b) if texts else [])

    def _encode_plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids by its own merges as ranks, all units in one text: a line feed between two units is a token of its own."""
        ids = self._ranks.encode_to_numpy("\n".join(units)).astype(np.int64)
        feeds = np.flatnonzero(ids == self._feed)
        return np.delete(ids, feeds), np.diff(np.concatenate([[-1], feeds, [len(ids)]])) - 1

    def _spell(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        """Per unit its groups as `a,a|b;a|b,b`; `tokens` is how many of both kinds each unit has."""
        key = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(key, kind="stable")
        key, flat = key[order], self._digits.joined(np.concatenate([a, b])[order])
        ends = np.cumsum(self._digits.lengths(np.concatenate([a, b])[order]))
        # Every number has a place for one sign after it; the last one's of a unit is left out.
        same, inside = key[1:] == key[:-1], key[1:] >> 1 == key[:-1] >> 1
        flat[ends[:-1] - 1] = np.where(same, ord(","), np.where(inside, ord("|"), ord(";")))
        raw, until = flat.tobytes(), np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(tokens)])].tolist()
        return [raw[i:j - 1] if j > i else b"" for i, j in zip(until, until[1:])]

    def _encode_b(self, units: list[str]) -> list[list[int]]:
        """B puts a space before what it reads: that of the unit, or else one before a line feed, both then dropped again."""
        spaced = [len(u) > 1 and u[0] == " " for u in units]
        found = self._b.encode([u[1:] if s else "\n" + u for u, s in zip(units, spaced)], num_threads=1)
        return [ids if s else ids[2:] for ids, s in zip(found, spaced)]

    def _cut(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Where the units of a block of texts, each with a space before it, begin and end."""
        data = block.data
        blank, begins = _BLANK[data], np.zeros(len(data), bool)
        begins[1:] = blank[1:] & ~blank[:-1] | _WORD[data[:-1]] & _STOP[data[1:]]
        alone = ~blank[2:] & (data[1:-1] == 10) & ~blank[:-2]  # what follows a single line feed
        begins[2:] |= alone
        begins[block.offsets[:-1]] = True
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], len(data))

    def slots(self, block: Block, starts: np.ndarray, ends: np.ndarray, texts: bool) -> np.ndarray:
        """The place of every unit in the table, which learns the new ones."""
        hashes, first, back = np.unique(block.stretch_hashes(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self._hashes, hashes)
        there = at < len(self._hashes)
        there[there] = self._hashes[at[there]] == hashes[there]
        new = np.flatnonzero(~there)
        if len(new):
            raw = block.data.tobytes()
            units = [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            plain = np.array([u[0] != "\n" and u[u[0] == " ":][:1] not in ("", " ", "\n") for u in units], bool)
            order = np.argsort(~plain, kind="stable")
            n, units, new = int(plain.sum()), [units[i] for i in order.tolist()], new[order]
            known, size = self.known, len(self.known.n_a)
            found = [known, *[self.align(part, texts, p) for part, p in ((units[:n], True), (units[n:], False)) if part]]
            self.known = Units(*[np.concatenate([getattr(u, f) for u in found]) for f in ("clean", "n_a", "n_b", "n_groups", "n_links", "links")],
                               list(chain.from_iterable(u.texts for u in found)))
            back_in_order = np.argsort(order)
            placed = (size + np.arange(len(new)))[back_in_order]
            new = new[back_in_order]
            self._slot_of = np.insert(self._slot_of, at[new], placed)
            self._hashes = np.insert(self._hashes, at[new], hashes[new])
            at = np.searchsorted(self._hashes, hashes)
        return self._slot_of[at][back]

    def parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array | None, list[str] | None]]:
        """Rows of a block in two kinds: texts to be cut into units, and texts that are one unit each, a few at a time."""
        values = texts.to_pylist()
        whole = np.array([not self._cuts or bool(_ODD.search(t)) for t in values], bool)
        filled = np.array([len(t) > 0 for t in values], bool)
        cut = np.flatnonzero(filled & ~whole)
        if len(cut):
            yield cut, pa.array([" " + values[i] for i in cut.tolist()], pa.large_string()), None
        some, size = [], 0
        for i in np.flatnonzero(filled & whole).tolist():
            some.append(i)
            size += len(values[i])
            if size > TOKENS_AT_ONCE:
                yield np.array(some), None, [" " + values[j] for j in some]
                some, size = [], 0
        if some:
            yield np.array(some), None, [" " + values[j] for j in some]

    def rows(self, texts: pa.Array, spelled: bool = True) -> Iterator[tuple[np.ndarray, Units, np.ndarray, np.ndarray]]:
        """Parts of a block: row numbers, a table of units, the units of all rows, and where those of each row begin.

        Take each part before the next: the table may forget its units then.
        """
        for which, cut, whole in self.parts(texts):
            if cut is not None:
                if len(self._hashes) > KNOWN_UNITS:
                    self.forget()
                block = Block(cut)
                starts, ends = self._cut(block)
                first = np.searchsorted(starts, block.offsets)
                long = np.unique(np.searchsorted(first, np.flatnonzero(ends - starts > LONGEST_UNIT), side="right") - 1)
                if len(long):
                    values = cut.to_pylist()
                    whole = [values[i] for i in long.tolist()]
                    keep = np.setdiff1d(np.arange(len(which)), long)
                    if len(keep):
                        block = Block(pa.array([values[i] for i in keep.tolist()], pa.large_string()))
                        starts, ends = self._cut(block)
                        yield which[keep], *self._known(block, starts, ends, spelled)
                    which = which[long]
                else:
                    yield which, *self._known(block, starts, ends, spelled)
            if whole is not None:
                yield which, self.align(whole, spelled), np.arange(len(whole)), np.arange(len(whole) + 1)

    def _known(self, block: Block, starts: np.ndarray, ends: np.ndarray, spelled: bool):
        slots = self.slots(block, starts, ends, spelled)
        return self.known, slots, np.searchsorted(starts, block.offsets)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after the other, and how long each is."""
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum())), counts


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text_column: str = "text") -> DataFrame:
    """`a, b, n`: how many links of all texts hold each pair of ids. A task sends every pair it met at most a few times."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, pairs, seen = Aligner.of(path_a, path_b), {}, np.zeros(0, np.int64)
        aligner.forget()

        def add(units: Units, times: np.ndarray) -> None:
            codes, back = np.unique(units.links, return_inverse=True)
            sums = np.bincount(back, weights=np.repeat(times, units.n_links), minlength=len(codes)).astype(np.int64)
            for code, n in zip(codes.tolist(), sums.tolist()):
                if n:
                    pairs[code] = pairs.get(code, 0) + n

        table, generation = aligner.known, aligner.generation
        for batch in blocks(batches):
            for _, units, slots, first in aligner.rows(batch.column("text"), spelled=False):
                dirty = np.add.reduceat(~units.clean[slots], first[:-1]) > 0
                times = np.bincount(slots, weights=np.repeat(~dirty, np.diff(first)), minlength=len(units.n_a)).astype(np.int64)
                if units is not aligner.known:
                    add(units, times)
                    continue
                if aligner.generation != generation:  # what was counted is of units forgotten since
                    add(table, seen)
                    seen, generation = np.zeros(0, np.int64), aligner.generation
                times[:len(seen)] += seen
                seen, table = times, units
        add(table, seen)
        codes = np.fromiter(pairs.keys(), np.int64, len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(codes >> 32), pa.array(codes & 0xFFFFFFFF),
                                          pa.array(np.fromiter(pairs.values(), np.int64, len(pairs)))], ["a", "b", "n"])

    found = docs.select(text_of(text_column).alias("text")).mapInArrow(counted, "a long, b long, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text",
                    groups: bool = False) -> DataFrame:
    """One row per input row: `doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`, and `groups` if asked for.

    `groups` is the alignment itself as text, `a,a|b;a|b,b`; `count_sum` adds up over the links of a text how often the
    corpus links their pair, `n_best` counts the links whose pair no other pair of the same B id exceeds. A text that is
    null or empty, or that the tokens of A or B do not spell byte by byte after its space, has zeros and empty texts and adds
    to no count. Rows that repeat count each time; ids may be null or repeat; other columns are not looked at. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    # At most `Aligner.most_pairs` rows, a figure of the vocabularies: about half a million, nine MB.
    table = pair_counts(docs, path_a, path_b, text_column).toArrow()
    a, b, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    most = np.zeros(int(b.max()) + 1 if len(b) else 1, np.int64)
    np.maximum.at(most, b, n)
    order = np.argsort((a << 32) + b)
    shared = spark.sparkContext.broadcast((((a << 32) + b)[order], n[order], (n == most[b])[order]))
    names = [f.split()[0] for f in RESULT.split(", ")]

    def aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, (codes, counts, best) = Aligner.of(path_a, path_b), shared.value
        aligner.forget()
        worth, size, generation = np.zeros((2, 0), np.int64), 0, aligner.generation

        def weigh(units: Units, done: int) -> np.ndarray:
            """Per unit from number `done` on: the sum of its links' counts, and how many of them are best."""
            links = units.links[int(units.n_links[:done].sum()):]
            at = np.minimum(np.searchsorted(codes, links), max(len(codes) - 1, 0))
            # A unit that only texts with nothing have may hold a pair without a count.
            there = codes[at] == links if len(codes) else np.zeros(len(links), bool)
            at = at if len(codes) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(units.n_links[done:])])
            values = [there * counts[at], there & best[at]] if len(codes) else [np.zeros(len(links)), np.zeros(len(links))]
            return np.stack([np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[ends]) for v in values])

        for batch in blocks(batches):
            rows = batch.num_rows
            out, digests, spelled = np.zeros((6, rows), np.int64), [""] * rows, [""] * rows
            for which, units, slots, first in aligner.rows(batch.column("text")):
                if units is aligner.known:
                    if aligner.generation != generation:
                        worth, size, generation = np.zeros((2, 0), np.int64), 0, aligner.generation
                    worth, size = np.concatenate([worth, weigh(units, size)], axis=1), len(units.n_a)
                    value = worth
                else:
                    value = weigh(units, 0)
                clean = np.add.reduceat(~units.clean[slots], first[:-1]) == 0
                for k, column in enumerate((units.n_a, units.n_b, units.n_groups, units.n_links, value[1], value[0])):
                    out[k, which] = np.add.reduceat(column[slots], first[:-1]) * clean
                of = slots.tolist()
                for i, row in enumerate(which.tolist()):
                    if clean[i]:
                        text = b";".join([units.texts[s] for s in of[first[i]:first[i + 1]]])
                        digests[row] = hashlib.sha256(text).hexdigest()
                        if groups:
                            spelled[row] = text.decode()
            arrays = [batch.column("doc_id"), *[pa.array(c) for c in out], pa.array(digests, pa.string())]
            more = [pa.array(spelled, pa.string())] if groups else []
            yield pa.RecordBatch.from_arrays([*arrays, *more], [*names, *(["groups"] if groups else [])])

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(aligned, RESULT + (", groups string" if groups else ""))
