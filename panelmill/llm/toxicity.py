"""Toxicity by compression distance: windows of a text are compressed with two zstandard dictionaries.

**Dictionaries.** One is made from toxic, one from ordinary text of a bounded sample of labelled rows. From either text
only the strings go in that mark its class: runs of character 5-grams that far more of its documents hold than of the
other's. What both have in common would only shift both lengths alike, and its noise would hide a rare word.

**Score.** Every text is cut into windows of some words, and each window is compressed with both dictionaries. What the
toxic one saves over the other is the window's gain; a few figures of a document's gains go through a logistic curve
that was fitted to sample rows kept apart from those the dictionaries are made of. A text without words has no gains
and gets what the curve gives for none.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import blocks, text_of
from .words import Block

# The bounded sample: rows per class, and the longest text that is taken into it.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 1500, 3000, 20_000
GRAM, RATIO, MOST_BYTES = 5, 8.0, 4096
WORDS = 40
# A window has at most so many bytes, or the dictionaries, which lie before it, would be out of the compressors' reach: longer ones
# (words without spaces between them) are cut into pieces that share as many bytes as the longest dictionary string has.
WINDOW_BYTES, SHARED_BYTES = 1024, 64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and the logistic curve: weights of the standardised figures and a constant."""

    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float


FIGURES = 6


class Compressors:
    """Gains of windows; one pair of compressors per task."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as zstd

        self._zstd = zstd
        settings = zstd.ZstdCompressionParameters(
            window_log=12, hash_log=12, chain_log=12, search_log=4, min_match=GRAM, target_length=32,
            strategy=zstd.STRATEGY_BTOPT, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False,
            write_checksum=False, write_dict_id=False)
        self._pair = []
        for content in (ordinary, toxic):
            # A dictionary needs a few bytes; a string of blanks saves nothing on either side.
            book = zstd.ZstdCompressionDict(content if len(content) >= 8 else b" " * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(compression_params=settings)
            self._pair.append(zstd.ZstdCompressor(dict_data=book, compression_params=settings))

    def gains(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        places = np.stack([starts, ends - starts], axis=1).astype("<u8").tobytes()
        lengths = []
        for compressor in self._pair:
            done = compressor.multi_compress_to_buffer(self._zstd.BufferWithSegments(data, places), threads=1)
            lengths.append(np.array([len(done[i]) for i in range(len(done))]))
        return lengths[0] - lengths[1]


def _figures(texts: pa.Array, compressors: Compressors) -> np.ndarray:
    """`FIGURES` numbers per text: greatest gain, sum of the three greatest, shares and number of windows that gain."""
    block = Block(texts)
    first = block.first
    heads = np.concatenate([np.arange(a, b, WORDS) for a, b in zip(first[:-1], first[1:])]) if block.texts else np.zeros(0, int)
    heads = heads.astype(np.int64)
    owner = np.searchsorted(first, heads, side="right") - 1
    tails = np.minimum(heads + WORDS, first[owner + 1]) - 1
    folded = _FOLD[block.data]
    starts = block.starts[heads]
    starts = starts - ((starts > 0) & (folded[starts - 1] == 32)) if len(starts) else starts
    starts, ends, parent = cut_windows(starts, block.ends[tails])
    owner = owner[parent]
    gains = compressors.gains(folded.tobytes(), starts, ends)
    out = np.zeros((block.texts, FIGURES))
    edges = np.searchsorted(owner, np.arange(block.texts + 1))
    for t in range(block.texts):
        own = np.sort(gains[edges[t]:edges[t + 1]])[::-1]
        if len(own):
            clipped = np.clip(own, -4, 8)
            out[t] = (min(own[0], 12), min(own[:3].sum(), 30), (own >= 2).mean(), math.log1p((own >= 2).sum()),
                      clipped.mean(), np.exp(0.7 * clipped).mean() / 10)
    return out


def cut_windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of at most WINDOW_BYTES, and which of the given ones each is a piece of."""
    step = WINDOW_BYTES - SHARED_BYTES
    many = np.maximum(-(-(ends - starts - SHARED_BYTES) // step), 1)
    parent = np.repeat(np.arange(len(starts)), many)
    first = starts[parent] + (np.arange(len(parent)) - (np.cumsum(many) - many)[parent]) * step
    return first, np.minimum(first + WINDOW_BYTES, ends[parent]), parent


def _grams(text: str) -> set[bytes]:
    return {w[i:i + GRAM] for w in {b" " + w for w in _words(text)} for i in range(len(w) - GRAM + 1)}


def _words(text: str) -> list[bytes]:
    return _FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes().split()


def _book(texts: list[str], others: list[str], counts: Counter, other_counts: Counter) -> bytes:
    """The strings that mark a class, the most frequent last: runs of grams that RATIO times more of its texts hold."""
    least = max(3, 0.004 * len(texts))
    marks = {g for g, n in counts.items()
             if n >= least and n * len(others) >= RATIO * (other_counts[g] + 1) * len(texts)}
    runs: Counter = Counter()
    for text in texts:
        for word in _words(text):
            word, at = b" " + word, None
            for i in range(len(word) - GRAM + 2):
                hit = word[i:i + GRAM] in marks if i <= len(word) - GRAM else False
                if hit and at is None:
                    at = i
                elif not hit and at is not None:
                    runs[word[at:i + GRAM - 1][:SHARED_BYTES]] += 1
                    at = None
    book = b""
    for run, _ in sorted(runs.items(), key=lambda x: (-x[1], x[0])):
        if len(book) + len(run) > MOST_BYTES:
            break
        if run not in book:
            book = run + book
    return book


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, with a small ridge on the weights."""
    full = np.column_stack([x, np.ones(len(x))])
    w, held = np.zeros(full.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (p - y) + held * w
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(held), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_texts(toxic: list[str], ordinary: list[str]) -> Model:
    """A model from two lists of texts; the first two thirds of either make the dictionaries, the rest the curve."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    a, b = -(-2 * len(toxic) // 3), -(-2 * len(ordinary) // 3)
    counts = [Counter(g for text in texts for g in _grams(text)) for texts in (toxic[:a], ordinary[:b])]
    books = (_book(toxic[:a], ordinary[:b], *counts), _book(ordinary[:b], toxic[:a], *reversed(counts)))
    x = _figures(pa.array(toxic[a:] + ordinary[b:], pa.string()), Compressors(*books))
    y = np.array([1.0] * len(toxic[a:]) + [0.0] * len(ordinary[b:]))
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(FIGURES), np.ones(FIGURES))
    if len(set(y)) < 2:  # too little to fit a curve: the share of toxic rows, whatever the text
        share = (len(toxic) + 1) / (len(toxic) + len(ordinary) + 2)
        return Model(*books, tuple(mean), tuple(spread), (0.0,) * FIGURES, math.log(share / (1 - share)))
    weights, constant = _fit_curve((x - mean) / spread, y)
    return Model(*books, *(tuple(map(float, v)) for v in (mean, spread, weights)), constant)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "toxic") -> Model:
    """A model from labelled rows: the first of each class in the order of a hash of the id, up to the bounded sample.

    `usable` says of `labels` which rows may be learnt from. Rows whose label is neither 0 nor 1 are not used; an id with several
    labels is toxic if any says so. At most SAMPLE_TOXIC + SAMPLE_ORDINARY texts of at most SAMPLE_CHARS characters
    reach the driver.
    """
    key = F.col(f"`{id_column}`").alias("doc_id")
    marked = labels.where(usable) if usable is not None else labels
    marked = marked.select(key, F.col(f"`{label_column}`").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(key, text_of(text_column).alias("text"))
    short = texts.where(F.length("text") <= SAMPLE_CHARS).select("doc_id").distinct()
    marked = marked.join(short, "doc_id", "left_semi")
    chosen = None
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        own = marked.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = own if chosen is None else chosen.union(own)
    rows = texts.join(F.broadcast(chosen), "doc_id").where(F.length("text") <= SAMPLE_CHARS).select("label", "text", "doc_id").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["text"]))
    return fit_texts([r["text"] for r in rows if r["label"]], [r["text"] for r in rows if not r["label"]])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: `doc_id, score` from 0 to 1, higher where the text is likelier toxic.

    Only the text is looked at, as a whole; null counts as empty. Repeated rows get the same score each.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_of(text_column).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(model.toxic, model.ordinary)
        mean, spread, weights = (np.array(v) for v in (model.mean, model.spread, model.weights))
        for batch in blocks(batches):
            x = (_figures(batch.column("text"), compressors) - mean) / spread
            scores = 1 / (1 + np.exp(-np.clip(x @ weights + model.constant, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")
