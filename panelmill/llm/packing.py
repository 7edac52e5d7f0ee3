"""Packing of tokenised documents into windows of a fixed length, best fit decreasing.

Each task takes its documents in portions of bounded size. Documents longer than a window are first cut into full
windows. What is left over, and every shorter document, goes by falling length into the open window it fits most
tightly, found by a segment tree over remaining capacities. The few windows that are then still open lend each other
tokens: pieces of the emptiest are moved, and cut where needed, into the gaps of the fullest, so that a portion leaves
one open window at most. It joins the next portion; the last one of every task joins those of 31 other tasks in a
round of the same packing, and so on up a tree. Only lengths and places travel there, never more than one window a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import blocks, settle, text_of
from .tokens import BLOCK, WordTokens

WINDOW = 4096
# A window with at most this many free places counts as full.
SLACK = 16
PORTION = 2 << 20
BRANCHES = 32


class OpenWindows:
    """Open windows in a segment tree over their remaining capacity; a node counts the windows below it."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._at: dict[int, list[int]] = {}

    def _change(self, capacity: int, by: int) -> None:
        node = self._leaves + capacity
        while node:
            self._count[node] += by
            node >>= 1

    def add(self, capacity: int, window: int) -> None:
        if capacity:
            self._at.setdefault(capacity, []).append(window)
            self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the window with the least capacity from `need` on, and that capacity."""
        node = self._leaves + need
        if not self._count[node]:
            while node > 1 and (node & 1 or not self._count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node + (not self._count[2 * node])
        capacity = node - self._leaves
        self._change(capacity, -1)
        return self._at[capacity].pop(), capacity


def best_fit(items: list[tuple], size: int = WINDOW, slack: int = SLACK) -> tuple[list[list[tuple]], list[tuple]]:
    """Pack `(what, start, length)` with lengths from 1 to `size`: the closed windows, and the pieces of the open one.

    Pieces keep their order in a window. All windows but the open one have at most `slack` free places; ties of length
    keep the order of the items, so the result is repeatable.
    """
    windows: list[list[tuple]] = []
    free: list[int] = []
    tree = OpenWindows(size)
    for item in sorted(items, key=lambda x: -x[2]):
        found = tree.take(item[2])
        if found is None:
            windows.append([])
            free.append(size)
            found = len(windows) - 1, size
        windows[found[0]].append(item)
        free[found[0]] = found[1] - item[2]
        tree.add(free[found[0]], found[0])
    short = sorted((w for w in range(len(windows)) if free[w] > slack), key=lambda w: free[w])
    closed = [windows[w] for w in range(len(windows)) if free[w] <= slack]
    low, high = 0, len(short) - 1
    while low < high:
        giver, taker = windows[short[high]], windows[short[low]]
        what, start, length = giver.pop()
        gap = free[short[low]]
        moved = min(gap, length)
        if moved < length:
            giver.append((what, start, length - moved))
        taker.append((what, start + length - moved, moved))
        free[short[low]] -= moved
        if not giver:
            high -= 1
        if free[short[low]] <= slack and low < high:
            closed.append(taker)
            low += 1
        elif free[short[low]] <= slack:
            closed.append(taker)
            return closed, []
    return closed, windows[short[low]] if short else []


def _packed(path: str, size: int, end_id: int, slack: int, portion: int):
    """Task code: `part, window, offset, open, doc_id, start, doc_tokens, ids` of every piece."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, made = WordTokens.of(path), TaskContext.get().partitionId(), 0
        ids: dict[int, np.ndarray] = {}
        names: dict[int, object] = {}
        items: list[tuple] = []
        held, seen = 0, 0

        def emit(windows: list[list[tuple]], opened: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for at in range(0, len(windows), 256):
                rows = []
                for window in windows[at:at + 256]:
                    offset = 0
                    for what, start, length in window:
                        rows.append((made, offset, what, start, ids[what][start:start + length]))
                        offset += length
                    made += 1
                ends = np.cumsum([0, *[len(r[4]) for r in rows]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()), pa.array([opened] * len(rows)),
                    pa.array([names[r[2]] for r in rows], kind), pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([len(ids[r[2]]) for r in rows], pa.int64()),
                    pa.ListArray.from_arrays(ends, np.concatenate([r[4] for r in rows]).astype(np.int32))],
                    ["part", "window", "offset", "open", "doc_id", "start", "doc_tokens", "ids"])

        kind = None
        for batch in blocks(batches, "_text", BLOCK):
            kind = batch.column("doc_id").type
            flat, first = encoder.encode(batch.column("_text"))
            for name, lo, hi in zip(batch.column("doc_id").to_pylist(), first[:-1], first[1:]):
                own = np.append(flat[lo:hi], np.int32(end_id))
                ids[seen], names[seen] = own, name
                whole = len(own) // size * size
                yield from emit([[(seen, at, size)] for at in range(0, whole, size)], False)
                if len(own) > whole:
                    items.append((seen, whole, len(own) - whole))
                    held += len(own) - whole
                else:
                    del ids[seen], names[seen]
                seen += 1
            if held >= portion:
                closed, items = best_fit(items, size, slack)
                yield from emit(closed, False)
                held = sum(x[2] for x in items)
                ids, names = {x[0]: ids[x[0]] for x in items}, {x[0]: names[x[0]] for x in items}
        closed, items = best_fit(items, size, slack)
        yield from emit(closed, False)
        if items:
            yield from emit([items], True)
    return run


def pack(docs: DataFrame, tokenizer: str, size: int = WINDOW, end_id: int = 2, id_column: str = "doc_id",
         text_column: str = "text", slack: int = SLACK, portion: int = PORTION) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids, doc_tokens, sequence_id, offset`.

    A document is the ids of its whole text by the tokenizer file, without special tokens, then `end_id`; a null or
    empty text is the end id alone. Every id lies in exactly one piece. `offset` is the place in the sequence, without
    gaps from 0; no sequence is longer than `size`. At most `slack` places of a sequence stay free, but for one
    sequence in all. Rows that repeat an id are documents of their own, each packed whole. An empty table gives no
    pieces. Other columns are not looked at. Memory of a task follows `portion`, in tokens, and its longest text.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_of(text_column).alias("_text"))
    pieces = settle(rows.mapInArrow(
        _packed(tokenizer, size, end_id, slack, portion),
        f"part int, window long, offset long, open boolean, doc_id {kind}, start long, doc_tokens long, ids array<int>"), "pieces")
    shown = ["doc_id", "start", F.size("ids").cast("long").alias("length"), "ids", "doc_tokens"]
    done = pieces.where("NOT open").select(*shown, _sequence(0, "part", "window"), "offset")
    rest = pieces.where("open")
    places = _tree(rest.select("part", "offset", F.size("ids").cast("long").alias("length")), size, slack)
    later = rest.withColumnRenamed("offset", "_from").join(places.withColumnRenamed("offset", "_to"), ["part", "_from"])
    later = later.select("doc_id", (F.col("start") + F.col("cut")).alias("start"), F.col("length"),
                         F.slice("ids", (F.col("cut") + 1).cast("int"), F.col("length").cast("int")).alias("ids"), "doc_tokens",
                         "sequence_id", F.col("_to").alias("offset"))
    return done.unionByName(later)


def _sequence(level: int, group: str, window: str):
    return (F.lit(level << 58) + F.shiftleft(F.col(group).cast("bigint"), 26) + F.col(window)).alias("sequence_id")


def _tree(rest: DataFrame, size: int, slack: int) -> DataFrame:
    """`part, _from, cut, length, sequence_id, offset`: where the pieces of the last open window of each task end up."""
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "_from", "cut"], kind="stable").reset_index(drop=True)
        # An item is known by its row; `start` is the place within the piece as it came from its task.
        closed, left = best_fit([(i, int(c), int(n)) for i, (c, n) in enumerate(zip(group["cut"], group["length"]))], size, slack)
        rows = []
        for number, (window, opened) in enumerate([*[(w, False) for w in closed], *([(left, True)] if left else [])]):
            offset = 0
            for i, cut, length in window:
                rows.append((group["part"][i], group["_from"][i], cut, length, group["branch"][i], number, offset, opened))
                offset += length
        return pd.DataFrame(rows, columns=["part", "_from", "cut", "length", "branch", "window", "offset", "open"])

    schema = "part int, _from long, cut long, length long, branch long, window long, offset long, open boolean"
    open_pieces = rest.select("part", F.col("offset").alias("_from"), F.lit(0).cast("long").alias("cut"), "length",
                              F.col("part").cast("long").alias("branch"))
    answer, level = None, 0
    while True:
        level += 1
        up = open_pieces.withColumn("branch", F.floor(F.col("branch") / BRANCHES).cast("long"))
        packed = settle(up.groupBy("branch").applyInPandas(merge, schema), f"level{level}")
        top = (packed.agg(F.max("branch")).first()[0] or 0) == 0
        done = packed if top else packed.where("NOT open")
        done = done.select("part", "_from", "cut", "length", _sequence(level, "branch", "window"), "offset")
        answer = done if answer is None else answer.unionByName(done)
        if top:
            return answer
        open_pieces = packed.where("open").select("part", "_from", "cut", "length", "branch")
