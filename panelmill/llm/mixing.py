"""Mixing of sources to target weights by a proportionate fair schedule of blocks.

The documents of a source, in a random but repeatable order, are cut into blocks of equal row counts. In an ideal, fluid
mix every source that has rows left gets its weight's share of each moment. Block k of a source is released in the slot
where its fluid service begins and due at the end of the slot where that service ends; every slot takes the released block
that is due first. The fluid mix serves each block inside its window, so earliest deadline first keeps all of them, and at
every slot of the whole run each source has had its fluid share to less than one block, also where sources run out.

Weights are whole numbers and all times fractions of them, so nothing is rounded. The fluid time after k blocks of a source
has a closed form: every other source has had its weight's share of the same, at most all it has. The schedule is made ahead from
one number per source. Blocks have so many rows that there are about MOST_BLOCKS, or one per source if these are more; what
the tasks are given is one slot per block. Every document comes out exactly once.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

MOST_BLOCKS = 1 << 20
BLOCK_ROWS = 32
BUCKET_ROWS = 20_000


def weights_of(rows: dict, temperature: float = 0.5) -> dict:
    """Whole weights in proportion to row counts to a power."""
    return {name: max(1, round(n ** temperature * 1024)) for name, n in rows.items()}


def rows_per_block(rows: int, least: int = BLOCK_ROWS) -> int:
    """Rows of a block: `least`, or what makes about MOST_BLOCKS blocks."""
    return max(least, -(-rows // MOST_BLOCKS))


class Fluid:
    """The ideal mix of sources with numbers of blocks and weights."""

    def __init__(self, blocks: list[int], weights: list[int]):
        order = sorted(range(len(blocks)), key=lambda i: Fraction(blocks[i], weights[i]))
        self._weights = weights
        # When sources run out, on a clock that a source of weight one would keep; how much those have had, and who is left.
        self._ends = [Fraction(blocks[i], weights[i]) for i in order]
        self._gone = [0, *accumulate(blocks[i] for i in order)]
        self._left = [sum(weights) - w for w in (0, *accumulate(weights[i] for i in order))]

    def time(self, source: int, k: int) -> tuple[int, int]:
        """When a source has had k blocks, as a numerator and a denominator."""
        w = self._weights[source]
        p = bisect_right(self._ends, Fraction(k, w))
        return self._gone[p] * w + k * self._left[p], w


def schedule(blocks: dict, weights: dict) -> dict:
    """The slot of every block of each source: earliest due block first."""
    names = sorted((n for n in blocks if blocks[n] > 0), key=lambda n: (n is not None, n or ""))
    counts = [blocks[n] for n in names]
    fluid = Fluid(counts, [weights[n] for n in names])
    slots = [np.empty(n, np.int64) for n in counts]
    done = [0] * len(names)
    ends = [fluid.time(i, 1) for i in range(len(names))]
    waiting, due = [(0, i) for i in range(len(names))], []
    for slot in range(sum(counts)):
        while waiting and waiting[0][0] <= slot:
            i = heapq.heappop(waiting)[1]
            a, b = ends[i]
            heapq.heappush(due, (-(-a // b), i))
        i = heapq.heappop(due)[1]
        slots[i][done[i]] = slot
        done[i] += 1
        if done[i] < counts[i]:
            a, b = ends[i]
            heapq.heappush(waiting, (a // b, i))
            ends[i] = fluid.time(i, done[i] + 1)
    return dict(zip(names, slots))


def mix(docs: DataFrame, parts: dict | None = None, temperature: float = 0.5, source_column: str = "source",
        id_column: str = "doc_id", block_rows: int | None = None, seed: int = 0, names: tuple[str, str, str] = ("block", "slot", "place")
        ) -> DataFrame:
    """`docs` with `block`, `slot` and `place` (within the block): in order of slot and place, sources are mixed.

    `parts` gives the whole weights of every source; without it a source weighs its row count to the power `temperature`.
    `block_rows` is by default what `rows_per_block` says.
    A null source is a source of its own; a source that `parts` does not name weighs one. Rows of a source are
    ordered by a hash of the id, then the id, so repeated ids stand together and rows that tie may swap places. The last
    block of a source may be short. An empty table stays empty. Columns named like the new ones are replaced.
    """
    rows = docs.drop(*names)
    columns = rows.columns
    shown = rows.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    source, own_id = (F.col(f"_c{columns.index(c)}") for c in (source_column, id_column))
    counted = {r[0]: r[1] for r in docs.groupBy(F.col(f"`{source_column}`")).count().collect()}  # one number per source
    weights = weights_of(counted, temperature) if parts is None else {name: int(parts.get(name, 1)) for name in counted}
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1")
    block_rows = block_rows or rows_per_block(sum(counted.values()))
    slots = schedule({name: -(-n // block_rows) for name, n in counted.items()}, weights)

    # Rank within the source: rows of earlier buckets, from a small count, and the row number within the bucket. A
    # source has as many buckets as it needs for about BUCKET_ROWS rows each.
    buckets = max(1, -(-max(counted.values(), default=1) // BUCKET_ROWS))
    shown = shown.withColumn("_hash", F.xxhash64(own_id, F.lit(seed)))
    shown = shown.withColumn("_bucket", F.pmod(F.shiftright("_hash", 8), F.lit(buckets)).cast("int"))
    sizes = shown.groupBy(source.alias("_source"), "_bucket").count()
    before = F.sum("count").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_source", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(source, "_bucket").orderBy("_hash", own_id)) - 1
    ranked = shown.withColumn("_at", at)
    ranked = ranked.join(starts.withColumnRenamed("_bucket", "_b"), source.eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_at")).select(*shown.columns, "_rank").drop("_hash", "_bucket")

    where, kinds = columns.index(source_column), {f.name: f.dataType.simpleString() for f in shown.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            block, slot = rank // block_rows, np.empty(len(rank), np.int64)
            owners = batch.column(f"_c{where}").dictionary_encode()
            codes = owners.indices.fill_null(len(owners.dictionary)).to_numpy()
            for code, name in enumerate([*owners.dictionary.to_pylist(), None]):
                mine = codes == code
                if mine.any():
                    slot[mine] = slots[name][block[mine]]
            own = [batch.column(f"_c{i}") for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(block), pa.array(slot), pa.array(rank % block_rows)],
                                             [*[f"_c{i}" for i in range(len(columns))], "_block", "_slot", "_place"])

    schema = ", ".join([*[f"_c{i} {kinds[f'_c{i}']}" for i in range(len(columns))], "_block long", "_slot long", "_place long"])
    return ranked.mapInArrow(run, schema).toDF(*columns, *names)


def slots_of(docs: DataFrame, source_column: str = "source", block_rows: int | None = None) -> int:
    """How many slots the mix of `docs` has: the blocks of all sources."""
    counts = docs.groupBy(F.col(f"`{source_column}`")).count()
    size = F.lit(block_rows) if block_rows else F.greatest(F.lit(BLOCK_ROWS), F.ceil(counts.agg(F.sum("count").alias("n")).scalar() / MOST_BLOCKS))
    return counts.agg(F.sum(F.ceil(F.col("count") / size))).first()[0] or 0


def in_order(mixed: DataFrame, slots: int, partitions: int, slot: str = "slot", place: str = "place") -> DataFrame:
    """Rows in the order of the mix: each partition holds a range of slots, in order, out of `slots` in all."""
    part = F.least(F.floor(F.col(slot) * partitions / max(slots, 1)), F.lit(partitions - 1)).cast("int")
    return mixed.repartitionById(partitions, part).sortWithinPartitions(slot, place)
