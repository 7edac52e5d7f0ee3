"""Near duplicates by MinHash with tensored banding, verified on full shingle sets.

**Tables.** Banding with L tables of 2h minhashes each would need 2hL minhashes. Here two small collections of m
tuples of h minhashes are drawn, and table (i, j) has the pair (u_i, v_j) as key: m * m tables from 2hm minhashes,
about the square root. Two sets of similarity s share a table with probability (1 - (1 - s**h)**m)**2; `tuples_for`
takes the least m that misses a pair at the threshold with a chance below 1 in 20,000.

**Scale.** A set that shares no u_i with any other set shares no table of row i, so tuples are matched first (2m rows
per set) and pairs are formed only of those that met another set. Equal sets are one set from the start, so a group of
copies of any size is one row. Within a table nothing is paired with everything: each member is compared with the
most central member, the one that meets most others over all tables. Verified links make components.

**The rest.** A link may be missed there when neither end is central. Tables that still hold more than one component
are therefore examined again, exactly: the shingles of their sets are counted. Two sets either have a rare shingle in
common, and meet in its short list, or only their common shingles can match, and must be enough for the threshold by
themselves. A copy that was edited more than the threshold allows has too many rare shingles for that, so few pairs of
different components are left; they are verified, and components are made again. There is no cap on members,
candidates or partners.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, settle, text_of
from .components import components
from .words import Block, mix

TUPLE = 3
MISSED = 5e-5
# Sets that a shingle may have to count as rare in the second look; no cap: shingles of more sets are looked at otherwise.
RARE = 8


def tuples_for(percent: int) -> int:
    """The least number of tuples per collection with which a pair at the threshold is missed with a chance below MISSED."""
    return max(2, math.ceil(math.log(MISSED / 2) / math.log(1 - min(percent / 100, 0.999) ** TUPLE)))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch."""
    hashes, first = Block(batch.column("text"), lower=True).windows(k, whole=True)
    for lo, hi in zip(first[:-1], first[1:]):
        own = np.sort(hashes[lo:hi])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if hi > lo else own


def _multipliers(m: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, size=2 * m * TUPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signed(m: int, k: int):
    """Task code: `doc_id, n_shingles, digest, tuples` of each text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers(m)
        for batch in blocks(batches):
            sizes, digests, tuples = [], [], []
            for own in _sets(batch, k):
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                least = np.full(len(by), ~np.uint64(0))
                for at in range(0, len(own), 2048):
                    np.minimum(least, (own[at:at + 2048, None] * by).min(axis=0), out=least)
                folded = np.zeros(2 * m, np.uint64)
                for column in mix(least).reshape(2 * m, TUPLE).T:
                    folded = mix(folded + column)
                tuples.append(folded.view(np.int64) if len(own) else folded.view(np.int64)[:0])
            ends = np.cumsum([0, *map(len, tuples)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(ends, np.concatenate(tuples))], ["doc_id", "n_shingles", "digest", "tuples"])
    return run


def _listed(k: int):
    """Task code: `doc_id, shingles`, the full set of each text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = list(_sets(batch, k))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "shingles"])
    return run


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5,
                    percent: int = 80, tuples: int | None = None) -> DataFrame:
    """One row per input row: `doc_id, n_shingles, component_id, kept`.

    Words are runs of anything but space and the controls 9 to 13, A-Z in lower case; the set of a document is its
    distinct shingles of `k` words, or the whole sequence where there are fewer. Two sets are linked if their
    intersection has at least `percent` hundredths of their union. `component_id` is the smallest id reachable, the
    own one included; `kept` says that it is the own one. A text that is null, empty or without words has no shingles
    and stays alone. Rows that repeat an id are one document with several texts: the links of each count for it. A row
    without an id gets the component of its equals if it has any, else null, and is not kept in the former case.
    Shingles are 64-bit hashes; equal hashes count as equal shingles. Other columns are not looked at.
    """
    m = tuples or tuples_for(percent)
    texts = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), text_of(text_column).alias("text"))
    signed = settle(texts.mapInArrow(_signed(m, k), "doc_id long, n_shingles long, digest binary, tuples array<long>"), "signed")
    # One row per distinct set: the document with the smallest id stands for its equals.
    first = (signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
             .agg(F.min(F.struct("doc_id", "n_shingles", "tuples")).alias("s")))
    reps = settle(first.select("digest", "s.*"), "sets")
    members = settle(_members(reps, m), "members")
    shared = members.select("doc_id").distinct()
    sets = settle(texts.join(shared, "doc_id", "left_semi").mapInArrow(_listed(k), "doc_id long, shingles array<long>"), "shingles")

    central = (members.groupBy("doc_id").agg(F.sum("met").alias("met"))
               .select("doc_id", F.struct("met", (-F.col("doc_id")).alias("by_id")).alias("rank")))
    ranked = members.join(central, "doc_id").select("key", "doc_id", "rank")
    centres = ranked.groupBy("key").agg((-F.max("rank")["by_id"]).alias("b"))
    pairs = members.join(centres, "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    links = settle(_verified(pairs, sets, percent), "star_links")
    found = components(links)
    more = settle(_verified(_open_pairs(members, reps, sets, found, percent, m), sets, percent), "open_links")
    if not more.isEmpty():
        found = components(links.union(more))

    answer = (reps.select("digest", "doc_id").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
              .select("digest", F.coalesce("component", "doc_id").alias("component")))
    out = signed.select("doc_id", "n_shingles", "digest").join(answer, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _members(reps: DataFrame, m: int) -> DataFrame:
    """`key, doc_id, met`: the sets of every table with at least two, and how many others each meets there."""
    from pyspark.sql import Window

    slots = reps.select("doc_id", F.posexplode("tuples").alias("slot", "value"))
    slots = slots.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("slot", "value"))).where("n > 1")
    # At most 2m rows per set, so the lists are bounded.
    sides = slots.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("slot") < m, F.struct("slot", "value"))).alias("u"),
        F.collect_list(F.when(F.col("slot") >= m, F.struct("slot", "value"))).alias("v"))
    keys = sides.select("doc_id", "v", F.explode("u").alias("u")).select("doc_id", "u", F.explode("v").alias("v"))
    keys = keys.select(F.xxhash64("u.slot", "u.value", "v.slot", "v.value").alias("key"), "doc_id")
    # A set is in m * m tables, which spreads a large group over as many keys; the window spills where it must.
    met = (F.count(F.lit(1)).over(Window.partitionBy("key")) - 1).alias("met")
    return keys.select("key", "doc_id", met).where("met > 0")


def _enough(common: str, a: str, b: str, percent: int) -> str:
    return f"(100 + {percent}) * {common} >= {percent} * ({a} + {b})"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.join(left, "a").join(right, "b").where(_enough("least(size(_a), size(_b))", "size(_a)", "size(_b)", percent))
    return both.where(_enough("size(array_intersect(_a, _b))", "size(_a)", "size(_b)", percent)).select("a", "b").distinct()


def _open_pairs(members: DataFrame, reps: DataFrame, sets: DataFrame, found: DataFrame, percent: int, m: int) -> DataFrame:
    """Pairs of different components that share a table and that the counts of rare shingles do not rule out."""
    named = found.select(F.col("node").alias("doc_id"), "component")
    placed = (members.select("key", "doc_id").join(named, "doc_id", "left")
              .select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    still = placed.join(mixed, "key").select("doc_id", "component").distinct()
    # Shingles by how many sets of the open tables have them: one, up to RARE, more.
    still = settle(still.join(reps.selectExpr("doc_id", "n_shingles AS n", "tuples"), "doc_id"), "open")
    own = sets.join(still.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("s"))
    counts = own.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("only"))
    alone = counts.where("df = 1").groupBy(F.col("only").alias("doc_id")).agg(F.sum("df").alias("alone"))
    rare = settle(own.join(counts.where(f"df BETWEEN 2 AND {RARE}").select("s"), "s"), "rare")
    several = rare.groupBy("doc_id").agg(F.count(F.lit(1)).alias("several"))
    bound = settle(still.join(alone, "doc_id", "left").join(several, "doc_id", "left").selectExpr(
        "doc_id", "component AS c", "n", "n - coalesce(alone, 0) AS shared", "n - coalesce(alone, 0) - coalesce(several, 0) AS common",
        f"slice(tuples, 1, {m}) AS u", f"slice(tuples, {m + 1}, {m}) AS v"), "bound")
    a, b = (bound.select([F.col(c).alias(f"{side}_{c}") for c in bound.columns]) for side in "ab")
    apart = f"a_doc_id < b_doc_id AND a_c <> b_c AND {_enough('least(a_%s, b_%s)', 'a_n', 'b_n', percent)}"
    chosen = ["a_doc_id AS a", "b_doc_id AS b"]

    # With a rare shingle in common: lists of at most RARE sets. What is not shared at all cannot count.
    narrow = rare.join(bound.select("doc_id", "c", "n", "shared"), "doc_id")
    x, y = (narrow.select("s", *[F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "c", "n", "shared")]) for side in "ab")
    by_rare = x.join(y, "s").where(apart % ("shared", "shared")).selectExpr(*chosen)

    # Without one: only shingles of more than RARE sets can be common. The first tuple a pair shares names it once.
    able = a.where(_enough("a_common", "a_n", "ceil(a_n * %d / 100)" % percent, percent))
    others = b.where(_enough("b_common", "b_n", "ceil(b_n * %d / 100)" % percent, percent))
    x = able.select("*", F.posexplode("a_u").alias("slot", "value"))
    y = others.select("*", F.posexplode("b_u").alias("slot", "value"))
    first = "array_position(zip_with(a_u, b_u, (p, q) -> p = q), true) = slot + 1 AND arrays_overlap(a_v, b_v)"
    by_table = x.join(y, ["slot", "value"]).where(apart % ("common", "common") + " AND " + first).selectExpr(*chosen)
    return by_rare.union(by_table).distinct()
