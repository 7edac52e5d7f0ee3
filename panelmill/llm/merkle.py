"""A manifest of a dataset as a persistent hash tree: every row a leaf, every tree (a language, say) a subroot, one root.

A node is the SHA-256 of its children's digests, eight to a node. Leaves get their place in their tree from one range sort and
the counts of its partitions. Nodes are then made in aligned blocks of 4096: a task takes one block, climbs four levels, and
only the top node of the block moves on, so each round has 4096 times fewer rows and no tree, however large, meets in a
task. Subroots are leaves of one more tree, made the same way.

A changed leaf does not change the tree; it makes a version of it. Within its block the version copies the path from the leaf
to the block's top, hashing each copy over the untouched siblings it shares with the first version. Above, it continues along
the path of its block, which the upper rounds left as one row per block: the siblings of each level, before and after. Rows and
paths of a block meet by block, so a version costs its ancestors alone, and versions never meet each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle

BRANCH, DEPTH = 8, 4
BLOCK = BRANCH ** DEPTH
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before: string, after: string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row: per value its length in bytes, a colon and the value, or a hyphen where it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class BlockTree:
    """The nodes of one aligned block by level, and versions of it. A block of a larger tree always has DEPTH levels above its leaves."""

    def __init__(self, leaves: list[str], total: int):
        self.levels = [leaves]
        while len(self.levels) <= DEPTH and (total > BLOCK or len(self.levels[-1]) > 1):
            below = self.levels[-1]
            self.levels.append([digest(*below[i:i + BRANCH]) for i in range(0, len(below), BRANCH)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def steps(self, at: int) -> list[tuple[str, str]]:
        """The siblings before and after, on every level from a leaf up to the top."""
        found = []
        for level in self.levels[:-1]:
            first = at - at % BRANCH
            found.append(("".join(level[first:at]), "".join(level[at + 1:first + BRANCH])))
            at //= BRANCH
        return found


def copied(leaf: str, steps: list[tuple[str, str]]) -> list[str]:
    """The copies that a version with another leaf makes, the root last; everything else it shares."""
    nodes = [leaf]
    for before, after in steps:
        nodes.append(digest(before, nodes[-1], after))
    return nodes[1:]


def _placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """`rows` with the column `tree`, and `index` from 0 and `total` within it, in an order that repeated rows share in any way."""
    stored = settle(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = settle(stored.orderBy("tree", *order, "_row").drop("_row").withColumns({"_part": F.spark_partition_id(), "_at": at}), "ordered")
    runs = ordered.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy("tree")  # one row per sort partition
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = runs.select("tree", "_part", (before - F.col("_first")).alias("_start"), F.sum("_n").over(own).alias("total"))
    return ordered.join(starts, ["tree", "_part"]).withColumn("index", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def _block() -> Column:
    return F.floor(F.col("index") / BLOCK).cast("long")


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("index")


def _tops(placed: DataFrame) -> DataFrame:
    """`tree, index, total, digest`: the top node of every block, and how many of them its tree has."""

    def top(table: pa.Table) -> pa.Table:
        rows = _sorted(table)
        total, at = rows.column("total")[0].as_py(), rows.column("index")[0].as_py()
        node = BlockTree(rows.column("leaf").to_pylist(), total).top
        return pa.table({"tree": rows.column("tree")[:1], "index": [at // BLOCK], "total": [-(-total // BLOCK)], "digest": [node]})

    nodes = placed.select("tree", "index", "total", "leaf", _block().alias("_block")).groupBy("tree", "_block")
    return nodes.applyInArrow(top, "tree string, index long, total long, digest string")


def _paths(nodes: DataFrame) -> DataFrame:
    """`tree, index, steps, root` of every node of `tree, index, total, digest`: its siblings level by level up to the root of its tree."""

    def climbed(table: pa.Table) -> pa.Table:
        rows = _sorted(table)
        tree = BlockTree(rows.column("digest").to_pylist(), rows.column("total")[0].as_py())
        steps = [[{"before": b, "after": a} for b, a in tree.steps(i)] for i in range(rows.num_rows)]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table({"tree": rows.column("tree"), "index": rows.column("index"), "total": rows.column("total"),
                         "steps": pa.array(steps, kind), "top": pa.array([tree.top] * rows.num_rows, pa.string())})

    rounds: list[DataFrame] = []
    nodes = settle(nodes, "tops")
    while (nodes.agg(F.max("total")).first()[0] or 0) > 1:
        grouped = nodes.withColumn("_block", _block()).groupBy("tree", "_block")
        rounds.append(settle(grouped.applyInArrow(climbed, f"tree string, index long, total long, steps {_STEPS}, top string"), "paths"))
        nodes = rounds[-1].where(F.col("index") % BLOCK == 0).select(
            "tree", _block().alias("index"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("digest"))
    paths = nodes.select("tree", "index", F.array().cast(_STEPS).alias("steps"), F.col("digest").alias("root"))
    for up in reversed(rounds):
        above = paths.select("tree", F.col("index").alias("_block"), F.col("steps").alias("_above"), "root")
        paths = up.withColumn("_block", _block()).join(above, ["tree", "_block"]).select(
            "tree", "index", F.concat("steps", "_above").alias("steps"), "root")
    return paths


def manifest(docs: DataFrame, id_column: str = "doc_id", tree_column: str = "lang", columns: Sequence[str] = COLUMNS,
             changes: Mapping[str, Column] | None = None, where: Column | None = None, copies: bool = False) -> DataFrame:
    """One row per input row: `doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`.

    `leaf` is the digest of `columns`; leaves of a tree go by id (null first), then by digest. `proof_sha256` is the digest of all
    siblings from the leaf to the root. Where `where` holds, the row has another version: `changes` gives other values of columns,
    and `folded_root` is the root of that version; elsewhere it is folded from the leaf itself. `verified` says whether it is
    the root of the first version. With `copies`, `copied` lists the nodes that a row's version does not share, as `level,
    index, digest` from the level above its leaf up to the root (`index` counts within the tree; above the subroot it is 0); it is null where the version's leaf is the same, which copies nothing.

    A null tree is a tree of its own, before all others; trees go by the bytes of their names. Rows that repeat, ids that are
    null or repeat are leaves of their own: rows with the same leaf may take each other's place. Empty and very long texts are values
    like others. An empty table gives an empty result. Other columns are not looked at, whatever their names.
    """
    named = {c: F.col(f"`{c}`") for c in columns}
    other = leaf_digest([(changes or {}).get(c, named[c]) for c in columns])
    tree = F.col(f"`{tree_column}`").cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("1"), tree), F.lit("0")).alias("tree"), F.col(f"`{id_column}`").alias("doc_id"),
                       leaf_digest(list(named.values())).alias("leaf"), F.when(F.lit(False) if where is None else where, other).alias("changed"))
    placed = settle(_placed(rows, [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]), "placed")
    paths = settle(_paths(_tops(placed)), "block_paths")
    subroots = paths.where("index = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    trees = settle(_placed(subroots, [F.col("name").asc()]), "subroots")
    upper = _paths(trees.select("tree", "index", "total", F.col("leaf").alias("digest")))
    named_upper = trees.join(upper, ["tree", "index"]).select(F.col("name").alias("tree"), F.col("leaf").alias("subroot"), F.col("steps").alias("_upper"),
                                                              F.col("root").alias("_root"))
    whole = paths.join(named_upper, "tree").select("tree", F.col("index").alias("_block"), F.concat("steps", "_upper").alias("steps"),
                                                   "subroot", F.col("_root").alias("root"))
    kind = dict(rows.dtypes)["doc_id"]
    shape = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    shape += ", copied array<struct<level: int, index: long, digest: string>>" if copies else ""
    left = placed.withColumn("_block", _block()).groupBy("tree", "_block")
    return left.cogroup(whole.groupBy("tree", "_block")).applyInArrow(_versions(copies), shape)


def _versions(copies: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def versions(table: pa.Table, path: pa.Table) -> pa.Table:
        rows = _sorted(table)
        above, subroot, root = (path.column(c)[0].as_py() for c in ("steps", "subroot", "root"))
        upper = [(s["before"], s["after"]) for s in above]
        leaves, changed, at = (rows.column(c).to_pylist() for c in ("leaf", "changed", "index"))
        tree = BlockTree(leaves, rows.column("total")[0].as_py())
        proofs, roots, lists = [], [], []
        for i, leaf in enumerate(leaves):
            steps = tree.steps(i) + upper
            proofs.append(digest(*[s for step in steps for s in step]))
            version = changed[i] or leaf
            nodes = copied(version, steps)
            roots.append(nodes[-1] if nodes else version)
            if copies:
                lists.append(None if version == leaf else [
                    {"level": k + 1, "index": at[i] // BRANCH ** (k + 1), "digest": n} for k, n in enumerate(nodes)])
        same = [r == root for r in roots]
        n = rows.num_rows
        out = {"doc_id": rows.column("doc_id"), "leaf": rows.column("leaf"), "subroot": pa.array([subroot] * n, pa.string()),
               "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
               "folded_root": pa.array(roots, pa.string()), "verified": pa.array(same, pa.bool_())}
        if copies:
            kind = pa.list_(pa.struct([("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]))
            out["copied"] = pa.array(lists, kind)
        return pa.table(out)

    return versions
