"""The manifest against a plain tree, its versions against a rebuilt one, and odd tables."""

import hashlib
import random
import string
import zlib

import pytest
from pyspark.sql import functions as F

from panelmill.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, index int, leaf string, total int, root string"


def leaf_of(row) -> str:
    texts = [None if v is None else str(v) for v in row[:5]]
    return H(*["-" if t is None else f"{len(t.encode())}:{t}" for t in texts])


def levels_of(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps_of(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        first = at // 8 * 8
        out.append(("".join(level[first:at]), "".join(level[at + 1:first + 8])))
        at //= 8
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    trees: dict = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda n: b"" if n is None else b"1" + n.encode())
    for own in trees.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    below = {n: levels_of([leaf_of(r) for r in trees[n]]) for n in names}
    top = levels_of([below[n][-1][0] for n in names])
    out = []
    for t, name in enumerate(names):
        for i, row in enumerate(trees[name]):
            steps = steps_of(below[name], i) + steps_of(top, t)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            changed = (*row[:4], row[4] and row[4].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
            folded = leaf_of(changed if hit else row)
            for before, after in steps:
                folded = H(before, folded, after)
            out.append((row[0], leaf_of(row), below[name][-1][0], top[-1][0], H(*[s for step in steps for s in step]), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def found(df, **more):
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.manifest(df, changes={"text": lowered}, where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, **more)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "l", 2, "r") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "é", None]), rnd.choice(["en"] * 8 + ["de", None, "ü"]), rnd.choice([None, 5]), rnd.choice(["Ab Ü", "", None, "lower"])) for i in range(700)]
    return rows + [(5, "a", "en", 1, "Again")] * 3 + [(None, None, None, None, None), (None, "x", "en", 2, "No id"), (900, "a", "only", 1, "X" * 200_000)]


def test_against_a_plain_tree(spark, odd):
    assert sorted(map(tuple, found(frame(spark, odd)).collect()), key=repr) == plain(odd)


def test_trees_larger_than_a_block(spark, odd, monkeypatch):
    """With small blocks the same rows take several rounds, below and above the subroots."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, "s", f"lang{i % 11}" if i % 3 else "en", 1, f"Text {i}") for i in range(1500)]
    assert sorted(map(tuple, found(frame(spark, rows + odd)).collect()), key=repr) == plain(rows + odd)


def test_a_version_copies_its_ancestors_and_shares_the_rest(spark):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(100)]
    whole = {r["doc_id"]: r for r in found(frame(spark, rows), copies=True).collect()}
    for i, row in whole.items():
        changed = [(*r[:4], r[4].lower()) if r[0] == i else r for r in rows]
        hit = zlib.crc32(str(i).encode()) % 3 == 0
        assert (row["copied"] is not None) == hit
        if hit:
            levels, first = levels_of([leaf_of(r) for r in changed]), levels_of([leaf_of(r) for r in rows])
            assert [(c["level"], c["index"], c["digest"]) for c in row["copied"]] == [(k, i // 8 ** k, levels[k][i // 8 ** k]) for k in range(1, len(levels))]
            shared = sum(a == b for x, y in zip(levels, first) for a, b in zip(x, y))
            assert shared == sum(map(len, levels)) - len(row["copied"]) - 1


def test_one_row_and_none(spark):
    row = (3, None, "en", 2, "Ab")
    assert [tuple(r) for r in found(frame(spark, [row])).collect()] == plain([row])
    assert found(frame(spark, [row]).where("false")).count() == 0
