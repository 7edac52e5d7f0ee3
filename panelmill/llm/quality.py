"""Quality rules as a cascade that stops at the first rule a document fails.

A rule looks at the texts of a block and says which it rejects. On a sample, every rule's time per byte and its share of
rejected documents are measured; the cascade then runs the rules in falling order of rejections per second, each one
only on the documents that all earlier ones passed. The order changes what the cascade costs, never its verdict: a
document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, text_of
from .words import Block, repeated

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


class Facts:
    """What rules ask about the texts of a block; each fact is computed once, when first asked for."""

    def __init__(self, texts: pa.Array):
        self.block = Block(texts)
        self._known: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = FACTS[name](self.block)
        return self._known[name]


def _word_chars(block: Block) -> np.ndarray:
    return block.count(((block.data & 0xC0) != 0x80) & ~block.space)


def _dup_lines(block: Block) -> np.ndarray:
    hashes, text, has_word = block.lines()
    hashes, text = hashes[has_word], text[has_word]
    return np.bincount(text[repeated(hashes, text)[1]], minlength=block.texts)


def _text_lines(block: Block) -> np.ndarray:
    _, text, has_word = block.lines()
    return np.bincount(text[has_word], minlength=block.texts)


def _repeat_words(block: Block) -> np.ndarray:
    hashes, first = block.windows(3)
    text = np.repeat(np.arange(block.texts), np.diff(first))
    often, _ = repeated(hashes, text)
    # Window w of text t begins at word w + 2 * (texts before t with windows cut at their ends).
    begins = np.flatnonzero(often) - first[text[often]] + block.first[text[often]]
    covered = np.zeros(len(block.starts), bool)
    for j in range(3):
        covered[begins + j] = True
    return np.bincount(block.text_of_words()[covered], minlength=block.texts)


FACTS: dict[str, Callable[[Block], np.ndarray]] = {
    "n_words": lambda block: block.n_words,
    "word_chars": _word_chars,
    "n_symbols": lambda block: block.count(_SYMBOL[block.data]),
    "n_dup_lines": _dup_lines,
    "n_text_lines": _text_lines,
    "n_repeat_words": _repeat_words,
    "n_upper": lambda block: block.count(_UPPER[block.data]),
    "n_lower": lambda block: block.count(_LOWER[block.data]),
    "n_shouts": lambda block: block.count(block.data == ord("!")),
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], np.ndarray]


RULES = (
    Rule("few_words", lambda f: f["n_words"] < 50),
    Rule("repeated_windows", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
    Rule("symbols", lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("shouting", lambda f: 5 * f["n_shouts"] > f["n_words"]),
    Rule("capitals", lambda f: 2 * f["n_upper"] > f["n_upper"] + f["n_lower"]),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("repeated_lines", lambda f: 100 * f["n_dup_lines"] > 50 * f["n_text_lines"]),
)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text",
                  sample_rows: int = 2000, seed: int = 11) -> list[dict]:
    """The rules in the order of the cascade, with what was measured: `name, seconds, rejected, seen`.

    About `sample_rows` documents are drawn; every rule is timed alone on all of them, facts included. A rule that
    takes no measurable time comes first among equals; on an empty table the rules keep their order.
    """
    total = docs.count()
    drawn = docs.sample(fraction=min(1.0, sample_rows / total), seed=seed) if total else docs.limit(0)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in blocks(batches):
            seen += batch.num_rows
            for i, rule in enumerate(rules):
                begun = time.perf_counter()
                rejected[i] += rule.rejects(Facts(batch.column("text"))).sum()
                spent[i] += time.perf_counter() - begun
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(spent), pa.array(rejected),
                                          pa.array([seen] * len(rules), pa.int64())], ["rule", "seconds", "rejected", "seen"])

    found = (drawn.select(text_of(text_column).alias("text"))
             .mapInArrow(measure, "rule int, seconds double, rejected long, seen long")
             .groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"), F.sum("seen")).collect())
    known = {r[0]: r[1:] for r in found}
    rows = [{"name": rule.name, "seconds": s, "rejected": r, "seen": n}
            for rule, (s, r, n) in ((rule, known.get(i, (0.0, 0, 0))) for i, rule in enumerate(rules))]
    return sorted(rows, key=lambda x: -(x["rejected"] / max(x["seconds"], 1e-9)))


def judge(docs: DataFrame, facts: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id",
          text_column: str = "text", order: list[str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: `doc_id`, the wanted `facts` as numbers, `kept`, and the columns to `carry` along.

    `order` names the rules in cascade order; without it a sample decides. A null text counts as empty; an empty text
    has no words, which `few_words` rejects. Facts asked for are computed for every document, outside of the cascade.
    Texts are taken in blocks of bounded size, so a very long text is the only thing a task must hold. Repeated rows
    are judged alike; other columns, whatever their names, are not looked at.
    """
    by_name = {rule.name: rule for rule in rules}
    cascade = [by_name[name] for name in (order or [x["name"] for x in cascade_order(docs, rules, text_column)])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            texts = batch.column("_text")
            stay, known = np.arange(batch.num_rows), Facts(texts)
            wanted = [pa.array(known[name].astype(np.int64)) for name in facts]
            for rule in cascade:
                passed = ~rule.rejects(known)
                if not passed.all():
                    stay = stay[passed]
                    # The rest of the cascade sees only what passed; facts asked for keep what they have.
                    known = Facts(texts.take(pa.array(stay))) if len(stay) else None
                if not len(stay):
                    break
            kept = np.zeros(batch.num_rows, bool)
            kept[stay] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *wanted, pa.array(kept), *[batch.column(f"_c{i}") for i in range(len(carry))]],
                ["doc_id", *facts, "kept", *carry])

    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), text_of(text_column).alias("_text"),
                       *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"doc_id {kinds[id_column]}", *[f"{f} long" for f in facts], "kept boolean",
                        *[f"`{c}` {kinds[c]}" for c in carry]])
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects, with all their columns."""
    order = [x["name"] for x in cascade_order(docs, rules, text_column)]
    by_name = {rule.name: rule for rule in rules}
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            for name in order:
                if not batch.num_rows:
                    break
                passed = ~by_name[name].rejects(Facts(batch.column("_text")))
                if not passed.all():
                    batch = batch.filter(pa.array(passed))
            yield batch.drop_columns(["_text"])

    at = docs.columns.index(text_column)
    shown = docs.toDF(*[f"_c{i}" for i in range(len(names))]).withColumn("_text", text_of(f"_c{at}"))
    kinds = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return shown.mapInArrow(run, kinds).toDF(*names)
