"""Aligned tokens against whole texts encoded one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelmill.llm import alignment

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
A.encode_special_tokens = True
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {**{chr(b): b for b in PRINTABLE}, **{chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}}


def ends(tokens: list[bytes]) -> list[int]:
    out, at = [], 0
    for t in tokens:
        out.append(at := at + len(t))
    return out


def groups(text: str | None) -> list[tuple[list[int], list[int]]] | None:
    """Groups of ids between the places where tokens of both end, or nothing."""
    if not text:
        return None
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(LETTER[c] for c in A.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        out.append((ids_a[i:p], ids_b[j:q]))
        i, j = p, q
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    found = [(i, groups(t)) for i, t in rows]
    counts = Counter((a[-1], b[-1]) for _, g in found for a, b in g or [])
    most: dict = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for i, g in found:
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[x] == most[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD_PARTS = list(" \n\n  abcXYZ's't.,;:!?123<>|[]/▁ \t\r\x00\x85　éß漢字ﬁ①😀​﻿") + [
    "<|endoftext|>", "</s>", "<s>", "<0x0A>", " the", "\n\n", "\n ", " \n", "  ", "'re", "word.", "e.g.", "...", " 's"]


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(ODD_PARTS) for _ in range(rnd.randint(1, 25))) for _ in range(800)]
    rows = list(enumerate(texts + ["x" * 5000, "a b " * 300 + "y" * 250 + " z", "\n", " ", "  ", "\n\n", "", None]))
    return rows + [(None, "no id here"), (None, None), (7, "repeated words."), (7, "repeated words.")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "g", 2) for i, t in rows], "doc_id long, text string, n_a int, groups string, a int")


def found(df):
    return sorted(map(tuple, alignment.align_documents(df, PATH_A, PATH_B).collect()), key=repr)


def test_odd_texts(spark, odd):
    assert found(frame(spark, odd).repartition(3)) == plain(odd)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(frame(spark, rows)) == plain(rows)


def test_a_table_of_units_that_forgets(spark, odd, monkeypatch):
    """In this process: few units are kept, blocks are small, and the result is the same."""
    monkeypatch.setattr(alignment, "KNOWN_UNITS", 50)
    aligner = alignment.Aligner(PATH_A, PATH_B)
    rows = [t for _, t in odd if t]
    for k in range(0, len(rows), 40):
        part = rows[k:k + 40]
        for which, units, slots, first in aligner.rows(pa.array(part, pa.large_string())):
            for n, i in enumerate(which.tolist()):
                own = slots[first[n]:first[n + 1]]
                wanted = groups(part[i])
                text = b";".join(units.texts[s] for s in own).decode() if units.clean[own].all() else None
                assert text == (wanted and ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in wanted))
    assert aligner.generation > 2


def test_groups_on_request_and_an_empty_table(spark, odd):
    shown = alignment.align_documents(frame(spark, odd), PATH_A, PATH_B, groups=True).collect()
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_groups"] else "") for r in shown)
    assert found(frame(spark, odd).where("false")) == []


def test_pairs_are_bounded_by_the_vocabularies(spark, odd):
    aligner = alignment.Aligner.of(PATH_A, PATH_B)
    pairs = alignment.pair_counts(frame(spark, odd), PATH_A, PATH_B).collect()
    one = lambda side, i: bytes(side.joined(np.array([i])))
    spelled = [(one(aligner._side_a, r["a"]), one(aligner._side_b, r["b"])) for r in pairs]
    assert all(x.endswith(y) or y.endswith(x) for x, y in spelled) and aligner.most_pairs < 600_000
