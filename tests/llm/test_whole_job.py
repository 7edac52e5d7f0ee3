"""What the operators once left out."""

from __future__ import annotations

import textwrap

import corpus_pipeline
import duckdb
import pandas as pd
from panelmill.llm.licenses import RULES, SENTENCES, oracle, scan_licenses


def test_line_dedup_of_rare_passages(spark):
    passage, short = " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"own {i}\n{passage if i % 25 == 7 else short if i % 25 == 8 else 'x' + str(i)}\nend {i}", "big") for i in range(200)]
    rows += [(300, rows[7][1], "big"), (301, f"other\n{passage}", "small"), (None, f"no id\n {passage} ", "big"), (302, None, "big"), (303, passage, None)]
    found = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert len(found) == len(rows)
    # The first copy in a source stays, with documents of the very same text; so do short lines, and documents without source.
    assert {r["doc_id"] for r in found if passage in (r["text"] or "")} == {7, 300, 301, 303}
    texts = {r["doc_id"]: r["text"] for r in found}
    assert texts[32] == "own 32\nend 32" and texts[None] == "no id" and texts[302] is None
    assert all(texts[i] == t for i, t, _ in rows[:200] if passage not in t)


def test_every_licence_rule_in_wrapped_text_below_a_title(spark):
    texts = []
    for _, numbers in RULES:
        body = textwrap.wrap(" ".join(SENTENCES[n - 1] for n in numbers) + " And more words follow.", 60)
        texts.append("\n".join(["Some Title", "", "Copyright (c) 2020 Some Holder", "", *body]))
        texts.append("\n".join(["/*", *[f" * {x}".rstrip() for x in texts[-1].split("\n")], " */"]))
    texts.append("Copyright Some Holder\n" + SENTENCES[23])
    found = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in found] == [[licence] for licence, _ in RULES for _ in range(2)] + [["MPL-2.0"]]


def test_licences_by_both_engines(spark):
    texts = [None, "", "plain words. And more", "\n".join(SENTENCES), " ".join(SENTENCES), "\n\n".join(reversed(SENTENCES))]
    for i, (_, numbers) in enumerate(RULES):
        joined = " ".join(SENTENCES[n - 1] for n in numbers)
        texts += [joined, joined.replace(" ", "\n * "), "A Title\n--\n" + "\n".join(textwrap.wrap(joined, 50)), joined[: len(joined) - 9] + joined,
                  " ".join(SENTENCES[n - 1] + " Words between." * (i % 5) for n in numbers)]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    wanted = {r[0]: r[1:] for r in duckdb.sql("SELECT doc_id, licenses, n_licenses, terms FROM (" + oracle() + ")").fetchall()}
    found = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (",".join(r["licenses"]), len(r["licenses"]), r["terms"]) for r in found} == wanted
    assert {x for r in found for x in r["licenses"]} == {licence for licence, _ in RULES}
