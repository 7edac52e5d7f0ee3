"""Licences in texts by their sentences: known sentences become letters, and ordered rules are matched on the letters.

A text is cut into sentences, each normalised to lower-case words; a known sentence has a letter, any other a dash.
A rule is a sequence of letters between which a few dashes may stand. Rules are tried in order at every place, longer
and more specific ones first, so a licence text is reported once and not again as the notices within it. The cut is
made three times, at line ends, at sentence ends alone, and at sentence ends and blank lines, so wrapped text is found,
also below a title without a full stop, as well as unpunctuated notices. A known sentence that the cut itself divides
has a letter for each piece. All of it is built-in functions on the row itself: nothing is shuffled, however often a
licence occurs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

# Sentences of public licence texts and notices.
SENTENCES = [
    "Released under the MIT License.",
    "Licensed under the MIT License.",
    "This project is licensed under the terms of the MIT license.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at",
    "See the License for the specific language governing permissions and limitations under the License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "This program is free software:",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "See the GNU General Public License for more details.",
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Licensed under CC BY 4.0.",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Licensed under CC BY-SA 4.0.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This is free and unencumbered software released into the public domain.",
    "All rights reserved.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "This library is free software;",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "The licenses for most software are designed to take away your freedom to share and change it.",
    "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\").",
    "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\").",
    "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License (\"Public License\").",
]
# Rules in order, each with its licence and the numbers of its sentences, from 1.
RULES = [
    ("MIT", (4, 5, 28, 29)), ("MIT", (4, 5)), ("Apache-2.0", (7, 8, 9, 10)), ("Apache-2.0", (7, 8)), ("GPL-3.0", (12, 13, 14)), ("GPL-3.0", (12, 13)),
    ("GPL-2.0", (12, 32, 14)), ("GPL-2.0", (12, 32)), ("LGPL-2.1", (33, 34)), ("LGPL-3.0", (12, 35)), ("LGPL-3.0", (33, 35)),
    ("AGPL-3.0", (12, 36)), ("BSD-3-Clause", (20, 21, 22, 23, 31)), ("BSD-3-Clause", (20, 21, 22, 23)),
    ("BSD-2-Clause", (20, 21, 22, 31)), ("BSD-2-Clause", (20, 21, 22)), ("Apache-2.0", (37, 38)), ("GPL-2.0", (40, 41)), ("LGPL-2.1", (40, 42)),
    ("MIT", (1,)), ("MIT", (2,)), ("MIT", (3,)), ("Apache-2.0", (6,)), ("Apache-2.0", (7,)), ("GPL-3.0", (11,)),
    ("CC-BY-NC-4.0", (15,)), ("CC-BY-NC-4.0", (16,)), ("CC-BY-4.0", (17,)), ("CC-BY-4.0", (18,)), ("CC-BY-SA-4.0", (19,)),
    ("MPL-2.0", (24,)), ("ISC", (25, 30)), ("ISC", (25,)), ("Unlicense", (26,)), ("All-Rights-Reserved", (27,)),
    ("GPL-3.0", (39,)), ("LGPL-3.0", (43,)), ("AGPL-3.0", (44,)), ("MPL-2.0", (45,)),
    ("CC-BY-4.0", (46,)), ("CC-BY-SA-4.0", (47,)), ("CC-BY-NC-4.0", (48,)),
]
# What a licence asks of use as training text, the strictest last.
TERMS = {
    "permissive": ["MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Unlicense", "CC-BY-4.0"],
    "copyleft": ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC-BY-SA-4.0"],
    "restricted": ["CC-BY-NC-4.0", "All-Rights-Reserved"],
}
MOST_DASHES = 3


def normal(sentence: str) -> str:
    """A sentence as lower-case words of ASCII letters and digits, one space between."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def letter_of(number: int) -> str:
    """The letter of the n-th sentence or piece, from 1: a code point each, so there is room for about 20,000."""
    return chr(0x4E00 + number)


SENTENCE_END = r"([.!?;:])[\x09-\x0D\x20]+"
# A line without letters and digits, as between paragraphs of a comment, is as good as a blank one.
BLANK_LINE = r"\n[^A-Za-z0-9\n]*\n"

# The known sentences as the cut leaves them: the first piece has the sentence's letter, the others have letters of their own.
PIECES = [[normal(x) for x in re.sub(SENTENCE_END, "\\1\u0001", s).split("\u0001")] for s in SENTENCES]
HEADS = {pieces[0]: letter_of(i) for i, pieces in enumerate(PIECES, 1)}
TAILS = {x: letter_of(i) for i, x in enumerate(dict.fromkeys(x for pieces in PIECES for x in pieces[1:]), len(PIECES) + 1)}
KNOWN = {**TAILS, **HEADS}
if len(KNOWN) < len(PIECES) + len(TAILS):
    raise ValueError("two known sentences begin alike, or one begins as another goes on")
# What may stand between the sentences of a rule.
NO_HEAD = "[-" + "".join(TAILS.values()) + "]"
RULE_OF = {"".join(letter_of(n) for n in numbers): licence for licence, numbers in RULES}
PATTERN = "|".join(f"{NO_HEAD}{{0,{MOST_DASHES}}}".join(
    letter_of(n) + "".join(TAILS[x] for x in PIECES[n - 1][1:]) for n in numbers) for _, numbers in RULES)


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _letters(text: Column, cut: str) -> Column:
    """The letters of a text cut at sentence ends and at what the pattern `cut` matches."""
    ended = F.regexp_replace(text, SENTENCE_END, "$1\u0001")
    pieces = F.split(ended, f"\u0001|{cut}" if cut else "\u0001", -1)
    known = _map(KNOWN)

    def letter(sentence: Column) -> Column:
        words = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
        return F.coalesce(F.try_element_at(known, words), F.lit("-"))

    return F.array_join(F.transform(pieces, letter), "")


def _recognised(letters: Column) -> Column:
    rules = _map(RULE_OF)
    found = F.regexp_extract_all(letters, F.lit(PATTERN), F.lit(0))
    return F.transform(found, lambda m: F.element_at(rules, F.regexp_replace(m, NO_HEAD, "")))


def scan_licenses(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with its columns and `licenses` (array, each once, in order of appearance) and `terms`.

    `terms` is the strictest among the licences found, empty where none is. A null text counts as empty and has none.
    Whole texts are read; repeated rows get the same answer each. Columns of these two names are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("licenses", "terms")]
    shown = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], text_of(text_column).alias("_text"))
    cuts = {"_lines": "\n", "_sentences": "", "_paragraphs": BLANK_LINE}
    coded = shown.withColumns({name: _letters(F.col("_text"), cut) for name, cut in cuts.items()})
    found = coded.withColumn("_found", F.array_distinct(F.concat(*[_recognised(F.col(name)) for name in cuts])))
    terms = F.lit("")
    for name, members in TERMS.items():
        terms = F.when(F.arrays_overlap("_found", F.array(*[F.lit(m) for m in members])), name).otherwise(terms)
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], F.col("_found").alias("licenses"), terms.alias("terms"))


def oracle(documents: str = "documents") -> str:
    """The same per document in DuckDB, from the same fixed values: `doc_id, licenses, n_licenses, terms`."""
    known = ", ".join(f"'{k}': '{v}'" for k, v in KNOWN.items())
    rules = ", ".join(f"'{k}': '{v}'" for k, v in RULE_OF.items())

    def letters(cut: str) -> str:
        return (f"list_aggregate(list_transform({cut}, lambda s: coalesce(map_extract_value(MAP {{{known}}}, "
                "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), '-')), 'string_agg', '')")

    def names(column: str) -> str:
        return (f"list_transform(regexp_extract_all({column}, '{PATTERN}'), "
                f"lambda m: map_extract_value(MAP {{{rules}}}, regexp_replace(m, '{NO_HEAD}', '', 'g')))")

    terms = "''"
    for name, members in TERMS.items():
        listed = ", ".join(f"'{m}'" for m in members)
        terms = f"CASE WHEN list_has_any(found, [{listed}]) THEN '{name}' ELSE {terms} END"
    return f"""
WITH cut AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SENTENCE_END}', '\\1' || chr(1), 'g') AS t FROM {documents}),
coded AS (
  SELECT doc_id, {letters("string_split(replace(t, chr(10), chr(1)), chr(1))")} AS a, {letters("string_split(t, chr(1))")} AS b,
    {letters(f"string_split(regexp_replace(t, '{BLANK_LINE}', chr(1), 'g'), chr(1))")} AS c
  FROM cut
),
matched AS (SELECT doc_id, list_concat({names("a")}, {names("b")}, {names("c")}) AS every FROM coded),
once AS (SELECT doc_id, list_filter(every, lambda x, i: list_position(every, x) = i) AS found FROM matched)
SELECT doc_id, coalesce(array_to_string(found, ','), '') AS licenses, len(found) AS n_licenses, {terms} AS terms FROM once
"""
