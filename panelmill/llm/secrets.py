"""Secrets in texts: three fixed patterns, and strings that look random to a pair of character Markov models.

**Models.** Two first-order models over the same alphabet, one of random strings and one of ordinary identifiers, are
counted from labelled samples: every value the patterns find, in any document, is labelled random; every other
identifier of the same documents is labelled ordinary. Distinct strings count once, so copies weigh nothing, and what is
counted grows with the corpus. A string is a secret if the sum of its log-likelihood ratios reaches `EVIDENCE`.

**Form.** All of it is built-in functions: a match's place follows from the lengths of what `split` leaves between the
matches. The time for a text grows in proportion to its length, and barely faster with its number of secrets. The only
thing that reaches the driver is the table of pair counts, as wide as the alphabet squared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

# The patterns to find, with the group that is the value, and the least length of the value.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = [*PATTERNS, "markov"]
IDENTIFIER = r"[A-Za-z0-9+/_=-]{4,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
WIDTH = len(ALPHABET) + 1
# Natural logarithm: about one in 160,000 ordinary strings would reach it if the models were exact.
EVIDENCE = 12.0
# Spans gathered by appending, or passed over together. No result depends on it.
CHUNK = 256
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _chunks(items: Column) -> Column:
    """An array in pieces of `CHUNK`."""
    last = F.floor((F.size(items) - 1) / CHUNK).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))
    return F.filter(pieces, lambda piece: F.size(piece) > 0)


def _placed(text: Column, matches: Column, pattern: str, kind: str, keep) -> Column:
    """`SPANS` of the matches that `keep` accepts, in order; the regular expression splits only texts with a match.

    Appending copies an array, so spans are gathered by chunks, and only the chunks are gathered for the whole text.
    """
    between = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    pairs = F.zip_with(between, matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    none = F.array().cast(SPANS)

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")))
        spans = F.when(keep(x["m"]), F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def piece(done: Column, chunk: Column) -> Column:
        begin = F.struct(done["last"]["at"].alias("at"), none.alias("spans"))
        return F.struct(F.aggregate(chunk, begin, step).alias("last"), F.concat(done["done"], F.array(done["last"]["spans"])).alias("done"))

    begin = F.struct(F.struct(F.lit(0).alias("at"), none.alias("spans")).alias("last"), F.array().cast(f"array<{SPANS}>").alias("done"))
    walked = F.aggregate(_chunks(pairs), begin, piece, lambda x: F.flatten(F.concat(x["done"], F.array(x["last"]["spans"]))))
    return F.when(F.size(matches) > 0, walked).otherwise(none)


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others; whole chunks of these, which are in order of start, are passed over."""
    ends = lambda chunk: F.array_max(F.transform(chunk, lambda b: b["end"]))
    chunks = F.transform(_chunks(F.array_sort(others)), lambda c: F.struct(
        F.element_at(c, 1)["start"].alias("start"), ends(c).alias("end"), c.alias("spans")))
    meets = lambda b, s: (b["start"] < s["end"]) & (s["start"] < b["end"])
    # The chunks are made once a text, not once a span.
    walked = F.transform(F.array(chunks), lambda known: F.filter(
        spans, lambda s: ~F.exists(known, lambda c: meets(c, s) & F.exists(c["spans"], lambda b: meets(b, s)))))
    return F.element_at(walked, 1)


def _long_enough(kind: str):
    pattern, group, least = PATTERNS[kind]
    return lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least


def _value(pattern: str, group: int):
    return lambda m: F.regexp_extract(m, pattern, group)


def _codes(string: Column) -> Column:
    """The numbers of a string's characters; it is cut into characters once, as finding a place walks there from the start."""
    return F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _cells(string: Column) -> Column:
    """The number of every pair of characters: the one before, or none at the first place, and the own one."""
    codes = _codes(string)
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), codes), codes, lambda before, own: before * WIDTH + own)
    return F.slice(pairs, F.lit(1), F.length(string))


def train(docs: DataFrame, text_column: str = "text") -> list[float]:
    """Log-likelihood ratios of character pairs, random over ordinary; all zero where no document has a labelled value."""
    rows = docs.select(text_of(text_column).alias("text"))
    found = rows.where(" OR ".join(f"text RLIKE {_sql(p)}" for p, _, _ in PATTERNS.values()))
    values = []
    for kind, (pattern, group, _) in PATTERNS.items():
        keep = _long_enough(kind)
        values.append(F.transform(F.filter(_matches(F.col("text"), pattern), keep), _value(pattern, group)))
    rest = F.col("text")
    for pattern, _, _ in PATTERNS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = F.array_distinct(_matches(rest, IDENTIFIER))
    random_one = found.select(F.explode(F.concat(*values)).alias("s")).distinct().withColumn("random", F.lit(1))
    plain = found.select(F.explode(ordinary).alias("s")).distinct()
    # An identifier is as ordinary in capitals or small letters.
    plain = plain.select(F.explode(F.array("s", F.upper("s"), F.lower("s"))).alias("s")).distinct().withColumn("random", F.lit(0))
    cells = random_one.unionByName(plain).select("random", F.explode(_cells(F.col("s"))).alias("cell"))
    counts = cells.groupBy("random", "cell").count().collect()
    logs = [[0.0] * (WIDTH * WIDTH) for _ in range(2)]
    seen = {(r["random"], r["cell"]): r["count"] for r in counts}
    for label in range(2):
        for before in range(WIDTH):
            row = [seen.get((label, before * WIDTH + own), 0) + 0.5 for own in range(WIDTH)]
            total = sum(row)
            for own in range(WIDTH):
                logs[label][before * WIDTH + own] = math.log(row[own] / total)
    if not any(label for label, _ in seen):
        return [0.0] * (WIDTH * WIDTH)
    return [r - o for o, r in zip(*logs)]


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _evidence(string: Column, ratios: list[float]) -> Column:
    table = F.lit(ratios)

    def step(done: Column, own: Column) -> Column:
        ratio = F.element_at(table, done["before"] * WIDTH + own + 1)
        return F.struct(own.alias("before"), (done["total"] + ratio).alias("total"))

    begin = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("total"))
    return F.aggregate(_codes(string), begin, step, lambda done: done["total"])


def find_secrets(docs: DataFrame, ratios: list[float] | None = None, text_column: str = "text") -> DataFrame:
    """`docs` with its columns and `secrets`, an array of `start, kind, end` in code points, the end exclusive.

    Kinds are the numbers of `KINDS`; spans are in order of start, then kind. Patterns are matched leftmost without
    overlap, each for itself, and matches whose value is too short are dropped. Spans of the models are added where
    they overlap none of these. A null text counts as empty and has none. Without `ratios` the models are trained on
    `docs`. Repeated rows get the same answer each. A column `secrets` of `docs` is replaced.
    """
    ratios = train(docs, text_column) if ratios is None else ratios
    names = [c for c in docs.columns if c.lower() != "secrets"]
    shown = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], text_of(text_column).alias("_text"))
    text = F.col("_text")
    shown = shown.withColumns({f"_m_{kind}": _matches(text, p) for kind, (p, _, _) in PATTERNS.items()})
    base = F.concat(*[_placed(text, F.col(f"_m_{kind}"), p, kind, _long_enough(kind)) for kind, (p, _, _) in PATTERNS.items()])
    likely = any(ratios)
    if likely:
        shown = shown.withColumns({"_base": base, "_m_markov": _matches(text, CANDIDATE)})
        has_letter = lambda m: m.rlike("[A-Za-z]")
        looks_random = lambda m: F.when(has_letter(m), _evidence(m, ratios) >= EVIDENCE).otherwise(False)
        more = _placed(text, F.col("_m_markov"), CANDIDATE, "markov", looks_random)
        shown = shown.withColumn("_more", more)
        spans = F.array_sort(F.concat("_base", _apart(F.col("_more"), F.col("_base"))))
    else:
        spans = F.array_sort(base)
    return shown.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], spans.alias("secrets"))


def number_of(kind: str, spans: str = "secrets") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def written(spans: Column) -> Column:
    """Spans as text: `kind:start:end`, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1),
                                                                 s["start"].cast("string"), s["end"].cast("string"))), ",")
