"""Each operator against a plain version, and on nulls, empty texts, ties, repeated rows, empty tables and odd columns."""

import hashlib
import random
import re
import time
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from fractions import Fraction

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelmill.llm import queries
from panelmill.llm.components import components
from panelmill.llm.exact_dedup import exact_duplicates
from panelmill.llm.licenses import SENTENCES, scan_licenses
from panelmill.llm.line_dedup import drop_boilerplate, host_of, html_lines
from panelmill.llm.mixing import mix, rows_per_block, schedule, weights_of
from panelmill.llm.near_dedup import near_duplicates, tuples_for
from panelmill.llm.packing import OpenWindows, best_fit, pack
from panelmill.llm.quality import RULES, cascade_order, judge, keep_good
from panelmill.llm.rollups import TokenRollup
from panelmill.llm.secrets import ALPHABET, CANDIDATE, EVIDENCE, IDENTIFIER, PATTERNS, WIDTH, find_secrets, train, written
from panelmill.llm.tokens import WordTokens
from panelmill.llm.toxicity import Compressors, cut_windows, fit, fit_texts, score

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# Extra columns whose names clash with those the operators use inside or give out.
EDGE_SCHEMA = "doc_id long, text string, source string, lang string, kept string, _text int, _c0 int, slot int, secrets int, _digest int, _host int"


@pytest.fixture(scope="module")
def edge(spark):
    long = " ".join(f"word{i % 977} filler{i % 1009}" for i in range(20_000))
    words = " ".join(f"alpha{i} beta{i}" for i in range(60))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, words, "a"), (4, words, "a"), (5, words + " ", None),
            (6, long, "b"), (None, words, "a"), (None, None, None), (7, "one", "b"), (8, "ONE", "b"), (9, "x" * 5000, "")]
    return spark.createDataFrame([(i, t, s, "en", "k", 1, 2, 3, 4, 5, 6) for i, t, s in rows], EDGE_SCHEMA)


@pytest.fixture(scope="module")
def nothing(edge):
    return edge.where("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


# Exact duplicates

def test_exact_edges(edge, nothing):
    found = exact_duplicates(edge).collect()
    assert len(found) == edge.count()
    empty = [r for r in found if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {r["group_size"] for r in empty} == {4} and sum(r["kept"] for r in empty) == 1
    assert {r["keep_id"] for r in empty} == {3}  # the longest original text
    same = [r for r in found if r["group_size"] == 4 and r not in empty]
    assert {r["keep_id"] for r in same} == {5} and sum(r["kept"] for r in same) == 1
    assert exact_duplicates(nothing).count() == 0


# Near duplicates

def test_near_against_all_pairs(documents, rows):
    found = {r["doc_id"]: r for r in near_duplicates(documents, k=3, percent=85).collect()}
    assert {i: r["component_id"] for i, r in found.items()} == brute.near_groups(rows, 3, 85)
    assert all(r["n_shingles"] == len(brute.shingles(t, 3)) for i, t in rows for r in [found[i]])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.values())


def test_near_group_of_edited_copies(spark):
    """A large group in which few pairs are linked directly; some members are edited too much for any link."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])):
            words[at] = rng.choice([f"n{rng.random()}", "same", words[at] + "."])
        texts.append((i, " ".join(words)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame, k=3, percent=85).collect()} == brute.near_groups(texts, 3, 85)


def test_near_edges(edge, nothing):
    found = near_duplicates(edge).collect()
    assert len(found) == edge.count()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[1]["n_shingles"] == 0 and by_id[1]["component_id"] == 1 and by_id[1]["kept"]
    assert by_id[5]["component_id"] == 4 and not by_id[5]["kept"] and by_id[8]["component_id"] == 7
    assert sorted((r["component_id"], r["kept"]) for r in found if r["doc_id"] is None and r["n_shingles"]) == [(4, False)]
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None and not r["n_shingles"]] == [(None, True)]
    assert near_duplicates(nothing).count() == 0


def test_tuples_keep_the_promise():
    for percent in (80, 85, 90):
        m = tuples_for(percent)
        assert (1 - (1 - (percent / 100) ** 3) ** m) ** 2 > 1 - 5e-5


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), *[(100 + i, 101 + i) for i in range(40)]]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{100 + i: 100 for i in range(41)}}


# Packing

def test_segment_tree_finds_the_tightest():
    tree, held, rng = OpenWindows(64), [], random.Random(1)
    for step in range(500):
        if rng.random() < 0.5 or not held:
            held.append((rng.randint(1, 64), step))
            tree.add(*held[-1])
        else:
            need = rng.randint(1, 64)
            found, fits = tree.take(need), [c for c, _ in held if c >= need]
            assert (found is None) == (not fits)
            if found:
                assert found[1] == min(fits)
                held.remove((found[1], found[0]))


def test_best_fit_keeps_every_token():
    rng = random.Random(3)
    for _ in range(50):
        items = [(i, 0, rng.randint(1, 100)) for i in range(rng.randint(0, 60))]
        closed, left = best_fit(items, 100, 2)
        assert all(98 <= sum(x[2] for x in w) <= 100 for w in closed) and sum(x[2] for x in left) <= 100
        pieces = sorted(x for w in [*closed, left] for x in w)
        for i, _, n in items:
            own = [(s, k) for j, s, k in pieces if j == i]
            assert [s for s, _ in own] == list(np.cumsum([0, *[k for _, k in own]])[:-1]) and sum(k for _, k in own) == n


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_packing(request, name):
    frame = request.getfixturevalue(name)
    whole = Tokenizer.from_file(VOCABULARY)
    wanted = Counter((r["doc_id"], tuple([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in frame.collect())
    pieces = pack(frame, VOCABULARY, portion=20_000).collect()
    assert all(r["length"] == len(r["ids"]) > 0 for r in pieces)
    sequences: dict = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert sequences.get(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 4096 and sum(n < 4096 - 16 for n in sequences.values()) <= 1
    spread = Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in pieces)
    for (doc, ids), copies in wanted.items():
        own = sorted((s, p) for d, s, p in spread if d == doc and ids[s:s + len(p)] == p)
        assert sum(len(p) * spread[doc, s, p] for s, p in own) >= copies * len(ids)
    assert sum(len(p) * n for (_, _, p), n in spread.items()) == sum(len(ids) * n for (_, ids), n in wanted.items())


def test_packing_nothing(nothing):
    assert pack(nothing, VOCABULARY).count() == 0


def test_tokens_equal_the_tokenizer():
    import pyarrow as pa

    texts = ["", " ", "Don't we'LL 'sabc ''d a1b2 x...!?", "<|endoftext|>a <|startoftext|> <|end", "<|ENDOFTEXT|>. The. THE, <|endoftext|>. x?y", "a.b 1.5, x!'s it.'s é. .é ”. e.\u0301", "À É ß ÿ × ÷ µ ª", "é ́a", "中文 テスト",
             "İ ς Σ ſ K", "a\tb\nc\x0bd\x0ce\r", "😀!! 'S", "x" * 400, "½²Ⅷ٣", "a\u0000b \x7f \x85c d e"]
    whole = Tokenizer.from_file(VOCABULARY)
    ids, first = WordTokens.of(VOCABULARY).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert WordTokens.of(VOCABULARY).counts(pa.array(texts)).tolist() == np.diff(first).tolist()


# Quality

def test_quality_facts(documents, edge):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for frame in (documents, edge):
        texts = Counter((r["doc_id"], brute.quality_facts(r["text"]), brute.good(r["text"])) for r in frame.collect())
        assert Counter((r["doc_id"], tuple(r[n] for n in names), r["kept"]) for r in judge(frame, names).collect()) == texts


def test_quality_order_changes_no_verdict(edge, nothing):
    order = [r.name for r in RULES]
    given = [Counter(judge(edge, order=o).collect()) for o in (order, order[::-1])]
    assert given[0] == given[1]
    assert sorted(x["name"] for x in cascade_order(edge)) == sorted(order) and len(cascade_order(nothing)) == len(RULES)
    kept = keep_good(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 4, 5, 6]
    assert keep_good(nothing).count() == 0


# Mixing

def plain_schedule(blocks: list[int], weights: list[int]) -> tuple[list[list[int]], list[list[Fraction]]]:
    """The fluid mix moment by moment, in fractions, and earliest deadline first over its windows by looking at all blocks."""
    left, now, times = [Fraction(n) for n in blocks], Fraction(0), [[Fraction(0)] for _ in blocks]
    while any(left):
        total = sum(w for w, n in zip(weights, left) if n)
        # The next moment at which some source has had a whole block or all it has.
        step = min((n - (n.numerator - 1) // n.denominator) * total / w for n, w in zip(left, weights) if n)
        now += step
        for i, w in enumerate(weights):
            if left[i]:
                left[i] -= step * w / total
                if left[i].denominator == 1:
                    times[i].append(now)
    open_blocks = {(i, k): (times[i][k].__floor__(), times[i][k + 1].__ceil__()) for i, n in enumerate(blocks) for k in range(n)}
    slots: list[list[int]] = [[] for _ in blocks]
    for slot in range(sum(blocks)):
        i, k = min((b for b, (release, _) in open_blocks.items() if release <= slot and b[1] == len(slots[b[0]])), key=lambda b: (open_blocks[b][1], b[0]))
        slots[i].append(slot)
        assert open_blocks.pop((i, k))[1] >= slot + 1
    return slots, times


def share(times: list[Fraction], t: int) -> Fraction:
    """What the fluid mix has given a source by a time between its block ends."""
    k = bisect_right(times, t) - 1
    return Fraction(k) if k == len(times) - 1 else k + (t - times[k]) / (times[k + 1] - times[k])


@pytest.mark.parametrize("seed", range(4))
def test_schedule_of_whole_runs(seed):
    """Sources of mixed size run out one after the other; every slot of the run stays within a block of the exact shares."""
    rnd = random.Random(seed)
    blocks = {f"s{i:02d}": rnd.choice([1, 2, 5, 9, 30, 60]) for i in range(25)}
    weights = {n: rnd.choice([1, 3, 7, 20]) if seed % 2 else round(b ** 0.5 * 1024) for n, b in blocks.items()}
    wanted, times = plain_schedule(list(blocks.values()), list(weights.values()))
    found = schedule({**blocks, None: 0}, {**weights, None: 5})
    assert {n: s.tolist() for n, s in found.items()} == dict(zip(blocks, wanted))
    for own, ends in zip(wanted, times):
        for t in range(sum(blocks.values()) + 1):
            # Linear between the ends of its blocks at least when no other source runs out there; at the ends exactly.
            assert abs(bisect_left(own, t) - share(ends, t)) < 1 or any(e[-1] not in ends and e[-1] < ends[-1] for e in times)
        for k, end in enumerate(ends[1:]):
            assert bisect_left(own, end.__ceil__()) >= k + 1 and own[k] >= ends[k].__floor__()


def test_sixty_sources_that_run_out():
    rnd = random.Random(60)
    blocks = {f"s{i:02d}": rnd.randint(1, 400) for i in range(60)}
    weights = weights_of({n: b * 32 for n, b in blocks.items()})
    slots = schedule(blocks, weights)
    assert sorted(s for own in slots.values() for s in own.tolist()) == list(range(sum(blocks.values())))
    had, exact = dict.fromkeys(blocks, 0), dict.fromkeys(blocks, Fraction(0))
    owner = {s: n for n, own in slots.items() for s in own.tolist()}
    for t in range(sum(blocks.values())):
        had[owner[t]] += 1
        rest = Fraction(1)
        while rest and (going := [n for n in blocks if exact[n] < blocks[n]]):
            total = sum(weights[n] for n in going)
            step = min([rest, *[(blocks[n] - exact[n]) * total / weights[n] for n in going]])
            for n in going:
                exact[n] += step * weights[n] / total
            rest -= step
        assert all(abs(had[n] - exact[n]) < 1 for n in blocks)
        if t > 900:
            break


def test_many_sources_and_large_tables():
    """No source is too many, and blocks grow with the rows, so their number does not."""
    slots = schedule({f"s{i}": 1 for i in range(20_000)} | {"large": 2000}, {f"s{i}": 10 for i in range(20_000)} | {"large": 2222})
    early = [int(n) for n in (slots["large"] < 1100).nonzero()[0]]
    assert abs(len(early) - 1100 * 2222 / (200_000 + 2222)) < 1
    assert rows_per_block(10 ** 6) == 32 and 10 ** 11 / rows_per_block(10 ** 11) <= 1 << 20


def test_mixing(edge, nothing, documents):
    mixed = mix(edge, block_rows=2)
    found = mixed.collect()
    assert len(found) == edge.count() and "slot" in mixed.columns and "kept" in mixed.columns
    assert len({(r["slot"], r["place"]) for r in found}) == len(found)
    for r in mix(documents, {f"src{i}": 1 for i in range(20)}, block_rows=2).groupBy("slot").agg(F.countDistinct("source").alias("n")).collect():
        assert r["n"] == 1
    assert mix(nothing).count() == 0


# Lines

def test_lines(spark, edge, nothing):
    rows = [(i, f"h{i % 2}", "\n".join([f"own {i}", " menu ", "odd" if i % 4 == 1 else "x", f"own {i}"])) for i in range(20)]
    rows += [(90, "solo", "menu\nmenu"), (91, "h0", ""), *[(100 + i, "h1", "copied\noften") for i in range(30)]]
    frame = spark.createDataFrame(rows, "doc_id long, host string, text string")
    found = {r["doc_id"]: r for r in drop_boilerplate(frame, F.col("host"), ratio=0.3, least=5, dropped="lines_dropped").collect()}
    assert {i: r["text"] for i, r in found.items()} == brute.without_boilerplate(rows, 0.3, 5)
    assert found[0]["lines_dropped"] == 2 and found[90]["lines_dropped"] == 0
    out = drop_boilerplate(edge, F.col("source"))
    assert out.columns == edge.columns and out.where("text IS NULL").count() == 2 and out.count() == edge.count()
    assert drop_boilerplate(nothing, F.col("source")).count() == 0


def test_small_hosts_lose_their_boilerplate(spark):
    rows = [(h * 100 + i, f"host{h}", f"menu\nown {h} {i}\n{'twice' if i < 2 else 'other'}") for h in range(2, 12) for i in range(h)]
    out = drop_boilerplate(spark.createDataFrame(rows, "doc_id long, host string, text string"), F.col("host")).collect()
    texts = {r["doc_id"]: r["text"] for r in out}
    assert texts == brute.without_boilerplate(rows)
    assert all(("menu" in t) == (i < 300) for i, t in texts.items()) and "twice" in texts[500]


def test_very_many_blank_lines(spark):
    html = "<p>a</p>" + "\n" * 100_000 + " \t\r\n" * 50_000 + "<p>b" + " " * 50_000 + "c</p>"
    row = spark.createDataFrame([(html,)], "html string").select(html_lines(F.col("html")).alias("t")).first()
    assert row["t"] == "\na\nb" + " " * 50_000 + "c\n"


def test_hosts_and_html(spark):
    row = spark.range(1).select(
        host_of(F.lit("HTTPS://me@WWW.Site.org:80/x?y#z")).alias("a"), host_of(F.lit("no url")).alias("b"), host_of(F.lit(None).cast("string")).alias("c"),
        html_lines(F.lit("<p>one</p><script>x</script><p>t<b>w</b>o<!-- c --><br>three")).alias("d")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ("www.site.org", None, None, "\none\ntwo\nthree")


# Secrets

def test_secrets(spark, edge, nothing):
    rng = random.Random(2)
    texts = ["token: token: abcdefgh", "pass PASSWORD = 'abc12' x", "API-KEY=zzzzzzz", "Api_Key : \"zzzzzzz\"", "é😀 secret=abcdef.-_/+", "AKIA" + "Z" * 16,
             "AKIAAKIA", "0123456789abcdef01234567 0123456789abcdef0123456", "paſſword=abcdefgh"]
    texts += [f"some words password={''.join(rng.choices('0123456789abcdef', k=30))} of ordinary identifiers like getUserName or max_value {i}" for i in range(60)]
    texts += ["key " + "".join(rng.choices("0123456789abcdef", k=11)) + "".join(rng.choices("0123456789abcdef", k=12)), "antidisestablishmentarianism"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in find_secrets(frame).select("doc_id", written(F.col("secrets")).alias("spans")).collect()}
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for i, t in enumerate(texts):
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        wanted = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert ",".join(x for x in found[i].split(",") if not x.startswith("markov")) == wanted, t
    assert found[len(texts) - 2].startswith("markov:4:") and found[len(texts) - 1] == ""
    out = find_secrets(edge)
    assert out.count() == edge.count() and set(out.columns) == set(edge.columns)
    assert find_secrets(nothing).count() == 0 and not any(train(nothing))


def plain_base_spans(text):
    found = []
    for k, (pattern, group, least) in enumerate(PATTERNS.values()):
        found += [(m.start(), k, m.end(), m[group]) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return sorted(found)


def plain_cells(s):
    codes = [0, *[ALPHABET.find(c) + 1 for c in s]]
    return [a * WIDTH + b for a, b in zip(codes, codes[1:], strict=False)]


def test_secret_models_against_a_plain_count(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n: "".join(rng.choices(letters, k=n))
    texts = [f"password={draw(30)} readFileContents of_the_current_user_account é {draw(8)}_x" for _ in range(40)]
    # More secrets than a chunk holds, on both sides of and within other matches.
    texts.append(" ".join(f"secret: {draw(30)} the_ordinary_words_of_a_name_{draw(2)}" for _ in range(700)))
    texts.append(" ".join(f"{draw(60)} the_ordinary_words_of_a_name" for _ in range(700)))
    texts += ["no labelled value here " + draw(40), draw(3000), "", None]
    values, ordinary = set(), set()
    for t in texts:
        base = plain_base_spans(t or "")
        if any(re.search(p, t or "", re.A) for p, _, _ in PATTERNS.values()):
            values.update(x[3] for x in base)
            rest = t
            for p, _, _ in PATTERNS.values():
                rest = re.sub(p, " ", rest, flags=re.A)
            ordinary.update(v for m in re.findall(IDENTIFIER, rest) for v in (m, m.upper(), m.lower()))
    counts = [Counter(c for s in strings for c in plain_cells(s)) for strings in (ordinary, values)]
    logs = []
    for found in counts:
        rows = np.array([found[i] for i in range(WIDTH * WIDTH)], float).reshape(WIDTH, WIDTH) + 0.5
        logs.append(np.log(rows / rows.sum(1, keepdims=True)).ravel())
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratios = train(frame)
    assert np.allclose(ratios, logs[1] - logs[0])
    found = {r["doc_id"]: r["secrets"] for r in find_secrets(frame, ratios).collect()}
    for i, t in enumerate(texts):
        base = [x[:3] for x in plain_base_spans(t or "")]
        more = [(m.start(), 3, m.end()) for m in re.finditer(CANDIDATE, t or "")
                if re.search("[A-Za-z]", m[0]) and sum(ratios[c] for c in plain_cells(m[0])) >= EVIDENCE
                and not any(a < m.end() and m.start() < e for a, _, e in base)]
        assert [tuple(x) for x in found[i]] == sorted(base + more), i
    assert len(found[40]) >= 700 and sum(x["kind"] == 3 for x in found[41]) > 256


def test_secrets_of_a_text_with_a_megabyte_without_space(spark):
    rng = random.Random(6)
    blob = "".join(rng.choices(ALPHABET[:64], k=1_000_000))
    frame = spark.createDataFrame([(1, f"token={blob[:30]} plain_words_for_contrast {blob} secret=abcdef")], "doc_id long, text string")
    begin = time.monotonic()
    spans = [tuple(x) for x in find_secrets(frame).collect()[0]["secrets"]]
    assert spans[0] == (0, 0, 36) and spans[-1][1] == 0 and time.monotonic() - begin < 60


def test_secret_digests_against_plain_patterns(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op1_secret_scan(spark, "/root/testdata/sf0.001").collect():
        base = plain_base_spans(texts[r["doc_id"]])
        spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e, _ in base)
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in base) for k in range(3)]


# Licences

def test_licenses(spark, edge, nothing):
    texts = [SENTENCES[3] + " " + SENTENCES[4], SENTENCES[3].replace(" to ", "\nto ") + "\n\n" + SENTENCES[4], SENTENCES[4], "Intro.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.",
             "\n".join(SENTENCES[6:10]), "released UNDER the -- mit license", None]
    found = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["licenses"], r["terms"]) for r in found] == [
        (["MIT"], "permissive"), (["MIT"], "permissive"), ([], ""), (["MIT", "CC-BY-NC-4.0"], "restricted"), (["Apache-2.0"], "permissive"), (["MIT"], "permissive"), ([], "")]
    assert scan_licenses(edge).count() == edge.count() and scan_licenses(nothing).count() == 0


# Token counts

def test_rollup(spark, tmp_path):
    store = TokenRollup(spark, str(tmp_path / "store"))
    shape = "op string, doc_id long, source string, lang string, version string, tokens long, seq int"
    make = lambda *rows: spark.createDataFrame(list(rows), shape)
    assert store.totals().count() == 0
    first = make(("insert", 1, "a", "en", "v1", 10, 0), ("insert", 2, "a", None, "v1", 5, 0), ("insert", 3, "b", "en", "v1", None, 0),
                 ("insert", None, "b", "en", "v1", 9, 0), ("odd", 4, "b", "en", "v1", 9, 0))
    assert store.apply("one", first) and not store.apply("one", first)
    second = make(("revise", 1, "a", "en", "v2", 12, 1), ("revise", 1, "a", "en", "v2", 11, 2), ("delete", 2, None, None, None, None, 0),
                  ("delete", 9, "a", "en", "v1", 4, 0), ("insert", 3, "b", "en", "v1", 7, 0))
    (tmp_path / "store" / "entries" / "two").mkdir(parents=True)  # what a broken run may leave
    assert store.apply("two", second)
    assert sorted(tuple(r) for r in store.totals().collect()) == [("a", "en", "v2", 1, 11), ("b", "en", "v1", 1, 7)]
    assert store.apply("none", make().limit(0)) and store.committed() == ["none", "one", "two"]
    assert store.current().count() == 2


def test_rollup_against_a_plain_count_over_many_batches(spark, tmp_path):
    rng, plain = random.Random(3), {}
    store = TokenRollup(spark, str(tmp_path / "store"), buckets=2)
    plans = []
    for n in range(12):
        rows = []
        for i in rng.sample(range(40), 9):
            op, key = rng.choice(["insert", "revise", "delete"]), (rng.choice(["a", None]), rng.choice(["en", "é"]), f"v{n % 2}")
            rows.append((op, i, *key, rng.randint(0, 9)))
            plain.pop(i, None)
            if op != "delete":
                plain[i] = (*key, rows[-1][-1])
        assert store.apply(f"batch {n}/x", spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, version string, tokens long"))
        plans.append(len(store.current()._jdf.queryExecution().optimizedPlan().toString()))
        assert max(map(len, store._state()["entries"].values())) <= 8 and len(store._state()["sums"]) <= 8
    wanted = {}
    for source, lang, version, tokens in plain.values():
        docs, total = wanted.get((source, lang, version), (0, 0))
        wanted[source, lang, version] = docs + 1, total + tokens
    assert {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()} == wanted
    assert {r["doc_id"]: tuple(r)[1:] for r in store.current().collect()} == plain
    assert "batch 3/x" in store.committed() and not store.apply("batch 3/x", spark.createDataFrame([], "op string"))
    assert max(plans) - min(plans) < 50  # one scan, whatever the number of batches


def test_token_counts_against_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    wanted = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        key = (r["source"], r["lang"], "word_bpe_49k")
        docs, total = wanted.get(key, (0, 0))
        wanted[key] = docs + 1, total + len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in queries.op2_token_counts(spark, "/root/testdata/sf0.001").collect()} == wanted


def test_token_counts_of_odd_tables(spark, tmp_path):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = [(1, "a", "en", "some words"), (1, "a", "en", "some words"), (None, "a", None, "more é"), (2, None, "en", None), (3, "b", "en", ""),
            (4, "b", "en", "x" * 50_000), (5, "b", "en", "last")]
    wanted = {}
    for _, source, lang, text in rows:
        docs, total = wanted.get((source, lang), (0, 0))
        wanted[source, lang] = docs + 1, total + len(tokenizer.encode(text or "", add_special_tokens=False).ids)
    for name, kept in (("full", rows), ("empty", [])):
        folder = str(tmp_path / name)
        frame = spark.createDataFrame(kept, "doc_id long, source string, lang string, text string").withColumns({"tokens": F.lit(1), "bucket": F.lit(2), "op": F.lit("x")})
        frame.write.parquet(f"{folder}/documents.parquet")
        # Labels repeat, are null, or name no document.
        labels = spark.createDataFrame([(1, 0), (1, 0), (None, 0), (9, 0), (5, 1), (4, None)], "doc_id long, quality int")
        labels.write.parquet(f"{folder}/labels.parquet")
        found = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in queries.op2_token_counts(spark, folder).collect()}
        assert found == (wanted if kept else {})


# Toxicity

def test_toxicity_on_rows_not_seen(spark, edge, nothing):
    rng = random.Random(4)
    bad, stock = ["blorkish", "snarfhead", "grumptoad"], [f"{a}{b}{c}" for a in ("ta", "ren", "mo", "il") for b in ("ve", "sto", "ka") for c in ("r", "ne", "lus", "")]
    texts = [(i, " ".join(rng.choices(stock, k=rng.randint(20, 200)) + ([rng.choice(bad) for _ in range(3)] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(900)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    usable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = fit(frame, frame, usable)
    got = {r["doc_id"]: r["score"] for r in score(frame, model).collect()}
    held = [(i, y) for i, _, y in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in score(edge, model).collect()) and score(edge, model).count() == edge.count()
    assert score(nothing, fit_texts([], [])).count() == 0
    assert fit(nothing.withColumn("toxic", F.lit(1)), nothing.withColumn("toxic", F.lit(1))).weights == (0.0,) * 6


# Registered queries

@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and all(kind != "void" for _, kind in found.dtypes)


def test_windows_by_bytes():
    starts, ends, parent = cut_windows(np.array([0, 300, 2000]), np.array([300, 2000, 60_000]))
    assert (ends - starts).max() <= 1024 and parent[:1].tolist() == [0] and np.bincount(parent).tolist() == [1, 2, 61]
    for n, (a, b) in enumerate([(0, 300), (300, 2000), (2000, 60_000)]):
        own = parent == n
        assert starts[own][0] == a and ends[own][-1] == b and (starts[own][1:] == ends[own][:-1] - 64).all()


def test_toxicity_at_the_end_of_an_unspaced_text(spark):
    """What marks a class is seen wherever it stands, in one word of 50,000 bytes too; gains are those of windows alone."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(3, 8)))
    bad = ["vilescum", "hatefool", "trashpig", "dumbrat"]
    texts = [" ".join([word() for _ in range(60)] + ([rnd.choice(bad) for _ in range(8)] if i % 2 else [])) for i in range(600)]
    model = fit_texts([t for i, t in enumerate(texts) if i % 2], [t for i, t in enumerate(texts) if not i % 2])
    long = "".join(word() for _ in range(9100))[:50_000]
    rows = [(1, long), (2, long + "vilescumhatefooltrashpigdumbrat" * 3), (3, "vilescumhatefooltrashpigdumbrat" * 3 + long)]
    found = {r["doc_id"]: r["score"] for r in score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found[2] > found[1] + 0.2 and abs(found[2] - found[3]) < 0.1
    compressors = Compressors(model.toxic, model.ordinary)
    data = (" " + rows[1][1]).encode()
    starts, ends, _ = cut_windows(np.array([0]), np.array([len(data)]))
    gains = compressors.gains(data, starts, ends)
    single = [compressors.gains(data[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends)]
    assert gains.tolist() == single and gains[-1] > 5 and np.abs(gains[:-2]).max() <= 4
