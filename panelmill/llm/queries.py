"""The queries of this folder and their SQL twins, for `__spark_entry__.py`."""

from __future__ import annotations

import string
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir
from . import chat
from .alignment import align_documents
from .common import blocks, settle, table, text_of
from .exact_dedup import exact_duplicates
from .licenses import oracle, scan_licenses
from .line_dedup import drop_boilerplate, host_of, html_lines
from .merkle import manifest
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .quality import judge
from .rollups import TokenRollup
from .secrets import KINDS, find_secrets, number_of, written
from .tokens import WordTokens
from .toxicity import fit, score
from .words import Block

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op5_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = judge(table(spark, sf_dir, "documents"), facts=base)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *base, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    kept = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]

    def checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            sums = [zlib.crc32(row.values.to_numpy().astype("<u4").tobytes()) for row in ids]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sums, pa.int64())], [*kept, "ids_crc32"])

    return pieces.mapInArrow(checked, ", ".join(f"{c} long" for c in [*kept, "ids_crc32"]))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # Read twice below, so the markup is taken out once.
    pages = settle(pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")), "plain")
    return drop_boilerplate(pages, F.col("host"), dropped="lines_dropped")


ORACLE["op9_line_dedup"] = r"""
WITH plain AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|nav|article|header|footer|title|head|body|html)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), '(?:[ \t\r]*\n)+[ \t\r]*', chr(10), 'g') AS text
  FROM pages
), lines AS (
  SELECT page_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM plain WHERE text IS NOT NULL
), keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM lines),
totals AS (SELECT host, count(DISTINCT text) AS host_pages FROM plain WHERE host IS NOT NULL GROUP BY host),
bad AS (
  SELECT host, k FROM (SELECT host, k, count(DISTINCT text) AS pages FROM keyed JOIN (SELECT page_id AS p, text FROM plain) ON p = page_id WHERE k <> '' GROUP BY host, k) JOIN totals USING (host)
  WHERE pages >= 3 AND pages > host_pages * 0.1::DOUBLE
), kept AS (
  SELECT page_id, coalesce(string_agg(CASE WHEN bad.k IS NULL THEN line END, chr(10) ORDER BY pos), '') AS text,
    count(bad.k) AS lines_dropped
  FROM keyed LEFT JOIN bad ON keyed.host = bad.host AND keyed.k = bad.k GROUP BY page_id
)
SELECT plain.page_id, plain.host, kept.text, coalesce(lines_dropped, 0) AS lines_dropped FROM plain LEFT JOIN kept USING (page_id)
"""


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [number_of(kind).alias(f"n_{kind}") for kind in KINDS[:3]]
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"), "terms")


ORACLE["op8_license_scan"] = oracle()


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional counts by words, revised to tokens; documents labelled as of low quality are withdrawn and given back.

    Each batch counts once, and the totals are those of all rows: a row has a key of its own, also without a doc_id.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text_of().alias("text"))
    path = public_tokenizers.path("word_bpe_49k.json")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            text = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "source", "lang")], pa.array(Block(text).n_words.astype("int64")),
                 pa.array(WordTokens.of(path).counts(text).astype("int64"))], ["doc_id", "source", "lang", "words", "tokens"])

    counts = docs.mapInArrow(counted, "doc_id long, source string, lang string, words long, tokens long")
    # The keys are fixed by being written.
    counts = settle(counts.withColumn("row_key", F.monotonically_increasing_id()), "counts")
    rollup = TokenRollup(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/panelmill-{uuid.uuid4().hex}/rollup")
    key = [F.col("row_key").alias("doc_id"), "source", "lang"]
    first = counts.select(F.lit("insert").alias("op"), *key, F.lit("words").alias("version"), F.col("words").alias("tokens"))
    exact = counts.select(F.lit("revise").alias("op"), *key, F.lit("word_bpe_49k").alias("version"), "tokens")
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    listed = counts.join(poor, "doc_id", "left_semi").select(*key, F.lit("word_bpe_49k").alias("version"), "tokens")
    gone, back = (listed.select(F.lit(op).alias("op"), "*") for op in ("delete", "insert"))
    for name, changes in (("load", first), ("recount", exact), ("withdraw", gone), ("restore", back), ("recount", exact)):
        rollup.apply(name, changes)
    return rollup.totals()


ORACLE["op6_quality_rules"] = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
per_line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
often AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM often GROUP BY doc_id),
facts AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(t) - length(replace(t, '!', '')) AS shouts,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower
  FROM w LEFT JOIN per_line USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 5 * shouts > n_words OR 2 * upper > upper + lower
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM judged
"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return manifest(table(spark, sf_dir, "documents"), changes={"text": lowered}, where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


_CRC = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, c:
    list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, c)), 4294967295::BIGINT))"""
_BLANK_OR = lambda c, v=None: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {v or c}::VARCHAR, '-')"
_LEAF = lambda text: f"sha256({' || '.join(_BLANK_OR(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {_BLANK_OR('text', text)})"
_NEXT = "list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], '')))"
_BEFORE, _AFTER = "array_to_string(nodes[pos - pos % 8 + 1:pos], '')", "array_to_string(nodes[pos + 2:pos - pos % 8 + 8], '')"
ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_LEAF('text')} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} END AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM documents
), levels AS (
  SELECT lang, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang
  UNION ALL SELECT lang, lvl + 1, {_NEXT} FROM levels WHERE len(nodes) > 1
), subs AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS lvl, list(subroot ORDER BY place) AS nodes FROM subs
  UNION ALL SELECT lvl + 1, {_NEXT} FROM tops WHERE len(nodes) > 1
), fold AS (
  SELECT doc_id, lang, leaf, 0 AS lvl, pos, coalesce(changed, leaf) AS h, '' AS proof FROM leaves
  UNION ALL SELECT doc_id, f.lang, leaf, f.lvl + 1, pos // 8, sha256({_BEFORE} || h || {_AFTER}), proof || {_BEFORE} || {_AFTER}
  FROM fold f JOIN levels l ON l.lang IS NOT DISTINCT FROM f.lang AND l.lvl = f.lvl AND len(nodes) > 1
), under AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, place AS pos, h, proof FROM fold f JOIN subs s ON s.lang IS NOT DISTINCT FROM f.lang
  JOIN levels l ON l.lang IS NOT DISTINCT FROM f.lang AND l.lvl = f.lvl AND len(nodes) = 1
), climb AS (
  FROM under UNION ALL SELECT doc_id, leaf, subroot, c.lvl + 1, pos // 8, sha256({_BEFORE} || h || {_AFTER}), proof || {_BEFORE} || {_AFTER}
  FROM climb c JOIN tops t ON t.lvl = c.lvl AND len(nodes) > 1
)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = nodes[1] AS verified
FROM climb c JOIN tops t ON t.lvl = c.lvl AND len(nodes) = 1
"""


@query
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and one more whose texts hold control strings, read back from the formatted output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = F.array(*[F.struct(F.lit(-1).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
                     for i, role in enumerate(("user", "assistant"))])
    found = chat.read_back(chat.format_chats(turns.unionByName(spark.range(1).select(F.inline(rows)))))
    return found.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples", "example_chars")


CONTROL = r"([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)"  # as in the template
ORACLE["op12_chat_format"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)
), w AS (
  SELECT *, row_number() OVER o AS pos,
    length('<|turn|>' || role || chr(10) || regexp_replace(text, '{CONTROL}', '\1\\\2\3', 'g') || '<|end|>' || chr(10)) AS n
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples, coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS example_chars
FROM s GROUP BY conv_id
"""


@query
def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
