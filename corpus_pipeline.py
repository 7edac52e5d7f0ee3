"""The corpus pipeline: quality rules, line dedup, near dedup, source mix and packing over `documents`.

Each stage takes what its predecessor kept, is written as Parquet and reread. All but the last return the columns of
their input; the last returns pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelmill.llm.common import settle, table
from panelmill.llm.line_dedup import PASSAGE_WORDS, drop_boilerplate
from panelmill.llm.mixing import in_order, mix, slots_of
from panelmill.llm.near_dedup import near_duplicates
from panelmill.llm.packing import pack
from panelmill.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, unchanged."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that more than the ratio of their source's documents share; `n_chars` follows.

    Of a long line that several documents of a source share at any ratio, the document with the smallest id keeps it.
    """
    cleaned = drop_boilerplate(docs, F.col("source"), passage_words=PASSAGE_WORDS, order=F.col("doc_id"))
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows without an id all stay."""
    gone = near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows in the order of the mix: every file holds the sources by their weights."""
    mixed = mix(docs, names=("_mix_block", "_mix_slot", "_mix_place"))
    return in_order(mixed, slots_of(docs), int(spark.conf.get("spark.sql.shuffle.partitions")), "_mix_slot", "_mix_place").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of all documents."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]

# SQL has no twin of the quality cascade's facts, near-duplicate groups and packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
