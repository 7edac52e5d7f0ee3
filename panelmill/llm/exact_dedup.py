"""Exact duplicates by a tree of merges of sorted digest runs.

Every partition turns its documents into a run: one record per digest, with how many rows have it and which of them
is to stay. In each binomial round a lane meets the few lanes whose number differs from its own in one digit, and
every one of them receives the records whose digest has its digit there. A round is one grouped aggregate: the sender
merges what it holds before the exchange, the receiver merges the sorted runs that arrive. After the last round the
digest alone names the lane, and every digest has one record. A digest is never gathered in rows, only in records: at
most one per lane and round. A record carries a second hash and the length of the normalised text; records are merged
only where all three agree, so the smallest identifier kept at each level is one of verified equal texts.

The answers go back the way they came: to the lanes that hold a digest, then to the rows of each lane. A text on a
third of all rows is therefore spread over all lanes in the last join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle, text_of

KEY = ["_digest", "_hash", "_length"]


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fan_in: int = 4) -> DataFrame:
    """One row per input row: `doc_id, keep_id, group_size, kept, text_sha256`.

    Texts are equal when they are after deleting every space and control 9 to 13; null counts as empty, and all empty
    texts are equal. The row with the most characters in its original text stays, then the smallest id, a null id
    last. Rows that repeat an id are rows of their own: exactly one row of a group is kept. Other columns of `docs`
    are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    wanted, rounds = int(spark.conf.get("spark.sql.shuffle.partitions")), 1
    while fan_in ** rounds < wanted:
        rounds += 1
    lanes = fan_in ** rounds
    text = text_of(text_column)
    normal = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.length(text).alias("_chars"), normal.alias("_normal"))
    rows = settle(rows.select(
        "doc_id", "_chars", F.unhex(F.sha2("_normal", 256)).alias("_digest"), F.xxhash64("_normal").alias("_hash"),
        F.length("_normal").alias("_length"), F.monotonically_increasing_id().alias("_row"),
        F.pmod(F.spark_partition_id(), F.lit(lanes)).alias("_lane")), "digests")
    # The greatest record stays: most characters, then the smallest id and row, as the complement turns order round.
    record = F.struct("_chars", F.bitwise_not("doc_id").alias("_id"), F.bitwise_not("_row").alias("_at"))
    runs = rows.select("_lane", *KEY, F.lit(1).cast("bigint").alias("_copies"), record.alias("_best"))
    place = F.pmod("_hash", F.lit(lanes))
    for r in range(rounds):
        step = fan_in ** r
        digit = lambda lane: F.pmod(F.floor(lane / step), F.lit(fan_in))
        partner = (F.col("_lane") + (digit(place) - digit(F.col("_lane"))) * step).cast("int")
        runs = (runs.groupBy(partner.alias("_lane"), *KEY)
                .agg(F.sum("_copies").alias("_copies"), F.max("_best").alias("_best")))
    answers = runs.select(*KEY, "_copies", "_best")
    held = rows.select("_lane", *KEY).distinct().join(answers, KEY)
    best = F.col("_best")
    return rows.join(held, ["_lane", *KEY]).select(
        "doc_id", F.bitwise_not(best["_id"]).alias("keep_id"), F.col("_copies").alias("group_size"),
        (F.bitwise_not(best["_at"]) == F.col("_row")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))
