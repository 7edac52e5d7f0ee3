"""Value counts, shares, distinct values, top values of many columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.values import clean, raw


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """`value`, `n` per distinct non-null value. Counts are combined on the map side, so a value that
    fills a third of the table reaches the shuffle as one row per task."""
    key = clean(df, column)
    return df.where(key.isNotNull()).groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def by_count() -> list[Column]:
    """Most frequent first, ties by value."""
    return [F.col("n").desc(), F.col("value").asc()]


def present_rows(df: DataFrame, column: str) -> Column:
    """Number of non-null values as a scalar subquery: a one-column count, no window, no shuffle of rows."""
    return df.agg(F.count(clean(df, column)).alias("present")).scalar()


def value_percentages(df: DataFrame, column: str) -> DataFrame:
    """`value`, `n`, `percentage` of all non-null rows, whatever is cut off later."""
    share = F.col("n") / present_rows(df, column) * F.lit(100.0)
    return value_counts(df, column).withColumn("percentage", share)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    key = clean(df, column)
    return df.where(key.isNotNull()).select(key.alias(column)).distinct()


# A text of up to so many bytes is its own key in a count; of a longer one the key has its beginning and a digest.
KEY_BYTES = 32
# Keys whose texts are looked up through a broadcast; a column with more of them is counted by its texts.
LOOKED_UP = 1000


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """`column`, `value` as text, one row per cell that has a value."""
    texts = df.select(*[clean(df, name).cast("string").alias(name) for name in columns])
    return texts.unpivot([], [raw(name) for name in columns], "column", "value").where(F.col("value").isNotNull())


def _key(value: Column) -> Column:
    """A key of bounded size that tells texts apart and sorts as they do, up to KEY_BYTES."""
    whole = value.cast("binary")
    return F.when(F.octet_length(value) <= KEY_BYTES, whole).otherwise(F.concat(F.substring(whole, 1, KEY_BYTES), F.unhex(F.md5(whole))))


def key_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """`column`, `key`, `n` for many columns in one scan and one shuffle, without a long text in it.

    Values are compared as text, by 128-bit digests where they are long. The key of the shuffle is (column, key), so one wide or
    skewed column spreads over all tasks, and a value on a third of all rows is one row per task.
    """
    return _long(df, columns).select("column", _key(F.col("value")).alias("key")).groupBy("column", "key").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values per column: `column`, `rank`, `value`, `n`, ties by value."""
    return top_of_keys(df, columns, key_counts(df, columns), k)


def top_of_keys(df: DataFrame, columns: list[str], keys: DataFrame, k: int) -> DataFrame:
    """The same from `key_counts`.

    Two phases: keys are ranked by count and by the beginning they hold, ties of both included, which leaves few candidates;
    then only their texts are fetched. A short text is its own key. The others are counted again as whole texts in a second scan,
    which meets the candidates in a broadcast of at most LOOKED_UP keys per column. If more texts of a column share
    the last count and beginning, the column's texts with that beginning are all counted. Without long candidates
    adaptive execution leaves the second scan out.
    """
    ranked = keys.selectExpr("*", f"substring(key, 1, {KEY_BYTES}) AS start").selectExpr(
        "*", "rank() OVER (PARTITION BY column ORDER BY n DESC, start) AS at").where(f"at <= {k}")
    short = ranked.where(f"length(key) <= {KEY_BYTES}").selectExpr("column", "string(key) AS value", "n")
    few = ranked.where(f"length(key) > {KEY_BYTES}").selectExpr(
        "*", "row_number() OVER (PARTITION BY column ORDER BY at, key) AS no").where(f"no <= {LOOKED_UP + 1}")
    wanted = few.selectExpr("column", "start", "key", f"max(no) OVER (PARTITION BY column) > {LOOKED_UP} AS every").groupBy("column", "start").agg(
        F.collect_list("key").alias("keys"), F.bool_or("every").alias("every"))
    rows = _long(df, columns).where(f"octet_length(value) > {KEY_BYTES}").selectExpr("*", f"substring(binary(value), 1, {KEY_BYTES}) AS start")
    found = rows.join(F.broadcast(wanted), ["column", "start"]).withColumn("key", _key(F.col("value"))).where("every OR array_contains(keys, key)")
    whole = short.unionByName(found.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    shown = whole.selectExpr("column", "row_number() OVER (PARTITION BY column ORDER BY n DESC, value) AS rank", "value", "n")
    return shown.where(f"rank <= {k}").selectExpr("column", "bigint(rank) AS rank", "value", "n")


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """`column`, `unique_count` per column: exact in one shuffle on (column, digest), or a sketch.

    What is shuffled is a 128-bit digest of each value as text, so its size does not depend on the texts.
    """
    if approximate:
        sketches = df.agg(*[F.approx_count_distinct(clean(df, c)).alias(c) for c in columns])
        return sketches.unpivot([], [raw(c) for c in columns], "column", "unique_count")
    digests = df.select(*[F.unhex(F.md5(clean(df, c).cast("string").cast("binary"))).alias(c) for c in columns])
    long = digests.unpivot([], [raw(c) for c in columns], "column", "digest").where("digest IS NOT NULL").distinct()
    counted = long.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    return with_all_columns(df, columns, counted, unique_count=F.lit(0).cast("bigint"))


def name_table(spark: SparkSession, columns: list[str]) -> DataFrame:
    """`position`, `column`: one literal row per name, so its size is that of the schema."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column")) for i, c in enumerate(columns)])
    return spark.range(1).select(F.inline(rows))


def with_all_columns(df: DataFrame, columns: list[str], found: DataFrame, **defaults: Column) -> DataFrame:
    """Add a row for every column that has no value at all."""
    joined = name_table(df.sparkSession, columns).join(found, "column", "left")
    return joined.select(*[F.coalesce(raw(c), defaults[c]).alias(c) if c in defaults else raw(c) for c in found.columns])
