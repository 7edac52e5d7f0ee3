"""Descriptive statistics in long form: one row per column, few scans for all columns together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import families as fam
from ..functions.values import as_micros, clean, raw
from .counts import key_counts, top_of_keys, with_all_columns
from .quantiles import day_scale, root_scale, quantile_columns

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
# Columns per aggregate: generated code stays within what the JVM compiles. Each batch reads its own columns.
BATCH = 40


def _per_column(df: DataFrame, columns: list[str], stats: dict[str, callable]) -> DataFrame:
    """One pass per batch of columns: `column` and one field per statistic."""
    parts = []
    for start in range(0, len(columns), BATCH):
        batch = columns[start:start + BATCH]
        wide = df.agg(*[
            F.struct(F.lit(name).alias("column"), *[make(name).alias(stat) for stat, make in stats.items()]).alias(f"c{i}")
            for i, name in enumerate(batch)
        ])
        parts.append(wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(batch))]))))
    return reduce(DataFrame.unionByName, parts)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`column`, `missing`: nulls and NaN per column."""
    return _per_column(df, columns or fam.data_columns(df), {"missing": lambda c: F.count_if(clean(df, c).isNull())})


def _measure(df: DataFrame, name: str) -> Column | None:
    """A number or moment (in microseconds since the epoch) as a double; nothing for other columns."""
    family = fam.family_of(fam.type_of(df, name))
    if family == fam.NUMERIC:
        return clean(df, name).cast("double")
    return as_micros(raw(name)).cast("double") if family == fam.DATETIME else None


def overview(df: DataFrame, columns: list[str] | None = None) -> Column:
    """What one scan tells of all columns, as a scalar subquery: `rows` and, per column in order, `column, count, missing, mean,
    std, min, max`, the last four of numbers and moments only.

    Whoever uses the same subquery more than once in a query pays for one scan.
    """
    columns = fam.data_columns(df) if columns is None else columns
    none, found = F.lit(None).cast("double"), []
    for start in range(0, max(len(columns), 1), BATCH):
        batch, structs = columns[start:start + BATCH], []
        values = df.select(*[clean(df, c).alias(f"c{i}") for i, c in enumerate(batch)],
                           *[m.alias(f"m{i}") for i, m in enumerate([_measure(df, c) for c in batch]) if m is not None])
        for i, name in enumerate(batch):
            m = F.col(f"m{i}") if f"m{i}" in values.columns else None
            stats = [none] * 4 if m is None else [F.avg(m), F.stddev_samp(m), F.min(m), F.max(m)]
            structs.append(F.struct(F.lit(name).alias("column"), F.count(f"c{i}").alias("count"), F.count_if(F.col(f"c{i}").isNull()).alias("missing"),
                                    *[x.alias(n) for x, n in zip(stats, ("mean", "std", "min", "max"))]))
        kind = "array<struct<column: string, count: bigint, missing: bigint, mean: double, std: double, min: double, max: double>>"
        whole = F.struct(F.count(F.lit(1)).alias("rows"), F.array(*structs).cast(kind).alias("columns"))
        found.append(values.agg(whole.alias("overview")).scalar())
    return F.struct(found[0]["rows"].alias("rows"), F.concat(*[x["columns"] for x in found]).alias("columns"))


def quartiles(df: DataFrame, numbers: list[str], times: list[str]) -> DataFrame:
    """`column` and its exact quartiles as doubles; all columns share the passes over the table. A column without values is absent."""
    values = df.select(*[_measure(df, c).alias(c) for c in numbers + times])
    long = values.unpivot([], [raw(c) for c in numbers + times], "column", "value")

    def scale(value: Column) -> Column:
        return F.when(F.col("column").isin(*times), day_scale(value)).otherwise(root_scale(value))

    return quantile_columns(long, ["column"], "value", QUARTILES, scale)


def measures(df: DataFrame, numbers: list[str], times: list[str]) -> DataFrame:
    """`column`, `count`, `mean`, `std`, `min`, quartiles, `max` as doubles, the quartiles exact; times are
    in microseconds since the epoch."""
    moments = df.sparkSession.range(1).select(F.inline(overview(df, numbers + times)["columns"]))
    joined = moments.join(quartiles(df, numbers, times), "column", "left")
    return joined.select("column", "count", "mean", "std", "min", *QUARTILES, "max")


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`column`, `count`, `mean`, `std`, `min`, quartiles, `max`."""
    return measures(df, columns or fam.numeric_columns(df), [])


def as_moment(micros: Column) -> Column:
    return F.timestamp_micros(F.round(micros).cast("bigint"))


def describe_datetime(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`column`, `count`, `mean`, `min`, quartiles, `max` as timestamps; a deviation has no such form."""
    table = measures(df, [], columns or fam.time_columns(df))
    return table.select("column", "count", *[as_moment(raw(s)).alias(s) for s in ("mean", "min", *QUARTILES, "max")])


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`column`, `count`, `unique`, `top`, `freq` for text and boolean columns."""
    columns = columns or fam.columns_of(df, fam.CATEGORICAL, fam.BOOLEAN)
    return categorical_summary(df, columns, key_counts(df, columns))


def categorical_summary(df: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """The same from `key_counts`, whose rows are combined per task before one row per column moves on."""
    found = keys.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"))
    tops = top_of_keys(df, columns, keys, 1).select("column", F.col("value").alias("top"), F.col("n").alias("freq"))
    zero = F.lit(0).cast("bigint")
    return with_all_columns(df, columns, found.join(tops, "column", "left"), count=zero, unique=zero)
