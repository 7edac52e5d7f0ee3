"""Small samples for a profile: first rows and earliest moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import families as fam
from ..functions.values import iso, raw
from .ordering import first_rows, order_columns


def row_sample(df: DataFrame, order_by: str | list[str], limit: int = 10) -> DataFrame:
    """The first rows in row order with their number; a per-task top-k, never a full sort."""
    return first_rows(df, order_columns(order_by), limit)


def earliest_moments(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """`ordinal`, `moment`: the smallest distinct values of a date or timestamp column.

    The first `limit` days with data contain them all, and days are few: a count per day finds the cut,
    and only values up to it are made distinct.
    """
    present = df.where(raw(column).isNotNull())
    days = present.groupBy(F.to_date(raw(column)).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last_day = days.orderBy("day").limit(limit).agg(F.max("day").alias("day")).scalar()
    early = present.where(raw(column) < F.date_add(last_day, 1).cast(fam.type_of(df, column)))
    moments = early.select(raw(column).alias("moment")).distinct()
    return first_rows(moments, [F.col("moment").asc()], limit)


def time_sample(df: DataFrame, columns: int = 2, limit: int = 10) -> DataFrame:
    """`column`, `ordinal`, `moment` (text) for the first time columns of the table."""
    parts = [
        earliest_moments(df, name, limit).select(
            F.lit(name).alias("column"), "ordinal", iso(F.col("moment"), fam.type_of(df, name), " ").alias("moment")
        )
        for name in fam.time_columns(df)[:columns]
    ]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, ordinal bigint, moment string")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
