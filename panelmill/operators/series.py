"""Series for line charts: sums per calendar date, and plain values in row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import SpecError
from ..functions import families as fam
from ..functions.values import clean, raw, to_timestamp_or_null
from .ordering import first_rows, order_columns


def dated_rows(df: DataFrame, date_column: str, value_column: str, formats: list[str] | None = None) -> DataFrame:
    """`moment`, `amount`: rows whose date parses and whose value is present."""
    if fam.family_of(fam.type_of(df, value_column)) not in (fam.NUMERIC, fam.BOOLEAN):
        raise SpecError(f"a time series sums numbers, and {value_column!r} is not numeric")
    moment = to_timestamp_or_null(clean(df, date_column), fam.type_of(df, date_column), formats)
    amount = clean(df, value_column)
    if fam.family_of(fam.type_of(df, value_column)) == fam.BOOLEAN:
        amount = amount.cast("int")
    # Null checks on the plain columns reach the scan; the parsed date is checked on what is left.
    present = df.where(raw(date_column).isNotNull() & raw(value_column).isNotNull())
    return present.select(moment.alias("moment"), amount.alias("amount")).na.drop("any")


def daily_sums(rows: DataFrame, limit: int | None) -> DataFrame:
    """`ordinal`, `day`, `value` of the first dates. A hot date is one partial sum per task."""
    sums = rows.groupBy(F.to_date("moment").alias("day")).agg(F.sum("amount").alias("value"))
    return first_rows(sums, [F.col("day").asc()], limit)


def first_values(df: DataFrame, column: str, order_by: str | list[str], limit: int | None) -> DataFrame:
    """`ordinal`, `value`: the first present values in row order."""
    order = order_columns(order_by)
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    value = clean(df, column)
    kept = df.where(value.isNotNull()).select(value.alias("_value"), *[raw(n) for n in names])
    return first_rows(kept, order, limit).select("ordinal", F.col("_value").alias("value"))
