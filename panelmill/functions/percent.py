"""Percent labels with the rounding of the exact binary value, in plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def one_decimal(value: Column) -> Column:
    """Text of a double with one decimal, rounded from its exact binary value, ties to even.

    Spark's own formatter rounds the shortest decimal form instead, so 0.15 (in truth a little less)
    would give 0.2. Here `20 * |v|` is split into a rounded sum and its exact error: only where the
    sum is an odd whole number can the decimal form be a tie, and then the error tells the side.
    """
    size = F.abs(value)
    twenty = size * 16 + size * 4
    error = size * 4 - (twenty - size * 16)
    odd = twenty % 2 == 1
    tenths = (
        F.when(odd & (error > 0), (twenty + 1) / 2)
        .when(odd & (error < 0), (twenty - 1) / 2)
        .otherwise(F.rint(twenty / 2))
        .cast("bigint")
    )
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    whole = ((tenths - tenths % 10) / 10).cast("bigint")
    return F.concat(sign, whole.cast("string"), F.lit("."), (tenths % 10).cast("string"))


def percent_label(label: Column, percentage: Column) -> Column:
    """`label (12.3%)`; the label alone where there is no percentage."""
    return F.when(percentage.isNull(), label).otherwise(
        F.concat(label, F.lit(" ("), one_decimal(percentage), F.lit("%)"))
    )
