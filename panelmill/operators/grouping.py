"""Group aggregates by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import SpecError
from ..functions import families as fam
from ..functions.aggregates import NAMES, NUMERIC_ONLY, QUANTILES, aggregate
from ..functions.values import clean, raw
from .quantiles import quantile_columns


def measure_input(df: DataFrame, column: str, name: str) -> Column:
    """The value column in the form the named aggregate takes."""
    value, family = clean(df, column), fam.family_of(fam.type_of(df, column))
    if name in ("any", "all"):
        return {fam.NUMERIC: value != 0, fam.CATEGORICAL: F.length(value) > 0}.get(family, value)
    if name in NUMERIC_ONLY:
        if family == fam.BOOLEAN:
            return value.cast("int")
        if family != fam.NUMERIC:
            raise SpecError(f"aggregation {name!r} needs a numeric column, and {column!r} is {family}")
    return value


def group_reduce(df: DataFrame, key: str, measures: dict[str, tuple[str, str]], order_by: str | None = None,
                 keys: DataFrame | None = None) -> DataFrame:
    """`key` and one column per measure `alias: (column, aggregate name)`; null keys are dropped.

    All plain aggregates share one scan and one shuffle of partial results. Medians and quantiles join in
    by key. `keys` (one column `key`, cut by a limit) restricts the work to those groups before anything
    is aggregated.
    """
    unknown = [name for _, name in measures.values() if name not in NAMES]
    if unknown:
        raise SpecError(f"unknown aggregation {unknown[0]!r}; known names: {', '.join(NAMES)}")
    group = clean(df, key)
    every = df.where(group.isNotNull()).withColumn("key", group)
    rows = every if keys is None else every.join(keys, "key", "left_semi")
    order = raw(order_by) if order_by else None
    plain = {a: (c, n) for a, (c, n) in measures.items() if n not in QUANTILES}
    columns = [aggregate(n, measure_input(df, c, n), order).alias(a) for a, (c, n) in plain.items()]
    result = rows.groupBy("key").agg(*columns) if columns else keys
    for alias, (column, name) in measures.items():
        if name in QUANTILES:
            values = every.select("key", measure_input(df, column, name).alias("_x"))
            wanted = {alias: QUANTILES[name]}
            found = quantile_columns(values, ["key"], "_x", wanted, only=keys)
            result = (rows.select("key").distinct() if result is None else result).join(found, "key", "left")
    return result.select("key", *[raw(a) for a in measures])


def first_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The first `limit` distinct keys in key order: one column `key`."""
    group = clean(df, key)
    return df.where(group.isNotNull()).select(group.alias("key")).distinct().orderBy("key").limit(limit)
