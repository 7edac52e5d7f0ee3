"""Aggregates by name: each is an expression with a map-side partial form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..errors import OrderRequiredError, SpecError

Aggregate = Callable[[Column, Column | None], Column]


def _corrected_skew(v: Column) -> Column:
    """Sample skewness with the small-sample correction; null below three values or without spread."""
    n = F.count(v).cast("double")
    factor = F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(F.count(v) >= 3, F.skewness(v) * F.when(F.count(v) >= 3, factor))


def _by_order(pick: Callable[[Column, Column], Column]) -> Aggregate:
    def build(v: Column, order: Column | None) -> Column:
        if order is None:
            raise OrderRequiredError("'first' and 'last' need order_by: a table has no row order of its own")
        return pick(v, F.when(v.isNotNull(), order))

    return build


# Names a chart spec may use. `median` and `quantile` are not here: exact ranks of a group of any size
# need more than one pass and live in operators.quantiles.
AGGREGATES: dict[str, Aggregate] = {
    "count": lambda v, _: F.count(v),
    "size": lambda v, _: F.count(F.lit(1)),
    "nunique": lambda v, _: F.count_distinct(v),
    "sum": lambda v, _: F.coalesce(F.sum(v), F.lit(0)),
    "avg": lambda v, _: F.avg(v),
    "mean": lambda v, _: F.avg(v),
    "min": lambda v, _: F.min(v),
    "max": lambda v, _: F.max(v),
    "std": lambda v, _: F.stddev_samp(v),
    "var": lambda v, _: F.var_samp(v),
    "sem": lambda v, _: F.stddev_samp(v) / F.sqrt(F.nullif(F.count(v), F.lit(0)).cast("double")),
    "prod": lambda v, _: F.coalesce(F.product(v), F.lit(1.0)),
    "skew": lambda v, _: _corrected_skew(v),
    "any": lambda v, _: F.coalesce(F.bool_or(v.cast("boolean")), F.lit(False)),
    "all": lambda v, _: F.coalesce(F.bool_and(v.cast("boolean")), F.lit(True)),
    "first": _by_order(F.min_by),
    "last": _by_order(F.max_by),
}
QUANTILES: dict[str, float] = {"median": 0.5, "quantile": 0.5}
NUMERIC_ONLY = {"sum", "avg", "mean", "std", "var", "sem", "prod", "skew", "median", "quantile"}
NAMES = sorted({*AGGREGATES, *QUANTILES, "percentage", "none"})


def aggregate(name: str, value: Column, order: Column | None = None) -> Column:
    """The named aggregate over a value column; nulls are skipped."""
    if name not in AGGREGATES:
        raise SpecError(f"unknown aggregation {name!r}; known names: {', '.join(NAMES)}")
    return AGGREGATES[name](value, order)
