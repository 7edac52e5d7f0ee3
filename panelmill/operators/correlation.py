"""Pearson correlations, each over the rows where both columns are present.

All pairs share one aggregate of plain sums. Rows are grouped by which columns they have (a bit per column): within such a
group every pair is either complete or absent, so the sums of values, squares and products serve all pairs, and a pair adds
up the groups that have both its columns. Values are taken from the mean of their column, which keeps the differences of sums
exact enough; whether a column varies is told by its least and greatest value, not by a difference.

The groups are few (tables have few patterns of gaps; two blocks of columns have at most 2**16) and are combined before the
shuffle, so what moves is a few rows per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import families as fam
from ..functions.values import clean

# Columns per block: one aggregate holds the pairs of two blocks at most.
BLOCK = 8


def centres(df: DataFrame, columns: list[str]) -> Column:
    """The mean of every column as an array, a scalar subquery; 0 where a column has none that is finite."""
    means = [F.avg(clean(df, c).cast("double")) for c in columns]
    return df.agg(F.array(*[F.when(F.abs(m) < float("inf"), m).otherwise(0.0) for m in means]).alias("centres")).scalar()


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, means: Column | None = None) -> DataFrame:
    """`a`, `b`, `r` for every pair of columns, a before b in column order; `r` is null where a column does not vary.

    `means` is what `centres` gives for these columns, if there is a scan that has it already.
    """
    columns = columns or fam.numeric_columns(df)
    whole = _pairs(df, columns, means)
    return whole.where("a < b").select(*[_name(columns, c).alias(c) for c in ("a", "b")], "r")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, means: Column | None = None) -> DataFrame:
    """`column`, `other`, `r` for all ordered pairs, the diagonal included."""
    columns = columns or fam.numeric_columns(df)
    one, other = _name(columns, "a"), _name(columns, "b")
    there = F.struct(one.alias("column"), other.alias("other"), "r")
    back = F.struct(other.alias("column"), one.alias("other"), "r")
    both = F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))
    return _pairs(df, columns, means).select(F.inline(both))


def _name(columns: list[str], position: str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(position) + 1)


def _pairs(df: DataFrame, columns: list[str], means: Column | None) -> DataFrame:
    """`a`, `b`, `r` by positions of columns, a at most b."""
    if not columns:
        return df.sparkSession.createDataFrame([], "a int, b int, r double")
    means = centres(df, columns) if means is None else means
    blocks = [range(i, min(i + BLOCK, len(columns))) for i in range(0, len(columns), BLOCK)]
    parts = [_block(df, columns, means, left, right) for n, left in enumerate(blocks) for right in blocks[n:]]
    return reduce(DataFrame.unionByName, parts)


def _block(df: DataFrame, columns: list[str], means: Column, left: range, right: range) -> DataFrame:
    """The pairs of two blocks of columns, or of one with itself."""
    own = sorted({*left, *right})
    pairs = [(a, b) for a in left for b in right if a <= b]
    bit = {i: 1 << k for k, i in enumerate(own)}
    plain = df.select(*[clean(df, columns[i]).cast("double").alias(f"v{i}") for i in own], means.alias("means"))
    has = " | ".join(f"IF(v{i} IS NULL, 0, {bit[i]})" for i in own)
    # Absent values count as 0: no pair looks at them.
    rows = plain.selectExpr(f"{has} AS has", *[f"v{i}" for i in own], *[f"coalesce(v{i} - means[{i}], 0D) AS d{i}" for i in own])
    single = [f"{f}({x}{i}) AS {as_}{i}" for i in own for f, x, as_ in (("sum", "d", "s"), ("min", "v", "l"), ("max", "v", "g"))]
    sums = [f"sum(d{a} * d{b}) AS p{a}_{b}" for a, b in sorted({*pairs, *[(i, i) for i in own]})]
    groups = rows.groupBy("has").agg(*[F.expr(x) for x in ("count(1) AS n", *single, *sums)])
    sides = lambda i, side: ", ".join([f"p{i}_{i} AS q_{side}", *[f"{x}{i} AS {x}_{side}" for x in "slg"]])
    each = ", ".join(f"struct({a} AS a, {b} AS b, {bit[a] | bit[b]} AS needs, p{a}_{b} AS p, {sides(a, 'a')}, {sides(b, 'b')})" for a, b in pairs)
    long = groups.selectExpr("has", "n", f"inline(array({each}))").where("has & needs = needs")
    adds = [f"sum({x}) AS {x}" for x in ("n", "p", "s_a", "q_a", "s_b", "q_b")]
    ends = [f"{f}({x}_{side}) AS {x}_{side}" for side in "ab" for x, f in (("l", "min"), ("g", "max"))]
    total = long.groupBy("a", "b").agg(*[F.expr(x) for x in (*adds, *ends)])
    known = df.sparkSession.range(1).selectExpr(f"inline(array({', '.join(f'struct({a} AS a, {b} AS b)' for a, b in pairs)}))")
    # The spread is the sum of squares about the mean of the rows that a pair shares. At most 1, at least -1; NaN is missing.
    spread = lambda side: f"sqrt(greatest(q_{side} - s_{side} * s_{side} / n, 0D))"
    r = f"CASE WHEN g_a > l_a AND g_b > l_b THEN try_divide(p - s_a * s_b / n, {spread('a')} * {spread('b')}) END"
    found = total.selectExpr("a", "b", f"nanvl({r}, CAST(NULL AS double)) AS r")
    bounded = "CASE WHEN r IS NULL THEN r WHEN a = b OR r > 1 THEN 1D WHEN r < -1 THEN -1D ELSE r END AS r"
    return known.join(found, ["a", "b"], "left").selectExpr("a", "b", bounded)
