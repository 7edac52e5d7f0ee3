"""Exact interpolated quantiles of groups of any size, by one path for every size.

`percentile` keeps every distinct value of a group in the memory of one task. Here a rank is found the
way one looks up a word: first the drawer, then the folder, then the page. Each level is an ordinary
grouped count with map-side combine, so a task sends at most one row per bucket, and the next level
looks only at rows in the buckets that hold a wanted rank:

    drawer = floor(s(v)), folder = one of 4096 equal parts of the drawer's own range of values, page = v itself

where the scale s never decreases as v grows. A drawer brings along its least and greatest value, so
values that lie close together around any offset are spread over all its folders. Only values of one
folder are ever put in order one by one, in a running count that spills to disk if it must.

The whole is one lazy plan of narrow scans. The chosen buckets are at most two per group and probability;
rows look them up in a hash table of their task, so no task sorts the rows of a group, and after the first
lookup rows are dealt by folder, as one drawer may hold a whole group. A drawer or folder that holds most
rows of a join is split by adaptive execution, which must be on. A group's result depends on its own values
alone: the two neighbouring values and one expression between them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import SpecError
from ..functions.values import quoted

DRAWERS, FOLDERS = 4096.0, 4096
# The 64th root of 1e77: the few numbers beyond share the outermost drawers.
REACH = 16.0


def root_scale(value: Column) -> Column:
    """Drawers about 1.5 % wide for numbers of common size, finer for tiny ones: the 64th root by six
    square roots, each rounded correctly and so never decreasing."""
    v = value.cast("double")
    root = reduce(lambda x, _: F.sqrt(x), range(6), F.abs(v))
    return F.signum(v) * F.least(root, F.lit(REACH)) * DRAWERS


def day_scale(micros: Column) -> Column:
    """One drawer per day, for microseconds since the epoch."""
    return micros.cast("double") / 86_400e6


def quantile_columns(df: DataFrame, keys: list[str], value: str, names: dict[str, float],
                     scale: Callable[[Column], Column] = root_scale, only: DataFrame | None = None) -> DataFrame:
    """`keys` and one double per name and probability: linear interpolation between the two nearest ranks.

    `df` holds `keys` and a numeric `value` without NaN; null values are skipped, and groups without any
    value are absent. `only` restricts the groups to a table of keys.
    """
    if not keys:
        raise SpecError("quantiles need at least one key column")
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), F.floor(scale(F.col(value))).cast("bigint").alias("_drawer"))
    drawer, folder = [*keys, "_drawer"], [*keys, "_in", "_folder"]
    total = F.sum("_n").over(Window.partitionBy(*keys))
    # Later passes need no restriction: they look only into drawers the first one chose.
    first = rows if only is None else rows.join(only, keys, "left_semi")
    ends = [F.min("_v").cast("double").alias("_least"), F.max("_v").cast("double").alias("_most")]
    drawers = _counted(first, drawer, *ends).withColumns({"_total": total, "_start": F.lit(0).cast("bigint")})
    # From here on a chosen bucket goes by the rows of its group before it, which no two share, so that rows and counts
    # are dealt by folder and not by drawer: one drawer may hold a whole group.
    in_drawer = _holding(drawers, keys, "_drawer", names).select(*drawer, F.col("_start").alias("_in"), "_total", "_least", "_most")
    # The quotient of halves stays finite where the difference of the ends would not.
    finite = "_most > _least AND _most < double('Infinity') AND _least > double('-Infinity')"
    part = f"least((double(_v) / 2 - _least / 2) / (_most / 2 - _least / 2) * {FOLDERS}, {FOLDERS - 1})"
    in_part = F.expr(f"IF({finite}, int({part}), 0)").alias("_folder")
    placed = rows.join(in_drawer.hint("shuffle_hash"), drawer).select(*keys, "_in", in_part, "_v", "_total")
    # The total is constant within a bucket; it rides along as a grouping column.
    folders = _counted(placed, [*folder, "_total"]).withColumn("_start", F.col("_in"))
    in_folder = _holding(folders, [*keys, "_in"], "_folder", names).select(*folder, "_start")
    # At most two folders per drawer and probability are wanted.
    near = placed.join(in_folder.hint("shuffle_hash"), folder)
    pages = _counted(near, [*keys, "_v", "_total", "_start"])
    return _interpolate(_holding(pages, [*keys, "_start"], "_v", names), keys, names)


def _counted(rows: DataFrame, bucket: list[str], *more: Column) -> DataFrame:
    return rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"), *more)


def _place(probability: float) -> str:
    """Where a probability falls between the first value (0) and the last (total - 1)."""
    return f"((_total - 1) * {float(probability)!r}D)"


def _low(p: float) -> str:
    """Whether the rank just below the probability's place is in this bucket."""
    return f"(floor({_place(p)}) + 1 > _start AND floor({_place(p)}) + 1 <= _until)"


def _high(p: float) -> str:
    return f"(ceil({_place(p)}) + 1 > _start AND ceil({_place(p)}) + 1 <= _until)"


def _holding(counted: DataFrame, group: list[str], bucket: str, names: dict[str, float]) -> DataFrame:
    """The buckets that hold a wanted rank of their group: `_start` rows come before, `_until` with it."""
    running = F.sum("_n").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_until", F.col("_start") + running).withColumn("_start", F.col("_until") - F.col("_n"))
    return placed.where(" OR ".join(side(p) for p in names.values() for side in (_low, _high)))


def _interpolate(found: DataFrame, keys: list[str], names: dict[str, float]) -> DataFrame:
    ends, results = [F.max("_total").alias("_total")], []
    for i, (name, p) in enumerate(names.items()):
        ends += [F.expr(f"max(CASE WHEN {_low(p)} THEN double(_v) END) AS _low{i}"),
                 F.expr(f"max(CASE WHEN {_high(p)} THEN double(_v) END) AS _high{i}")]
        between = f"_low{i} + (_high{i} - _low{i}) * ({_place(p)} - floor({_place(p)}))"
        results.append(f"CASE WHEN _low{i} = _high{i} THEN _low{i} ELSE {between} END AS {quoted(name)}")
    return found.groupBy(*keys).agg(*ends).selectExpr(*[quoted(k) for k in keys], *results)
