"""Row numbers, first rows and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import OrderRequiredError, SpecError
from ..functions.values import raw
from ..session import ensure_checkpoint_dir

# Up to this many rows the final sort of a limit fits one task with ease.
SMALL_LIMIT = 100_000


def order_columns(order_by: str | list[str] | None) -> list[Column]:
    names = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not names:
        raise OrderRequiredError("give order_by: a table has no row order of its own")
    return [raw(name) for name in names]


def check_limit(limit: int | None) -> int | None:
    """`None` means no limit; a negative limit is refused."""
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise SpecError(f"limit must be null or a whole number from 0, not {limit!r}")
    return limit


def first_rows(df: DataFrame, order: list[Column], limit: int | None, shown: list[Column] | None = None,
               ordinal: str = "ordinal") -> DataFrame:
    """The first rows in an order, numbered from 1; `shown` is another order for what is kept.

    A small limit is a per-task top-k merged once, so the number comes from a window over at most
    `limit` rows. Without such a bound the rows stay distributed, see `number_rows`, which needs a
    checkpoint folder. The folder is asked for in either case, so a request does not start to fail as it grows.
    """
    check_limit(limit)
    ensure_checkpoint_dir(df.sparkSession)
    if limit is None or limit > SMALL_LIMIT:
        kept = df if limit is None else number_rows(df, order, "_kept").where(F.col("_kept") <= limit).drop("_kept")
        return number_rows(kept, shown or order, ordinal)
    kept = df.orderBy(*order).limit(limit)
    return kept.withColumn(ordinal, F.row_number().over(Window.orderBy(*(shown or order))).cast("bigint"))


def number_rows(df: DataFrame, order: list[Column], ordinal: str = "ordinal") -> DataFrame:
    """Consecutive numbers from 1 over any number of rows, with no single-task window.

    The rows are range-sorted once and checkpointed with their partition and position, so that the
    partition sizes and the rows come from the same stored sort even if an executor is lost. Only one
    size per partition is added up in one place.
    """
    ensure_checkpoint_dir(df.sparkSession)
    position = F.monotonically_increasing_id()
    stored = (
        df.orderBy(*order)
        .withColumn("_part", F.shiftright(position, 33))
        .withColumn("_at", position.bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint()
    )
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # One row per sort partition: at most spark.sql.shuffle.partitions rows, so a broadcast is bounded.
    numbered = stored.join(F.broadcast(starts), "_part")
    return numbered.withColumn(ordinal, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")


def page(df: DataFrame, order_by: list[str], limit: int | None = 100, offset: int = 0,
         after: dict | None = None) -> DataFrame:
    """One page in a total order: by offset, or after the last row of the previous page.

    `after` names the order values of the last row seen; it filters instead of counting, so every page
    costs the same and the filter is pushed to the scan. A deep offset goes through `number_rows`.
    """
    check_limit(limit)
    check_limit(offset)
    order = order_columns(order_by)
    if after is not None:
        df = df.where(_beyond(order_by, after))
    if limit is None or offset + limit > SMALL_LIMIT:
        numbered = number_rows(df, order, "_ordinal").where(F.col("_ordinal") > offset)
        if limit is not None:
            numbered = numbered.where(F.col("_ordinal") <= offset + limit)
        return numbered.drop("_ordinal")
    return df.orderBy(*order).offset(offset).limit(limit)


def _beyond(order_by: list[str], after: dict) -> Column:
    """Rows after a position in the lexicographic order of the columns (first column first), nulls first as in the sort."""
    first, *rest = order_by
    value, column = after[first], raw(first)
    if value is None:
        later, same = column.isNotNull(), column.isNull()
    else:
        later, same = column > F.lit(value), column == F.lit(value)
    if not rest:
        return later
    below = _beyond(rest, after)
    # The first form gives the scan a plain lower bound.
    return later | (same & below) if value is None else (column >= F.lit(value)) & (later | below)
