"""Chart points and chart payloads of one spec, as lazy DataFrames.

Points have the columns `ordinal, label, caption, value, percentage, color`: `label` is the group key as
text, `caption` what the axis shows (with the share on pies). `value` keeps its natural type, so a
count stays a whole number in the payload.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import SpecError
from ..functions import colors, families as fam
from ..functions.aggregates import QUANTILES
from ..functions.percent import percent_label
from ..functions.values import clean, json_ready, label_text
from ..operators.counts import value_counts, value_percentages
from ..operators.grouping import first_keys, group_reduce
from ..operators.ordering import SMALL_LIMIT, first_rows, order_columns
from ..operators.series import daily_sums, dated_rows, first_values
from .spec import CATEGORY_TYPES, LINE_TYPE, PIE_TYPES, UNTITLED_SERIES, ChartSpec, resolve

POINTS_PER_PART = 10_000
Spec = ChartSpec | Mapping[str, Any]


@dataclass(frozen=True)
class Chart:
    """A planned chart: its spec, its lazy points, and how a payload shows them."""

    spec: ChartSpec
    points: DataFrame
    kind: str
    series: str


def plan_chart(df: DataFrame, spec: Spec) -> Chart:
    """Plan one chart. Unknown columns fall back as `resolve` says; real errors are raised."""
    wanted = ChartSpec.of(spec)
    found = resolve(df, wanted)
    if found is None:
        return Chart(wanted, no_data(df), "empty", "No Data")
    if found.order_by is None and fam.ROW_COLUMN in df.columns:
        found = replace(found, order_by=fam.ROW_COLUMN)
    if found.chart_type == LINE_TYPE:
        return _line(df, found)
    aggregation = found.aggregation if found.chart_type in CATEGORY_TYPES else "count"
    title = UNTITLED_SERIES if found.title is None else found.title
    return Chart(found, _bars(df, found, aggregation), "bars", title)


def chart_points(df: DataFrame, spec: Spec) -> DataFrame:
    """The points of a chart."""
    return plan_chart(df, spec).points


def no_data(df: DataFrame) -> DataFrame:
    """The placeholder: one point `No Data` with value 0."""
    return df.sparkSession.range(1).select(
        F.lit(1).cast("bigint").alias("ordinal"), F.lit("No Data").alias("label"), F.lit("No Data").alias("caption"),
        F.lit(0).cast("bigint").alias("value"), F.lit(None).cast("double").alias("percentage"),
        F.lit(colors.NO_DATA_FILL).alias("color"),
    )


def _bars(df: DataFrame, spec: ChartSpec, aggregation: str) -> DataFrame:
    kept = _ranked(df, spec, aggregation)
    label = label_text(F.col("key"), fam.type_of(kept, "key"))
    points = kept.select("ordinal", label.alias("label"), "value")
    caption, percentage = F.col("label"), F.lit(None).cast("double")
    if spec.chart_type in PIE_TYPES or spec.show_percentages:
        points, percentage = _with_share(points, spec.limit), F.col("percentage")
        if spec.chart_type in PIE_TYPES:
            caption = F.when(F.col("_shared"), percent_label(caption, percentage)).otherwise(caption)
    fill = colors.color_at(F.col("ordinal"), spec.color_scheme)
    return points.select("ordinal", "label", caption.alias("caption"), "value", percentage.alias("percentage"), fill.alias("color"))


def _ranked(df: DataFrame, spec: ChartSpec, aggregation: str) -> DataFrame:
    """`ordinal`, `key`, `value`: cut to the limit first, then shown in the order of the spec."""
    column, grouped = spec.source_columns[0], len(spec.source_columns) > 1
    ascending = [F.col("value").asc_nulls_last(), F.col("key").asc()] if spec.sort == "asc" else None
    if aggregation == "percentage":
        shares = value_percentages(df, column).select(F.col("value").alias("key"), "n", F.col("percentage").alias("value"))
        kept = first_rows(shares, [F.col("n").desc(), F.col("key").asc()], spec.limit, ascending)
    elif aggregation == "count" or not grouped:
        counts = value_counts(df, column)
        kept = first_rows(counts.select(F.col("value").alias("key"), F.col("n").alias("value")),
                          [F.col("value").desc(), F.col("key").asc()], spec.limit, ascending)
    elif aggregation == "none":
        key = clean(df, column)
        pairs = df.where(key.isNotNull()).select(
            key.alias("key"), clean(df, spec.source_columns[1]).alias("value"),
            *[c.alias("_order") for c in order_columns(spec.order_by)])
        kept = first_rows(pairs, [F.col("_order").asc()], spec.limit, ascending)
    else:
        kept = _grouped(df, spec, aggregation, ascending)
    return kept.select("ordinal", "key", "value")


def _grouped(df: DataFrame, spec: ChartSpec, aggregation: str, ascending: list[Column] | None) -> DataFrame:
    column, measure = spec.source_columns[0], {"value": (spec.source_columns[1], aggregation)}
    by_key = [F.col("key").asc()]
    by_value = [F.col("value").desc_nulls_last(), F.col("key").asc()]
    keys = None
    if aggregation in QUANTILES and spec.rank_by == "key" and spec.limit is not None:
        keys = first_keys(df, column, spec.limit)
    groups = group_reduce(df, column, measure, spec.order_by, keys)
    return first_rows(groups, by_value if spec.rank_by == "value" else by_key, spec.limit, ascending)


def _with_share(points: DataFrame, limit: int | None) -> DataFrame:
    """Each value's share of the kept total; the values themselves where the total is not positive."""
    if fam.family_of(fam.type_of(points, "value")) not in (fam.NUMERIC, fam.BOOLEAN):
        raise SpecError("shares need numeric values")
    value = F.col("value").cast("double")
    if limit is not None and limit <= SMALL_LIMIT:
        total = F.sum(value).over(Window.partitionBy())
    else:
        total = points.agg(F.sum(value).alias("total")).scalar()
    shared = points.withColumn("_total", total).withColumn("_shared", F.coalesce(F.col("_total") > 0, F.lit(False)))
    percentage = F.when(F.col("_shared"), value / F.nullif(F.col("_total"), F.lit(0.0)) * 100).otherwise(value)
    return shared.withColumn("percentage", percentage).drop("_total")


def _line(df: DataFrame, spec: ChartSpec) -> Chart:
    points, series = None, spec.source_columns[0]
    if len(spec.source_columns) > 1:
        points = _time_series(df, spec)
    if points is not None:
        series = f"{spec.source_columns[1]} over time"
    else:
        values = first_values(df, spec.source_columns[0], spec.order_by, spec.limit)
        points = values.select("ordinal", F.col("ordinal").cast("string").alias("label"), "value")
    shown = points.select(
        "ordinal", "label", F.col("label").alias("caption"), "value",
        F.lit(None).cast("double").alias("percentage"), F.lit(colors.LINE_BORDER).alias("color"),
    )
    return Chart(spec, shown, "line", series)


def _time_series(df: DataFrame, spec: ChartSpec) -> DataFrame | None:
    """Sums per date, or None where no row has both a readable date and a value.

    The check reads until it meets one such row, so on data with dates it costs one small task.
    """
    dates, values = spec.source_columns[:2]
    if fam.family_of(fam.type_of(df, values)) not in (fam.NUMERIC, fam.BOOLEAN):
        return None
    rows = dated_rows(df, dates, values, list(spec.date_formats))
    if rows.isEmpty():
        return None
    return daily_sums(rows, spec.limit).select("ordinal", F.col("day").cast("string").alias("label"), "value")


def part_count(chart: Chart) -> Column:
    """How many parts the payload of a chart has, as a scalar subquery."""
    return F.coalesce(chart.points.agg(F.ceil(F.max("ordinal") / POINTS_PER_PART).alias("n")).scalar(), F.lit(1))


def chart_payload(df: DataFrame, spec: Spec) -> DataFrame:
    """`part`, `payload`: the chart as the JSON document a chart widget takes."""
    return payload_of(plan_chart(df, spec))


def payload_of(chart: Chart) -> DataFrame:
    """`part`, `payload`: points 1 to POINTS_PER_PART are part 0, and so on, for every chart and limit, so
    no task ever holds a whole unbounded chart and no point is lost. A chart without points has an empty part 0.
    """
    points = chart.points
    value = json_ready(F.col("value"), fam.type_of(points, "value"))
    point = F.struct("ordinal", "caption", value.alias("value"), "percentage", "color").alias("point")
    dealt = points.select(F.floor((F.col("ordinal") - 1) / POINTS_PER_PART).alias("part"), point)
    # A part 0 without a point, which the list below leaves out.
    first = points.sparkSession.range(1).select(F.col("id").alias("part"), F.lit(None).cast(dealt.schema["point"].dataType).alias("point"))
    parts = dealt.unionByName(first).groupBy("part").agg(F.array_sort(F.collect_list("point")).alias("points"))
    dataset = F.struct(F.lit(chart.series).alias("label"), F.col("points.value").alias("data"), *_style(chart))
    body = F.struct(F.col("points.caption").alias("labels"), F.array(dataset).alias("datasets"))
    return parts.select("part", F.to_json(body).alias("payload"))


def _style(chart: Chart) -> list[Column]:
    if chart.kind == "line":
        return [
            F.lit(colors.LINE_BORDER).alias("borderColor"), F.lit(colors.LINE_FILL).alias("backgroundColor"),
            F.lit(0.4).alias("tension"), F.lit(False).alias("fill"),
        ]
    on_pie = chart.kind == "bars" and chart.spec.chart_type in PIE_TYPES
    style = [
        F.col("points.color").alias("backgroundColor"),
        F.transform("points.color", colors.border_of).alias("borderColor"),
        F.lit(2 if on_pie else 1).alias("borderWidth"),
    ]
    shares = on_pie or (chart.kind == "bars" and chart.spec.show_percentages)
    return style + ([F.col("points.percentage").alias("percentages")] if shares else [])
