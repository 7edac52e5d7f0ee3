"""Dashboards: many charts and their texts as one row."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import PanelmillError, SpecError
from ..functions import colors, families as fam
from ..operators import describe
from ..operators.counts import by_count, value_counts
from ..operators.ordering import first_rows
from . import texts
from .charts import Chart, Spec, no_data, part_count, payload_of, plan_chart
from .replies import read_replies
from .spec import BASIC_LIMIT, DEFAULTS, ChartSpec


def union_points(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """The points of many charts in one table: `chart_id` counts from 1, values are doubles."""
    parts = []
    for i, spec in enumerate(specs, 1):
        points = plan_chart(df, spec).points
        parts.append(points.select(F.lit(i).cast("bigint").alias("chart_id"), "*").withColumn("value", F.col("value").try_cast("double")))
    return reduce(DataFrame.unionByName, parts)


def read_spec(spec: Any) -> tuple[ChartSpec, str | None]:
    """A spec, and why it cannot be used if it cannot. A limit that is no whole number from 0 becomes the default."""
    if isinstance(spec, ChartSpec):
        return spec, None
    if not isinstance(spec, Mapping):
        return ChartSpec(), "a chart is not an object"
    config = spec.get("data_config")
    flat = {**spec, **(config if isinstance(config, Mapping) else {})}
    flat.pop("data_config", None)
    limit = flat.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        del flat["limit"]
    try:
        return ChartSpec.of(flat), None
    except (PanelmillError, TypeError, ValueError) as error:
        shown = {k: flat[k] for k in ("chart_type", "title", "x_axis", "y_axis") if isinstance(flat.get(k), str)}
        return ChartSpec(**shown), str(error)


def selected(specs: Any, chart_types: list[str] | None = None, number_of_charts: int | None = None) -> list[tuple[ChartSpec, str | None]]:
    """Specs of the wanted types, in order, at most as many as asked for; none where `specs` is no list."""
    known = [read_spec(s) for s in specs] if isinstance(specs, (list, tuple)) else []
    kept = [s for s in known if not chart_types or s[0].chart_type in chart_types]
    return kept if number_of_charts is None else kept[:number_of_charts]


def dashboard(df: DataFrame, source: str, document: Mapping[str, Any] | None = None,
              category: str | None = None, description: str | None = None, chart_types: list[str] | None = None,
              number_of_charts: int | None = None, on_error: str = "placeholder") -> DataFrame:
    """One row per dashboard: `title, charts, insights, summary, key_metrics, category, metadata`.

    `document` is the reply of a model or a hand-written request; without any chart in it the rule-based
    dashboard is built. `charts` and `metadata` are JSON, `key_metrics` an array of structs. A chart that
    cannot be planned is shown as a placeholder with `status` and `reason`; with `on_error="raise"` it is an error.
    """
    document = document if isinstance(document, Mapping) else {}
    specs = selected(document.get("charts"), chart_types, number_of_charts)
    if not specs:
        return basic_dashboard(df, source, category, description)
    charts = [_chart_or_placeholder(df, spec, reason, i, on_error) for i, (spec, reason) in enumerate(specs, 1)]
    given = document.get("key_metrics")
    metrics = [texts.metric(F.lit(m.get("metric")), F.lit(m.get("value")), F.lit(m.get("description")))
               for m in (given if isinstance(given, list) else []) if isinstance(m, Mapping)]
    return _assemble(
        df, charts,
        title=F.lit(document.get("dashboard_title", texts.REQUESTED_TITLE % source)),
        insights=F.lit(document.get("insights", "")), summary=F.lit(document.get("summary", "")),
        metrics=F.array(*metrics).cast(texts.METRIC_TYPE), category=category, metadata=document["metadata"] if isinstance(document.get("metadata"), Mapping) else {},
    )


def dashboard_from_reply(df: DataFrame, source: str, reply: str, **options: Any) -> DataFrame:
    """The dashboard a model's reply asks for; the rule-based one where the reply holds no document."""
    replies = df.sparkSession.createDataFrame([(reply,)], "reply string")
    read = read_replies(replies, "reply", F.lit(source)).select(F.to_json("document").alias("document")).first()
    return dashboard(df, source, json.loads(read["document"]) if read["document"] else None, **options)


def chart_document(df: DataFrame, spec: Spec, number: int) -> DataFrame:
    """`chart_no`, `part`, `chart`: the spec's texts with its payload as `data`, a row per part of the payload.

    `status` in the document is ok; `parts` says how many parts there are.
    """
    chart = plan_chart(df, spec)
    shown = ChartSpec.of(spec)
    title = DEFAULTS["title"] if shown.title is None else shown.title
    return _chart_row(payload_of(chart), number, shown, title, part_count(chart))


def _chart_or_placeholder(df: DataFrame, spec: ChartSpec, reason: str | None, number: int, on_error: str) -> DataFrame:
    try:
        if reason is not None:
            raise SpecError(reason)
        return chart_document(df, spec, number)
    except PanelmillError as error:
        if on_error == "raise":
            raise
        title = DEFAULTS["title"] if spec.title is None else spec.title
        empty = payload_of(Chart(spec, no_data(df), "empty", "No Data"))
        return _chart_row(empty, number, spec, title, F.lit(1), str(error))


def _chart_row(payload: DataFrame, number: int, spec: ChartSpec, title: str, parts: Column, reason: str | None = None) -> DataFrame:
    body = F.struct(
        F.lit(spec.chart_type).alias("chart_type"), F.lit(title).alias("title"),
        F.lit(spec.x_axis).alias("x_axis"), F.lit(spec.y_axis).alias("y_axis"),
        F.parse_json("payload").alias("data"), F.lit(spec.insights).alias("insights"),
        F.lit(spec.color_scheme).alias("color_scheme"), _json_value(spec.metadata).alias("metadata"),
        F.array(*[F.lit(x) for x in spec.interactive_features]).cast("array<string>").alias("interactive_features"),
        F.lit("ok" if reason is None else "error").alias("status"), F.lit(reason).cast("string").alias("reason"),
        parts.cast("bigint").alias("parts"),
    )
    return payload.select(F.lit(number).alias("chart_no"), "part", F.to_json(body).alias("chart"))


def _json_value(value: Mapping[str, Any]) -> Column:
    return F.parse_json(F.lit(json.dumps(dict(value))))


def _assemble(df: DataFrame, charts: list[DataFrame], title: Column, insights: Column, summary: Column,
              metrics: Column, category: str | None, metadata: Mapping[str, Any]) -> DataFrame:
    """Every chart once, with the first part of its payload and the number of parts: one row holds a bounded
    number of points per chart, whatever its limit. `chart_document` gives the other parts."""
    documents = F.array().cast("array<string>")
    if charts:
        every = reduce(DataFrame.unionByName, charts).where("part = 0")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("chart_no", "chart"))), lambda c: c["chart"])
        documents = every.agg(ordered.alias("charts")).scalar()
    joined = F.concat(F.lit("["), F.concat_ws(",", documents), F.lit("]"))
    return df.sparkSession.range(1).select(
        title.alias("title"), joined.alias("charts"), insights.alias("insights"), summary.alias("summary"),
        metrics.alias("key_metrics"), F.lit(category).cast("string").alias("category"),
        F.lit(json.dumps(dict(metadata))).alias("metadata"),
    )


def basic_points(df: DataFrame) -> DataFrame | None:
    """Top values of the first text column, or None where there is none."""
    columns = fam.categorical_columns(df)
    if not columns:
        return None
    kept = first_rows(value_counts(df, columns[0]), by_count(), BASIC_LIMIT)
    return kept.select("ordinal", F.col("value").alias("label"), F.col("n").alias("value"))


def _fields(df: DataFrame) -> Column:
    return F.lit(len(fam.data_columns(df)))


def basic_metrics(df: DataFrame) -> DataFrame:
    """`metric`, `value`, `description`: records and fields of the table."""
    return describe.row_count(df).select(F.inline(texts.basic_metrics(F.col("rows"), _fields(df))))


def basic_dashboard(df: DataFrame, source: str, category: str | None = None, description: str | None = None) -> DataFrame:
    """The rule-based dashboard: the distribution of the first text column, and two metrics."""
    rows = describe.row_count(df).scalar()
    points = basic_points(df)
    charts = []
    if points is not None:
        name = fam.categorical_columns(df)[0]
        listed = points.agg(F.array_sort(F.collect_list(F.struct("ordinal", "label", "value"))).alias("points"))
        dataset = F.struct(F.lit(texts.CHART_AXIS).alias("label"), F.col("points.value").alias("data"),
                           F.lit(colors.BASIC_FILL).alias("backgroundColor"))
        body = F.struct(F.col("points.label").alias("labels"), F.array(dataset).alias("datasets"))
        payload = listed.select(F.lit(0).alias("part"), F.to_json(body).alias("payload"))
        spec = ChartSpec(x_axis=name, y_axis=texts.CHART_AXIS, insights=texts.CHART_INSIGHTS % name)
        charts.append(_chart_row(payload, 1, spec, texts.CHART_TITLE % name, F.lit(1)))
    name = F.lit(source)
    return _assemble(
        df, charts, title=texts.title(name, category), insights=F.lit(texts.BASIC_INSIGHTS),
        summary=texts.summary(name, rows, _fields(df), description), metrics=texts.basic_metrics(rows, _fields(df)),
        category=category, metadata={},
    )
