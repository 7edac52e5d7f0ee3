"""Texts of dashboards, shared by single dashboards and whole folders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.values import capitalized

# Titles, sentences and metric names that dashboards show.
REQUESTED_TITLE = "Dashboard - %s"
BASIC_TITLE = "%s Dashboard - %s"
BASIC_KIND = "Basic"
BASIC_INSIGHTS = "Basic dashboard with fundamental data visualizations"
BASIC_SUMMARY = "Analysis of %s containing %s rows and %s columns"
CHART_TITLE = "Distribution of %s"
CHART_INSIGHTS = "Shows the distribution of %s values in the dataset"
CHART_AXIS = "Count"
RECORDS = ("Total Records", "Number of data rows")
FIELDS = ("Data Fields", "Number of columns")
METRIC_TYPE = "array<struct<metric: string, value: string, description: string>>"


def title(source: Column, category: str | None) -> Column:
    kind = capitalized(F.lit(category)) if category else F.lit(BASIC_KIND)
    return F.format_string(BASIC_TITLE, kind, source)


def summary(source: Column, rows: Column, fields: Column, description: str | None) -> Column:
    text = F.format_string(BASIC_SUMMARY, source, rows.cast("string"), fields.cast("string"))
    return F.concat(text, F.lit(f". {description}")) if description else text


def metric(name: Column, value: Column, description: Column) -> Column:
    return F.struct(name.cast("string").alias("metric"), value.cast("string").alias("value"),
                    description.cast("string").alias("description"))


def basic_metrics(rows: Column, fields: Column) -> Column:
    """Records and fields as an array of metrics."""
    pairs = ((RECORDS, rows), (FIELDS, fields))
    return F.array(*[metric(F.lit(name), value, F.lit(description)) for (name, description), value in pairs])
