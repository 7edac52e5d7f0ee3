"""Model replies: free text around a JSON dashboard document becomes rows of chart specs.

Replies are read with VARIANT, because the document has no fixed schema: any key may be absent, and an
explicit null differs from an absent key (`"limit": null` means no limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .spec import DEFAULTS
from .texts import REQUESTED_TITLE

# The document that stands for an unreadable reply.
ERROR_TITLE, ERROR_INSIGHTS = "Error", "Error extracting insights"


def json_part(text: Column) -> Column:
    """From the first opening to the last closing brace; null where there is none. Two linear searches: a
    greedy pattern would start over at every opening brace of a text that never closes one."""
    start = F.instr(text, "{")
    end = F.length(text) - F.length(F.substring_index(text, "}", -1))
    return F.when((start > 0) & (end > start), text.substr(start, end - start + 1))


def _text(document: Column, path: str, default: Column | str | None = None) -> Column:
    value = F.try_variant_get(document, path, "string")
    if default is None:
        return value
    return F.coalesce(value, F.lit(default) if isinstance(default, str) else default)


def read_replies(df: DataFrame, text: str, source: Column | None = None) -> DataFrame:
    """The input columns plus `status` (ok or error), `document` (VARIANT), `dashboard_title`, `summary`,
    `insights`, `metadata` (JSON). `source` names the table for the default title."""
    # The part starts with a brace, so whatever parses is an object.
    rows = df.withColumn("document", F.try_parse_json(json_part(F.col(text))))
    ok = F.col("document").isNotNull()
    source = F.lit("Unknown") if source is None else source
    titled = _text(F.col("document"), "$.dashboard_title", F.format_string(REQUESTED_TITLE, source))
    return rows.select(
        "*",
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(ok, titled).otherwise(ERROR_TITLE).alias("dashboard_title"),
        F.when(ok, _text(F.col("document"), "$.summary", "")).otherwise("").alias("summary"),
        F.when(ok, _text(F.col("document"), "$.insights", "")).otherwise(ERROR_INSIGHTS).alias("insights"),
        F.coalesce(F.to_json(F.try_variant_get("document", "$.metadata", "variant")), F.lit("{}")).alias("metadata"),
    )


def chart_specs(replies: DataFrame, keys: list[str]) -> DataFrame:
    """One row per chart spec of each readable reply, absent keys filled with their defaults.

    A limit that is no whole number from 0 becomes the default too, and `limit_reason` says so.
    """
    charts = F.try_variant_get(F.col("document"), "$.charts", "array<variant>")
    specs = replies.select(*keys, F.posexplode(charts).alias("at", "spec"))
    spec = F.col("spec")
    config = "$.data_config."
    limit = F.try_variant_get(spec, config + "limit", "variant")
    empty = F.array().cast("array<string>")
    number = F.try_variant_get(limit, "$", "bigint")
    whole = F.coalesce(number.between(0, (1 << 31) - 1) & (F.try_variant_get(limit, "$", "double") == number), F.lit(False))
    open_ended = F.coalesce(F.is_variant_null(limit), F.lit(False))  # only an explicit null means no limit
    return specs.select(
        *keys,
        (F.col("at") + 1).cast("bigint").alias("chart_no"),
        _text(spec, "$.chart_type", DEFAULTS["chart_type"]).alias("chart_type"),
        _text(spec, "$.title").alias("title"),
        _text(spec, "$.x_axis", DEFAULTS["x_axis"]).alias("x_axis"),
        _text(spec, "$.y_axis", DEFAULTS["y_axis"]).alias("y_axis"),
        _text(spec, "$.insights", DEFAULTS["insights"]).alias("insights"),
        _text(spec, "$.color_scheme", DEFAULTS["color_scheme"]).alias("color_scheme"),
        F.coalesce(F.try_variant_get(spec, config + "source_columns", "array<string>"), empty).alias("source_columns"),
        _text(spec, config + "aggregation", DEFAULTS["aggregation"]).alias("aggregation"),
        F.when(open_ended, F.lit(None).cast("int")).when(whole, number.cast("int")).otherwise(F.lit(DEFAULTS["limit"])).alias("limit"),
        _text(spec, config + "sort", DEFAULTS["sort"]).alias("sort"),
        F.coalesce(F.try_variant_get(spec, config + "show_percentages", "boolean"), F.lit(False)).alias("show_percentages"),
        F.coalesce(F.to_json(F.try_variant_get(spec, "$.metadata", "variant")), F.lit("{}")).alias("metadata"),
        F.coalesce(F.try_variant_get(spec, "$.interactive_features", "array<string>"), empty).alias("interactive_features"),
        F.when(limit.isNotNull() & ~open_ended & ~whole, "limit is not a whole number from 0").alias("limit_reason"),
    )


def key_metrics(replies: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key metric of each readable reply."""
    metrics = F.try_variant_get(F.col("document"), "$.key_metrics", "array<variant>")
    rows = replies.select(*keys, F.posexplode(metrics).alias("at", "item"))
    return rows.select(
        *keys, (F.col("at") + 1).cast("bigint").alias("metric_no"),
        *[_text(F.col("item"), f"$.{name}").alias(name) for name in ("metric", "value", "description")],
    )
