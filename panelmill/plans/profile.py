"""Profiles: one table summarised as one JSON document, in one query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import EmptyInputError
from ..functions import families as fam
from ..functions.values import JSON_OPTIONS, iso, json_ready, or_blank, raw
from ..operators import correlation, counts, describe, samples

# Names of the statistics in the document.
NUMERIC_NAMES = {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%", "q50": "50%", "q75": "75%", "max": "max"}
TEXT_NAMES = {"count": "count", "unique": "unique", "top": "top", "freq": "freq"}
TOP_VALUES = 5
NO_ROWS = "the table has no rows"


def require_rows(df: DataFrame) -> DataFrame:
    """The table itself; an empty one is an error. Reads until the first row."""
    if df.isEmpty():
        raise EmptyInputError(NO_ROWS)
    return df


def row_states(df: DataFrame, group: str, groups: DataFrame) -> DataFrame:
    """`group`, `state` for every group of a table of groups: `rows`, or what the empty-input error of its part says.

    The check for many tables at once, as rows instead of an error.
    """
    filled = df.select(raw(group)).distinct().withColumn("_filled", F.lit(True))
    state = F.when(F.col("_filled"), F.lit("rows")).otherwise(F.lit(NO_ROWS))
    return groups.join(filled, group, "left").select(raw(group), state.alias("state"))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: `position, column, data_type, family, missing`, then whatever statistics fit
    its family (`count, unique, top, freq, mean, std, min, q25, q50, q75, max`, the last seven as text)."""
    types = fam.data_types(df)
    heads = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(types[c]).alias("data_type"), F.lit(f).alias("family"))
        for i, (c, f) in enumerate(fam.families(df).items())
    ])
    named = df.sparkSession.range(1).select(F.inline(heads))
    stats = _facts(df).select(F.inline(_statistics(df)))
    return named.join(stats, "column", "left")


def _facts(df: DataFrame) -> DataFrame:
    """One row: `overview`, and by column name `quartiles` and `texts`, each from a subquery of its own."""
    texts = fam.columns_of(df, fam.CATEGORICAL, fam.BOOLEAN)
    shape = "struct<unique: bigint, top: string, freq: bigint>"
    found = _nothing(shape) if not texts else _as_map(describe.describe_categorical(df, texts), "column", F.struct("unique", "top", "freq"))
    return df.sparkSession.range(1).select(
        describe.overview(df).alias("overview"), _quartiles(df, fam.numeric_columns(df), fam.time_columns(df)).alias("quartiles"), found.alias("texts"))


def _statistics(df: DataFrame) -> Column:
    """From the row of `_facts`, per column of the table: `column, missing, count, unique, top, freq`, and the other statistics as text."""
    times = fam.time_columns(df)
    counted = fam.columns_of(df, fam.CATEGORICAL, fam.BOOLEAN, fam.NUMERIC, fam.DATETIME)

    def one(x: Column) -> Column:
        q, t = (F.try_element_at(F.col(name), x["column"]) for name in ("quartiles", "texts"))
        values = {"mean": x["mean"], "std": x["std"], "min": x["min"], "q25": q["q25"], "q50": q["q50"], "q75": q["q75"], "max": x["max"]}
        is_time = x["column"].isin(*times)
        moment = lambda s, v: F.lit(None).cast("string") if s == "std" else iso(describe.as_moment(v), T.TimestampType())
        count = F.when(x["column"].isin(*counted), x["count"])
        return F.struct(x["column"].alias("column"), x["missing"].alias("missing"), count.alias("count"), *[t[s].alias(s) for s in ("unique", "top", "freq")],
                        *[F.when(is_time, moment(s, v)).otherwise(v.cast("string")).alias(s) for s, v in values.items()])

    return F.transform("overview.columns", one)


def _quartiles(df: DataFrame, numbers: list[str], times: list[str]) -> Column:
    """Column name to exact quartiles, a scalar subquery."""
    if not numbers + times:
        return _nothing("struct<q25: double, q50: double, q75: double>")
    return _as_map(describe.quartiles(df, numbers, times), "column", F.struct("q25", "q50", "q75"))


def _nothing(values: str) -> Column:
    return F.create_map().cast(f"map<string, {values}>")


def _as_map(table: DataFrame, key: str, value: Column) -> Column:
    """A small table (one row per column of the schema) as a map, as a subquery of the document."""
    entries = F.collect_list(F.struct(raw(key).alias("k"), value.alias("v")))
    return table.agg(F.map_from_entries(F.array_sort(entries, _by_key)).alias("m")).scalar()


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["k"] < b["k"], F.lit(-1)).when(a["k"] > b["k"], F.lit(1)).otherwise(F.lit(0))


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])


def _missing() -> Column:
    return _by_column(F.col("overview.columns"), lambda x: x["missing"])


def _by_column(columns: Column, value: Callable[[Column], Column]) -> Column:
    """An array with one struct per column as a map by column name, in the order of names."""
    entries = F.transform(columns, lambda x: F.struct(x["column"].alias("k"), value(x).alias("v")))
    return F.map_from_entries(F.array_sort(entries, _by_key))


def analysis_document(df: DataFrame) -> DataFrame:
    """One row, `document`: columns, rows, families, statistics, missing values and types as JSON.

    Statistics that do not apply to a column are empty texts. Besides the passes of the quartiles there are two scans: one
    for rows, missing values and moments, one for the counts of texts.
    """
    shown = {"count": "count", **TEXT_NAMES, **NUMERIC_NAMES}
    described = F.filter(_statistics(df), lambda x: x["count"].isNotNull())
    summary = _by_column(described, lambda x: F.struct(*[or_blank(x[s]).alias(n) for s, n in shown.items()]))
    body = F.struct(
        _names(fam.data_columns(df)).alias("columns"),
        F.col("overview.rows").alias("rows"),
        _names(fam.numeric_columns(df)).alias("numeric_columns"),
        _names(fam.categorical_columns(df)).alias("categorical_columns"),
        summary.alias("summary"),
        _missing().alias("missing_values"),
        _literal_map(fam.data_types(df)).alias("data_types"),
    )
    return _facts(df).select(F.to_json(body, JSON_OPTIONS).alias("document"))


def sample_columns(df: DataFrame, order_by: str | list[str], limit: int = 10) -> Column:
    """The first rows by column: column name to row number (from 0) to value."""
    rows = samples.row_sample(df, order_by, limit)
    at = (F.col("ordinal") - 1).cast("string")
    columns = []
    for name in fam.data_columns(df):
        entries = F.collect_list(F.struct(F.col("ordinal"), at.alias("k"), json_ready(raw(name), fam.type_of(df, name)).alias("v")))
        pairs = F.transform(F.array_sort(entries, _by_ordinal), lambda e: F.struct(e["k"], e["v"]))
        columns.append(F.map_from_entries(pairs).alias(name))
    return rows.agg(F.struct(*columns).alias("sample")).scalar()


def _by_ordinal(a: Column, b: Column) -> Column:
    return (a["ordinal"] - b["ordinal"]).cast("int")


def summary_document(df: DataFrame, source: str, order_by: str | list[str], pretty: bool = False) -> DataFrame:
    """One row, `document`: the full profile that describes a table to a reader or a model.

    Every section is a subquery over a table of schema size; the sections run side by side. Rows, missing values and moments
    come from one scan; texts have one, correlations two, and the samples one each.
    """
    numbers, texts, times = fam.numeric_columns(df), fam.categorical_columns(df), fam.time_columns(df)
    parts = [
        F.lit(source).alias("filename"),
        F.struct(F.col("overview.rows").alias("rows"), F.lit(len(fam.data_columns(df))).alias("columns")).alias("shape"),
        F.struct(_names(numbers).alias("numeric"), _names(texts).alias("categorical"),
                 _names(fam.data_columns(df)).alias("all_columns")).alias("columns"),
        sample_columns(df, order_by).alias("sample_data"),
        _literal_map(fam.data_types(df)).alias("data_types"),
        _missing().alias("missing_values"),
        (_basic_stats(numbers) if numbers else _empty()).alias("basic_stats"),
        (_correlations(df, numbers) if len(numbers) > 1 else _empty()).alias("correlations"),
        _empty().alias("trends"),
        _empty().alias("outliers"),
    ]
    if texts:
        parts.append(_categorical_stats(df, texts).alias("categorical_stats"))
    if times:
        parts += [_names(times).alias("time_columns"), _time_sample(df).alias("time_sample")]
    options = {**JSON_OPTIONS, "pretty": "true"} if pretty else JSON_OPTIONS
    facts = df.sparkSession.range(1).select(describe.overview(df).alias("overview"), _quartiles(df, numbers, []).alias("quartiles"))
    return facts.select(F.to_json(F.struct(*parts), options).alias("document"))


def _empty() -> Column:
    return F.create_map().cast("map<string,string>")


def _basic_stats(numbers: list[str]) -> Column:
    def one(x: Column) -> Column:
        q = F.try_element_at("quartiles", x["column"])
        return F.struct(*[(q[s] if s.startswith("q") else x[s]).alias(n) for s, n in NUMERIC_NAMES.items()])

    return _by_column(F.filter("overview.columns", lambda x: x["column"].isin(*numbers)), one)


def _correlations(df: DataFrame, numbers: list[str]) -> Column:
    matrix = correlation.correlation_matrix(df, numbers)
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("other").alias("k"), F.col("r").alias("v"))), _by_key))
    return _as_map(matrix.groupBy("column").agg(entries.alias("row")), "column", F.col("row"))


def _categorical_stats(df: DataFrame, texts: list[str]) -> Column:
    keys = counts.key_counts(df, texts)
    ranked = F.collect_list(F.struct("rank", F.col("value").alias("k"), F.col("n").alias("v")))
    ordered = F.transform(F.array_sort(ranked), lambda e: F.struct(e["k"], e["v"]))
    tops = counts.top_of_keys(df, texts, keys, TOP_VALUES).groupBy("column").agg(F.map_from_entries(ordered).alias("top_values"))
    unique = keys.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    none = F.create_map().cast("map<string,bigint>")
    table = counts.with_all_columns(df, texts, tops.join(unique, "column"), top_values=none, unique_count=F.lit(0).cast("bigint"))
    return _as_map(table, "column", F.struct("top_values", "unique_count"))


def _time_sample(df: DataFrame) -> Column:
    moments = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "moment"))), lambda e: e["moment"])
    return _as_map(samples.time_sample(df).groupBy("column").agg(moments.alias("moments")), "column", F.col("moments"))


def availability_document(df: DataFrame) -> DataFrame:
    """One row, `document`: how many columns of each family there are, and whether there is data."""
    known = fam.availability(df, 0)
    rows = describe.row_count(df).scalar()
    body = F.struct(
        rows.alias("rows"),
        *[F.lit(known[n]).alias(n) for n in ("columns", "numeric_columns_count", "categorical_columns_count")],
        ((rows > 0) & F.lit(known["columns"] > 0)).alias("has_data"),
    )
    return df.sparkSession.range(1).select(F.to_json(body).alias("document"))
