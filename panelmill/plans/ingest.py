"""From a landing folder to the catalog: check files, read workbooks, build dashboards, store them.

All files go through together: every step is one Spark job over the whole folder, keyed by file, so ten
files and ten million files run the same few jobs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import colors
from ..functions.families import FILE_COLUMN, ROW_COLUMN
from ..sources import uploads, workbooks
from ..sources.store import CatalogStore
from . import texts
from .spec import BASIC_LIMIT, DEFAULTS


@dataclass(frozen=True)
class Ingested:
    """Where the results of a run are: its files, rows and outcomes, and the catalog of all runs."""

    run_id: str
    files: str
    rows: str
    outcomes: str
    catalog: str


def ingest_folder(spark: SparkSession, folder: str, target: str, user_id: int, category: str | None = None,
                  description: str | None = None, max_size: int = uploads.MAX_FILE_SIZE) -> Ingested:
    """Run the whole path for a folder and append one dashboard per readable workbook that has none yet.

    `target` is a shared folder. Every run writes its files and rows to folders of its own and reads only
    these, so its cost follows what is new. Contents are read once. A file is known by path, size and time of change: run again over
    the same folder and nothing is appended twice. `outcomes` has a row per file: `outcome` is refused (with
    `reason`), unreadable, empty, known or new, the last two with the `dashboard_id`.
    """
    run = uuid.uuid4().hex
    places = Ingested(run, *[f"{target}/{kind}/run_id={run}" for kind in ("files", "rows", "outcomes")], f"{target}/catalog")
    workbooks.scan_folder(spark, folder, max_size).write.parquet(places.rows)
    scanned = spark.read.parquet(places.rows)
    found = scanned.where(F.col(ROW_COLUMN) == workbooks.FILE_ROW).withColumnRenamed(FILE_COLUMN, "path")
    uploads.write_landing(found.select("path", "modificationTime", "length", "reason", "accepted"), places.files)
    files = spark.read.parquet(places.files)
    rows = scanned.where(F.col(ROW_COLUMN) > workbooks.FILE_ROW).select(FILE_COLUMN, ROW_COLUMN, "cells")
    boards_of = CatalogStore(spark, places.catalog)
    found = file_outcomes(files, rows, boards_of.versions())
    found.write.parquet(places.outcomes)
    fresh = spark.read.parquet(places.outcomes).where("outcome = 'new'").select(
        F.col("path").alias(FILE_COLUMN), "dashboard_id", F.concat(F.lit("/uploads/"), F.col("stored_name")).alias("file_url"))
    boards = file_dashboards(rows, category, description)
    ready = boards.join(fresh, FILE_COLUMN).withColumn("user_id", F.lit(user_id))
    boards_of.create(run, ready)
    return places


def file_outcomes(files: DataFrame, rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """`path, length, reason, outcome, dashboard_id, stored_name`: what becomes of every file of a run.

    `rows` are those of `workbook_rows`: row -1 stands for a file that cannot be read, rows from 1 are data.
    """
    read = rows.groupBy(F.col(FILE_COLUMN).alias("path")).agg(
        F.max(F.when(F.col(ROW_COLUMN) > 0, 1).otherwise(0)).alias("_data"), F.min(ROW_COLUMN).alias("_least"))
    seen = files.join(read, "path", "left").withColumn("_known", F.lit(False))
    if stored is not None:
        ids = stored.select(F.col("dashboard_id").alias("file_id")).distinct().withColumn("_there", F.lit(True))
        seen = seen.join(ids, "file_id", "left").withColumn("_known", F.coalesce("_there", F.lit(False)))
    outcome = (F.when(~F.col("accepted"), "refused").when(F.col("_least") < 0, "unreadable")
               .when(F.coalesce("_data", F.lit(0)) == 0, "empty").when(F.col("_known"), "known").otherwise("new"))
    named = seen.withColumn("outcome", outcome)
    board = F.when(F.col("outcome").isin("known", "new"), F.col("file_id"))
    return named.select("path", "length", "reason", "outcome", board.alias("dashboard_id"), "stored_name")


def file_dashboards(rows: DataFrame, category: str | None = None, description: str | None = None) -> DataFrame:
    """One rule-based dashboard per file from `workbook_rows`; empty and unreadable files give none."""
    cells = workbooks.workbook_cells(rows)
    kinds = workbooks.column_kinds(cells, [FILE_COLUMN])
    sizes = rows.where(F.col(ROW_COLUMN) > 0).groupBy(FILE_COLUMN).agg(F.max(ROW_COLUMN).alias("rows"))
    shapes = kinds.groupBy(FILE_COLUMN).agg(
        F.count(F.lit(1)).alias("fields"),
        F.min(F.when(F.col("data_type") == "string", F.struct("position", "column"))).alias("_first"))
    shaped = sizes.join(shapes, FILE_COLUMN).select(FILE_COLUMN, "rows", "fields", F.col("_first.column").alias("column"))
    values = cells.where(~F.col("kind").isin(workbooks.HEADER, workbooks.ERROR))
    return group_dashboards(shaped, values.select(FILE_COLUMN, "column", "text"), FILE_COLUMN, category, description)


def group_top_values(values: DataFrame, group: str, limit: int = BASIC_LIMIT) -> DataFrame:
    """`group, ordinal, text, n`: the most frequent texts per group. Counts are combined before the
    shuffle and the rank filter runs per task too, so a group that holds most rows is spread out."""
    counted = values.groupBy(group, "text").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), F.asc("text"))
    ranked = counted.withColumn("ordinal", F.row_number().over(order))
    return ranked.where(F.col("ordinal") <= limit).select(group, F.col("ordinal").cast("bigint").alias("ordinal"), "text", "n")


def group_dashboards(shapes: DataFrame, values: DataFrame, group: str, category: str | None = None,
                     description: str | None = None) -> DataFrame:
    """The rule-based dashboard of every group at once.

    `shapes` has one row per group: `group, rows, fields, column` (the column to chart, or null); `values`
    has `group, column, text`.
    """
    charted = values.join(shapes.select(group, "column"), [group, "column"], "left_semi")
    points = F.array_sort(F.collect_list(F.struct("ordinal", "text", "n"))).alias("points")
    tops = group_top_values(charted, group).groupBy(group).agg(points)
    name, rows, fields = F.element_at(F.split(group, "/"), -1), F.col("rows"), F.col("fields")
    return shapes.join(tops, group, "left").select(
        group,
        texts.title(name, category).alias("title"),
        F.when(F.col("points").isNull(), "[]").otherwise(F.to_json(F.array(_chart()))).alias("charts"),
        F.lit(texts.BASIC_INSIGHTS).alias("insights"),
        texts.summary(name, rows, fields, description).alias("summary"),
        F.to_json(texts.basic_metrics(rows, fields)).alias("key_metrics"),
        F.lit(category).cast("string").alias("category"),
        F.lit("{}").alias("metadata"),
    )


def _chart() -> Column:
    axis, column = F.lit(texts.CHART_AXIS), F.col("column")
    dataset = F.struct(axis.alias("label"), F.col("points.n").alias("data"), F.lit(colors.BASIC_FILL).alias("backgroundColor"))
    data = F.struct(F.col("points.text").alias("labels"), F.array(dataset).alias("datasets"))
    return F.struct(
        F.lit("bar").alias("chart_type"), F.format_string(texts.CHART_TITLE, column).alias("title"),
        column.alias("x_axis"), axis.alias("y_axis"), data.alias("data"),
        F.format_string(texts.CHART_INSIGHTS, column).alias("insights"),
        F.lit(DEFAULTS["color_scheme"]).alias("color_scheme"), F.create_map().cast("map<string,string>").alias("metadata"),
        F.array().cast("array<string>").alias("interactive_features"),
        F.lit("ok").alias("status"), F.lit(1).cast("bigint").alias("parts"),
    )
