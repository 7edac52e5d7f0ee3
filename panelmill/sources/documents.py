"""JSON documents as output: one compact UTF-8 document per row, never NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import JSON_OPTIONS, json_table


def json_documents(df: DataFrame) -> DataFrame:
    """Each row as one JSON document in the column `document`; missing values are null."""
    return json_table(df).select(F.to_json(F.struct("*"), JSON_OPTIONS).alias("document"))


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the column `document`, one line each. Documents must not be pretty-printed."""
    documents.select(F.col("document").alias("value")).write.mode(mode).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents written before, one per row."""
    return spark.read.text(path).withColumnRenamed("value", "document")
