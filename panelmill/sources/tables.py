"""Table sources: any tabular input becomes a DataFrame with NaN already read as missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ..functions.values import clean_table


def read_table(spark: SparkSession, path: str | list[str], format: str = "parquet",
               schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, CSV or JSON from a path. Give a schema for text formats: inferring one costs a scan."""
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", options.get("header", "true"))
        if schema is None:
            reader = reader.option("inferSchema", options.get("inferSchema", "true"))
    return clean_table(reader.load(path))


def named_table(spark: SparkSession, name: str) -> DataFrame:
    """A table or view of the session's catalog."""
    return clean_table(spark.table(name))


def jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
               bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A relational table. With a numeric column and its bounds the read is split into range queries."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
                                numPartitions=partitions)
    return clean_table(reader.load())
