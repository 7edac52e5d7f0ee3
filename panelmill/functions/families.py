"""Column families: numeric, categorical, datetime, boolean, other. Metadata only, no job."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

NUMERIC, CATEGORICAL, DATETIME, BOOLEAN, OTHER = "numeric", "categorical", "datetime", "boolean", "other"


# Columns that ingestion adds: the file and the row order. They are not data.
FILE_COLUMN, ROW_COLUMN = "_file", "_row"


def data_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name not in (FILE_COLUMN, ROW_COLUMN)]


def family_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return OTHER


def families(df: DataFrame) -> dict[str, str]:
    """Column name to family, in column order; the columns ingestion adds are left out."""
    return {name: family_of(type_of(df, name)) for name in data_columns(df)}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    """The columns of the wanted families, in column order."""
    return [name for name, family in families(df).items() if family in wanted]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC)


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_of(df, CATEGORICAL)


def time_columns(df: DataFrame) -> list[str]:
    return columns_of(df, DATETIME)


def data_types(df: DataFrame) -> dict[str, str]:
    """Column name to Spark type name."""
    return {name: kind for name, kind in df.dtypes if name in data_columns(df)}


def type_of(df: DataFrame, name: str) -> T.DataType:
    return next(field.dataType for field in df.schema if field.name == name)


def has_columns(df: DataFrame, names: list[str]) -> bool:
    """Exact, case-sensitive check that every name is a column."""
    return set(names) <= set(df.columns)


def availability(df: DataFrame, rows: int) -> dict[str, int | bool]:
    """What the table offers: counts per family and whether there is any data at all."""
    return {
        "rows": rows,
        "columns": len(data_columns(df)),
        "numeric_columns_count": len(numeric_columns(df)),
        "categorical_columns_count": len(categorical_columns(df)),
        "has_data": rows > 0 and len(data_columns(df)) > 0,
    }
