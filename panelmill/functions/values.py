"""Value handling: missing values, text forms, coercions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .families import CATEGORICAL, DATETIME, NUMERIC, family_of, type_of


# Documents keep missing values as null.
JSON_OPTIONS = {"ignoreNullFields": "false"}


def quoted(name: str) -> str:
    """A column name safe inside an expression, whatever characters a header holds."""
    return "`" + name.replace("`", "``") + "`"


def raw(name: str) -> Column:
    return F.col(quoted(name))


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so that counts and statistics skip it.

    Only float columns are wrapped; others stay bare, which keeps their filters pushed down.
    """
    column = raw(name)
    if isinstance(type_of(df, name), (T.FloatType, T.DoubleType)):
        return F.nanvl(column, F.lit(None).cast(type_of(df, name)))
    return column


def clean_table(df: DataFrame) -> DataFrame:
    """Every float column cleaned; a plain projection."""
    return df.select(*[clean(df, name).alias(name) for name in df.columns])


def as_micros(column: Column) -> Column:
    """Date or timestamp as microseconds since the epoch, in the session time zone (UTC)."""
    return F.unix_micros(column.cast("timestamp"))


def iso(column: Column, data_type: T.DataType, separator: str = "'T'") -> Column:
    """ISO text of a date or timestamp; the fraction appears only when it is not zero."""
    if isinstance(data_type, T.DateType):
        return column.cast("string")
    pattern = f"yyyy-MM-dd{separator}HH:mm:ss"
    precise = F.date_format(column, pattern + ".SSSSSS")
    return F.when(precise.endswith(".000000"), F.date_format(column, pattern)).otherwise(precise)


def label_text(column: Column, data_type: T.DataType) -> Column:
    """The text of a group key on an axis."""
    if family_of(data_type) == DATETIME:
        return iso(column, data_type)
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def json_ready(column: Column, data_type: T.DataType) -> Column:
    """The column in a form `to_json` renders as plain JSON: no NaN, ISO dates, nesting kept."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        finite = ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))
        return F.when(finite, column)
    if family_of(data_type) == DATETIME:
        return iso(column, data_type)
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda item: json_ready(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(
            F.transform_keys(column, lambda k, v: label_text(k, data_type.keyType)),
            lambda k, v: json_ready(v, data_type.valueType),
        )
    if isinstance(data_type, T.StructType):
        fields = [json_ready(column.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType)):
        return column
    if isinstance(data_type, T.VariantType):
        return column
    return column.cast("string")


def json_table(df: DataFrame) -> DataFrame:
    """Every column in its JSON-ready form."""
    return df.select(*[json_ready(raw(f.name), f.dataType).alias(f.name) for f in df.schema])


def to_timestamp_or_null(column: Column, data_type: T.DataType, formats: list[str] | None = None) -> Column:
    """Parse to a timestamp; what cannot be parsed becomes null.

    Numbers are nanoseconds since the epoch. Text is read with the given formats in order, else as ISO.
    """
    family = family_of(data_type)
    if family == DATETIME:
        return column.cast("timestamp")
    if family == NUMERIC:
        if isinstance(data_type, T.IntegralType):
            # Whole numbers stay whole: a double cannot hold today's nanoseconds.
            return F.timestamp_micros(F.call_function("div", column - F.pmod(column, F.lit(1000)), F.lit(1000)))
        return F.timestamp_micros(F.floor(column / F.lit(1000)).try_cast("bigint"))
    if family == CATEGORICAL:
        if not formats:
            return F.try_to_timestamp(column)
        return F.coalesce(*[F.try_to_timestamp(column, F.lit(one)) for one in formats])
    return F.lit(None).cast("timestamp")


def capitalized(column: Column) -> Column:
    """First letter upper case, the rest lower case."""
    first, rest = column.substr(F.lit(1), F.lit(1)), column.substr(F.lit(2), F.length(column))
    return F.concat(F.upper(first), F.lower(rest))


def comma_list(column: Column) -> Column:
    """Comma-separated text to an array; null or empty text gives an empty array."""
    return F.when(F.length(column) > 0, F.split(column, ",")).otherwise(F.array().cast("array<string>"))


def int_or_default(column: Column, default: int) -> Column:
    """Whole number in text, or the default where the text is missing or not a number."""
    return F.coalesce(F.trim(column).try_cast("int"), F.lit(default))


def or_blank(column: Column) -> Column:
    """Missing statistics and texts as an empty string, for documents only."""
    return F.coalesce(column.cast("string"), F.lit(""))
