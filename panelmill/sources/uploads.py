"""Uploaded files: acceptance rules, size limit, landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What counts as a workbook upload.
EXTENSIONS = (".xlsx", ".xls")
MIME_TYPES = (
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel",
)
MAX_FILE_SIZE = 10 * 1024 * 1024
# First bytes of the two container formats: zip (.xlsx) and compound file (.xls).
ZIP_MAGIC, COMPOUND_MAGIC = "504B0304", "D0CF11E0"


def file_kind(name: Column) -> Column:
    """The accepted extension a file name ends with, in lower case; null for any other name."""
    lowered = F.lower(name)
    kind = F.lit(None).cast("string")
    for extension in reversed(EXTENSIONS):
        kind = F.when(lowered.endswith(extension), F.lit(extension)).otherwise(kind)
    return kind


def rejection(name: Column, size: Column, mime: Column | None = None, magic: Column | None = None,
              max_size: int | None = MAX_FILE_SIZE) -> Column:
    """Why a file is refused, or null if it is accepted. The first rule that fails gives the reason; without `max_size` any size is right."""
    reason = F.when(file_kind(name).isNull(), F.lit("extension"))
    if mime is not None:
        reason = reason.when(mime.isNull() | ~mime.isin(*MIME_TYPES), F.lit("content_type"))
    if max_size is not None:
        reason = reason.when(size > max_size, F.lit("too_large"))
    if magic is not None:
        reason = reason.when((file_kind(name) == ".xls") & (magic == COMPOUND_MAGIC), F.lit("legacy_format"))
        reason = reason.when(magic.isNull() | (magic != ZIP_MAGIC), F.lit("content"))
    return reason


def check_uploads(df: DataFrame, name: str, size: str, mime: str | None = None, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """A table of upload requests with `accepted` and `reason` added."""
    reason = rejection(F.col(name), F.col(size), F.col(mime) if mime else None, max_size=max_size)
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """`path, modificationTime, length` of every file under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return files.load(folder).select("path", "modificationTime", "length")


def check_folder(spark: SparkSession, folder: str, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """`path, modificationTime, length, accepted, reason` of every file, by name, size and first bytes.

    Only files that pass name and size are opened: those filters reach the file source.
    """
    listed = list_files(spark, folder)
    by_name = rejection(F.col("path"), F.col("length"), max_size=max_size)
    refused = listed.select("path", "modificationTime", "length", by_name.alias("reason")).where(F.col("reason").isNotNull())
    magic = F.hex(F.substring("content", 1, 4))
    opened = accepted_contents(spark, folder, max_size).select(
        "path", "modificationTime", "length", rejection(F.col("path"), F.col("length"), magic=magic, max_size=max_size).alias("reason"))
    return refused.unionByName(opened).withColumn("accepted", F.col("reason").isNull())


def accepted_contents(spark: SparkSession, folder: str, max_size: int | None = MAX_FILE_SIZE) -> DataFrame:
    """`path, modificationTime, length, content` of files with an accepted name and, if it is limited, size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.where(file_kind(F.col("path")).isNotNull())
    return named if max_size is None else named.where(F.col("length") <= max_size)


def file_identity(files: DataFrame) -> Column:
    """The same id for the same path, size and time of change in every run, as far as the table has them."""
    known = [F.col(c).cast("string") for c in ("path", "length", "modificationTime") if c in files.columns]
    return F.substring(F.sha2(F.concat_ws("|", *known), 256), 1, 32)


def landed(files: DataFrame, day: Column | None = None) -> DataFrame:
    """Add `file_id`, the stored name `<file_id>_<name>` and the ingest date."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("file_id", file_identity(files))
    return rows.withColumn("stored_name", F.concat_ws("_", "file_id", name)).withColumn(
        "ingest_date", day if day is not None else F.current_date())


def write_landing(files: DataFrame, path: str) -> None:
    """Append landed files, partitioned by ingest date."""
    landed(files).write.mode("append").partitionBy("ingest_date").parquet(path)
