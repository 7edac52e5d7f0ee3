"""Workbooks (.xlsx) as tables: a folder of files is read in parallel, one file at a time per task.

The files come through Spark's binary file source, so any storage Spark reads will do, the size limit is
applied before a file is opened, and Spark spreads the files over tasks. A small reader turns the first
sheet of one file into rows; typing, filtering and everything after it are DataFrame operations.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import EmptyInputError
from ..functions.families import FILE_COLUMN, ROW_COLUMN
from .uploads import ZIP_MAGIC, accepted_contents, list_files, rejection

# Fixed values of the file format: built-in date styles, and texts that spreadsheets use for "missing".
DATE_STYLES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
MISSING_TEXTS = {
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
}
CELL = pa.struct([("position", pa.int32()), ("column", pa.string()), ("kind", pa.string()), ("text", pa.string())])
ROW_FIELDS = pa.schema([(FILE_COLUMN, pa.string()), (ROW_COLUMN, pa.int64()), ("cells", pa.list_(CELL))])
ROWS = f"{FILE_COLUMN} string, {ROW_COLUMN} bigint, cells array<struct<position: int, column: string, kind: string, text: string>>"
# What a scan of a folder adds to the row that stands for a file.
SCAN = f"{ROWS}, length bigint, modificationTime timestamp, magic string"
FILE_ROW = -2
HEADER, ERROR = "header", "error"
BATCH_ROWS = 4_096


def workbook_rows(files: DataFrame) -> DataFrame:
    """`_file, _row, cells` of the first sheet of each file in `files` (`_file`, `content`).

    Row 0 is the header. A cell is `position, column, kind, text` with the kind int, float, bool, date,
    text, or header where it only names a column; missing cells are left out, blank rows inside the sheet
    are kept. A file that cannot be read gives one row -1 with a cell of kind error.
    """
    return files.select(FILE_COLUMN, "content").mapInArrow(_read_batches, ROWS)


def scan_folder(spark: SparkSession, folder: str, max_size: int | None = None) -> DataFrame:
    """A folder in one read: `_file, _row, cells, length, modificationTime, reason, accepted`.

    Every file has a row FILE_ROW with its size, time and the reason it was refused for, if it was; the others are those of
    `workbook_rows`. Files refused by name or size are listed and never opened; the others are opened once, for the first bytes
    and the rows alike.
    """
    listed = list_files(spark, folder).withColumnRenamed("path", FILE_COLUMN)
    by_name = rejection(F.col(FILE_COLUMN), F.col("length"), max_size=max_size)
    shut = listed.select(FILE_COLUMN, F.lit(FILE_ROW).cast("bigint").alias(ROW_COLUMN), F.lit(None).cast("array<struct<position: int, column: string, kind: string, text: string>>").alias("cells"),
                         "length", "modificationTime", by_name.alias("reason")).where(F.col("reason").isNotNull())
    opened = accepted_contents(spark, folder, max_size).select("path", "length", "modificationTime", "content").mapInArrow(_scan_batches, SCAN)
    by_content = rejection(F.col(FILE_COLUMN), F.col("length"), magic=F.col("magic"), max_size=max_size)
    read = opened.withColumn("reason", F.when(F.col(ROW_COLUMN) == FILE_ROW, by_content)).drop("magic")
    return shut.unionByName(read).withColumn("accepted", F.when(F.col(ROW_COLUMN) == FILE_ROW, F.col("reason").isNull()))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            content = one.column("content")[0].as_py()
            file = pa.RecordBatch.from_arrays([one.column("path"), pa.array([FILE_ROW], pa.int64()), pa.nulls(1, pa.list_(CELL)), one.column("length"),
                                               one.column("modificationTime"), pa.array([content[:4].hex().upper()])], names=_SCAN_NAMES)
            yield file
            if file.column("magic")[0].as_py() == ZIP_MAGIC:
                for rows in _read_batches([one.select(["path", "content"])]):
                    empty = [pa.nulls(rows.num_rows, file.schema.field(n).type) for n in _SCAN_NAMES[3:]]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *empty], names=_SCAN_NAMES)


_SCAN_NAMES = [FILE_COLUMN, ROW_COLUMN, "cells", "length", "modificationTime", "magic"]


def workbook_cells(rows: DataFrame) -> DataFrame:
    """`_file, _row, position, column, kind, text`: one row per cell."""
    return rows.select(FILE_COLUMN, ROW_COLUMN, F.inline("cells"))


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1)):
            rows = []
            for number, cells in _safely(content.as_py()):
                rows.append((name.as_py(), number, cells))
                if len(rows) == BATCH_ROWS:
                    yield _to_arrow(rows)
                    rows = []
            if rows:
                yield _to_arrow(rows)


def _to_arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), ROW_FIELDS)]
    return pa.RecordBatch.from_arrays(columns, schema=ROW_FIELDS)


def _cell(position: int, column: str | None, kind: str, text: str | None) -> dict:
    return {"position": position, "column": column, "kind": kind, "text": text}


def _safely(content: bytes) -> Iterator[tuple[int, list[dict]]]:
    try:
        yield from _sheet_rows(content)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, StopIteration) as problem:
        yield -1, [_cell(-1, None, ERROR, f"{type(problem).__name__}: {problem}")]


def _sheet_rows(content: bytes) -> Iterator[tuple[int, list[dict]]]:
    """(row number below the header, cells) of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        sheet, shifted = _first_sheet(book)
        strings = _shared_strings(book) if "xl/sharedStrings.xml" in names else []
        dated = _date_styles(book) if "xl/styles.xml" in names else []
        header, top, last = {}, None, 0
        with book.open(sheet) as stream:
            for number, raw_cells in _rows(stream):
                values = [(at, *_typed(cell, strings, dated, shifted)) for at, cell in raw_cells]
                values = [v for v in values if v[1] is not None]
                if not values:
                    continue
                if top is None:
                    top, header = number, _header(values)
                    yield 0, [_cell(at, name, HEADER, None) for at, name in header.items()]
                    continue
                for blank in range(last + 1, number - top):
                    yield blank, []
                last = number - top
                cells = []
                for at, kind, text in values:
                    if at not in header:
                        header[at] = f"Unnamed: {at}"
                        cells.append(_cell(at, header[at], HEADER, None))
                    cells.append(_cell(at, header[at], kind, text))
                yield last, cells


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """Path of the first sheet, and whether dates count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    shifted = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
    sheet = next(e for e in root.iter() if _local(e.tag) == "sheet")
    relation = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.get("Target") for e in links if e.get("Id") == relation)
    return (target.lstrip("/") if target.startswith("/") else f"xl/{target}"), shifted


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    texts = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, item in ElementTree.iterparse(stream):
            if _local(item.tag) == "si":
                texts.append(_plain_text(item))
                item.clear()
    return texts


def _plain_text(item: ElementTree.Element) -> str:
    """Text of a string item: its runs joined, phonetic hints left out."""
    runs = [item] + [r for r in item if _local(r.tag) == "r"]
    return "".join(t.text or "" for run in runs for t in run if _local(t.tag) == "t")


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style, whether it shows a date or time."""
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {}
    for item in root.iter():
        if _local(item.tag) == "numFmt":
            bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", item.get("formatCode", ""))
            custom[int(item.get("numFmtId"))] = bool(re.search(r"[ymdhs]", bare, re.IGNORECASE)) and "General" not in bare
    styles = next((e for e in root if _local(e.tag) == "cellXfs"), [])
    numbers = [int(xf.get("numFmtId", 0)) for xf in styles]
    return [custom.get(n, n in DATE_STYLES) for n in numbers]


def _rows(stream) -> Iterator[tuple[int, list]]:
    """(row number, cells with their column position) in sheet order, freeing each row after use."""
    number = 0
    for _, row in ElementTree.iterparse(stream):
        if _local(row.tag) != "row":
            continue
        number = int(row.get("r", number + 1))
        cells, at = [], -1
        for cell in row:
            letters = re.match(r"[A-Z]+", cell.get("r", ""))
            at = _position(letters.group()) if letters else at + 1
            cells.append((at, cell))
        yield number, cells
        row.clear()


def _position(letters: str) -> int:
    total = 0
    for letter in letters:
        total = total * 26 + ord(letter) - 64
    return total - 1


def _typed(cell, strings: list[str], dated: list[bool], shifted: bool) -> tuple[str | None, str | None]:
    kind = cell.get("t", "n")
    value = next((e for e in cell if _local(e.tag) == ("is" if kind == "inlineStr" else "v")), None)
    if value is None or kind == "e":
        return None, None
    if kind in ("s", "inlineStr", "str"):
        text = _plain_text(value) if kind == "inlineStr" else value.text or ""
        text = strings[int(text)] if kind == "s" else text
        return (None, None) if text in MISSING_TEXTS else ("text", text)
    if kind == "b":
        return "bool", "true" if value.text == "1" else "false"
    if kind == "d":
        return "date", value.text
    number, style = float(value.text), int(cell.get("s", 0))
    if style < len(dated) and dated[style]:
        return "date", _moment(number, shifted)
    if number.is_integer() and abs(number) < 2**63:
        return "int", str(int(value.text) if value.text.lstrip("-").isdigit() else int(number))
    return "float", repr(number)


def _moment(days: float, shifted: bool) -> str:
    """ISO text of a serial day. The 1900 calendar counts a 29 February that never was."""
    start = datetime(1904, 1, 1) if shifted else datetime(1899, 12, 31 if days < 60 else 30)
    return (start + timedelta(microseconds=round(days * 86_400_000) * 1000)).isoformat(sep=" ")


def _header(values: list[tuple]) -> dict[int, str]:
    """Column names by position; blanks and repeats are made unique."""
    texts = {at: text for at, _, text in values}
    names, seen = {}, {}
    for at in range(max(texts) + 1):
        name = texts.get(at, f"Unnamed: {at}")
        seen[name] = seen.get(name, -1) + 1
        names[at] = f"{name}.{seen[name]}" if seen[name] else name
    return names


def folder_files(spark: SparkSession, folder: str, max_size: int | None = None) -> DataFrame:
    """`_file`, `content` of the workbooks in a folder that pass the checks."""
    opened = accepted_contents(spark, folder, max_size).where(F.hex(F.substring("content", 1, 4)) == ZIP_MAGIC)
    return opened.select(F.col("path").alias(FILE_COLUMN), "content")


def column_kinds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, column, position, data_type, present`: the type of each column from the kinds of its cells."""
    kinds = F.collect_set(F.when(F.col("kind") != HEADER, F.col("kind")))  # at most five kinds
    found = cells.where(F.col("position") >= 0).groupBy(*keys, "column").agg(
        F.min("position").alias("position"), kinds.alias("kinds"), F.count_if(F.col("kind") != HEADER).alias("present"))
    return found.select(*keys, "column", "position", _type_name(F.col("kinds")).alias("data_type"), "present")


def _type_name(kinds: Column) -> Column:
    """An empty column is a double, as a column of missing numbers is."""

    def only(*allowed: str) -> Column:
        return F.size(F.array_except(kinds, F.array(*[F.lit(k) for k in allowed]))) == 0

    return (
        F.when(F.size(kinds) == 0, "double").when(only("int"), "bigint").when(only("int", "float"), "double")
        .when(only("date"), "timestamp").when(only("bool"), "boolean").otherwise("string")
    )


def infer_schema(rows: DataFrame) -> T.StructType:
    """One schema for all workbooks of a folder, columns in sheet order. Collects one row per header name."""
    names = column_kinds(workbook_cells(rows), []).orderBy("position", "column").collect()
    if not names:
        raise EmptyInputError("no readable workbook")
    schema = T.StructType()
    for name in names:
        schema = schema.add(name["column"], name["data_type"])
    return schema


def read_workbooks(spark: SparkSession, folder: str, schema: T.StructType | str | None = None,
                   max_size: int | None = None) -> DataFrame:
    """The first sheets of all accepted workbooks as one table, with `_file` and `_row` added.

    Give a schema to read the files once; without one they are read twice, first for the types. Write the
    result to parquet before querying it more than once.
    """
    rows = workbook_rows(folder_files(spark, folder, max_size))
    if schema is None:
        schema = infer_schema(rows)
    return typed_rows(rows, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def typed_rows(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of a schema; a cell that does not fit its column's type is null."""
    filled = F.filter("cells", lambda c: c["kind"] != HEADER)
    by_name = F.map_from_entries(F.transform(filled, lambda c: F.struct(c["column"], c["text"])))
    body = rows.where(F.col(ROW_COLUMN) > 0).select(FILE_COLUMN, ROW_COLUMN, by_name.alias("_cells"))
    fields = [F.try_element_at("_cells", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return body.select(*fields, FILE_COLUMN, ROW_COLUMN)
