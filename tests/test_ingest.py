import datetime
import json

import pytest
from books import write_book
from pyspark.sql import functions as F

from panelmill.errors import EmptyInputError
from panelmill.plans import charts, ingest
from panelmill.sources import catalog, documents, tables, uploads, workbooks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("landing")
    (place / "deep").mkdir()
    write_book(place / "trips.xlsx", {
        1: ["Name", "Dept", "When", "Cost", "Paid", None, "Cost"],
        2: ["Ann", "Sales", ("date", 44211, 1), 1500, True, None, 1.5],
        3: ["Bob", "IT", ("date", 44260.5, 2), 3000, False, None, ("date", 2.5, 3)],
        6: ["Cy", ("inline", "Sales"), None, 1800, ("error",), None, "n/a"],
        7: [],
    })
    write_book(place / "deep" / "more.XLSX", {2: ["Name", "Cost"], 3: ["Dee", 0.5], 4: ["Eve", 7, "extra"]})
    write_book(place / "empty.xlsx", {1: ["Name", "Cost"]})
    (place / "broken.xlsx").write_bytes(b"PK\x03\x04 not a workbook")
    (place / "text.xlsx").write_bytes(b"name,cost")
    (place / "old.xls").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1"))
    (place / "notes.csv").write_text("a,b")
    (place / "huge.xlsx").write_bytes(b"PK\x03\x04" + b"0" * 9000)
    return str(place)


def test_folder_check(spark, folder):
    reasons = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in uploads.check_folder(spark, folder, max_size=8000).collect()}
    assert reasons == {
        "trips.xlsx": None, "more.XLSX": None, "empty.xlsx": None, "broken.xlsx": None, "text.xlsx": "content",
        "old.xls": "legacy_format", "notes.csv": "extension", "huge.xlsx": "too_large"}


def test_size_filter_reaches_the_file_source(spark, folder):
    plan = uploads.accepted_contents(spark, folder, 8000)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,8000)" in plan


def test_cells_become_typed_rows(spark, folder):
    df = workbooks.read_workbooks(spark, folder)
    assert dict(df.dtypes) == {
        "Name": "string", "Cost": "double", "Dept": "string", "When": "timestamp", "Unnamed: 2": "string", "Paid": "boolean",
        "Unnamed: 5": "double", "Cost.1": "double", "_file": "string", "_row": "bigint"}
    rows = [r.asDict() for r in df.where(F.col("_file").endswith("trips.xlsx")).orderBy("_row").collect()]
    assert [r["_row"] for r in rows] == [1, 2, 3, 4, 5]
    assert rows[0]["When"] == datetime.datetime(2021, 1, 15) and rows[1]["When"] == datetime.datetime(2021, 3, 5, 12)
    assert [r["Paid"] for r in rows] == [True, False, None, None, None]
    assert [r["Cost.1"] for r in rows] == [1.5, 2.5, None, None, None]
    assert rows[4]["Dept"] == "Sales" and rows[2]["Name"] is None
    more = df.where(F.col("_file").endswith("more.XLSX")).orderBy("_row").collect()
    assert [(r["Name"], r["Cost"], r["Unnamed: 2"]) for r in more] == [("Dee", 0.5, None), ("Eve", 7.0, "extra")]


def test_given_schema_reads_once(spark, folder):
    df = workbooks.read_workbooks(spark, folder, "Cost bigint, Name string")
    assert sorted((r["Name"] or "", r["Cost"]) for r in df.where("Cost is not null").collect()) == [
        ("Ann", 1500), ("Bob", 3000), ("Cy", 1800), ("Eve", 7)]


def test_calendar_of_1904(spark, tmp_path):
    write_book(tmp_path / "mac.xlsx", {1: ["d"], 2: [("date", 0, 1)], 3: [("date", 366, 1)]}, epoch_1904=True)
    rows = workbooks.read_workbooks(spark, str(tmp_path)).orderBy("_row").collect()
    assert [r["d"] for r in rows] == [datetime.datetime(1904, 1, 1), datetime.datetime(1905, 1, 1)]


def test_unreadable_files_are_reported(spark, folder):
    rows = workbooks.workbook_rows(workbooks.folder_files(spark, folder, 8000)).where("_row = -1").collect()
    assert [(r["_file"].rsplit("/", 1)[-1], r["cells"][0]["kind"]) for r in rows] == [("broken.xlsx", "error")]
    with pytest.raises(EmptyInputError):
        workbooks.infer_schema(spark.createDataFrame([], workbooks.ROWS))


def test_row_order_comes_from_ingestion(spark, folder):
    df = workbooks.read_workbooks(spark, folder).where(F.col("_file").endswith("trips.xlsx"))
    points = charts.chart_points(df, {"chart_type": "line", "source_columns": ["Name"]}).orderBy("ordinal").collect()
    assert [p["value"] for p in points] == ["Ann", "Bob", "Cy"]


def test_folder_to_catalog(spark, folder, tmp_path):
    done = ingest.ingest_folder(spark, folder, str(tmp_path), user_id=7, category="trips", max_size=8000)
    live = catalog.current(catalog.read(spark, done.catalog))
    rows = {r["title"]: r for r in live.collect()}
    assert set(rows) == {"Trips Dashboard - trips.xlsx", "Trips Dashboard - more.XLSX"}
    trips = rows["Trips Dashboard - trips.xlsx"]
    assert trips["summary"] == "Analysis of trips.xlsx containing 5 rows and 7 columns"
    (chart,) = json.loads(trips["charts"])
    assert chart["x_axis"] == "Name" and chart["data"]["labels"] == ["Ann", "Bob", "Cy"]
    assert trips["file_url"].endswith("_trips.xlsx") and trips["user_id"] == 7 and trips["version"] == 1
    public = catalog.public_documents(catalog.find(catalog.read(spark, done.catalog), trips["dashboard_id"], 7)).first()
    assert public["dashboard_config"]["title"] == trips["title"]
    assert catalog.find(catalog.read(spark, done.catalog), trips["dashboard_id"], 8).isEmpty()
    files = spark.read.parquet(done.files)
    assert files.count() == 8 and files.where("accepted").count() == 4


def test_ingestion_again(spark, folder, tmp_path):
    """The same folder again appends nothing; a second folder appends its own files only."""
    target = str(tmp_path / "target")
    first = ingest.ingest_folder(spark, folder, target, user_id=7, max_size=8000)
    again = ingest.ingest_folder(spark, folder, target, user_id=7, max_size=8000)
    other = tmp_path / "other"
    other.mkdir()
    write_book(other / "third.xlsx", {1: ["Name"], 2: ["Zed"], 3: ["Zed"]})
    third = ingest.ingest_folder(spark, str(other), target, user_id=7)
    by_run = [{r["path"].rsplit("/", 1)[-1]: r["outcome"] for r in spark.read.parquet(run.outcomes).collect()} for run in (first, again, third)]
    assert by_run[0] == {"trips.xlsx": "new", "more.XLSX": "new", "empty.xlsx": "empty", "broken.xlsx": "unreadable",
                         "text.xlsx": "refused", "old.xls": "refused", "notes.csv": "refused", "huge.xlsx": "refused"}
    assert by_run[1] == {**by_run[0], "trips.xlsx": "known", "more.XLSX": "known"}
    assert by_run[2] == {"third.xlsx": "new"}
    versions = catalog.read(spark, third.catalog)
    assert versions.count() == 3 and versions.select("dashboard_id").distinct().count() == 3
    (chart,) = json.loads(versions.where("title LIKE '%third%'").first()["charts"])
    assert chart["data"]["datasets"][0]["data"] == [2] and chart["status"] == "ok"


def test_table_sources(spark, gaps, tmp_path):
    gaps.write.csv(f"{tmp_path}/csv", header=True)
    gaps.write.orc(f"{tmp_path}/orc")
    gaps.write.json(f"{tmp_path}/json")
    gaps.createOrReplaceTempView("gaps_view")
    for df in (tables.read_table(spark, f"{tmp_path}/csv", "csv", "k string, v double, i long"),
               tables.read_table(spark, f"{tmp_path}/orc", "orc"), tables.read_table(spark, f"{tmp_path}/json", "json", "k string, v double, i long"),
               tables.named_table(spark, "gaps_view")):
        assert df.where("v is null").count() == 3 and df.count() == 7
    assert dict(tables.read_table(spark, f"{tmp_path}/csv", "csv").dtypes)["i"] == "int"


def test_documents(spark, gaps, tmp_path):
    wide = spark.sql("""select double('NaN') as n, array(double('Infinity'), 1d) as a, map(1, date'2020-01-01') as m,
        named_struct('t', timestamp'2020-01-01 10:00:00.5') as s, 1.50bd as d, binary('x') as b, cast(null as int) as z""")
    documents.write_documents(documents.json_documents(wide), f"{tmp_path}/docs")
    (line,) = [r["document"] for r in documents.read_documents(spark, f"{tmp_path}/docs").collect()]
    assert json.loads(line) == {"n": None, "a": [None, 1.0], "m": {"1": "2020-01-01"}, "s": {"t": "2020-01-01T10:00:00.500000"},
                                "d": "1.50", "b": "x", "z": None}
    assert ": " not in line


def test_one_scan_reads_a_folder(spark, folder):
    """Every file has its row, refused ones with the reason; contents are opened in one scan."""
    scan = workbooks.scan_folder(spark, folder, max_size=8000)
    files = {r["_file"].rsplit("/", 1)[-1]: (r["accepted"], r["reason"]) for r in scan.where(F.col("_row") == workbooks.FILE_ROW).collect()}
    checked = uploads.check_folder(spark, folder, 8000).collect()
    assert files == {r["path"].rsplit("/", 1)[-1]: (r["accepted"], r["reason"]) for r in checked} and len(files) == 8
    rows = workbooks.workbook_rows(workbooks.folder_files(spark, folder, 8000))
    assert sorted(map(tuple, scan.where(F.col("_row") > workbooks.FILE_ROW).select(*rows.columns).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert scan._jdf.queryExecution().executedPlan().toString().count("content#") > 0
    assert scan._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2  # the listing has no contents


def test_readers_take_files_of_any_size(spark, tmp_path):
    write_book(tmp_path / "big.xlsx", {1: ["Name"], **{i: [f"row {i} " + "x" * 90] for i in range(2, 60)}})
    assert workbooks.read_workbooks(spark, str(tmp_path)).count() == 58
    assert workbooks.read_workbooks(spark, str(tmp_path), "Name string", max_size=10).count() == 0
