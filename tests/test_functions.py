import random

import pytest
from pyspark.sql import functions as F, types as T

from panelmill.functions import values as val
from panelmill.functions.percent import one_decimal
from panelmill.plans import replies


def test_one_decimal_rounds_like_python(spark):
    rng = random.Random(3)
    numbers = [0.05 * i for i in range(-400, 2001)] + [i / 20 for i in range(-400, 2001)] + [rng.uniform(0, 100) for _ in range(2000)]
    numbers += [0.0, -0.0, 0.049999999999999996, 99.95, 100.0, 1e15, 12.25, 0.15, -0.01]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", one_decimal(F.col("x")).alias("t"))
    wrong = [(r["x"], r["t"]) for r in df.collect() if r["t"] != f"{r['x']:.1f}" and f"{r['x']:.1f}" != f"-{r['t']}"]
    assert wrong == []


def test_time_coercion(spark):
    df = spark.sql("select * from values ('2021-01-15'), ('2021-01-15 10:11:12'), ('15/01/2021'), ('nonsense'), (null) as t(s)")
    plain = [str(r[0]) for r in df.select(val.to_timestamp_or_null(F.col("s"), T.StringType())).collect()]
    assert plain == ["2021-01-15 00:00:00", "2021-01-15 10:11:12", "None", "None", "None"]
    listed = val.to_timestamp_or_null(F.col("s"), T.StringType(), ["yyyy-MM-dd", "dd/MM/yyyy"])
    assert [str(r[0]) for r in df.select(listed).collect()] == ["2021-01-15 00:00:00", "None", "2021-01-15 00:00:00", "None", "None"]
    nanos = spark.sql("select -1L as n")
    assert str(nanos.select(val.to_timestamp_or_null(F.col("n"), T.LongType())).first()[0]) == "1969-12-31 23:59:59.999999"


def test_option_texts(spark):
    df = spark.sql("select * from values ('sALES team', 'a,b', ' 7 '), ('', '', 'x'), (null, null, null) as t(c, l, i)")
    rows = df.select(val.capitalized(F.col("c")), val.comma_list(F.col("l")), val.int_or_default(F.col("i"), 3)).collect()
    assert [tuple(r) for r in rows] == [("Sales team", ["a", "b"], 7), ("", [], 3), (None, [], 3)]


def test_iso(spark):
    df = spark.sql("select timestamp'2020-01-02 03:04:05' as a, timestamp'2020-01-02 03:04:05.06' as b, date'2020-01-02' as c")
    row = df.select(*[val.iso(F.col(f.name), f.dataType) for f in df.schema]).first()
    assert tuple(row) == ("2020-01-02T03:04:05", "2020-01-02T03:04:05.060000", "2020-01-02")


REPLIES = [
    (1, '{"dashboard_title": "T", "charts": [{"chart_type": "pie", "data_config": {"limit": null, "sort": "asc"}}, {}], "key_metrics": [{"metric": "m", "value": 3}]}'),
    (2, 'Sure!\n```json\n{"summary": "multi\\nline", "charts": [{"data_config": {"source_columns": ["a", "b"], "limit": 4}}]}\n```'),
    (3, '{"charts": [}'), (4, "no document"), (5, None), (6, "} {"), (7, '{"charts": "none"}'),
]


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame(REPLIES, "id int, text string")
    return replies.read_replies(df, "text", F.lit("f.xlsx"))


def test_reply_status(read):
    rows = {r["id"]: r for r in read.drop("document").collect()}
    assert {i: r["status"] for i, r in rows.items()} == {1: "ok", 2: "ok", 3: "error", 4: "error", 5: "error", 6: "error", 7: "ok"}
    assert rows[1]["dashboard_title"] == "T" and rows[2]["dashboard_title"] == "Dashboard - f.xlsx"
    assert (rows[3]["dashboard_title"], rows[3]["insights"]) == ("Error", "Error extracting insights")
    assert rows[2]["summary"] == "multi\nline" and rows[2]["metadata"] == "{}"


def test_reply_specs_and_metrics(read):
    specs = {(r["id"], r["chart_no"]): r for r in replies.chart_specs(read, ["id"]).collect()}
    assert set(specs) == {(1, 1), (1, 2), (2, 1)}
    assert (specs[1, 1]["chart_type"], specs[1, 1]["limit"], specs[1, 1]["sort"]) == ("pie", None, "asc")
    assert (specs[1, 2]["chart_type"], specs[1, 2]["limit"], specs[1, 2]["aggregation"]) == ("bar", 15, "count")
    assert (specs[2, 1]["source_columns"], specs[2, 1]["limit"]) == (["a", "b"], 4)
    metrics = replies.key_metrics(read, ["id"]).collect()
    assert [(m["id"], m["metric"], m["value"]) for m in metrics] == [(1, "m", "3")]
