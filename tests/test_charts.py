import json

import pytest
from pyspark.sql import functions as F

from panelmill.errors import OrderRequiredError, SpecError
from panelmill.functions import colors
from panelmill.plans import charts, dashboards
from panelmill.plans.spec import ChartSpec, resolve


def shown(df, spec, *columns):
    rows = charts.chart_points(df, spec).orderBy("ordinal").collect()
    return [tuple(r[c] for c in columns or ("label", "value")) for r in rows]


def payloads(df, spec):
    return [json.loads(r["payload"]) for r in charts.chart_payload(df, spec).orderBy("part").collect()]


def test_counts_with_ties_in_key_order(loans):
    assert shown(loans, {"source_columns": ["branch"]}) == [("North", 3), ("South", 3)]


def test_ascending_turns_what_the_limit_kept(loans):
    assert shown(loans, {"source_columns": ["tool"], "limit": 2, "sort": "asc"}) == [("Drill", 2), ("Saw", 3)]


def test_group_sum_in_key_order(loans):
    spec = {"data_config": {"source_columns": ["tool", "days"], "aggregation": "sum"}}
    assert shown(loans, spec) == [("Drill", 32), ("Ladder", 5), ("Saw", 20)]
    assert shown(loans, {**spec, "rank_by": "value"})[0] == ("Drill", 32)


def test_time_series_of_text_dates(loans):
    spec = {"chart_type": "line", "source_columns": ["lent", "days"]}
    assert shown(loans, spec) == [("2021-04-18", 5), ("2021-05-03", 9), ("2021-05-09", 30), ("2021-06-20", 13)]
    assert payloads(loans, spec)[0]["datasets"][0]["label"] == "days over time"


def test_line_without_dates_takes_row_order(loans):
    spec = {"chart_type": "line", "source_columns": ["branch", "days"], "order_by": "days", "limit": 2}
    assert shown(loans, spec) == [("1", "North"), ("2", "South")]
    with pytest.raises(OrderRequiredError):
        charts.chart_points(loans, {"chart_type": "line", "source_columns": ["days"]})


def test_pie_payload(loans):
    (body,) = payloads(loans, {"chart_type": "pie", "title": "Tools", "source_columns": ["tool"]})
    (series,) = body["datasets"]
    assert body["labels"] == ["Saw (50.0%)", "Drill (33.3%)", "Ladder (16.7%)"]
    assert series == {
        "label": "Tools", "data": [3, 2, 1], "percentages": pytest.approx([50.0, 100 / 3, 50 / 3]), "borderWidth": 2,
        "backgroundColor": colors.palette("primary")[:3],
        "borderColor": [c.replace("0.8", "1") for c in colors.palette("primary")[:3]],
    }


def test_bar_shares_only_when_asked(loans):
    spec = {"source_columns": ["tool"], "show_percentages": True}
    assert shown(loans, spec, "caption", "percentage")[0] == ("Saw", 50.0)
    assert payloads(loans, spec)[0]["datasets"][0]["percentages"] == pytest.approx([50.0, 100 / 3, 50 / 3])
    assert "percentages" not in payloads(loans, {"source_columns": ["tool"]})[0]["datasets"][0]
    assert shown(loans, {"source_columns": ["tool"]}, "percentage")[0] == (None,)


@pytest.mark.parametrize("name, expected", [
    ("sum", [4.0, 0.0, -2.0]), ("avg", [2.0, None, -2.0]), ("mean", [2.0, None, -2.0]), ("min", [1.0, None, -2.0]),
    ("max", [3.0, None, -2.0]), ("median", [2.0, None, -2.0]), ("quantile", [2.0, None, -2.0]), ("prod", [3.0, 1.0, -2.0]),
    ("std", [2 ** 0.5, None, None]), ("var", [2.0, None, None]), ("sem", [1.0, None, None]), ("skew", [None] * 3),
    ("nunique", [2, 0, 1]), ("size", [3, 2, 1]), ("any", [True, False, True]), ("all", [True, True, True]),
    ("first", [1.0, None, -2.0]), ("last", [3.0, None, -2.0]),
])
def test_aggregates_skip_missing(gaps, name, expected):
    spec = {"source_columns": ["k", "v"], "aggregation": name, "order_by": "i"}
    values = [v for _, v in shown(gaps, spec)]
    assert [None if v is None else pytest.approx(v) for v in expected] == values


def test_count_ignores_the_second_column(gaps):
    assert shown(gaps, {"source_columns": ["k", "v"]}) == [("a", 3), ("b", 2), ("c", 1)]


def test_percentage_counts_rows_beyond_the_limit(gaps):
    assert shown(gaps, {"source_columns": ["k"], "aggregation": "percentage", "limit": 1}) == [("a", 50.0)]


def test_share_falls_back_to_values_without_positive_total(gaps):
    negative = gaps.where("k = 'c'")
    spec = {"chart_type": "pie", "source_columns": ["k", "v"], "aggregation": "sum"}
    assert shown(negative, spec, "caption", "percentage") == [("c", -2.0)]


def test_skew_is_corrected(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 9.0)], "k string, v double")
    assert shown(df, {"source_columns": ["k", "v"], "aggregation": "skew"})[0][1] == pytest.approx(1.630059, abs=1e-6)


def test_unknown_names_are_errors(loans):
    with pytest.raises(SpecError):
        charts.chart_points(loans, {"source_columns": ["tool", "days"], "aggregation": "modus"})
    with pytest.raises(SpecError):
        charts.chart_points(loans, {"source_columns": ["tool", "branch"], "aggregation": "sum"})
    with pytest.raises(SpecError):
        ChartSpec(limit=-1)


def test_fallbacks(spark, loans):
    assert resolve(loans, ChartSpec(source_columns=("Tool",))).source_columns == ("tool",)
    assert resolve(loans, ChartSpec(chart_type="radar")).source_columns == ("days",)
    dates = spark.sql("select date'2020-01-01' as d")
    assert resolve(dates, ChartSpec()) is None
    (body,) = payloads(dates, {"chart_type": "bar"})
    assert (body["labels"], body["datasets"][0]["data"]) == (["No Data"], [0])
    assert body["datasets"][0]["backgroundColor"] == ["rgba(156, 163, 175, 0.8)"]


def test_other_types_count(loans):
    assert shown(loans, {"chart_type": "heatmap", "source_columns": ["tool", "days"], "aggregation": "sum"})[0] == ("Saw", 3)


def test_empty_table(loans):
    none = loans.limit(0)
    assert shown(none, {"source_columns": ["tool"]}) == []
    assert payloads(none, {"source_columns": ["tool"]})[0]["datasets"][0]["data"] == []
    assert payloads(none, {"chart_type": "line", "source_columns": ["lent", "days"], "order_by": "days"})[0]["labels"] == []


def test_unknown_palette_and_cycle(spark):
    df = spark.range(12).select(F.col("id").cast("string").alias("k"))
    spec = {"source_columns": ["k"], "color_scheme": "no such"}
    picked = [c for (c,) in shown(df, spec, "color")]
    assert picked == colors.palette("primary") + colors.palette("primary")[:2]


def test_unlimited_chart_is_cut_into_whole_parts(spark, monkeypatch):
    monkeypatch.setattr(charts, "POINTS_PER_PART", 1000)
    df = spark.range(2500).select(F.col("id").alias("k"))
    bodies = payloads(df, {"source_columns": ["k"], "limit": None})
    assert [len(b["labels"]) for b in bodies] == [1000, 1000, 500]
    assert [x for b in bodies for x in b["labels"]] == [str(i) for i in range(2500)]


def test_dashboard_from_document(loans):
    (row,) = dashboards.dashboard(loans, "loans.xlsx", {
        "charts": [{"chart_type": "pie", "metadata": {"importance": "high"}, "data_config": {"source_columns": ["tool"]}},
                   {"chart_type": "line", "data_config": {"source_columns": ["lent", "days"]}}],
        "key_metrics": [{"metric": "Loans", "value": 6, "description": "all"}], "summary": "s"}, category="hr").collect()
    first, second = json.loads(row["charts"])
    assert (row["title"], row["category"], row["summary"]) == ("Dashboard - loans.xlsx", "hr", "s")
    assert (first["title"], first["x_axis"], first["metadata"]) == ("Chart", "X", {"importance": "high"})
    assert second["data"]["datasets"][0]["data"] == [5, 9, 30, 13]
    assert row["key_metrics"][0].asDict() == {"metric": "Loans", "value": "6", "description": "all"}


def test_basic_dashboard_when_there_is_no_chart(loans):
    (row,) = dashboards.dashboard(loans, "loans.xlsx", {"charts": []}, category="sALES", description="More.").collect()
    (chart,) = json.loads(row["charts"])
    assert row["title"] == "Sales Dashboard - loans.xlsx"
    assert row["summary"] == "Analysis of loans.xlsx containing 6 rows and 4 columns. More."
    assert chart["title"] == "Distribution of tool"
    assert [m["value"] for m in row["key_metrics"]] == ["6", "4"]


def test_dashboard_from_reply(loans):
    reply = 'Here: {"dashboard_title": "Loans", "charts": [{"chart_type": "bar", "data_config": {"source_columns": ["tool"]}}, {"chart_type": "pie"}]}!'
    (row,) = dashboards.dashboard_from_reply(loans, "loans.xlsx", reply, chart_types=["bar"]).collect()
    assert row["title"] == "Loans" and [c["chart_type"] for c in json.loads(row["charts"])] == ["bar"]
    (row,) = dashboards.dashboard_from_reply(loans, "loans.xlsx", "sorry, no").collect()
    assert row["title"] == "Basic Dashboard - loans.xlsx"


def test_options_filter_and_cut_specs():
    specs = [{"chart_type": "bar"}, {"chart_type": "pie"}, {"chart_type": "bar", "title": "b"}]
    assert [s.title for s, _ in dashboards.selected(specs, ["bar"], 2)] == [None, "b"]
    assert len(dashboards.selected(specs)) == 3


def test_bad_charts_become_placeholders(spark, loans):
    asked = {"charts": [{"chart_type": "bar", "data_config": {"source_columns": ["tool", "days"], "aggregation": "no such"}},
                        "text", {"chart_type": "pie", "title": "Kept", "data_config": {"source_columns": ["tool"], "limit": "ten"}}]}
    shown = json.loads(dashboards.dashboard(loans, "t", asked).first()["charts"])
    assert [c["status"] for c in shown] == ["error", "error", "ok"] and "no such" in shown[0]["reason"]
    assert shown[0]["data"]["labels"] == ["No Data"] and len(shown[2]["data"]["labels"]) > 1
    with pytest.raises(SpecError):
        dashboards.dashboard(loans, "t", asked, on_error="raise")
    for charts_given in ("none", None, {}, []):
        assert "Dashboard" in dashboards.dashboard(loans, "t", {"charts": charts_given}).first()["title"]


def test_one_document_per_chart_at_any_limit(spark):
    frame = spark.range(10_001).selectExpr("string(id) AS k")
    for limit in (10_000, 10_001, None):
        spec = {"chart_type": "bar", "source_columns": ["k"], "limit": limit}
        (chart,) = json.loads(dashboards.dashboard(frame, "t", {"charts": [spec]}).first()["charts"])
        assert len(chart["data"]["labels"]) == 10_000 and chart["parts"] == (1 if limit == 10_000 else 2)
