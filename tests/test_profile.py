import json
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from panelmill.errors import EmptyInputError, OrderRequiredError
from panelmill.functions import families as fam
from panelmill.operators import correlation, counts, describe, ordering, samples
from panelmill.operators.quantiles import day_scale, quantile_columns
from panelmill.plans import profile

NAMES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


def by_pandas(pairs):
    frame = pd.DataFrame(pairs, columns=["k", "v"])
    return {k: [g["v"].quantile(p) for p in NAMES.values()] for k, g in frame.groupby("k")}


def test_quantiles_of_hard_values(spark):
    rng = random.Random(5)
    pairs = [("tails", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(2000)]
    pairs += [("same", 3.5)] * 3000 + [("one", -7.0)] + [("close", 1 + i * 1e-12) for i in range(999)]
    pairs += [("whole", float(rng.randrange(-5, 6))) for _ in range(1000)] + [("zero", 0.0), ("zero", -0.0)]
    df = spark.createDataFrame(pairs, "k string, v double").repartition(8)
    found = {r["k"]: [r[n] for n in NAMES] for r in quantile_columns(df, ["k"], "v", NAMES).collect()}
    expected = by_pandas(pairs)
    assert found.keys() == expected.keys()
    for key in expected:
        assert found[key] == pytest.approx(expected[key], rel=1e-12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=50))
def test_quantiles_of_any_values(spark, values):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    (row,) = quantile_columns(df, ["k"], "v", NAMES).collect()
    assert [row[n] for n in NAMES] == pytest.approx([float(pd.Series(values).quantile(p)) for p in NAMES.values()], rel=1e-9, abs=1e-30)


def test_quantiles_of_a_group_do_not_depend_on_others(spark):
    rng = random.Random(9)
    pairs = {k: [(k, rng.gauss(0, 1) * 10 ** rng.randrange(4)) for _ in range(n)] for k, n in (("a", 30_000), ("b", 50), ("c", 101), ("d", 1))}
    every = [p for own in pairs.values() for p in own]
    alone = {}
    for own in pairs.values():
        for r in quantile_columns(spark.createDataFrame(own, "k string, v double"), ["k"], "v", NAMES).collect():
            alone[r["k"]] = r
    frame = spark.createDataFrame([*every, ("e", None)], "k string, v double")
    together = {r["k"]: r for r in quantile_columns(frame, ["k"], "v", NAMES).collect()}
    assert together == alone  # to the last bit
    some = quantile_columns(frame, ["k"], "v", NAMES, only=spark.createDataFrame([("b",), ("z",)], "k string"))
    assert {r["k"]: r for r in some.collect()} == {"b": alone["b"]}
    for key, wanted in by_pandas(every).items():
        assert [together[key][n] for n in NAMES] == pytest.approx(wanted, rel=1e-12)


def test_quantiles_of_close_values_around_an_offset_use_many_folders(spark):
    frame = spark.range(20_000).selectExpr("string(id % 1) AS k", "1e9 + id * 0.001 AS v")
    (row,) = quantile_columns(frame, ["k"], "v", {"m": 0.5}).collect()
    assert row["m"] == pytest.approx(1e9 + 9.9995, abs=1e-6)
    text = quantile_columns(frame, ["k"], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in text and "SinglePartition" not in text


def test_quantiles_deal_the_rows_of_one_drawer_by_folder_and_sort_none(spark):
    frame = spark.range(30_000).selectExpr("string(id % 3) AS k", "if(id < 9000, 1e9, 1e9 + id * 0.001) AS v")
    pairs = [(r["k"], r["v"]) for r in frame.collect()]
    big = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (big, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            found = quantile_columns(frame, ["k"], "v", NAMES)
            for row in found.collect():
                assert [row[n] for n in NAMES] == pytest.approx(by_pandas(pairs)[row["k"]], rel=1e-15)
            text = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in text and re.search(r"Exchange hashpartitioning\(k#\d+, _in#\d+L?, _folder#\d+, ", text)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", big)


def test_quantiles_reach_infinity_and_large_whole_numbers(spark):
    df = spark.createDataFrame([("k", float("inf")), ("k", float("-inf")), ("k", 1.0)], "k string, v double")
    (row,) = quantile_columns(df, ["k"], "v", {"low": 0.0, "mid": 0.5, "high": 1.0}).collect()
    assert (row["low"], row["mid"], row["high"]) == (float("-inf"), 1.0, float("inf"))
    micros = [1_700_000_000_000_000 + i for i in range(101)]
    longs = spark.createDataFrame([("k", m) for m in micros], "k string, v long")
    (row,) = quantile_columns(longs, ["k"], "v", {"mid": 0.5}, day_scale).collect()
    assert row["mid"] == micros[50]


def test_families(spark):
    df = spark.sql("""select 1 as i, 1.5d as d, 1.5bd as m, 'x' as s, true as b, date'2020-01-01' as day,
        timestamp'2020-01-01' as t, timestamp_ntz'2020-01-01' as n, array(1) as a, 1L as _row""")
    assert fam.numeric_columns(df) == ["i", "d", "m"]
    assert fam.categorical_columns(df) == ["s"]
    assert fam.time_columns(df) == ["day", "t", "n"]
    assert fam.families(df)["b"] == "boolean" and fam.families(df)["a"] == "other"
    assert fam.availability(df, 0)["has_data"] is False


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"x": rng.normal(size=500), "y": rng.integers(0, 9, 500).astype(float), "c": 5.0})
    frame.loc[::7, "x"] = np.nan
    table = describe.describe_numeric(spark.createDataFrame(frame))
    expected = frame.describe()
    for row in table.collect():
        e = expected[row["column"]]
        assert [row[n] for n in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(list(e), rel=1e-12)


def test_describe_edges(spark, gaps):
    one = describe.describe_numeric(gaps.where("k = 'c'"), ["v"]).collect()[0]
    assert (one["count"], one["mean"], one["std"], one["q50"]) == (1, -2.0, None, -2.0)
    none = describe.describe_numeric(gaps.where("k = 'b'"), ["v"]).collect()[0]
    assert (none["count"], none["mean"], none["q50"]) == (0, None, None)
    text = describe.describe_categorical(spark.sql("select cast(null as string) as s, true as b")).collect()
    assert {r["column"]: (r["count"], r["unique"], r["top"], r["freq"]) for r in text} == {"s": (0, 0, None, None), "b": (1, 1, "true", 1)}


def test_missing_counts_nan(gaps):
    found = {r["column"]: r["missing"] for r in describe.missing_values(gaps).collect()}
    assert found == {"k": 1, "v": 3, "i": 0}


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(300, 10)), columns=list("abcdefghij"))
    frame["b"] += frame["a"]
    frame.loc[::3, "a"] = np.nan
    frame["j"] = 5.0
    found = {(r["column"], r["other"]): r["r"] for r in correlation.correlation_matrix(spark.createDataFrame(frame)).collect()}
    expected = frame.corr()
    assert len(found) == 100
    for (a, b), r in found.items():
        e = expected.loc[a, b]
        assert r is None if np.isnan(e) else r == pytest.approx(e, abs=1e-12)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "a double, b double")
    assert correlation.correlation_pairs(df).collect()[0]["r"] is None


def test_top_values_ties_and_k(gaps):
    rows = counts.top_values(gaps, ["k", "v"], 2).collect()
    assert sorted((r["column"], r["rank"], r["value"], r["n"]) for r in rows) == [
        ("k", 1, "a", 3), ("k", 2, "b", 2), ("v", 1, "-2.0", 1), ("v", 2, "1.0", 1)]


def test_counts_sum_to_present_rows(spark, data):
    df = spark.read.parquet(f"{data}/orders.parquet")
    total = counts.value_counts(df, "o_custkey").agg(F.sum("n")).first()[0]
    assert total == df.count()
    share = counts.value_percentages(df, "o_orderpriority").agg(F.sum("percentage")).first()[0]
    assert share == pytest.approx(100)


def test_distinct_counts_of_empty_column(spark):
    df = spark.sql("select cast(null as string) as s, 'x' as t")
    assert {r["column"]: r["unique_count"] for r in counts.distinct_counts(df, ["s", "t"]).collect()} == {"s": 0, "t": 1}
    assert counts.distinct_counts(df, ["t"], approximate=True).collect()[0]["unique_count"] == 1


def test_sample_needs_an_order(loans):
    with pytest.raises(OrderRequiredError):
        samples.row_sample(loans, [])


def test_earliest_moments_are_distinct(spark):
    df = spark.sql("""select timestamp'2020-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 30) as t
        from range(3000) union all select timestamp'2019-05-01' from range(1000)""")
    rows = samples.earliest_moments(df, "t", 3).orderBy("ordinal").collect()
    assert [str(r["moment"]) for r in rows] == ["2019-05-01 00:00:00", "2020-01-01 10:00:00", "2020-01-01 10:00:01"]


def test_numbering_is_gapless_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(13)
    rows = ordering.number_rows(df, [F.col("x").desc()]).collect()
    assert sorted((r["ordinal"], r["x"]) for r in rows) == [(i + 1, 4999 - i) for i in range(5000)]


def test_pages_are_disjoint_and_complete(spark, data):
    df = spark.read.parquet(f"{data}/customer.parquet").select("c_custkey", "c_nationkey")
    order = ["c_nationkey", "c_custkey"]
    whole = [tuple(r) for r in df.orderBy(*order).select(*order).collect()]
    by_offset, by_key, after = [], [], None
    for start in range(0, 1500, 400):
        by_offset += [tuple(r) for r in ordering.page(df, order, 400, start).select(*order).collect()]
        rows = ordering.page(df, order, 400, after=after).select(*order).collect()
        by_key += [tuple(r) for r in rows]
        after = rows[-1].asDict()
    assert by_offset == whole and by_key == whole


def test_deep_page_is_the_same(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").alias("x"))
    monkeypatch.setattr(ordering, "SMALL_LIMIT", 100)
    assert sorted(r["x"] for r in ordering.page(df, ["x"], 50, 500).collect()) == list(range(500, 550))


def test_analysis_document(loans):
    document = json.loads(profile.analysis_document(loans).first()["document"])
    assert document["columns"] == loans.columns and document["rows"] == 6
    assert document["summary"]["tool"]["top"] == "Saw" and document["summary"]["tool"]["mean"] == ""
    assert document["summary"]["days"]["50%"] == "6.0"
    assert document["data_types"]["days"] == "bigint" and document["missing_values"]["days"] == 0


def test_summary_document(spark):
    df = spark.sql("""select id, id * 2.0d as twice, if(id % 3 = 0, null, concat('v', id % 2)) as s,
        timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as t from range(20)""")
    document = json.loads(profile.summary_document(df, "f", "id", pretty=True).first()["document"])
    assert document["shape"] == {"rows": 20, "columns": 4}
    assert document["sample_data"]["id"] == {str(i): i for i in range(10)}
    assert document["sample_data"]["s"]["0"] is None
    assert document["correlations"]["id"]["twice"] == pytest.approx(1) and document["correlations"]["id"]["id"] == 1
    assert document["missing_values"]["s"] == 7
    assert document["categorical_stats"]["s"] == {"top_values": {"v1": 7, "v0": 6}, "unique_count": 2}
    assert document["time_sample"]["t"][:2] == ["2024-01-01 00:00:00", "2024-01-02 00:00:00"]
    assert document["trends"] == {} and document["outliers"] == {}
    assert document["basic_stats"]["id"]["75%"] == 14.25


def test_empty_input(loans):
    with pytest.raises(EmptyInputError):
        profile.require_rows(loans.limit(0))
    assert profile.require_rows(loans) is loans


def test_top_texts_in_two_phases(spark, monkeypatch):
    """Long texts that share their beginning and their count, few and many of them, beside short ones, as by counting whole texts."""
    start = "x" * 40
    rows = [(start + f"{i:04d}", "s" if i % 2 else None, "é" * 20) for i in range(60)] + [(start + "0007", "t", "é" * 16)] * 2 + [("short", "t", None)] * 2
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for looked_up in (1000, 5):
        monkeypatch.setattr(counts, "LOOKED_UP", looked_up)
        found = [tuple(r) for r in counts.top_values(df, ["a", "b", "c"], 4).orderBy("column", "rank").collect()]
        assert found == [("a", 1, start + "0007", 3), ("a", 2, "short", 2), ("a", 3, start + "0000", 1), ("a", 4, start + "0001", 1),
                         ("b", 1, "s", 30), ("b", 2, "t", 4), ("c", 1, "é" * 20, 60), ("c", 2, "é" * 16, 2)]


def test_no_text_in_the_counting_exchange(spark, data):
    plan = counts.key_counts(spark.read.parquet(f"{data}/documents.parquet"), ["text", "lang"])._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange"):]
    assert "hashpartitioning(column" in exchange and "key#" in exchange.split("ENSURE")[0] and "value#" not in exchange.split("ENSURE")[0]


def test_correlations_over_patterns_of_gaps(spark):
    """Pairs whose shared rows are few, constant, one or none, far from zero, in several blocks."""
    rng = np.random.default_rng(7)
    frame = pd.DataFrame(rng.normal(size=(400, 18)) + 1e8, columns=[f"c{i}" for i in range(18)])
    for i in range(18):
        frame.loc[rng.random(400) < i / 20, f"c{i}"] = np.nan
    frame.loc[frame["c17"].notna(), "c0"] = 3.0
    frame["c5"] = frame["c4"] * -2
    frame["c9"] = np.nan
    found = {(r["column"], r["other"]): r["r"] for r in correlation.correlation_matrix(spark.createDataFrame(frame)).collect()}
    exact = (frame - 1e8).corr()
    assert len(found) == 18 * 18 and found["c0", "c17"] is None and found["c9", "c9"] is None
    for (a, b), r in found.items():
        if a == "c0" or b == "c0":
            continue  # its own values are of two sizes
        assert (r is None) == bool(np.isnan(exact.loc[a, b])) and (r is None or r == pytest.approx(exact.loc[a, b], abs=1e-6))
    pairs = {(r["a"], r["b"]): r["r"] for r in correlation.correlation_pairs(spark.createDataFrame(frame)).collect()}
    assert all(found[k] == r for k, r in pairs.items()) and len(pairs) == 18 * 17 // 2


def test_profile_scans(spark, data):
    """Besides the passes of the quartiles one scan for numbers and missing values, and the texts' scans."""
    df = spark.read.parquet(f"{data}/orders.parquet")
    first = describe.overview(df)
    both = spark.range(1).select(first["rows"].alias("n"), F.size(first["columns"]).alias("m"))
    row = both.first()
    assert (row["n"], row["m"]) == (df.count(), len(df.columns))
    assert "ReusedSubquery" in both._jdf.queryExecution().executedPlan().toString() or both._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2
