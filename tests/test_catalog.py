import json

import pytest
from pyspark.sql import functions as F

from panelmill.errors import ConstraintError
from panelmill.sources import catalog


def config(spark, rows):
    return spark.createDataFrame(rows, "dashboard_id string, title string, charts string, user_id long")


@pytest.fixture()
def place(spark, tmp_path):
    path = f"{tmp_path}/catalog"
    rows = [("a", "A", "[]", 1), ("b", "B", "[]", 2), ("c", "C", "[]", 1)]
    catalog.append(catalog.new_versions(config(spark, rows)), path)
    return path


def live(spark, path):
    return {r["dashboard_id"]: r for r in catalog.current(catalog.read(spark, path)).collect()}


def test_create_read_and_page(spark, place):
    versions = catalog.read(spark, place)
    assert {r["status"] for r in versions.collect()} == {"ready"}
    assert catalog.find(versions, "a").first()["title"] == "A"
    assert catalog.find(versions, "a", owner=2).isEmpty()
    page = catalog.list_page(versions, owner=1, limit=1, offset=1).collect()
    assert [(r["dashboard_id"], r["total"]) for r in page] == [("c", 2)]


def test_page_document(spark, place):
    versions = catalog.read(spark, place)
    document = json.loads(catalog.page_document(catalog.list_page(versions, limit=2)).first()["document"])
    assert (document["page_size"], document["total"]) == (2, 3)
    assert [d["dashboard_id"] for d in document["dashboards"]] == ["a", "b"]
    assert document["dashboards"][0]["dashboard_config"] == {"title": "A", "charts": [], "insights": "", "summary": "", "key_metrics": []}
    empty = json.loads(catalog.page_document(catalog.list_page(versions, owner=9)).first()["document"])
    assert empty == {"dashboards": [], "page_size": 0, "total": 0}


def test_random_ids(spark, tmp_path):
    df = config(spark, [("x", "A", "[]", 1)] * 3).drop("dashboard_id")
    catalog.append(catalog.new_versions(df), f"{tmp_path}/c")
    assert len(live(spark, f"{tmp_path}/c")) == 3


def test_update_only_by_owner(spark, place):
    updates = spark.createDataFrame([("a", 1, "new"), ("b", 1, "stolen"), ("z", 1, "none")], "dashboard_id string, user_id long, title string")
    before = catalog.current(catalog.read(spark, place))
    assert {r["dashboard_id"] for r in catalog.refused(updates, before).collect()} == {"b", "z"}
    catalog.append(catalog.updated_versions(catalog.read(spark, place), updates), place)
    after = live(spark, place)
    assert (after["a"]["title"], after["a"]["version"], after["a"]["charts"]) == ("new", 2, "[]")
    assert after["a"]["updated_at"] is not None and after["b"]["title"] == "B" and len(after) == 3


def test_delete_only_by_owner(spark, place):
    deletes = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "dashboard_id string, user_id long")
    catalog.append(catalog.tombstones(catalog.read(spark, place), deletes), place)
    assert set(live(spark, place)) == {"b", "c"}
    catalog.compact(catalog.read(spark, place), place + "-new")
    assert catalog.read(spark, place + "-new").count() == 2


def test_upsert_is_idempotent(spark):
    rows = spark.range(10).withColumn("v", F.lit("old"))
    changes = spark.range(5, 15).withColumn("v", F.lit("new"))
    once = catalog.upsert(rows, changes, "id")
    twice = catalog.upsert(once, changes, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == 15 and catalog.without(once, changes, "id").count() == 5


def test_conflicts_name_the_first_key(spark):
    existing = spark.createDataFrame([("e1", "u1"), ("e2", "u2"), (None, "u9")], "email string, username string")
    incoming = spark.createDataFrame([(1, "e1", "u2"), (2, "x", "u1"), (3, "x", "y"), (4, None, None)], "id int, email string, username string")
    rows = catalog.key_conflicts(incoming, existing, ["email", "username"], "id").collect()
    assert sorted(map(tuple, rows)) == [(1, "email"), (2, "username")]


def test_owner_join_keeps_idle_users(spark):
    users = spark.createDataFrame([(1, "ann"), (2, "bob")], "id long, username string")
    boards = spark.createDataFrame([("a", 1, 10), ("b", 1, 11), ("c", None, 12)], "dashboard_id string, user_id long, id long")
    rows = catalog.users_with_dashboards(users, boards).select("username", "dashboard_id", "owner_id").collect()
    assert sorted(map(tuple, rows), key=str) == [("ann", "a", 1), ("ann", "b", 1), ("bob", None, 2)]
    counted = catalog.dashboards_per_user(users, boards).select("username", "dashboards").collect()
    assert sorted(map(tuple, counted)) == [("ann", 2), ("bob", 0)]


def test_backfill_and_constraints(spark):
    rows = spark.createDataFrame([("a", None), ("a", 5), (None, 9)], "dashboard_id string, user_id long")
    users = spark.createDataFrame([(5, "admin")], "id long, username string")
    admin = users.where("username = 'admin'").agg(F.max("id").alias("id")).scalar()
    assert [r["user_id"] for r in catalog.backfill_owner(rows, admin).collect()] == [5, 5, 9]
    with pytest.raises(ConstraintError):
        catalog.require_filled(rows, "user_id")
    report = catalog.constraint_report(rows, ["dashboard_id", "user_id"], ["dashboard_id"], [("user_id", users, "id")]).collect()
    assert sorted(map(tuple, report)) == [
        ("foreign_key", "user_id", 1), ("not_null", "dashboard_id", 1), ("not_null", "user_id", 1), ("unique", "dashboard_id", 1)]
