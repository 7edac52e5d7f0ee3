"""The catalog store: batches that come twice, break off or race, and snapshots."""

import pytest
from pyspark.sql import functions as F

from panelmill.errors import SpecError
from panelmill.sources import catalog
from panelmill.sources.store import CatalogStore


def asked(spark, *rows):
    return spark.createDataFrame([(i, t, "[]", u) for i, t, u in rows], "dashboard_id string, title string, charts string, user_id long")


def titles(store):
    return {r["dashboard_id"]: (r["title"], r["version"]) for r in store.current().collect()}


@pytest.fixture()
def store(spark, tmp_path):
    made = CatalogStore(spark, f"{tmp_path}/catalog")
    assert made.current().count() == 0 and made.create("first", asked(spark, ("a", "A", 1), ("b", "B", 2), ("b", "B2", 2)))
    return made


def test_a_batch_twice(spark, store):
    assert not store.create("first", asked(spark, ("z", "Z", 1)))
    assert set(titles(store)) == {"a", "b"} and store.versions().count() == 2
    assert [tuple(r) for r in store.refused("first").collect()] == [("b", "repeated")]
    with pytest.raises(SpecError):
        store.create("", asked(spark, ("z", "Z", 1)))


def test_a_batch_that_broke_off(spark, store, monkeypatch):
    """Rows were written, the commit was not: nothing is seen, and the same batch again leaves one version per id."""
    with monkeypatch.context() as broken:
        broken.setattr(CatalogStore, "_create", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.create("second", asked(spark, ("c", "C", 1)))
    assert set(titles(store)) == {"a", "b"}
    assert store.create("second", asked(spark, ("c", "C", 1))) and store.versions().where("dashboard_id = 'c'").count() == 1


def test_a_lost_race(spark, store, monkeypatch):
    """Another writer commits the same id between our look and our commit: we look again and are refused."""
    other, state, raced = CatalogStore(spark, store.folder), CatalogStore.state, []

    def late(self):
        found = state(self)
        if self is store and not raced:
            raced.append(1)
            other.create("theirs", asked(spark, ("c", "theirs", 9)))
        return found

    monkeypatch.setattr(CatalogStore, "state", late)
    assert store.create("ours", asked(spark, ("c", "ours", 1), ("d", "D", 1)))
    assert titles(store)["c"] == ("theirs", 1) and titles(store)["d"] == ("D", 1)
    assert [tuple(r) for r in store.refused("ours").collect()] == [("c", "taken")]


def test_changes_and_snapshots(spark, store):
    assert store.update("rename", asked(spark, ("a", "A2", 1), ("b", "stolen", 1), ("x", "none", 1)))
    assert sorted(map(tuple, store.refused("rename").collect())) == [("b", "owner"), ("x", "missing")]
    assert store.delete("drop", asked(spark, ("b", "", 2)).select("dashboard_id", "user_id"))
    before = titles(store)
    assert before == {"a": ("A2", 2)} and store.compact() and not store.compact() and titles(store) == before
    assert store.versions().count() == 2  # the live one and the mark of the deleted one
    assert store.state().batches == {} and store.applied("rename") and not store.create("first", asked(spark, ("q", "Q", 1)))
    assert store.create("again", asked(spark, ("b", "B3", 2), ("e", "E", 2))) and set(titles(store)) == {"a", "e"}
    assert store.find("a", 1).first()["title"] == "A2" and store.find("b").isEmpty()
    assert [r["total"] for r in store.list_page(owner=2).collect()] == [1]
    assert catalog.read(spark, store.folder).count() == store.versions().count()


def test_reads_cost_recent_batches_only(spark, store):
    for n in range(5):
        store.update(f"u{n}", asked(spark, ("a", f"A{n}", 1)))
    many = len(store.state().batches)
    store.compact()
    store.update("last", asked(spark, ("a", "end", 1)))
    assert many == 6 and list(store.state().batches) == ["last"] and titles(store)["a"] == ("end", 7)
    assert store.versions().select(F.input_file_name()).distinct().count() <= 1 + 2
