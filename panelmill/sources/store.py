"""A catalog that many jobs write: a log of commits, batches of versions, and snapshots that keep reads short.

    commits/000000000007   one small file per commit: the batch and where its rows are, or where a snapshot is
    batches/<batch>/<try>  the rows of a batch; a try that was broken off is never named by a commit, so never read
    snapshots/<try>        the latest version per dashboard, in order of ids, so that a point read skips files
    hints/000000000007     that this commit is a snapshot: readers begin at the last one
    applied/<batch>        batches from before the last snapshot

A commit is the creation of its file, which fails if another writer has made that number: then the batch is worked out again
over the newer state. So conflicts are checked against exactly the state a batch follows. A batch whose name was committed
before does nothing. Reads merge the last snapshot with the batches since: they cost live rows, deletion marks and recent
changes, not the history.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ConcurrentWriteError, SpecError
from . import catalog

TRIES = 20
REFUSED = "dashboard_id string, reason string"


@dataclass(frozen=True)
class State:
    """The log as one reader found it: the number of its last commit, the snapshot, the batches since and their rows."""

    last: int
    snapshot: str | None
    batches: dict[str, str]


class CatalogStore:
    """A catalog in a folder that the whole cluster can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # The log

    def state(self) -> State:
        numbers = self._names("commits")
        hints = [n for n in self._names("hints") if n in set(numbers)]
        snapshot, batches = None, {}
        for number in numbers[numbers.index(hints[-1]) if hints else 0:]:
            entry = json.loads(self._read(f"commits/{number}"))
            if "snapshot" in entry:
                snapshot, batches = entry["snapshot"], {}
            else:
                batches[entry["batch"]] = entry["rows"]
        return State(int(numbers[-1]) if numbers else 0, snapshot, batches)

    def applied(self, batch: str) -> bool:
        """Whether a batch of this name was committed."""
        return batch in self.state().batches or self._exists(f"applied/{_safe(batch)}")

    def _names(self, kind: str) -> list[str]:
        place = self._path(f"{self.folder}/{kind}")
        if not self._files.exists(place):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._files.listStatus(place)) if not n.startswith("."))

    def _exists(self, name: str) -> bool:
        return self._files.exists(self._path(f"{self.folder}/{name}"))

    def _read(self, name: str) -> str:
        stream = self._files.open(self._path(f"{self.folder}/{name}"))
        try:
            return self._text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str = "") -> bool:
        """Make a file that nobody has made; False if it is there. It is written beside and renamed, so it is never seen half.

        The file system must not rename over a file that is there, as HDFS does not; a local one is for one writer at a time.
        """
        place, beside = self._path(f"{self.folder}/{name}"), self._path(f"{self.folder}/.tries/{uuid.uuid4().hex}")
        if self._files.exists(place):
            return False
        stream = self._files.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._files.mkdirs(place.getParent())
        return self._files.rename(beside, place) and self._read(name) == text

    # Reading

    def versions(self, state: State | None = None) -> DataFrame:
        """The versions a reader needs: those of the last snapshot and of every batch since, in one scan."""
        state = state or self.state()
        places = [f"{self.folder}/{p}" for p in (*([state.snapshot] if state.snapshot else []), *state.batches.values())]
        if not places:
            return self.spark.createDataFrame([], catalog.SCHEMA)
        return self.spark.read.schema(catalog.SCHEMA).parquet(*places)

    def current(self) -> DataFrame:
        return catalog.current(self.versions())

    def find(self, dashboard_id: str, owner: int | None = None) -> DataFrame:
        return catalog.find(self.versions(), dashboard_id, owner)

    def list_page(self, owner: int | None = None, limit: int | None = catalog.PAGE_SIZE, offset: int = 0, after: dict | None = None) -> DataFrame:
        return catalog.list_page(self.versions(), owner, limit, offset, after)

    def refused(self, batch: str) -> DataFrame:
        """`dashboard_id, reason` of what a committed batch was refused; known until the next snapshot."""
        place = self.state().batches.get(batch)
        if place is None or not self._exists(f"{place}-refused"):
            return self.spark.createDataFrame([], REFUSED)
        return self.spark.read.schema(REFUSED).parquet(f"{self.folder}/{place}-refused")

    # Writing

    def create(self, batch: str, dashboards: DataFrame, order: str | None = None) -> bool:
        """First versions of the dashboards whose id is free, one per id; the others are in `refused`. False if the batch is there."""
        return self._commit(batch, lambda v: catalog.created_versions(v, dashboards, order), lambda v: catalog.create_conflicts(v, dashboards))

    def update(self, batch: str, updates: DataFrame, order: str | None = None) -> bool:
        """New versions where the user owns the dashboard; the other requests are in `refused`."""
        return self._commit(batch, lambda v: catalog.updated_versions(v, updates, order), lambda v: _not_owned(v, updates))

    def delete(self, batch: str, deletes: DataFrame) -> bool:
        return self._commit(batch, lambda v: catalog.tombstones(v, deletes), lambda v: _not_owned(v, deletes))

    def _commit(self, batch: str, build: Callable[[DataFrame], DataFrame], refuse: Callable[[DataFrame], DataFrame]) -> bool:
        if not batch:
            raise SpecError("a batch needs a name")
        for _ in range(TRIES):
            state = self.state()
            if batch in state.batches or self._exists(f"applied/{_safe(batch)}"):
                return False
            place, versions = f"batches/{_safe(batch)}/{uuid.uuid4().hex}", self.versions(state)
            build(versions).write.parquet(f"{self.folder}/{place}")
            refuse(versions).select("dashboard_id", "reason").write.parquet(f"{self.folder}/{place}-refused")
            if self._create(_number(state.last + 1), json.dumps({"batch": batch, "rows": place})):
                return True
        raise ConcurrentWriteError(f"batch {batch!r} lost {TRIES} races for the next commit")

    def compact(self) -> bool:
        """Commit a snapshot: the latest version per dashboard, deletions as marks without documents, so that no id is given twice."""
        for _ in range(TRIES):
            state = self.state()
            if not state.batches:
                return False
            latest = catalog.latest(self.versions(state), "dashboard_id", "version")
            gone = F.coalesce("deleted", F.lit(False))
            slim = latest.withColumns({c: F.when(~gone, F.col(c)) for c in ("charts", "insights", "summary", "key_metrics", "metadata")})
            place = f"snapshots/{uuid.uuid4().hex}"
            slim.repartitionByRange("dashboard_id").sortWithinPartitions("dashboard_id").write.parquet(f"{self.folder}/{place}")
            for batch in state.batches:  # before the commit: a batch that a snapshot holds must not come again
                self._create(f"applied/{_safe(batch)}")
            if self._create(_number(state.last + 1), json.dumps({"snapshot": place})):
                self._create(f"hints/{state.last + 1:012d}")
                return True
        raise ConcurrentWriteError(f"a snapshot lost {TRIES} races for the next commit")


def _number(number: int) -> str:
    return f"commits/{number:012d}"


def _safe(batch: str) -> str:
    """A batch name as a file name."""
    return quote(batch, safe="").replace(".", "%2E")


def _not_owned(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests without such a live dashboard, or for another owner's."""
    asked, live = requests.select("dashboard_id", "user_id").distinct(), catalog.current(versions).select("dashboard_id", "user_id")
    missing = catalog.refused(asked, live, ["dashboard_id"]).withColumn("reason", F.lit("missing"))
    other = catalog.refused(catalog.owned(asked, live, ["dashboard_id"]), live).withColumn("reason", F.lit("owner"))
    return missing.unionByName(other)
