"""Token totals by source, language and tokenizer version, kept by signed deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed entries: a delete takes away what the document had, a
revision takes that away and adds the new count. Entries are summed per key within the batch and the sums are kept;
totals are the sum of all committed sums, so there is never a recount.

    changes/<commit>            what the batch asks for, one change a document, by bucket
    entries/<commit>/bucket=7   signed entries of documents whose id falls in a bucket
    sums/<commit>               signed sums per key
    commits/000000000012-<name> one small file per commit: the folders that hold each bucket now, and the sums

A commit is the creation of its file by a rename; folders that no commit names are never read. To find what a batch takes
away, the folders of the buckets that it touches are read, in one scan. A bucket that a batch touches after `DELTAS`
others is written anew as what is left of it, and the sums likewise, so neither folders nor plans grow with the number of
batches. A batch that was committed before is not applied again; one that broke off is written anew, over its remains.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

KEYS = ["source", "lang", "version"]
ENTRY = "doc_id long, source string, lang string, version string, tokens long, sign int"
CHANGE = "doc_id long, op string, source string, lang string, version string, tokens long, bucket int"
SUMS = "source string, lang string, version string, docs long, tokens long"
DELTAS = 8


class TokenRollup:
    """A store in a folder that the whole cluster can reach; one writer at a time.

    `buckets` counts for a store that has no commit yet: about a million documents each is a good size, since a bucket is
    written by one task.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fresh = {"number": 0, "buckets": buckets, "entries": {}, "sums": []}

    # The log

    def _names(self, kind: str) -> list[str]:
        place = self._path(f"{self.folder}/{kind}")
        return sorted(s.getPath().getName() for s in self._files.listStatus(place)) if self._files.exists(place) else []

    def committed(self) -> list[str]:
        """The names of all committed batches."""
        return sorted(unquote(n.split("-", 1)[1]) for n in self._names("commits"))

    def _state(self) -> dict:
        commits = self._names("commits")
        if not commits:
            return self._fresh
        stream = self._files.open(self._path(f"{self.folder}/commits/{commits[-1]}"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, state: dict) -> None:
        beside, place = self._path(f"{self.folder}/.tries/{uuid.uuid4().hex}"), self._path(f"{self.folder}/commits/{name}")
        stream = self._files.create(beside, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        self._files.mkdirs(place.getParent())
        if self._files.exists(place) or not self._files.rename(beside, place):
            raise RuntimeError(f"another writer has committed {name}")

    # Reading

    def _read(self, places: list[str], schema: str) -> DataFrame:
        """The rows of some folders, in one scan."""
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in places])

    def current(self, buckets: set[int] | None = None) -> DataFrame:
        """`doc_id, source, lang, version, tokens` of every document that is counted now, or of those in some buckets."""
        held = self._state()["entries"]
        places = [p for b, found in held.items() if buckets is None or int(b) in buckets for p in found]
        return _left(self._read(places, ENTRY)).drop("n")

    def totals(self) -> DataFrame:
        """`source, lang, version, docs, tokens` of all keys that have a document now."""
        return _summed(self._read(self._state()["sums"], SUMS)).where("docs <> 0")

    # Writing

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of `op, doc_id, source, lang, version, tokens` and, if there is one, `seq`; False if it was before.

        `op` is insert, revise or delete. An insert of a counted document revises it, a revision of one that is not
        counted inserts it, a delete of one that is not counted does nothing, and neither does a change without a
        doc_id or with another `op`. Of several changes to a document in one batch the one with the greatest `seq`
        holds; ties go to a delete, then to the greatest count. Null counts are 0; null keys are keys of their own.
        """
        if batch in self.committed():
            return False
        state = self._state()
        name = f"{state['number'] + 1:012d}-{quote(batch, safe='')}"
        last = self._settled(_last(changes), f"changes/{name}", state["buckets"])
        touched = {r["bucket"] for r in last.select("bucket").distinct().collect()}
        held = {int(b): places for b, places in state["entries"].items()}
        crowded = {b for b in touched if len(held.get(b, [])) >= DELTAS}
        shown = ["doc_id", *KEYS, "tokens", "sign"]
        taken = self.current(touched).join(last.select("doc_id"), "doc_id", "left_semi").withColumn("sign", F.lit(-1))
        given = last.where("op <> 'delete'").withColumn("sign", F.lit(1))
        delta = taken.select(*shown).unionByName(given.select(*shown)).withColumn("bucket", _bucket(state["buckets"]))
        written = delta.where(~F.col("bucket").isin(*crowded)) if crowded else delta
        if crowded:
            old = self._read([p for b in crowded for p in held[b]], ENTRY)
            whole = _left(old.unionByName(delta.where(F.col("bucket").isin(*crowded)).select(*shown)))
            written = written.unionByName(whole.select("doc_id", *KEYS, "tokens", F.lit(1).alias("sign"), _bucket(state["buckets"]).alias("bucket")))
        self._write(written, f"entries/{name}")
        new = {int(n.split("=")[1]): f"entries/{name}/{n}" for n in self._names(f"entries/{name}") if n.startswith("bucket=")}
        for b in touched:
            held[b] = ([] if b in crowded else held.get(b, [])) + ([new[b]] if b in new else [])
        many = len(state["sums"]) >= DELTAS
        sums = delta.select(*KEYS, F.col("sign").cast("long").alias("docs"), (F.col("sign") * F.col("tokens")).alias("tokens"))
        sums = _summed(sums.unionByName(self._read(state["sums"], SUMS)) if many else sums)
        sums.where("docs <> 0 OR tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/sums/{name}")
        kept = {b: places for b, places in held.items() if places}
        self._commit(name, {"number": state["number"] + 1, "buckets": state["buckets"], "entries": kept,
                            "sums": ([] if many else state["sums"]) + [f"sums/{name}"]})
        return True

    def _settled(self, last: DataFrame, place: str, buckets: int) -> DataFrame:
        """What a batch asks for, written once, since it is read several times and must be the same each time."""
        last.withColumn("bucket", _bucket(buckets)).write.mode("overwrite").parquet(f"{self.folder}/{place}")
        return self._read([place], CHANGE)

    def _write(self, rows: DataFrame, place: str) -> None:
        # Ids are spread over the buckets by their hash, so no bucket is much larger than another.
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{place}")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def _last(changes: DataFrame) -> DataFrame:
    """The one change of each document that holds."""
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    rows = changes.where("op IN ('insert', 'revise', 'delete') AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), "op", *[F.col(k).cast("string").alias(k) for k in KEYS],
        F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"), seq.alias("seq"))
    order = [F.col("seq").desc_nulls_last(), (F.col("op") == "delete").desc(), F.col("tokens").desc(), *[F.col(k) for k in KEYS]]
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return ranked.where("at = 1").drop("at", "seq")


def _left(entries: DataFrame) -> DataFrame:
    return entries.groupBy("doc_id", *KEYS, "tokens").agg(F.sum("sign").alias("n")).where("n > 0")


def _summed(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
