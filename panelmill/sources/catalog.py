"""The dashboard catalog: an append-only table of versions.

A change adds a row with a higher version; a delete adds a tombstone. The current catalog is the latest
version per dashboard. Nothing is overwritten in place, so a lost job leaves the old state readable.
Functions take and return DataFrames; only `append` and `compact` write.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..errors import ConstraintError
from ..functions.values import JSON_OPTIONS, iso, raw
from ..operators.ordering import page

SCHEMA = """
    dashboard_id string, title string, charts string, insights string, summary string, key_metrics string,
    status string, file_url string, user_id bigint, category string, metadata string,
    created_at timestamp, updated_at timestamp, version bigint, deleted boolean
"""
# What an update may replace; key, owner, status, file and creation time stay.
UPDATABLE = ["title", "charts", "insights", "summary", "key_metrics", "category", "metadata"]
REQUIRED = ["dashboard_id", "title", "charts", "status", "user_id"]
PAGE_ORDER = ["created_at", "dashboard_id"]
PAGE_SIZE = 100


def read(spark: SparkSession, path: str) -> DataFrame:
    """All versions of a plain table, or what a reader needs of a `store.CatalogStore` in that folder."""
    if exists(spark, f"{path}/commits"):
        from .store import CatalogStore

        return CatalogStore(spark, path).versions()
    return spark.read.schema(SCHEMA).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a catalog at a place, on any file system that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def append(versions: DataFrame, path: str) -> None:
    versions.write.mode("append").parquet(path)


def compact(versions: DataFrame, new_path: str) -> None:
    """Write the current catalog to a new place, clustered by id so that a point read skips files."""
    current(versions).repartitionByRange("dashboard_id").sortWithinPartitions("dashboard_id").write.parquet(new_path)


def new_versions(dashboards: DataFrame, dashboard_id: Column | None = None) -> DataFrame:
    """First versions of finished dashboards. `dashboards` holds `user_id` and the config columns.

    Without an id column or expression each row gets a random one: write the result before using it.
    """
    has = set(dashboards.columns)
    identity = dashboard_id if dashboard_id is not None else (F.col("dashboard_id") if "dashboard_id" in has else F.uuid())
    texts = [_text_of(dashboards, c).alias(c) for c in UPDATABLE]
    file_url = F.col("file_url") if "file_url" in has else F.lit(None).cast("string")
    rows = dashboards.select(
        identity.alias("dashboard_id"), *texts, F.lit("ready").alias("status"), file_url.alias("file_url"),
        F.col("user_id").cast("bigint").alias("user_id"),
    )
    stamped = rows.withColumns({
        "created_at": F.current_timestamp(), "updated_at": F.lit(None).cast("timestamp"),
        "version": F.lit(1).cast("bigint"), "deleted": F.lit(False),
    })
    return _arranged(stamped)


def _text_of(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    return raw(name) if dict(df.dtypes)[name] == "string" else F.to_json(raw(name))


def _arranged(df: DataFrame) -> DataFrame:
    return df.select(*[part.split()[0] for part in SCHEMA.split(",")])


def latest(versions: DataFrame, key: str | list[str], version: str) -> DataFrame:
    """The row with the highest version per key. Every task first keeps one row per key of its own, so a
    key with very many versions does not gather in one task. Rows of one version are told apart by a hash
    of all their columns, so the choice is the same in every run."""
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.xxhash64(*[raw(c) for c in versions.columns]).desc())
    return versions.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def current(versions: DataFrame) -> DataFrame:
    """The live dashboards."""
    return latest(versions, "dashboard_id", "version").where(~F.coalesce("deleted", F.lit(False)))


def find(versions: DataFrame, dashboard_id: str, owner: int | None = None) -> DataFrame:
    """At most one dashboard by id, optionally only if it belongs to the owner. The id filter comes
    first and is pushed to the scan."""
    found = current(versions.where(F.col("dashboard_id") == dashboard_id))
    return (found if owner is None else found.where(F.col("user_id") == owner)).limit(1)


def list_page(versions: DataFrame, owner: int | None = None, limit: int | None = PAGE_SIZE, offset: int = 0,
              after: dict | None = None) -> DataFrame:
    """One page of all dashboards, or of one owner's, oldest first, with the true `total` on every row.

    An owner never changes after creation, so the owner filter goes below the version ranking. Ranking, page
    and total look at the narrow columns only; documents are fetched for the dashboards of the page.
    """
    rows = versions if owner is None else versions.where(F.col("user_id") == owner)
    live = current(rows.select("dashboard_id", "version", "deleted", "created_at"))
    shown = page(live, PAGE_ORDER, limit, offset, after).select("dashboard_id", "version")
    documents = latest(rows.join(shown, ["dashboard_id", "version"], "left_semi"), "dashboard_id", "version")
    listed = documents.select(*rows.columns).withColumn("total", live.agg(F.count(F.lit(1)).alias("n")).scalar())
    return listed.orderBy(*PAGE_ORDER)


def public_documents(dashboards: DataFrame) -> DataFrame:
    """What a reader of the catalog sees: nested config, blanks for missing texts, ISO time."""
    config = F.struct(
        F.col("title"), F.parse_json("charts").alias("charts"),
        F.coalesce("insights", F.lit("")).alias("insights"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce(F.parse_json("key_metrics"), F.parse_json(F.lit("[]"))).alias("key_metrics"),
    )
    created = iso(F.col("created_at"), dashboards.schema["created_at"].dataType)
    return dashboards.select("dashboard_id", config.alias("dashboard_config"), "status", created.alias("created_at"),
                             "file_url", "user_id")


def page_document(listed: DataFrame) -> DataFrame:
    """One row, `document`: the JSON answer to a list request, from a page that `list_page` cut to its limit.

    `page_size` counts the dashboards shown, `total` all there are.
    """
    shown = public_documents(listed).withColumn("_at", F.struct("created_at", "dashboard_id"))
    body = F.to_json(F.struct("dashboard_id", "dashboard_config", "status", "created_at", "file_url", "user_id"),
                     JSON_OPTIONS)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", body.alias("body")))), lambda d: d["body"])
    total = F.coalesce(listed.agg(F.max("total").alias("total")).scalar(), F.lit(0).cast("bigint"))
    return shown.agg(ordered.alias("d")).select(F.concat(
        F.lit('{"dashboards":['), F.concat_ws(",", "d"), F.lit('],"page_size":'), F.size("d").cast("string"),
        F.lit(',"total":'), total.cast("string"), F.lit("}")).alias("document"))


def owned(requests: DataFrame, dashboards: DataFrame, keys: list[str] = ["dashboard_id", "user_id"]) -> DataFrame:
    """Requests whose dashboard belongs to the user who asks."""
    return requests.join(dashboards.select(*keys), keys, "left_semi")


def refused(requests: DataFrame, dashboards: DataFrame, keys: list[str] = ["dashboard_id", "user_id"]) -> DataFrame:
    """The other requests: no such dashboard, or another owner."""
    return requests.join(dashboards.select(*keys), keys, "left_anti")


def one_per_key(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the greatest by `order`, nulls last, and among equals the greatest hash of all columns."""
    by = [raw(order).desc_nulls_last()] if order else []
    ranked = Window.partitionBy(*[raw(k) for k in keys]).orderBy(*by, F.xxhash64(*[raw(c) for c in rows.columns]).desc())
    return rows.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def created_versions(versions: DataFrame, dashboards: DataFrame, order: str | None = None) -> DataFrame:
    """First versions of the dashboards whose id no version has yet, deleted ones included; one per id of the batch.

    Unlike `new_versions` this looks at the catalog; `create_conflicts` names the ids that are taken.
    """
    fresh = dashboards.join(versions.select("dashboard_id"), "dashboard_id", "left_anti")
    return new_versions(one_per_key(fresh, ["dashboard_id"], order))


def create_conflicts(versions: DataFrame, dashboards: DataFrame) -> DataFrame:
    """`dashboard_id`, `reason` of incoming ids: taken in the catalog, or repeated in the batch."""
    counted = dashboards.groupBy("dashboard_id").agg(F.count(F.lit(1)).alias("_n"))
    taken = counted.join(versions.select("dashboard_id").distinct().withColumn("_taken", F.lit(True)), "dashboard_id", "left")
    reason = F.when(F.col("_taken"), "taken").when(F.col("_n") > 1, "repeated")
    return taken.select("dashboard_id", reason.alias("reason")).where("reason IS NOT NULL")


def updated_versions(versions: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """New versions for the updates whose user owns the dashboard; columns absent from `updates` stay.

    Of several updates of one dashboard in a batch one holds, see `one_per_key`.
    """
    given = [c for c in UPDATABLE if c in updates.columns]
    single = one_per_key(updates, ["dashboard_id", "user_id"], order)
    changes = single.select("dashboard_id", "user_id", *[_text_of(updates, c).alias(f"_{c}") for c in given])
    rows = changes.join(current(versions), ["dashboard_id", "user_id"])
    replaced = rows.withColumns({**{c: F.col(f"_{c}") for c in given},
                                 "updated_at": F.current_timestamp(), "version": F.col("version") + 1})
    return _arranged(replaced)


def tombstones(versions: DataFrame, deletes: DataFrame) -> DataFrame:
    """Delete markers for the requests whose user owns the dashboard."""
    rows = owned(current(versions), deletes.distinct())
    return _arranged(rows.withColumns({"updated_at": F.current_timestamp(), "version": F.col("version") + 1,
                                       "deleted": F.lit(True)}))


def upsert(rows: DataFrame, updates: DataFrame, key: str | list[str], order: str | None = None) -> DataFrame:
    """Snapshot form of an update: rows without an update, and one update per key. Applying it twice changes nothing."""
    keys = [key] if isinstance(key, str) else key
    single = one_per_key(updates, keys, order)
    return rows.join(updates.select(*keys), keys, "left_anti").unionByName(single.select(*rows.columns))


def without(rows: DataFrame, deletes: DataFrame, key: str | list[str]) -> DataFrame:
    """Snapshot form of a delete."""
    keys = [key] if isinstance(key, str) else key
    return rows.join(deletes.select(*keys), keys, "left_anti")


def backfill_owner(rows: DataFrame, owner: Column, column: str = "user_id") -> DataFrame:
    """Give rows without an owner to the looked-up one. `owner` is a scalar subquery, so it is one value."""
    return rows.withColumn(column, F.coalesce(raw(column), owner))


def require_filled(rows: DataFrame, column: str) -> DataFrame:
    """The rows themselves; any null in the column is an error."""
    if not rows.where(raw(column).isNull()).isEmpty():
        raise ConstraintError(f"{column} holds nulls")
    return rows


def users_with_dashboards(users: DataFrame, dashboards: DataFrame, user_key: str = "id", owner: str = "user_id") -> DataFrame:
    """Every user with each of their dashboards; users without one appear once.

    Written as owner-side inner join plus the users left over: in an inner join a user who owns a third of
    all dashboards can be split over tasks, which an outer join that preserves the users cannot do.
    """
    names = {c: f"owner_{c}" if c in dashboards.columns else c for c in users.columns}
    people = users.withColumnsRenamed(names).withColumn("_owner", raw(names[user_key]))
    owns = dashboards.withColumn("_owner", raw(owner))
    idle = people.join(owns.select("_owner").distinct(), "_owner", "left_anti")
    return owns.join(people, "_owner").unionByName(idle, allowMissingColumns=True).drop("_owner")


def dashboards_per_user(users: DataFrame, dashboards: DataFrame, user_key: str = "id", owner: str = "user_id") -> DataFrame:
    """Each user with `dashboards`, the number they own: counted before the join, so ownership skew is gone."""
    per_owner = dashboards.where(raw(owner).isNotNull()).groupBy(raw(owner).alias(user_key)).agg(F.count(F.lit(1)).alias("dashboards"))
    return users.join(per_owner, user_key, "left").withColumn("dashboards", F.coalesce("dashboards", F.lit(0).cast("bigint")))


def key_conflicts(incoming: DataFrame, existing: DataFrame, keys: list[str | tuple[str, str]], row_id: str) -> DataFrame:
    """`row_id`, `reason` for incoming rows whose value of a unique column is taken; the first key in the
    list gives the reason.

    One equi-join per key in place of one join with OR, which could not be hashed. Existing values are made
    distinct first, and incoming rows are the side a skewed value can be split on.
    """
    found = []
    for rank, key in enumerate(keys):
        mine, theirs = (key, key) if isinstance(key, str) else key
        taken = existing.where(raw(theirs).isNotNull()).select(raw(theirs).alias("_taken")).distinct()
        hits = incoming.withColumn("_taken", raw(mine)).join(taken, "_taken", "left_semi")
        found.append(hits.select(raw(row_id), F.lit(rank).alias("_at")))
    first = reduce(DataFrame.unionByName, found).groupBy(raw(row_id)).agg(F.min("_at").alias("_at"))
    names = F.array(*[F.lit(k if isinstance(k, str) else k[0]) for k in keys])
    return first.select(raw(row_id), F.element_at(names, F.col("_at") + 1).alias("reason"))


def constraint_report(rows: DataFrame, required: list[str] = (), unique: list[str] = (),
                      references: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """`constraint`, `column`, `violations`: nulls in required columns, values of unique columns held by
    more than one row, and values without a parent row. Parents are given as (column, table, parent key)."""
    parts = []
    if required:
        wide = rows.agg(*[F.count_if(raw(c).isNull()).alias(c) for c in required])
        parts.append(wide.unpivot([], [raw(c) for c in required], "column", "violations").select(
            F.lit("not_null").alias("constraint"), "column", "violations"))
    for column in unique:
        held = rows.where(raw(column).isNotNull()).groupBy(raw(column)).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(_violations(held.where(F.col("_n") > 1).agg(F.count(F.lit(1)).alias("violations")), "unique", column))
    for column, parent, parent_key in references:
        # Counted per value first: a value on a third of all rows is one row of the join.
        held = rows.where(raw(column).isNotNull()).groupBy(raw(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
        orphans = held.join(parent.select(raw(parent_key).alias("_value")), "_value", "left_anti")
        total = F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("violations")
        parts.append(_violations(orphans.agg(total), "foreign_key", column))
    return reduce(DataFrame.unionByName, parts)


def _violations(counted: DataFrame, constraint: str, column: str) -> DataFrame:
    return counted.select(F.lit(constraint).alias("constraint"), F.lit(column).alias("column"), "violations")
