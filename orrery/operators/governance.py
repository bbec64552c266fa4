"""Governance: cascades, status log, tasks and the CSV import. Pure functions from tables to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.names import blank_to_null
from orrery.operators.bridge import unique_by

STATUSES = ("UNVERIFIED", "VERIFIED", "ATTENTION", "DELETED")
#: Statuses that call for a task, and who gets it: the first of these that a group has.
TASK_STATUSES, ASSIGNEES = ("ATTENTION", "DELETED"), ("steward_id", "ownership_person_id")


def changed(groups: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """groups with `changes` (id, status, deleted; null leaves as it is) applied: deletion forces DELETED, restoring clears it."""
    own = changes.select("id", F.col("status").alias("_status"), F.col("deleted").alias("_deleted"))
    joined = groups.join(own, "id", "left")
    deleted = F.coalesce("_deleted", F.when(F.col("_status") == "DELETED", True), F.when(F.col("_status").isNotNull(), False), "deleted", F.lit(False))
    restored = F.when((F.col("status") == "DELETED") & F.col("_status").isNull(), "UNVERIFIED").otherwise(F.coalesce("_status", "status"))
    done = joined.withColumn("_was", F.coalesce("deleted", F.lit(False))).withColumn("_now", deleted)
    done = done.withColumn("status", F.when(F.col("_now"), "DELETED").otherwise(F.when(F.col("_status") == "DELETED", "DELETED").otherwise(restored)))
    done = done.withColumn("deleted_at", F.when(F.col("_now") & ~F.col("_was"), now).when(~F.col("_now"), F.lit(None)).otherwise(F.col("deleted_at"))).withColumn("deleted", F.col("_now"))
    return done.select(*groups.columns)


def cascaded(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Items take status and deletion from their group."""
    own = groups.select(F.col("id").alias("item_group_id"), F.col("status").alias("_status"), F.col("deleted").alias("_deleted"), F.col("deleted_at").alias("_at"))
    joined = items.join(own, "item_group_id", "left")
    for c, new in (("status", "_status"), ("deleted", "_deleted"), ("deleted_at", "_at")):
        joined = joined.withColumn(c, F.when(F.col("_status").isNotNull(), F.col(new)).otherwise(F.col(c)))
    return joined.select(*items.columns)


def status_log(before: DataFrame, after: DataFrame, now: Column, by: str | None = None) -> DataFrame:
    """Rows to append: groups whose status is another than before."""
    old = before.select("id", F.col("status").alias("old_status"))
    return after.join(old, "id", "left").where(~F.col("status").eqNullSafe(F.col("old_status"))).select(F.col("id").alias("group_id"), "old_status", F.col("status").alias("new_status"), now.alias("changed_at"), F.lit(by).alias("changed_by"))


def last_deletion(log: DataFrame) -> DataFrame:
    return log.where("new_status = 'DELETED'").groupBy("group_id").agg(F.max("changed_at").alias("deleted_at"))


def synced_tasks(tasks: DataFrame, groups: DataFrame, now: Column, roles: Sequence[str] = ASSIGNEES) -> DataFrame:
    """Tasks with one open task for each group that calls for one: an open one is refreshed, a missing one is made; others stay."""
    due = groups.where(F.col("status").isin(*TASK_STATUSES)).select(F.col("id").alias("group_id"), F.col("status").alias("_status"), F.coalesce(*roles).alias("_assignee"))
    is_open = F.col("state") == "open"
    joined = tasks.join(due, "group_id", "left")
    fresh = is_open & F.col("_status").isNotNull()
    kept = joined.withColumn("status", F.when(fresh, F.col("_status")).otherwise(F.col("status"))).withColumn("assignee_id", F.when(fresh, F.col("_assignee")).otherwise(F.col("assignee_id"))).withColumn("updated_at", F.when(fresh, now).otherwise(F.col("updated_at")))
    made = due.join(tasks.where(is_open).select("group_id"), "group_id", "left_anti")
    row = {"id": F.md5(F.concat_ws("/", F.col("group_id").cast("string"), now.cast("string")).cast("binary")), "group_id": F.col("group_id"), "state": F.lit("open"), "status": F.col("_status"), "assignee_id": F.col("_assignee"), "created_at": now, "updated_at": now, "done_at": F.lit(None)}
    return kept.select(*tasks.columns).unionByName(made.select(*(row[f.name].cast(f.dataType).alias(f.name) for f in tasks.schema)))


def done(tasks: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    joined = tasks.join(ids.select("id", F.lit(True).alias("_done")), "id", "left")
    return joined.withColumn("state", F.when(F.col("_done"), "done").otherwise(F.col("state"))).withColumn("done_at", F.when(F.col("_done"), now).otherwise(F.col("done_at"))).select(*tasks.columns)


def resolved(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """rows with {column}_id and {column}_outcome (blank, found, unknown, ambiguous): names in any case, the organisation's own before common ones.

    known: (id, name, organization_id).
    """
    named = known.select(F.lower(F.trim("name")).alias("_key"), "id", "organization_id")
    own, common = unique_by(named.where("organization_id IS NOT NULL"), "_key", "id"), unique_by(named.where("organization_id IS NULL"), "_key", "id")
    every = named.select("_key").distinct().withColumn("_any", F.lit(True))
    key = F.lower(blank_to_null(F.col(column)))
    joined = rows.withColumn("_key", key).join(own.withColumnRenamed("id", "_own"), "_key", "left").join(common.withColumnRenamed("id", "_common"), "_key", "left").join(every, "_key", "left")
    found = F.coalesce("_own", "_common")
    outcome = F.when(F.col("_key").isNull(), "blank").when(found.isNotNull(), "found").when(F.col("_any"), "ambiguous").otherwise("unknown")
    return joined.withColumn(f"{column}_id", found).withColumn(f"{column}_outcome", outcome).drop("_key", "_own", "_common", "_any")


def imported(groups: DataFrame, rows: DataFrame, people: DataFrame, departments: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups with the CSV's governance, report of group_pk, group_id, field, outcome).

    A row finds its group by number, else by key. Blank fields keep what the group has; unknown and ambiguous names and invalid statuses are reported
    and keep it too; rows without a group are reported as such.
    """
    by_pk = groups.select(F.col("id").cast("string").alias("group_pk"), F.col("id").alias("_by_pk"))
    by_key = unique_by(groups.select("group_key", "id"), "group_key", "id").select(F.col("group_key").alias("group_id"), F.col("id").alias("_by_key"))
    found = rows.withColumn("group_pk", F.trim("group_pk")).withColumn("group_id", F.trim("group_id")).join(by_pk, "group_pk", "left").join(by_key, "group_id", "left").withColumn("_id", F.coalesce("_by_pk", "_by_key"))
    for column, known in (("owner", people), ("steward", people), ("department", departments), ("category", categories)):
        found = resolved(found, column, known)
    status = F.upper(blank_to_null(F.col("status")))
    found = found.withColumn("status_outcome", F.when(status.isNull(), "blank").when(status.isin(*STATUSES), "found").otherwise("invalid"))
    fields = ("owner", "steward", "department", "category", "status")
    problems = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_outcome").alias("outcome")) for f in fields)), lambda x: ~x["outcome"].isin("blank", "found"))
    problems = F.when(F.col("_id").isNull(), F.array(F.struct(F.lit("group").alias("field"), F.lit("unknown").alias("outcome")))).otherwise(problems)
    report = found.select("group_pk", "group_id", F.explode(problems).alias("p")).select("group_pk", "group_id", "p.field", "p.outcome")
    new = found.where("_id IS NOT NULL").groupBy(F.col("_id").alias("id")).agg(
        F.max("owner_id").alias("_owner"), F.max("steward_id").alias("_steward"), F.max("department_id").alias("_department"), F.max("category_id").alias("_category"),
        F.max(F.when(status.isin(*STATUSES), status)).alias("_status"), F.max(blank_to_null(F.col("custom_description"))).alias("_text"),
    )
    joined = groups.join(new, "id", "left")
    for c, source in (("ownership_person_id", "_owner"), ("steward_id", "_steward"), ("ownership_department_id", "_department"), ("category_id", "_category"), ("status", "_status"), ("custom_description", "_text")):
        joined = joined.withColumn(c, F.coalesce(source, c))
    return joined.select(*groups.columns), report


def exported(groups: DataFrame, items: DataFrame, people: DataFrame, departments: DataFrame, categories: DataFrame) -> DataFrame:
    """The CSV's rows, one for each group, named by its first item by name."""
    first = items.groupBy(F.col("item_group_id").alias("id")).agg(F.min(F.struct(F.col("item_name").alias("name"), "service", "item_type")).alias("i")).select("id", "i.*")
    named = lambda df, key, alias: df.select(F.col("id").alias(key), F.col("name").alias(alias))
    out = groups.join(first, "id", "left").join(named(people, "ownership_person_id", "owner"), "ownership_person_id", "left").join(named(people, "steward_id", "steward"), "steward_id", "left")
    out = out.join(named(departments, "ownership_department_id", "department"), "ownership_department_id", "left").join(named(categories, "category_id", "category"), "category_id", "left")
    return out.select(F.col("id").cast("string").alias("group_pk"), F.col("group_key").alias("group_id"), "kind", "name", "service", "item_type", "status", "owner", "steward", "department", "category", "custom_description")


def with_primary(groups: DataFrame, group_id: int, item_id: str) -> DataFrame:
    return groups.withColumn("primary_item_id", F.when(F.col("id") == group_id, F.lit(item_id)).otherwise(F.col("primary_item_id")))


def items_updated(items: DataFrame, groups: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items, groups) after changes of items (item_id, status, deleted; null leaves as it is), one row an item.

    A valid status goes to the item's group (of several for one group that of the last item by id), and marking an item as deleted makes its group
    DELETED. Items of groups whose status changed mirror it; items without a group take theirs. Deletion is stamped, restoring clears the stamp.
    """
    own = changes.select("item_id", F.when(F.col("status").isin(*STATUSES), F.col("status")).alias("_status"), F.col("deleted").alias("_deleted"))
    was = F.coalesce("deleted", F.lit(False))
    work = items.join(own, "item_id", "left").withColumn("_was", was).withColumn("_now", F.coalesce("_deleted", was))
    asked = work.where("item_group_id IS NOT NULL AND (_status IS NOT NULL OR _deleted IS NOT NULL)").groupBy(F.col("item_group_id").alias("id"))
    asked = asked.agg(F.max_by("_status", F.when(F.col("_status").isNotNull(), F.col("item_id"))).alias("_asked"), F.bool_or(F.expr("_now AND NOT _was")).alias("_gone"))
    new = F.when(F.col("_gone"), "DELETED").otherwise(F.coalesce("_asked", "status"))
    joined = groups.join(asked, "id", "left").withColumn("_new", new).withColumn("_other", ~F.col("status").eqNullSafe(F.col("_new")))
    stamp = F.when(F.col("_other"), F.when(F.col("_new") == "DELETED", now)).otherwise(F.col("deleted_at"))
    moved = joined.where("_other").select(F.col("id").alias("item_group_id"), F.col("_new").alias("_mirrored"))
    after = joined.withColumn("deleted_at", stamp).withColumn("deleted", F.when(F.col("_other"), F.col("_new") == "DELETED").otherwise(F.col("deleted"))).withColumn("status", F.col("_new")).select(*groups.columns)
    status = F.coalesce("_mirrored", F.when(F.col("item_group_id").isNull(), F.col("_status")), "status")
    stamped = F.when(F.col("_now") != F.col("_was"), F.when(F.col("_now"), now)).otherwise(F.col("deleted_at"))
    done = work.join(moved, "item_group_id", "left").withColumn("status", status).withColumn("deleted_at", stamped).withColumn("deleted", F.col("_now"))
    return done.select(*items.columns), after


def lifted(items: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Groups made from items' own governance: (group_key, kind, organization_id, the governance fields, status, primary_item_id).

    Measures are grouped by group_id, other items stand alone. In the order given, each field takes the first value that is not blank, status the first
    beyond UNVERIFIED, and the first item is primary. Rows combine before the shuffle, so a large group is no hot one.
    """
    measure = (F.col("item_type") == "PB_MEASURE") & blank_to_null(F.col("group_id")).isNotNull()
    key = F.when(measure, F.col("group_id")).otherwise(F.concat(F.lit("item::"), "item_id"))
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    rows = items.withColumn("_key", key).withColumn("_measure", measure).withColumn("_place", place)
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    fields = ("ownership_department_id", "ownership_person_id", "steward_id", "category_id", "custom_description")
    first = [F.min_by(c, F.when(has(c), F.col("_place"))).alias(c) for c in fields]
    status = F.min_by("status", F.when(has("status") & (F.col("status") != "UNVERIFIED"), F.col("_place")))
    return rows.groupBy(F.col("_key").alias("group_key")).agg(
        F.when(F.bool_or("_measure"), "measure_name").otherwise("singleton").alias("kind"), F.min_by("organization_id", "item_id").alias("organization_id"), *first,
        F.coalesce(status, F.lit("UNVERIFIED")).alias("status"), F.min_by("item_id", "_place").alias("primary_item_id"),
    )
