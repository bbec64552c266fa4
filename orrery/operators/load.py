"""Loads: typed staging, merges by column policy, soft deletes and month replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.names import blank_to_null, measure_key

#: What a merge does with a column where both sides have the row: take the new value; take it unless null; keep the old.
OVERWRITE, COALESCE, PRESERVE = "overwrite", "coalesce", "preserve"

_GOVERNED = ("status", "item_group_id", "group_id", "organization_id")
BI_POLICY = {**dict.fromkeys(("database_name", "schema_name", "alias", "tags", "meta", "integration_source_id", *_GOVERNED), PRESERVE)}
DBT_POLICY = {**dict.fromkeys(("item_name", "description", "expression"), COALESCE), **dict.fromkeys(("connected_reports", "is_unused", "bq_project", "bq_schema", "bq_source_name", *_GOVERNED), PRESERVE)}


def typed(staged: DataFrame, schema: T.StructType, null_words: Sequence[str] = ()) -> DataFrame:
    """Text columns of a staging table as the schema's types; columns that it lacks are null, flags false and counts 0.

    Blank text is null, and so are null_words. true, 1 and t are true in any case. Numbers are rounded, not cut; what is no number is null.
    """
    low = {c.lower().lstrip("﻿"): c for c in staged.columns}

    def column(f: T.StructField) -> Column:
        if f.name.lower() not in low:
            return (F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(0) if isinstance(f.dataType, (T.IntegerType, T.LongType)) and f.name.startswith(("connected", "view")) else F.lit(None)).cast(f.dataType).alias(f.name)
        raw = F.col(f"`{low[f.name.lower()]}`")
        if not isinstance(staged.schema[low[f.name.lower()]].dataType, T.StringType):
            return raw.cast(f.dataType).alias(f.name)
        text = blank_to_null(raw)
        for w in null_words:
            text = F.nullif(text, F.lit(w))
        if isinstance(f.dataType, T.BooleanType):
            out = F.coalesce(F.lower(text).isin("true", "1", "t"), F.lit(False))
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)):
            number = F.round(text.try_cast("decimal(38,6)")).cast(f.dataType)
            out = F.coalesce(number, F.lit(0).cast(f.dataType)) if f.name.startswith(("connected", "view")) else number
        elif isinstance(f.dataType, T.StringType):
            out = text
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            out = F.from_json(text, f.dataType)
        else:
            out = text.try_cast(f.dataType.simpleString())
        return out.alias(f.name)

    return staged.select(*(column(f) for f in schema))


def _comparable(value: Column, kind: T.DataType) -> Column:
    """A map as sorted entries; other values as they are."""
    return F.array_sort(F.map_entries(value)) if isinstance(kind, T.MapType) else value


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], policy: Mapping[str, str], reset: Mapping[str, object] | None = None, differs: str | None = None) -> DataFrame:
    """old with new's rows merged in by keys: one row for each key, columns by policy (OVERWRITE where it names none).

    `reset` gives columns of rows that new has a fixed value (deleted: False). Rows that new lacks stay as they are. Rows of
    new without a key are left out; of repeated keys the last by all columns counts. One full outer join; running it again changes nothing.
    With `differs`, a column of this name tells which rows are new or have another value than in old.
    """
    reset = reset or {}
    others = [f for f in old.schema if f.name not in keys]
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    fresh = new.where(present).groupBy(*keys).agg(*(F.max_by(c, F.struct(*(x for x in new.columns if not isinstance(new.schema[x].dataType, T.MapType)))).alias(c) for c in new.columns if c not in keys)).withColumn("_new", F.lit(True))
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(fresh.alias("n"), list(keys), "full")

    def column(f: T.StructField) -> Column:
        was = F.col(f"o.{f.name}")
        if f.name not in new.columns:
            value = was
        else:
            rule, now = policy.get(f.name, OVERWRITE), F.col(f"n.{f.name}")
            kept = {OVERWRITE: now, COALESCE: F.coalesce(now, was), PRESERVE: was}[rule]
            value = F.when(F.col("_new").isNull(), was).when(F.col("_old").isNull(), now).otherwise(kept)
        if f.name in reset:
            value = F.when(F.col("_new"), F.lit(reset[f.name])).otherwise(value)
        return (value if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else value.cast(f.dataType)).alias(f.name)

    if differs is None:
        return joined.select(*keys, *(column(f) for f in others)).select(*old.columns)
    was, now = (F.struct(*(_comparable(of(f), f.dataType).alias(f.name) for f in others)) for of in (lambda f: F.col(f"o.{f.name}"), column))
    return joined.select(*keys, *(column(f) for f in others), (F.col("_old").isNull() | ~now.eqNullSafe(was)).alias(differs)).select(*old.columns, differs)


def load_items(old: DataFrame, new: DataFrame, policy: Mapping[str, str], service: str, organization_id: int | None = None, now: Column | None = None) -> DataFrame:
    """Merge, then soft deletion: rows of the service (and organisation) that new lacks are marked; those that are back are not deleted. Inserts are UNVERIFIED."""
    new = new.withColumn("status", F.lit("UNVERIFIED")).withColumn("group_id", measure_key(F.col("organization_id"), F.col("item_type"), F.col("item_name")))
    done = merged(old, new, ["item_id"], {**policy, "group_id": OVERWRITE}, {"deleted": False, "deleted_at": None})
    scope = F.col("service") == service
    if organization_id is not None:
        scope = scope & (F.col("organization_id").eqNullSafe(F.lit(organization_id)) | F.col("organization_id").isNull())
    return soft_deleted(done, new.select("item_id"), scope, now)


def soft_deleted(items: DataFrame, present: DataFrame, scope: Column, now: Column | None = None) -> DataFrame:
    """Items in scope whose id is not among `present` are marked deleted. Null ids among `present` suppress nothing."""
    ids = present.where("item_id IS NOT NULL").select("item_id", F.lit(True).alias("_present")).distinct()
    gone = scope & F.col("_present").isNull() & ~F.coalesce("deleted", F.lit(False))
    marked = items.join(ids, "item_id", "left").withColumn("_gone", F.coalesce(gone, F.lit(False)))
    marked = marked.withColumn("deleted_at", F.when(F.col("_gone"), F.current_timestamp() if now is None else now).otherwise(F.col("deleted_at"))).withColumn("deleted", F.col("deleted") | F.col("_gone"))
    return marked.select(*items.columns)


def months_replaced(old: DataFrame, new: DataFrame, month: str = "month", scope: Sequence[str] = ("organization_id", "integration_source_id")) -> DataFrame:
    """Usage in which the months that new holds for a scope are replaced; nulls of the scope are equal; an empty new deletes nothing."""
    keys = [month, *scope]
    windows = new.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return old.join(F.broadcast(windows) if windows.limit(10_001).count() <= 10_000 else windows, same, "left_anti").unionByName(new.select(*old.columns))


def graph_without(edges: DataFrame, prefix: str) -> DataFrame:
    """Edges that stay when one tool's part is loaded anew: the other tool's own; bridges go."""
    inside = F.col("source").startswith(prefix) | F.col("target").startswith(prefix)
    return edges.where(~inside & F.col("bridge_reason").isNull())


def with_groups(items: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items linked to their groups, groups with those that were missing).

    Measures are grouped by name, other items stand alone. A renamed measure leaves its group for the one of its new name. Statuses of
    items mirror their groups'. New groups get ids hashed from their keys; running it again changes nothing.
    """
    key = F.coalesce(F.col("group_id"), F.concat(F.lit("item::"), F.col("item_id")))
    keyed = items.withColumn("_key", key)
    wanted = keyed.groupBy(F.col("_key").alias("group_key")).agg(F.min("organization_id").alias("organization_id"), F.bool_or(F.col("group_id").isNotNull()).alias("_measure"), F.min("item_id").alias("_first"))
    missing = wanted.join(groups, "group_key", "left_anti")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in groups.schema}
    numbered = missing.withColumn("id", F.shiftrightunsigned(F.xxhash64("group_key"), 1))
    made = {**blank, "id": F.col("id"), "group_key": F.col("group_key"), "kind": F.when(F.col("_measure"), "measure_name").otherwise("singleton"), "organization_id": F.col("organization_id"), "status": F.lit("UNVERIFIED"), "deleted": F.lit(False), "primary_item_id": F.when(~F.col("_measure"), F.col("_first"))}
    every = groups.unionByName(numbered.select(*(made[f.name].cast(f.dataType).alias(f.name) for f in groups.schema)))
    link = every.select(F.col("group_key").alias("_key"), F.col("id").alias("_id"), F.col("status").alias("_status"))
    linked = keyed.join(link, "_key", "left").withColumn("item_group_id", F.col("_id")).withColumn("status", F.coalesce("_status", "status"))
    return linked.select(*items.columns), every


def edges_upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """One edge for each (source, target); the new one wins."""
    return old.join(new.select("source", "target").distinct(), ["source", "target"], "left_anti").unionByName(new.dropDuplicates(["source", "target"]), allowMissingColumns=True)


def retained(log: DataFrame, days: int, started: str = "started_at", now: Column | None = None) -> DataFrame:
    return log.where(F.col(started) >= (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days)))


def latest(runs: DataFrame, by: str, started: str = "started_at") -> DataFrame:
    """The last run of each source."""
    return runs.groupBy(by).agg(F.max_by(F.struct(*(c for c in runs.columns if c != by)), F.col(started)).alias("r")).select(by, "r.*")
