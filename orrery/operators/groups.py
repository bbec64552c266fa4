"""Measure groups: representatives, surfaces and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import names, rules

SURFACE = ("description", "expression", "formatstring", "datatype", "table_name", "dataset_name", "workspace_name", "web_url")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the order.

    A reduction (min_by of whole rows), not a window: rows of a key combine before the shuffle, so a key that holds much of the
    table is no hot partition.
    """
    others = [c for c in df.columns if c not in keys]
    ranked = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), ranked).alias("_row"))
    return picked.select(*(f"_row.{c}" if c not in keys else c for c in df.columns))


def keep_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return first_of(df, keys, [-F.col(seq)])


def keep_first(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The first of repeated edges stays, so a dependency outlives a later join edge of the same pair."""
    return first_of(df, keys, [F.col(seq)])


def instance_order(primary: Column | None = None) -> list[Column]:
    """A pinned instance; then measures with an expression of their own, by workspace, dataset and id."""
    pinned = [F.when(primary, 0).otherwise(1)] if primary is not None else []
    external = rules.is_external_measure(F.col("expression"), F.col("description"))
    return [*pinned, F.when(external, 1).otherwise(0), rules.workspace_rank(F.col("workspace_name")), F.coalesce("dataset_name", F.lit("")), F.col("item_id")]


def representatives(measures: DataFrame, primary: Column | None = None) -> DataFrame:
    return first_of(measures, ["group_id"], instance_order(primary))


def chat_representatives(measures: DataFrame, primary: Column) -> DataFrame:
    """Another order: the curated one, then most reports, most visuals, a description, the id."""
    most = lambda c: -F.coalesce(F.col(c), F.lit(0))
    has = F.when(names.blank_to_null(F.col("description")).isNotNull(), 0).otherwise(1)
    return first_of(measures, ["group_id"], [F.when(primary, 0).otherwise(1), most("connected_reports"), most("connected_visuals"), has, F.col("item_id")])


def surface(measures: DataFrame, fields: Sequence[str] = SURFACE, primary: Column | None = None, match: Column | None = None) -> DataFrame:
    """For each group, the first value that is not blank of every field, in the instances' order; instances that match come first."""
    order = [*([F.when(match, 0).otherwise(1)] if match is not None else []), *instance_order(primary)]
    ranked = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)))
    value = lambda c: names.blank_to_null(F.col(c).cast("string"))
    return measures.groupBy("group_id").agg(*(F.min_by(value(c), F.when(value(c).isNotNull(), ranked)).alias(c) for c in fields if c in measures.columns), F.count(F.lit(1)).alias("instances"))


def spans(measures: DataFrame) -> DataFrame:
    """Workspaces and datasets of each group."""
    return measures.groupBy("group_id").agg(F.countDistinct("workspace_id").alias("workspaces"), F.countDistinct("dataset_id").alias("datasets"))


def dashboard(measures: DataFrame) -> DataFrame:
    """One row: groups, unused groups (their representatives are unused), groups without a description anywhere, instances."""
    per_group = measures.groupBy("group_id").agg(
        F.min_by("is_unused", F.struct(*instance_order())).alias("unused"), F.bool_or(names.blank_to_null(F.col("description")).isNotNull()).alias("described"), F.count(F.lit(1)).alias("n")
    )
    return per_group.agg(F.count(F.lit(1)).alias("groups"), F.count_if("unused").alias("unused"), F.count_if(~F.col("described")).alias("undocumented"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("instances"))


def coverage(measure_reports: DataFrame) -> DataFrame:
    """For each group: distinct reports of all its instances, most visuals, datasets, and the band of its spread.

    Takes one row for each instance and report (group_id, item_id, report, visuals, dataset_id), report null where it has none.
    """
    groups = measure_reports.groupBy("group_id").agg(F.countDistinct("report").alias("reports"), F.max(F.coalesce("visuals", F.lit(0))).cast("long").alias("visuals"), F.countDistinct("dataset_id").alias("datasets"))
    return groups.withColumn("spread", rules.spread_bucket(F.col("reports")))


def spread(measure_reports: DataFrame) -> DataFrame:
    return coverage(measure_reports).groupBy("spread").agg(F.count(F.lit(1)).alias("groups"))


def measures_by_report(measure_reports: DataFrame) -> DataFrame:
    return measure_reports.where("report IS NOT NULL").groupBy("report").agg(F.countDistinct("group_id").alias("measures"))


def measure_usage(measure_reports: DataFrame, group: str) -> DataFrame:
    """Measure mode: the reports of one group over all instances, with its most visuals."""
    own = measure_reports.where(F.col("group_id") == group)
    return own.where("report IS NOT NULL").groupBy("report").agg(F.max("visuals").cast("long").alias("visuals"), F.countDistinct("item_id").alias("instances"))


def report_usage(measure_reports: DataFrame, report: str) -> DataFrame:
    """Report mode: distinct measure groups that feed a report, most visuals first, then by name."""
    own = measure_reports.where(F.col("report") == report)
    return own.groupBy("group_id").agg(F.max("visuals").cast("long").alias("visuals")).orderBy(F.desc("visuals"), "group_id")


def with_reports(measures: DataFrame) -> DataFrame:
    """Instances exploded by the distinct names of connected_reports_json, for coverage()."""
    reports = F.explode_outer(names.distinct_names(F.transform("connected_reports_json", lambda r: r["name"])))
    return measures.select("group_id", "item_id", F.col("connected_visuals").alias("visuals"), "dataset_id", reports.alias("report"))


def merged_reports(measures: DataFrame) -> DataFrame:
    """For each group the reports of all instances, one for each id (or name where it has none), by name."""
    rows = measures.select("group_id", F.explode("connected_reports_json").alias("r")).select("group_id", "r.*")
    rows = rows.groupBy("group_id", F.coalesce(names.blank_to_null(F.col("id")), F.col("name")).alias("key")).agg(F.min(F.struct("name", "url")).alias("r"))
    return rows.select("group_id", "key", "r.name", "r.url")


def ranked(df: DataFrame, by: Sequence[Column], partition: Sequence[str] = ()) -> DataFrame:
    """df with the position in an order, within small partitions such as the instances of one group."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*partition).orderBy(*by)))


def context_listing(measures: DataFrame, workspaces: Sequence[str] = ()) -> DataFrame:
    """One row for each group (item_group_id, else the name): its instance with most reports, then most visuals, then by name; in that order."""
    most = lambda c: -F.coalesce(F.col(c), F.lit(0))
    order = lambda: [most("connected_reports"), most("connected_visuals"), F.col("item_name"), F.col("item_id")]
    own = measures.where("item_type = 'PB_MEASURE' AND coalesce(item_name, '') <> '' AND NOT coalesce(deleted, false)")
    own = own.where(F.col("workspace_id").isin(*workspaces)) if workspaces else own
    keyed = own.withColumn("_group", F.coalesce(F.col("item_group_id").cast("string"), F.concat(F.lit("name::"), "item_name")))
    return first_of(keyed, ["_group"], order()).orderBy(*order()).drop("_group")
