"""Runs, queues, tool calls and activity logs; profiles of workspaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def queue_counters(runs: DataFrame, now: Column | None = None) -> DataFrame:
    """One row: queued, scheduled, success and failed runs, and those that ended well or badly in the last day (runs: state, ended_at)."""
    day = F.col("ended_at") >= (F.current_timestamp() if now is None else now) - F.expr("INTERVAL 1 DAY")
    states = ("queued", "scheduled", "success", "failed")
    return runs.agg(*(F.count_if(F.col("state") == s).alias(s) for s in states), *(F.count_if((F.col("state") == s) & day).alias(f"{s}_last_day") for s in states[2:]))


def run_status(runs: DataFrame, by: str = "source_id") -> DataFrame:
    """For each source its last run's state, when that started, and how many runs failed."""
    return runs.groupBy(by).agg(F.max_by("state", "started_at").alias("state"), F.max("started_at").alias("started_at"), F.count_if(F.col("state") == "failed").alias("failed"), F.count(F.lit(1)).alias("runs"))


def last_runs(runs: DataFrame, most: int, started: str = "started_at", key: str = "id") -> DataFrame:
    return runs.orderBy(F.desc(started), F.desc(key)).limit(most)


def tool_calls(calls: DataFrame) -> DataFrame:
    """For each tool and in all (null): calls, errors, mean seconds (calls: tool, is_error, seconds)."""
    return calls.rollup("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))


def activity(log: DataFrame, events: DataFrame) -> DataFrame:
    """An activity log with a batch of events (user_id, kind, path, forwarded_for, address, at) appended; the address is the first that was forwarded."""
    first = F.coalesce(F.nullif(F.trim(F.substring_index("forwarded_for", ",", 1)), F.lit("")), F.col("address"))
    return log.unionByName(events.select("user_id", "kind", "path", first.alias("address"), "at"))


def workspace_profile(items: DataFrame, workspace_id: str, most: int = 10) -> dict[str, DataFrame]:
    """Counts by type, datasets, and the owners of most items."""
    own = items.where(F.col("workspace_id") == workspace_id)
    return {
        "types": own.groupBy("item_type").agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("items"), "item_type"),
        "datasets": own.where("dataset_name IS NOT NULL").select("dataset_name").distinct().orderBy("dataset_name"),
        "owners": own.where("owner IS NOT NULL").groupBy("owner").agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("items"), "owner").limit(most),
    }


def filled(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str | None = None) -> DataFrame:
    """left with nulls of the columns filled from right by trimmed keys; of right's rows of one key the last by `order` counts, or by all columns. What left has stays."""
    clean = lambda df: df.select(*(F.trim(F.col(k)).alias(f"_{k}") for k in keys), (F.col(order) if order else F.lit(0)).alias("_order"), *(F.col(c).alias(f"_r_{c}") for c in columns))
    own = clean(right)
    fill = [f"_r_{c}" for c in columns]
    own = own.groupBy(*(f"_{k}" for k in keys)).agg(F.max_by(F.struct(*fill), F.struct("_order", *fill)).alias("_r"))
    on = [F.trim(F.col(k)) == F.col(f"_{k}") for k in keys]
    joined = left.join(own, on, "left")
    return joined.select(*(F.coalesce(F.col(c), F.col(f"_r._r_{c}")).alias(c) if c in columns else F.col(c) for c in left.columns))


def usage_relationships(report_fields: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One flat table of what uses what: LINEAGE from reports, DEPENDENCY from expressions."""
    lineage = report_fields.where("field_name IS NOT NULL").select(F.lit("LINEAGE").alias("kind"), F.col("field_name").alias("used"), F.col("report").alias("user"), F.col("page_name").alias("place"))
    needs = dependencies.select(F.lit("DEPENDENCY").alias("kind"), F.col("referenced").alias("used"), F.col("object").alias("user"), F.col("object_table").alias("place"))
    return lineage.unionByName(needs).distinct()
