"""Usage analytics over the monthly fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.rules import identity_kind

#: Dimensions that the pivot may group by, and those it takes where none is asked for.
DIMENSIONS = ("month", "workspace_id", "workspace_name", "report_id", "report_name", "user_email", "user_display_name", "platform", "distribution_method", "report_page")
DEFAULT = ("month", "workspace_name", "report_name", "platform", "distribution_method")
GRAIN = (*DIMENSIONS, "organization_id", "integration_source_id")
MISSING = "—"
MOST_ROWS = 10_000


def dimensions(asked: str | Sequence[str] | None, allowed: Sequence[str] = DIMENSIONS, default: Sequence[str] = DEFAULT) -> list[str]:
    """Asked dimensions in order, unknown ones and repeats gone; the default where none is left."""
    names = asked.split(",") if isinstance(asked, str) else list(asked or [])
    return list(dict.fromkeys(n.strip() for n in names if n.strip() in allowed)) or list(default)


def usage_pivot(usage: DataFrame, group_by: str | Sequence[str] | None = None, limit: int | None = None, month_from=None, month_to=None, workspace_id: str | None = None, allowed: Sequence[str] = DIMENSIONS, default: Sequence[str] = DEFAULT) -> DataFrame:
    """views (sum of view_count) and users (distinct user_email) by the dimensions, most views first; limit from 0 to MOST_ROWS."""
    dims = dimensions(group_by, allowed, default)
    for condition in (month_from is not None and (F.col("month") >= F.lit(month_from)), month_to is not None and (F.col("month") <= F.lit(month_to)), workspace_id is not None and (F.col("workspace_id") == workspace_id)):
        usage = usage.where(condition) if condition is not False else usage
    out = usage.groupBy(*dims).agg(F.sum("view_count").cast("long").alias("views"), F.countDistinct("user_email").alias("users"))
    if limit is None:
        return out
    return out.orderBy(F.desc("views"), *dims).limit(max(0, min(limit, MOST_ROWS)))


def months(usage: DataFrame) -> DataFrame:
    return usage.select("month").distinct().orderBy(F.desc("month"))


def usage_totals(usage: DataFrame, rows: str, columns: str) -> DataFrame:
    """The two-dimensional pivot with its totals. Distinct users are counted anew for every total, and nothing is cut off before.

    level: 0 cell, 1 row total, 2 column total, 3 grand total. Blank dimension values read —.
    """
    axis = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(MISSING)).alias(c)
    cells = usage.select(axis(rows), axis(columns), "view_count", "user_email")
    return cells.cube(rows, columns).agg(F.grouping_id().cast("int").alias("level"), F.sum("view_count").cast("long").alias("views"), F.countDistinct("user_email").alias("users"))


def axis_order(totals: DataFrame, axis: str) -> DataFrame:
    """An axis of usage_totals in its order: most views first, then by name, — last."""
    return totals.orderBy(F.when(F.col(axis) == MISSING, 1).otherwise(0), F.desc("views"), axis)


def recent_totals(usage: DataFrame, by: str) -> DataFrame:
    """views in all and in the latest month of the whole table (views_recent_month)."""
    latest = usage.agg(F.max("month").alias("latest"))
    return usage.join(F.broadcast(latest)).groupBy(by).agg(F.sum("view_count").cast("long").alias("views"), F.coalesce(F.sum(F.when(F.col("month") == F.col("latest"), F.col("view_count"))), F.lit(0)).cast("long").alias("views_recent_month"))


def leaderboard(usage: DataFrame, most: int = 100) -> DataFrame:
    """Users by views: rank, views, distinct reports. Ties by user.

    The rank is numbered after the cut to `most`, so no task sorts all users.
    """
    users = usage.groupBy("user_email").agg(F.sum("view_count").cast("long").alias("views"), F.countDistinct("report_id").alias("reports_touched"))
    top = users.orderBy(F.desc("views"), "user_email").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("views"), "user_email")).cast("long"))


def monthly_rollup(usage: DataFrame) -> DataFrame:
    """Rows summed to the fact's grain; rows without views are left out."""
    grain = [c for c in GRAIN if c in usage.columns]
    return usage.where(F.col("view_count") > 0).groupBy(*grain).agg(F.sum("view_count").cast("int").alias("view_count"))


def identity_tallies(usage: DataFrame, by: str = "report_name") -> DataFrame:
    """Rows by the kind of the user's identity, for each report and in all (null), with the share of those that are e-mail addresses in percent."""
    kind = identity_kind(F.col("user_email"))
    n = lambda k: F.count_if(kind == k).alias(k)
    return usage.rollup(by).agg(F.count(F.lit(1)).alias("rows"), *(n(k) for k in ("email", "guid", "opaque", "empty")), F.round(100 * F.count_if(kind == "email") / F.count(F.lit(1)), 1).alias("email_percent"))


def relabelled(usage: DataFrame, people: DataFrame) -> DataFrame:
    """Users by id get the address and name of `people` (guid, email, name); others stay. Precedence: address, id, key as it was."""
    from orrery.functions.names import guid

    own = people.select(guid(F.col("guid")).alias("_guid"), "email", "name").dropDuplicates(["_guid"])
    joined = usage.withColumn("_guid", guid(F.col("user_email"))).join(own, "_guid", "left")
    return joined.withColumn("user_email", F.coalesce(F.nullif(F.col("email"), F.lit("")), "user_email")).withColumn("user_display_name", F.coalesce(F.nullif(F.col("name"), F.lit("")), "user_display_name")).drop("_guid", "email", "name")

