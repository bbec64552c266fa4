"""Usage collection from both schemas of the usage datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.names import blank_to_null, guid, month_of


def modern(views: DataFrame, users: DataFrame, names: DataFrame, since: str) -> DataFrame:
    """Facts (report, date, user_key, consumption, distribution, views) by month, with users looked up by key (user_key, guid, email) and display names (email, display_name).

    A user is its address, else its id in upper case, else its key. Rows before `since` or without views are left out.
    """
    joined = views.where((F.col("date") >= since) & (F.col("views") > 0)).join(users.dropDuplicates(["user_key"]), "user_key", "left")
    user = F.coalesce(blank_to_null(F.col("email")), blank_to_null(guid(F.col("guid"))), F.col("user_key").cast("string"))
    joined = joined.withColumn("user_email", user).join(names.select(F.col("email").alias("user_email"), "display_name").dropDuplicates(["user_email"]), "user_email", "left")
    return joined.groupBy(month_of(F.col("date")).alias("month"), F.col("report").alias("report_name"), "user_email", F.col("display_name").alias("user_display_name"), F.col("consumption").alias("platform"), F.col("distribution").alias("distribution_method")).agg(F.sum("views").cast("int").alias("view_count"))


def legacy(views: DataFrame, reports: DataFrame, users: DataFrame, since: str) -> DataFrame:
    """Facts that are aggregated already (report_guid, date, user_guid, platform, distribution, views), with two lookups."""
    joined = views.where((F.col("date") >= since) & (F.col("views") > 0)).withColumn("_r", guid(F.col("report_guid"))).withColumn("_u", guid(F.col("user_guid")))
    joined = joined.join(reports.select(guid(F.col("report_guid")).alias("_r"), "report_name").dropDuplicates(["_r"]), "_r", "left").join(users.select(guid(F.col("user_guid")).alias("_u"), "email", "display_name").dropDuplicates(["_u"]), "_u", "left")
    user = F.coalesce(blank_to_null(F.col("email")), F.col("_u"))
    return joined.groupBy(month_of(F.col("date")).alias("month"), F.coalesce("report_name", "_r").alias("report_name"), user.alias("user_email"), F.col("display_name").alias("user_display_name"), "platform", F.col("distribution").alias("distribution_method")).agg(F.sum("views").cast("int").alias("view_count"))


def first_with_rows(candidates: Sequence[DataFrame], by: str) -> DataFrame:
    """Of candidates in order of preference, for each key the rows of the first that has any, so nothing is counted twice."""
    done = candidates[0]
    for c in candidates[1:]:
        done = done.unionByName(c.join(done.select(by).distinct(), by, "left_anti").select(*done.columns))
    return done


def datasets_in_order(names: Column) -> Column:
    """The preference among usage datasets: the modern one first."""
    low = F.lower(names)
    return F.when(low.contains("report usage metrics model"), 0).when(low.contains("usage metrics"), 1).otherwise(2)
