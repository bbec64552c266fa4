"""Relationships of semantic models: index, join paths and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.storage import few, stored

MOST_HOPS = 5


def indexed(relationships: DataFrame) -> DataFrame:
    """relationships_json for each (dataset_id, table, column): every relationship from both of its ends, once.

    Takes (dataset_id, from_table, from_column, to_table, to_column, from_cardinality, to_cardinality, cross_filter, is_active).
    """

    def side(role: str, this: str, other: str) -> DataFrame:
        pick = {"this_table": f"{this}_table", "this_column": f"{this}_column", "other_table": f"{other}_table", "other_column": f"{other}_column", "cardinality": f"{this}_cardinality", "other_cardinality": f"{other}_cardinality"}
        return relationships.select("dataset_id", F.lit(role).alias("role"), *(F.col(c).alias(n) for n, c in pick.items()), "cross_filter", "is_active")

    rows = side("from", "from", "to").unionByName(side("to", "to", "from")).distinct()
    entry = F.struct("role", "this_table", "this_column", "other_table", "other_column", "cardinality", "other_cardinality", "cross_filter", "is_active")
    return rows.groupBy("dataset_id", F.col("this_table").alias("table_name"), F.col("this_column").alias("column_name")).agg(F.array_sort(F.collect_list(entry)).alias("relationships_json"))


def paths(relationships: DataFrame, dataset_id: str, start: str, end: str, hops: int = MOST_HOPS) -> DataFrame:
    """(path, cardinalities, inactive_hops, hops): the shortest join path from one table to another in a dataset, in either
    direction of relationships; of several that with the fewest inactive hops, then the first in the order of paths. Tables do not
    repeat on it. The same table: a path of no hops.
    """
    spark = relationships.sparkSession
    own = relationships.where(F.col("dataset_id") == dataset_id)
    arrow = lambda a, b: F.concat(F.substring(F.col(f"{a}_cardinality"), 1, 1), F.lit(":"), F.substring(F.col(f"{b}_cardinality"), 1, 1))
    step = lambda a, b: own.select(F.lower(f"{a}_table").alias("at"), F.lower(f"{b}_table").alias("next"), arrow(a, b).alias("card"), "is_active")
    steps = step("from", "to").unionByName(step("to", "from")).where("at <> next").groupBy("at", "next").agg(F.max(F.struct("is_active", "card")).alias("s")).select("at", "next", "s.*")
    steps = few(stored(steps))
    grown = spark.createDataFrame([([start.lower()], [], 0)], "path array<string>, cardinalities array<string>, inactive_hops int")
    for n in range(hops + 1):
        there = grown.where(F.element_at("path", -1) == end.lower())
        if not there.isEmpty():
            return there.select("*", F.lit(n).alias("hops")).orderBy("path")
        longer = grown.withColumn("at", F.element_at("path", -1)).join(steps, "at").where(~F.array_contains("path", F.col("next")))
        # Of all paths to one table only the first by order can begin the first shortest path.
        longer = longer.select(F.concat("path", F.array("next")).alias("path"), F.concat("cardinalities", F.array("card")).alias("cardinalities"), (F.col("inactive_hops") + F.when(F.col("is_active"), 0).otherwise(1)).alias("inactive_hops"))
        grown = stored(longer.groupBy(F.element_at("path", -1).alias("last")).agg(F.min_by(F.struct("path", "cardinalities", "inactive_hops"), F.struct(F.col("inactive_hops"), F.col("path"))).alias("p")).select("p.*"))
        if grown.isEmpty():
            break
    return spark.createDataFrame([], "path array<string>, cardinalities array<string>, inactive_hops int, hops int")


def verdict(found: DataFrame) -> DataFrame:
    """status: OK, INACTIVE (some hop must be activated), REFUSED (no path) or AMBIGUOUS (several shortest paths)."""
    return found.agg(
        F.when(F.count(F.lit(1)) == 0, "REFUSED").when(F.count(F.lit(1)) > 1, "AMBIGUOUS").when(F.max("inactive_hops") > 0, "INACTIVE").otherwise("OK").alias("status")
    )
