"""The star tables as a catalogue: suppliers are models, parts are measures, orders, customers and nations are visuals, pages and reports,
regions are workspaces and events are usage. The same projection stands below as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.names import measure_key
from orrery.storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event; days stand for months, since events cover one month."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("report_key"), F.col("n_name").alias("report_name"), F.col("n_regionkey"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("workspace_name"))
    reports = F.broadcast(nation.join(F.broadcast(region), "n_regionkey"))
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("month"), (F.col("user_id") % 25).alias("report_key"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("user_email"), F.col("event_type").alias("platform"), F.lit(1).alias("view_count"))
    return events.join(reports, "report_key").select("month", "workspace_name", F.col("report_key").cast("string").alias("report_id"), "report_name", "user_email", "platform", "view_count")


USAGE_SQL = """usage AS (
  SELECT CAST(e.ts AS DATE) AS month, r.r_name AS workspace_name, CAST(e.user_id % 25 AS VARCHAR) AS report_id, n.n_name AS report_name,
         'user' || e.user_id || '@example.org' AS user_email, e.event_type AS platform, 1 AS view_count
  FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25 JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.col("p_name")
    return part.select(
        F.col("p_partkey").cast("string").alias("item_id"), name.alias("item_name"), F.lit("PB_MEASURE").alias("item_type"), F.col("p_brand").alias("dataset_id"), F.col("p_brand").alias("dataset_name"),
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_type")).alias("expression"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("description"),
        F.concat(F.lit("ws"), (F.col("p_size") % 4).cast("string")).alias("workspace_name"), F.concat(F.lit("ws"), (F.col("p_size") % 4).cast("string")).alias("workspace_id"), F.col("p_type").alias("table_name"), (F.col("p_size") % 7 == 0).alias("is_unused"),
        measure_key(F.lit(None).cast("long"), F.lit("PB_MEASURE"), name).alias("group_id"), F.col("p_size").alias("connected_visuals"), F.lit(None).cast("string").alias("custom_description"), F.lit(False).alias("deleted"),
    )


MEASURES_SQL = """measures AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name, 'PB_MEASURE' AS item_type, p_brand AS dataset_id, p_brand AS dataset_name,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS expression, CASE WHEN p_size % 3 <> 0 THEN 'size ' || p_size END AS description,
         'ws' || (p_size % 4) AS workspace_name, 'ws' || (p_size % 4) AS workspace_id, p_type AS table_name, p_size % 7 = 0 AS is_unused,
         '0::' || lower(trim(p_name)) AS group_id, p_size AS connected_visuals, NULL::VARCHAR AS custom_description, FALSE AS deleted
  FROM part)"""
#: The order of a measure group's instances.
ORDER_SQL = """CASE WHEN trim(expression) = '' OR regexp_matches(lower(expression || ' ' || coalesce(description, '')), 'external\\s*measure') THEN 1 ELSE 0 END,
  CASE WHEN workspace_name LIKE '%finance%' THEN 0 ELSE 4 END, coalesce(dataset_name, ''), item_id"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target and their types, distinct: model to measure to visual to page to report.

    Pairs of lines are dealt before they are made distinct: nearly all differ, so that a scan's own hash table would hold the rows of a whole split.
    """
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    pair = lambda df, a, ka, b, kb: df.select(F.concat(F.lit(f"{ka}::"), F.col(a).cast("string")).alias("source"), F.concat(F.lit(f"{kb}::"), F.col(b).cast("string")).alias("target"))
    lines = line.count()
    distinct = lambda a, b: spread(line.select(a, b), lines, a, b).distinct()
    out = pair(distinct("l_suppkey", "l_partkey"), "l_suppkey", "DBT_MODEL", "l_partkey", "PB_MEASURE")
    out = out.unionByName(pair(distinct("l_partkey", "l_orderkey"), "l_partkey", "PB_MEASURE", "l_orderkey", "PB_VISUAL"))
    out = out.unionByName(pair(orders, "o_orderkey", "PB_VISUAL", "o_custkey", "PB_PAGE"))
    return out.unionByName(pair(customer, "c_custkey", "PB_PAGE", "c_nationkey", "PB_REPORT"))


EDGES_SQL = """edges AS (
  SELECT DISTINCT 'DBT_MODEL::' || l_suppkey AS source, 'PB_MEASURE::' || l_partkey AS target FROM lineitem
  UNION SELECT DISTINCT 'PB_MEASURE::' || l_partkey, 'PB_VISUAL::' || l_orderkey FROM lineitem
  UNION SELECT 'PB_VISUAL::' || o_orderkey, 'PB_PAGE::' || o_custkey FROM orders
  UNION SELECT 'PB_PAGE::' || c_custkey, 'PB_REPORT::' || c_nationkey FROM customer)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(t: str, key: str, name: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, t).select(F.concat(F.lit(f"{kind}::"), F.col(key).cast("string")).alias("node_id"), F.col(name).cast("string").alias("name"), F.lit(kind).alias("group"))

    return (
        one("supplier", "s_suppkey", "s_name", "DBT_MODEL").unionByName(one("part", "p_partkey", "p_name", "PB_MEASURE")).unionByName(one("orders", "o_orderkey", "o_orderkey", "PB_VISUAL"))
        .unionByName(one("customer", "c_custkey", "c_name", "PB_PAGE")).unionByName(one("nation", "n_nationkey", "n_name", "PB_REPORT"))
    )


NODES_SQL = """nodes AS (
  SELECT 'DBT_MODEL::' || s_suppkey AS node_id, s_name AS name, 'DBT_MODEL' AS "group" FROM supplier
  UNION ALL SELECT 'PB_MEASURE::' || p_partkey, p_name, 'PB_MEASURE' FROM part
  UNION ALL SELECT 'PB_VISUAL::' || o_orderkey, CAST(o_orderkey AS VARCHAR), 'PB_VISUAL' FROM orders
  UNION ALL SELECT 'PB_PAGE::' || c_custkey, c_name, 'PB_PAGE' FROM customer
  UNION ALL SELECT 'PB_REPORT::' || n_nationkey, n_name, 'PB_REPORT' FROM nation)"""


def measure_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each measure and report that it feeds, by the orders of its lines; measures without one have a null report.

    Lines are reduced to distinct pairs before each join, so the second and third joins carry pairs, not lines.
    """
    line, orders, customer, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    of_customer = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("report"))
    of_order = orders.join(of_customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "report")
    pairs = line.select("l_partkey", "l_orderkey").join(of_order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").cast("string").alias("item_id"), "report").distinct()
    return measures(spark, sf_dir).select("group_id", "item_id", F.col("connected_visuals").alias("visuals"), "dataset_id").join(pairs, "item_id", "left")


MEASURE_REPORTS_SQL = f"""{MEASURES_SQL}, fed AS (
  SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS item_id, n_name AS report FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
measure_reports AS (
  SELECT m.group_id, m.item_id, m.connected_visuals AS visuals, m.dataset_id, f.report FROM measures m LEFT JOIN fed f ON f.item_id = m.item_id)"""
