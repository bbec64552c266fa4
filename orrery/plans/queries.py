"""Queries over the star tables, each with SQL for the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import extract, names, rules
from orrery.operators import bridge, catalog, governance, graph, groups, load
from orrery.operators import usage as use
from orrery.plans import starmap as star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CASE_SQL = """CASE WHEN st IN ('PB_VISUAL','PB_PAGE','PB_REPORT') OR tt IN ('PB_VISUAL','PB_PAGE','PB_REPORT') THEN 'model'
  WHEN st IN ('DBT_MODEL','DBT_SEED','DBT_SOURCE','PB_TABLE') AND tt IN ('DBT_COLUMN','PB_COLUMN','PB_FIELD','PB_MEASURE') THEN 'contains'
  WHEN st IN ('DBT_COLUMN','PB_COLUMN','PB_FIELD','PB_MEASURE') OR tt IN ('DBT_COLUMN','PB_COLUMN','PB_FIELD','PB_MEASURE') THEN 'column' ELSE 'model' END"""
LEVEL_SQL = """CASE WHEN st IN ('PB_VISUAL','PB_PAGE','PB_REPORT') OR tt IN ('PB_VISUAL','PB_PAGE','PB_REPORT') THEN 'asset'
  WHEN st IN ('DBT_MODEL','DBT_SEED','DBT_SOURCE','PB_TABLE') AND tt = 'PB_MEASURE' THEN 'both'
  WHEN st IN ('DBT_MODEL','DBT_SEED','DBT_SOURCE','PB_TABLE') AND tt IN ('DBT_COLUMN','PB_COLUMN','PB_FIELD') THEN 'column'
  WHEN (st = 'PB_FIELD' AND tt = 'PB_MEASURE') OR (st = 'PB_MEASURE' AND tt = 'PB_FIELD') THEN 'both'
  WHEN st IN ('DBT_COLUMN','PB_COLUMN','PB_FIELD','PB_MEASURE') OR tt IN ('DBT_COLUMN','PB_COLUMN','PB_FIELD','PB_MEASURE') THEN 'column' ELSE 'asset' END"""


def query(sql: str | None = None):
    """Registers a query by its function's name, which no other one may have."""

    def register(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Usage


@query(f"WITH {star.USAGE_SQL} SELECT month, workspace_name, report_name, platform, CAST(sum(view_count) AS BIGINT) AS views, count(DISTINCT user_email) AS users FROM usage GROUP BY ALL")
def usage_pivot_default(spark, d):
    return use.usage_pivot(star.usage(spark, d), default=("month", "workspace_name", "report_name", "platform"))


@query(f"WITH {star.USAGE_SQL} SELECT platform, report_name, CAST(sum(view_count) AS BIGINT) AS views, count(DISTINCT user_email) AS users FROM usage GROUP BY ALL ORDER BY views DESC, platform, report_name LIMIT 40")
def usage_pivot_whitelist(spark, d):
    return use.usage_pivot(star.usage(spark, d), "platform,password,report_name,platform", limit=40)


@query(f"""WITH {star.USAGE_SQL} SELECT month, CAST(sum(view_count) AS BIGINT) AS views, count(DISTINCT user_email) AS users FROM usage WHERE month BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY month""")
def usage_pivot_filtered(spark, d):
    return use.usage_pivot(star.usage(spark, d), "month", month_from=date(2024, 1, 10), month_to=date(2024, 1, 20))


@query(f"""WITH {star.USAGE_SQL} SELECT report_name, platform, CAST(grouping(report_name, platform) AS INTEGER) AS level, CAST(sum(view_count) AS BIGINT) AS views, count(DISTINCT user_email) AS users FROM usage GROUP BY CUBE (report_name, platform)""")
def usage_pivot_totals(spark, d):
    return use.usage_totals(star.usage(spark, d), "report_name", "platform")


@query(f"""WITH {star.USAGE_SQL} SELECT workspace_name, CAST(sum(view_count) AS BIGINT) AS views, CAST(coalesce(sum(view_count) FILTER (WHERE month = (SELECT max(month) FROM usage)), 0) AS BIGINT) AS views_recent_month FROM usage GROUP BY workspace_name""")
def usage_filtered_totals(spark, d):
    return use.recent_totals(star.usage(spark, d), "workspace_name")


@query(f"""WITH {star.USAGE_SQL}, users AS (SELECT user_email, CAST(sum(view_count) AS BIGINT) AS views, count(DISTINCT report_id) AS reports_touched FROM usage GROUP BY user_email)
SELECT *, row_number() OVER (ORDER BY views DESC, user_email) AS rank FROM users ORDER BY rank LIMIT 100""")
def champions_leaderboard(spark, d):
    return use.leaderboard(star.usage(spark, d))


@query(f"""WITH {star.USAGE_SQL} SELECT month, workspace_name, report_id, report_name, user_email, platform, CAST(sum(view_count) AS INTEGER) AS view_count FROM usage GROUP BY ALL""")
def usage_rollup(spark, d):
    return use.monthly_rollup(star.usage(spark, d))


_IDENTITY = "CASE user_id % 4 WHEN 0 THEN 'user' || user_id || '@example.org' WHEN 1 THEN '0123abcd-0000-0000-0000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') WHEN 2 THEN 'u' || user_id ELSE '' END"


@query(f"""WITH i AS (SELECT event_type AS report_name, {_IDENTITY} AS u FROM events),
k AS (SELECT report_name, CASE WHEN u = '' THEN 'empty' WHEN contains(u, '@') THEN 'email' WHEN regexp_matches(u, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN 'guid' ELSE 'opaque' END AS kind FROM i)
SELECT report_name, count(*) AS rows, count(*) FILTER (WHERE kind = 'email') AS email, count(*) FILTER (WHERE kind = 'guid') AS guid, count(*) FILTER (WHERE kind = 'opaque') AS opaque, count(*) FILTER (WHERE kind = 'empty') AS empty,
       round(100 * count(*) FILTER (WHERE kind = 'email') / count(*), 1) AS email_percent FROM k GROUP BY ROLLUP (report_name)""")
def identity_tallies(spark, d):
    return use.identity_tallies(star.table(spark, d, "events").select(F.col("event_type").alias("report_name"), F.expr(_IDENTITY.replace("VARCHAR", "STRING")).alias("user_email")))


# Measure groups and coverage


@query(f"WITH {star.MEASURES_SQL} SELECT group_id, item_id, dataset_name, workspace_name FROM measures QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {star.ORDER_SQL}) = 1")
def measure_groups(spark, d):
    return groups.representatives(star.measures(spark, d)).select("group_id", "item_id", "dataset_name", "workspace_name")


def _surface_sql() -> str:
    first = lambda c: f"first({c} ORDER BY {star.ORDER_SQL}) FILTER (WHERE trim({c}) <> '') AS {c}"
    return f"WITH {star.MEASURES_SQL} SELECT group_id, {', '.join(first(c) for c in ('description', 'expression', 'table_name', 'dataset_name', 'workspace_name'))}, count(*) AS instances FROM measures GROUP BY group_id"


@query(_surface_sql())
def measure_group_surface(spark, d):
    return groups.surface(star.measures(spark, d))


@query(f"WITH {star.MEASURES_SQL} SELECT group_id, count(DISTINCT workspace_id) AS workspaces, count(DISTINCT dataset_id) AS datasets FROM measures GROUP BY group_id")
def measure_group_spans(spark, d):
    return groups.spans(star.measures(spark, d))


@query(f"""WITH {star.MEASURES_SQL}, g AS (SELECT group_id, first(is_unused ORDER BY {star.ORDER_SQL}) AS unused, bool_or(coalesce(trim(description), '') <> '') AS described, count(*) AS n FROM measures GROUP BY group_id)
SELECT count(*) AS groups, count(*) FILTER (WHERE unused) AS unused, count(*) FILTER (WHERE NOT described) AS undocumented, CAST(sum(n) AS BIGINT) AS instances FROM g""")
def dashboard(spark, d):
    return groups.dashboard(star.measures(spark, d))


_COVER = "cover AS (SELECT group_id, count(DISTINCT report) AS reports, CAST(max(coalesce(visuals, 0)) AS BIGINT) AS visuals, count(DISTINCT dataset_id) AS datasets FROM measure_reports GROUP BY group_id)"
_SPREAD = "CASE WHEN reports = 0 THEN '0' WHEN reports = 1 THEN '1' WHEN reports <= 4 THEN '2-4' WHEN reports <= 9 THEN '5-9' ELSE '10+' END"


@query(f"WITH {star.MEASURE_REPORTS_SQL}, {_COVER} SELECT *, {_SPREAD} AS spread FROM cover")
def coverage_overview(spark, d):
    return groups.coverage(star.measure_reports(spark, d))


@query(f"WITH {star.MEASURE_REPORTS_SQL}, {_COVER} SELECT {_SPREAD} AS spread, count(*) AS groups FROM cover GROUP BY ALL")
def coverage_spread(spark, d):
    return groups.spread(star.measure_reports(spark, d))


@query(f"WITH {star.MEASURE_REPORTS_SQL} SELECT report, count(DISTINCT group_id) AS measures FROM measure_reports WHERE report IS NOT NULL GROUP BY report")
def coverage_reports(spark, d):
    return groups.measures_by_report(star.measure_reports(spark, d))


@query(f"WITH {star.MEASURE_REPORTS_SQL} SELECT report, CAST(max(visuals) AS BIGINT) AS visuals, count(DISTINCT item_id) AS instances FROM measure_reports WHERE group_id = (SELECT min(group_id) FROM measures) AND report IS NOT NULL GROUP BY report")
def coverage_measure_mode(spark, d):
    group = star.measures(spark, d).agg(F.min("group_id")).first()[0]
    return groups.measure_usage(star.measure_reports(spark, d), group)


@query(f"WITH {star.MEASURE_REPORTS_SQL} SELECT group_id, CAST(max(visuals) AS BIGINT) AS visuals FROM measure_reports WHERE report = (SELECT min(n_name) FROM nation) GROUP BY group_id")
def coverage_report_mode(spark, d):
    report = star.table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return groups.report_usage(star.measure_reports(spark, d), report)


# Lists, counts and searches


@query(f"WITH {star.NODES_SQL} SELECT \"group\" AS item_type, count(*) AS items FROM nodes GROUP BY ALL")
def type_counts(spark, d):
    return catalog.type_counts(star.nodes(spark, d).withColumnRenamed("group", "item_type"))


@query(f"WITH {star.NODES_SQL} SELECT count(*) FILTER (WHERE \"group\" = 'PB_REPORT') AS reports, count(*) FILTER (WHERE \"group\" = 'PB_MEASURE') AS measures, count(*) FILTER (WHERE \"group\" = 'PB_TABLE') AS tables, count(*) FILTER (WHERE \"group\" = 'PB_COLUMN') AS columns, count(*) FILTER (WHERE \"group\" = 'DBT_MODEL') AS models FROM nodes")
def summary_counts(spark, d):
    return catalog.summary(star.nodes(spark, d).withColumnRenamed("group", "item_type").withColumn("deleted", F.lit(False)))


@query(f"""WITH {star.MEASURES_SQL} SELECT count(*) FILTER (WHERE is_unused) AS unused_measures, CAST(0 AS BIGINT) AS unused_columns, CAST(0 AS BIGINT) AS unused_tables, count(*) FILTER (WHERE coalesce(trim(description), '') = '') AS missing_docs,
count(*) FILTER (WHERE trim(expression) = '' OR regexp_matches(lower(expression || ' ' || coalesce(description, '')), 'external\\s*measure')) AS external_measures FROM measures WHERE workspace_id = 'ws1'""")
def cleanup_counts(spark, d):
    return catalog.cleanup_counts(star.measures(spark, d), workspace_id="ws1")


@query(f"WITH {star.MEASURES_SQL} SELECT item_id, item_name FROM measures WHERE coalesce(trim(description), '') = ''")
def undocumented_measures(spark, d):
    return catalog.undocumented(star.measures(spark, d), "PB_MEASURE").select("item_id", "item_name")


@query("SELECT 'DBT_MODEL::' || s_suppkey AS node_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def untested_models(spark, d):
    tests = star.table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.concat(F.lit("DBT_MODEL::"), F.col("l_suppkey").cast("string")).alias("source"), F.lit("DBT_TEST::1").alias("target")).distinct()
    return graph.untested(tests, star.nodes(spark, d).where("group = 'DBT_MODEL'").select("node_id"))


@query(f"WITH {star.MEASURES_SQL} SELECT item_id, item_name, connected_visuals FROM measures ORDER BY connected_visuals DESC, item_name, item_id LIMIT 15")
def top_by_visuals(spark, d):
    return catalog.top(star.measures(spark, d), "connected_visuals").select("item_id", "item_name", "connected_visuals")


@query(f"WITH {star.EDGES_SQL} SELECT source, count(DISTINCT target) AS targets FROM edges WHERE source LIKE 'DBT_MODEL::%' GROUP BY source ORDER BY targets DESC, source LIMIT 15")
def top_by_fanout(spark, d):
    return graph.fan_out(star.edges(spark, d), "DBT_MODEL")


@query(f"WITH {star.MEASURES_SQL} SELECT item_id, item_name, workspace_name FROM measures WHERE workspace_id = 'ws2' ORDER BY item_name DESC, item_id LIMIT 50 OFFSET 50")
def items_page(spark, d):
    own = catalog.filtered(star.measures(spark, d), {"workspace_id": "ws2", "password": "x", "dataset_id": ""})
    return catalog.page(own, "-item_name", 2).select("item_id", "item_name", "workspace_name")


@query(f"WITH {star.MEASURES_SQL} SELECT item_id, item_name FROM measures WHERE contains(lower(item_name), 're') OR contains(lower(description), 're')")
def items_search(spark, d):
    return star.measures(spark, d).where(catalog.any_contains(("item_name", "description"), "RE")).select("item_id", "item_name")


@query(f"WITH {star.MEASURES_SQL} SELECT item_id, item_name FROM measures WHERE regexp_matches(lower(item_name), '^[a-m].*e')")
def items_regex(spark, d):
    return catalog.by_text(star.measures(spark, d), "^[A-M].*e", "regex").select("item_id", "item_name")


@query(f"WITH {star.MEASURES_SQL} SELECT DISTINCT dataset_id, dataset_name FROM measures WHERE workspace_id = 'ws3'")
def filters_cascade(spark, d):
    return catalog.cascade(star.measures(spark, d), workspace="ws3")["datasets"]


@query("""WITH hits AS (SELECT c_custkey, c_name, CASE WHEN CAST(c_custkey AS VARCHAR) = 'customer#000000017' THEN 0 WHEN lower(trim(c_name)) = 'customer#000000017' THEN 1 WHEN contains(lower(c_name), 'customer#000000017') THEN 2 END AS stage FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS item_id, c_name AS item_name, stage FROM hits WHERE stage = (SELECT min(stage) FROM hits) ORDER BY lower(c_name), item_id LIMIT 25""")
def staged_lookup(spark, d):
    people = star.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), F.col("c_name").alias("item_name"))
    return catalog.staged_lookup(people, "customer#000000017")


@query("""WITH h AS (SELECT o_custkey, count(*) AS visuals, count(DISTINCT o_orderpriority) AS pages FROM orders GROUP BY o_custkey)
SELECT o_custkey AS report, visuals + pages AS complexity, CAST(visuals AS DOUBLE) / CASE WHEN pages = 0 THEN 1 ELSE pages END AS ratio, CASE WHEN visuals / pages > 20 THEN 'Complex' WHEN visuals / pages > 10 THEN 'Moderate' ELSE 'Healthy' END AS band FROM h""")
def report_health(spark, d):
    own = star.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("report")).agg(F.count(F.lit(1)).alias("visuals"), F.countDistinct("o_orderpriority").alias("pages"))
    ratio = rules.visuals_per_page(F.col("visuals"), F.col("pages"))
    return own.select("report", rules.complexity(F.col("visuals"), F.col("pages")).alias("complexity"), ratio.alias("ratio"), rules.health_band(ratio).alias("band"))


# The graph

_TYPES = ", ".join(f"('{t}')" for t in rules.ALL_TYPES)


@query(f"SELECT a.t AS st, b.t AS tt, {CASE_SQL.replace('st ', 'a.t ').replace('tt ', 'b.t ')} AS kind, {LEVEL_SQL.replace('st ', 'a.t ').replace('tt ', 'b.t ')} AS level FROM (VALUES {_TYPES}) a(t), (VALUES {_TYPES}) b(t)")
def edge_types(spark, d):
    types = spark.createDataFrame([(a, b) for a in rules.ALL_TYPES for b in rules.ALL_TYPES], "st string, tt string")
    return types.select("st", "tt", rules.edge_kind(F.col("st"), F.col("tt")).alias("kind"), rules.edge_level(F.col("st"), F.col("tt")).alias("level"))


@query(f"WITH {star.EDGES_SQL}, t AS (SELECT source, target, split_part(source, '::', 1) AS st, split_part(target, '::', 1) AS tt FROM edges) SELECT {CASE_SQL} AS kind, {LEVEL_SQL} AS level, count(*) AS edges FROM t GROUP BY ALL")
def edge_classify(spark, d):
    typed = star.edges(spark, d).withColumn("kind", F.lit(None).cast("string"))
    return graph.reclassified(typed).groupBy("kind", "level").agg(F.count(F.lit(1)).alias("edges"))


def _staged(spark, d) -> DataFrame:
    """The edges as staged rows: ends by name, id and type."""
    end = lambda c: [F.col(c), names.id_of_node(F.col(c)).alias(f"{c}_id"), names.type_of_node(F.col(c)).alias(f"{c}_type")]
    return star.edges(spark, d).select(*end("source"), *end("target"))


@query(f"WITH {star.EDGES_SQL} SELECT node_id, node_id AS name, split_part(node_id, '::', 1) AS \"group\" FROM (SELECT source AS node_id FROM edges UNION SELECT target FROM edges)")
def graph_nodes_union(spark, d):
    return graph.nodes_of(_staged(spark, d))


@query(f"""WITH {star.EDGES_SQL}, {star.NODES_SQL}
SELECT 'nodes ' || "group" AS metric, count(*) AS value FROM nodes GROUP BY "group" UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'repeated ids', count(*) FROM (SELECT node_id FROM nodes GROUP BY node_id HAVING count(*) > 1)
UNION ALL SELECT 'ends without node', count(*) FROM (SELECT source AS n FROM edges UNION SELECT target FROM edges) WHERE n NOT IN (SELECT node_id FROM nodes)""")
def graph_health(spark, d):
    return graph.health(star.nodes(spark, d), star.edges(spark, d))


@query(f'WITH {star.NODES_SQL} SELECT name, count(*) AS nodes FROM nodes GROUP BY name HAVING count(*) > 1 ORDER BY nodes DESC, name LIMIT 10')
def graph_shared_names(spark, d):
    return graph.shared_names(star.nodes(spark, d))


def _walk(start: str, this: str, other: str) -> str:
    return f"""WITH RECURSIVE {star.EDGES_SQL}, walk AS (SELECT {start} AS node_id, 0 AS distance UNION SELECT e.{other}, w.distance + 1 FROM walk w JOIN edges e ON e.{this} = w.node_id WHERE w.distance < 15)
SELECT node_id, min(distance) AS distance FROM walk GROUP BY node_id"""


def _start(spark, d, kind: str, table: str, key: str) -> DataFrame:
    return star.table(spark, d, table).agg(F.min(key).alias("k")).select(F.concat(F.lit(f"{kind}::"), F.col("k").cast("string")).alias("node_id"))


@query(_walk("(SELECT 'PB_MEASURE::' || min(l_partkey) FROM lineitem)", "source", "target"))
def reachable_down(spark, d):
    return graph.reachable(star.edges(spark, d), _start(spark, d, "PB_MEASURE", "lineitem", "l_partkey"))


@query(_walk("(SELECT 'PB_PAGE::' || min(o_custkey) FROM orders)", "target", "source"))
def reachable_up(spark, d):
    return graph.reachable(star.edges(spark, d), _start(spark, d, "PB_PAGE", "orders", "o_custkey"), "up")


@query(f"""WITH {star.EDGES_SQL}, s AS (SELECT 'PB_MEASURE::' || min(l_partkey) AS n FROM lineitem),
down AS (SELECT e.target AS node_id, 1 AS distance FROM edges e, s WHERE e.source = s.n UNION SELECT e2.target, 2 FROM edges e JOIN edges e2 ON e2.source = e.target, s WHERE e.source = s.n),
up AS (SELECT e.source AS node_id, 1 AS distance FROM edges e, s WHERE e.target = s.n UNION SELECT e2.source, 2 FROM edges e JOIN edges e2 ON e2.target = e.source, s WHERE e.target = s.n)
SELECT node_id, min(distance) AS distance FROM (SELECT n AS node_id, 0 AS distance FROM s UNION ALL SELECT * FROM down UNION ALL SELECT * FROM up) GROUP BY node_id""")
def ego_asset_depth2(spark, d):
    own = graph.reclassified(star.edges(spark, d).withColumn("kind", F.lit(None).cast("string")))
    return graph.ego(own, _start(spark, d, "PB_MEASURE", "lineitem", "l_partkey"))[0]


@query(f"""WITH {star.EDGES_SQL}, p AS (
  SELECT [a.source, a.target, b.target, c.target, e.target] AS path FROM edges a JOIN edges b ON b.source = a.target JOIN edges c ON c.source = b.target JOIN edges e ON e.source = c.target
  WHERE a.source = (SELECT 'DBT_MODEL::' || min(s_suppkey) FROM supplier) AND e.target = (SELECT 'PB_REPORT::' || min(c_nationkey) FROM customer))
SELECT array_to_string(path, '>') AS path, 4 AS hops FROM p ORDER BY p.path LIMIT 50""")
def shortest_paths(spark, d):
    source = _start(spark, d, "DBT_MODEL", "supplier", "s_suppkey").first()[0]
    target = _start(spark, d, "PB_REPORT", "customer", "c_nationkey").first()[0]
    return graph.shortest_paths(star.edges(spark, d), source, target).select(F.array_join("path", ">").alias("path"), "hops")


_REACHED = """c4 AS (SELECT c_custkey, c_nationkey FROM customer), c3 AS (SELECT o_orderkey, c_nationkey FROM orders JOIN c4 ON o_custkey = c_custkey), c2 AS (SELECT DISTINCT l_partkey, c_nationkey FROM lineitem JOIN c3 ON l_orderkey = o_orderkey),
c1 AS (SELECT DISTINCT l_suppkey, c_nationkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN c2 USING (l_partkey)),
pairs AS (SELECT 'PB_PAGE::' || c_custkey AS node_id, c_nationkey FROM c4 UNION SELECT 'PB_VISUAL::' || o_orderkey, c_nationkey FROM c3 UNION SELECT 'PB_MEASURE::' || l_partkey, c_nationkey FROM c2 UNION SELECT 'DBT_MODEL::' || l_suppkey, c_nationkey FROM c1)"""


@query(f"WITH {_REACHED} SELECT node_id, 'PB_REPORT' AS \"group\", count(DISTINCT n_name) AS names, count(DISTINCT c_nationkey) AS ids FROM pairs JOIN nation ON n_nationkey = c_nationkey GROUP BY node_id")
def downstream_counts(spark, d):
    return graph.downstream_counts(star.edges(spark, d), star.nodes(spark, d), ["PB_REPORT"])


_WALK = "walk AS (SELECT source AS node_id, target AS reached FROM edges UNION SELECT w.node_id, e.target FROM walk w JOIN edges e ON e.source = w.reached)"
_COUNTS = 'SELECT node_id, "group", count(DISTINCT name) AS names, count(DISTINCT reached) AS ids FROM walk JOIN nodes USING (reached) GROUP BY ALL'


@query(f"WITH RECURSIVE {star.EDGES_SQL}, {star.NODES_SQL.replace('AS node_id', 'AS reached')}, {_WALK} {_COUNTS}")
def downstream_counts_by_type(spark, d):
    return graph.downstream_counts(star.edges(spark, d), star.nodes(spark, d), ["DBT_MODEL", "PB_MEASURE", "PB_VISUAL", "PB_PAGE", "PB_REPORT"])


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_partkey % 8 AS m FROM part), hops AS (
  SELECT k, k + 1 AS t FROM p WHERE m <> 7 UNION ALL SELECT k, k + 2 FROM p WHERE m < 6 UNION ALL SELECT k, k - 3 FROM p WHERE m = 5 AND k % 16 < 8 UNION ALL SELECT k, k FROM p WHERE m = 6 AND k % 24 < 8),
edges AS (SELECT 'PB_MEASURE::' || k AS source, 'PB_MEASURE::' || t AS target FROM hops UNION ALL SELECT 'PB_MEASURE::' || k, 'PB_REPORT::' || (k % 25) FROM p WHERE m = 7),
{star.NODES_SQL.replace('AS node_id', 'AS reached')}, {_WALK} {_COUNTS}""")
def downstream_counts_through_cycles(spark, d):
    part = star.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 8).alias("m"))
    hop = lambda where, by: part.where(where).select(F.col("k"), (F.col("k") + by).alias("t"))
    hops = hop("m <> 7", 1).unionByName(hop("m < 6", 2)).unionByName(hop("m = 5 AND k % 16 < 8", -3)).unionByName(hop("m = 6 AND k % 24 < 8", 0))
    node = lambda kind, c: F.concat(F.lit(f"{kind}::"), c.cast("string"))
    edges = hops.select(node("PB_MEASURE", F.col("k")).alias("source"), node("PB_MEASURE", F.col("t")).alias("target"))
    edges = edges.unionByName(part.where("m = 7").select(node("PB_MEASURE", F.col("k")).alias("source"), node("PB_REPORT", F.col("k") % 25).alias("target")))
    return graph.downstream_counts(edges, star.nodes(spark, d), ["PB_MEASURE", "PB_REPORT"])


@query("SELECT 'PB_MEASURE::' || p_partkey AS node_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def unused_producers(spark, d):
    used = star.table(spark, d, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("PB_MEASURE::"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("PB_VISUAL::"), F.col("l_orderkey").cast("string")).alias("target")).distinct()
    return graph.unused(used, star.nodes(spark, d).where("group = 'PB_MEASURE'").select("node_id"), ["PB_VISUAL"])


@query(f"""WITH {star.EDGES_SQL}, {star.NODES_SQL}, a AS (SELECT DISTINCT source, target FROM edges WHERE source IN (SELECT node_id FROM nodes) AND target IN (SELECT node_id FROM nodes)),
l1 AS (SELECT node_id, CASE WHEN node_id IN (SELECT target FROM a) THEN NULL ELSE 0 END AS layer FROM nodes),
l AS (SELECT n.node_id, n."group", CASE n."group" WHEN 'DBT_MODEL' THEN 0 WHEN 'PB_MEASURE' THEN 1 WHEN 'PB_VISUAL' THEN 2 WHEN 'PB_PAGE' THEN 3 ELSE 4 END AS full_layer FROM nodes n),
m AS (SELECT node_id, CASE WHEN node_id IN (SELECT target FROM a) THEN 1 ELSE 0 END AS layer FROM l WHERE "group" IN ('DBT_MODEL', 'PB_MEASURE')),
v AS (SELECT l.node_id, coalesce(max(m.layer) + 1, 0) AS layer FROM l LEFT JOIN a ON a.target = l.node_id LEFT JOIN m ON m.node_id = a.source WHERE l."group" = 'PB_VISUAL' GROUP BY l.node_id),
p AS (SELECT l.node_id, coalesce(max(v.layer) + 1, 0) AS layer FROM l LEFT JOIN a ON a.target = l.node_id LEFT JOIN v ON v.node_id = a.source WHERE l."group" = 'PB_PAGE' GROUP BY l.node_id),
r AS (SELECT l.node_id, coalesce(max(p.layer) + 1, 0) AS layer FROM l LEFT JOIN a ON a.target = l.node_id LEFT JOIN p ON p.node_id = a.source WHERE l."group" = 'PB_REPORT' GROUP BY l.node_id)
SELECT node_id, CAST(layer AS INTEGER) AS layer FROM (SELECT * FROM m UNION ALL SELECT * FROM v UNION ALL SELECT * FROM p UNION ALL SELECT * FROM r)""")
def layering(spark, d):
    return graph.layers(star.edges(spark, d), star.nodes(spark, d))


@query(f"WITH {star.EDGES_SQL} SELECT a.target AS middle, CAST(count(*) AS BIGINT) AS hops FROM edges a JOIN edges b ON b.source = a.target WHERE split_part(a.source, '_', 1) <> split_part(b.target, '_', 1) GROUP BY a.target")
def two_hops_across(spark, d):
    return graph.two_hop_counts(star.edges(spark, d))


@query(f"WITH {star.EDGES_SQL} SELECT node_id, count(*) AS degree FROM (SELECT source AS node_id FROM edges UNION ALL SELECT target FROM edges) GROUP BY node_id HAVING count(*) > 30")
def hubs(spark, d):
    return graph.hubs(star.edges(spark, d), 30)


@query("SELECT r_name AS level_0, n_name AS level_1, count(*) AS leaves, CAST(2 - bit_count(grouping(r_name, n_name)) AS INTEGER) AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def tree_counts(spark, d):
    nation, region = F.broadcast(star.table(spark, d, "nation")), F.broadcast(star.table(spark, d, "region"))
    own = star.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return graph.tree(own, [F.col("r_name"), F.col("n_name")])


# Bridges

_KEYS = """models AS (SELECT s_suppkey AS id, regexp_extract(s_name, '[0-9]+') AS digits, 'wh.' || (s_suppkey % 3) || '.t' || CAST(regexp_extract(s_name, '[0-9]+') AS BIGINT) % 70 AS name FROM supplier),
tables AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'T' || CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) % 90 ELSE '"wh.' || (c_custkey % 3) || '.T' || CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) % 90 || '"' END AS name FROM customer),
m AS (SELECT id, lower(name) AS full_name, lower(split_part(name, '.', -1)) AS tail FROM models), t AS (SELECT id, lower(trim(name, '"')) AS name FROM tables)"""


def _bridge_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("long")
    none = F.lit(None).cast("string")
    models = star.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("item_id"), none.alias("database_name"), none.alias("schema_name"), none.alias("alias"), F.concat(F.lit("wh."), (F.col("s_suppkey") % 3).cast("string"), F.lit(".t"), (number("s_name") % 70).cast("string")).alias("table_name"))
    tail = (number("c_name") % 90).cast("string")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("T"), tail)).otherwise(F.concat(F.lit('"wh.'), (F.col("c_custkey") % 3).cast("string"), F.lit(".T"), tail, F.lit('"')))
    tables = star.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), name.alias("item_name"), none.alias("bq_project"), none.alias("bq_schema"), none.alias("bq_source_name"))
    return tables, models


@query(f"""WITH {_KEYS}, f AS (SELECT full_name, min(id) AS id FROM m GROUP BY full_name HAVING count(*) = 1), l AS (SELECT tail, min(id) AS id FROM m GROUP BY tail HAVING count(*) = 1)
SELECT CAST(t.id AS VARCHAR) AS pbi_item_id, CAST(coalesce(f.id, l.id) AS VARCHAR) AS dbt_item_id, CASE WHEN f.id IS NOT NULL THEN 'name_full' ELSE 'name_tail' END AS reason
FROM t LEFT JOIN f ON f.full_name = t.name LEFT JOIN l ON l.tail = t.name WHERE coalesce(f.id, l.id) IS NOT NULL""")
def bridge_tables(spark, d):
    return bridge.bridge_tables(*_bridge_sides(spark, d))


@query(f"""WITH {_KEYS} SELECT CAST(t.id AS VARCHAR) AS pbi_item_id, CAST(m.id AS VARCHAR) AS dbt_item_id, 'name_full' AS reason FROM t JOIN m ON m.full_name = t.name
UNION ALL SELECT CAST(t.id AS VARCHAR), CAST(m.id AS VARCHAR), 'name_tail' FROM t JOIN m ON m.tail = t.name WHERE m.full_name <> t.name""")
def bridge_preview(spark, d):
    return bridge.bridge_preview(*_bridge_sides(spark, d))


# Loads and governance


@query("""WITH old AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE lower(o_orderpriority) END AS o_orderpriority, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN o.o_orderpriority WHEN o.o_orderkey IS NULL THEN n.o_orderpriority ELSE coalesce(n.o_orderpriority, o.o_orderpriority) END AS o_orderpriority,
  CASE WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE n.o_totalprice END AS o_totalprice, o.o_orderstatus AS o_orderstatus FROM old o FULL JOIN new n ON n.o_orderkey = o.o_orderkey""")
def item_upsert(spark, d):
    orders = star.table(spark, d, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.lower("o_orderpriority")).alias("o_orderpriority"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return load.merged(old, new, ["o_orderkey"], {"o_orderpriority": load.COALESCE})


@query(f"WITH {star.MEASURES_SQL} SELECT item_id, (workspace_id = 'ws1' AND CAST(item_id AS BIGINT) % 3 = 0) AS deleted FROM measures")
def soft_delete(spark, d):
    own = star.measures(spark, d).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    present = own.where(F.col("item_id").cast("long") % 3 != 0).select("item_id").unionByName(spark.createDataFrame([(None,)], "item_id string"))
    return load.soft_deleted(own, present, F.col("workspace_id") == "ws1").select("item_id", "deleted")


@query(f"""WITH {star.USAGE_SQL}, old AS (SELECT *, NULL::BIGINT AS organization_id, 1 AS integration_source_id FROM usage WHERE platform <> 'click'), new AS (SELECT *, NULL::BIGINT AS organization_id, 1 AS integration_source_id FROM usage WHERE month >= DATE '2024-01-20')
SELECT month, count(*) AS rows FROM (SELECT * FROM old WHERE month NOT IN (SELECT month FROM new) UNION ALL SELECT * FROM new) GROUP BY month""")
def month_replace(spark, d):
    own = star.usage(spark, d).withColumn("organization_id", F.lit(None).cast("long")).withColumn("integration_source_id", F.lit(1))
    done = load.months_replaced(own.where("platform <> 'click'"), own.where(F.col("month") >= F.lit(date(2024, 1, 20))))
    return done.groupBy("month").agg(F.count(F.lit(1)).alias("rows"))


def _groups(spark, d) -> DataFrame:
    n = F.col("p_partkey")
    none = lambda t: F.lit(None).cast(t)
    return star.table(spark, d, "part").select(
        n.alias("id"), F.concat(F.lit("g"), n.cast("string")).alias("group_key"), F.lit("measure_name").alias("kind"), none("long").alias("organization_id"), none("long").alias("ownership_department_id"), (n % 5).alias("ownership_person_id"), F.when(n % 4 == 0, n % 7).alias("steward_id"), none("long").alias("category_id"),
        F.when(n % 6 == 0, "ATTENTION").otherwise("UNVERIFIED").alias("status"), none("string").alias("custom_description"), F.lit(False).alias("deleted"), none("timestamp").alias("deleted_at"), none("string").alias("primary_item_id"),
    )


_GROUPS = "g AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'ATTENTION' ELSE 'UNVERIFIED' END AS status, p_partkey % 5 AS owner, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 7 END AS steward FROM part)"


def _changes(spark, d) -> DataFrame:
    n = F.col("p_partkey")
    return star.table(spark, d, "part").where("p_partkey % 3 = 0").select(n.alias("id"), F.when(n % 2 == 0, "VERIFIED").alias("status"), F.when(n % 5 == 0, True).alias("deleted"))


_CHANGED = f"""{_GROUPS}, c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'VERIFIED' END AS status, CASE WHEN p_partkey % 5 = 0 THEN TRUE END AS deleted FROM part WHERE p_partkey % 3 = 0),
after AS (SELECT g.id, g.status AS old_status, CASE WHEN c.deleted THEN 'DELETED' ELSE coalesce(c.status, g.status) END AS status, coalesce(c.deleted, FALSE) AS deleted, owner, steward FROM g LEFT JOIN c ON c.id = g.id)"""


def _after(spark, d) -> DataFrame:
    return governance.changed(_groups(spark, d), _changes(spark, d), F.lit("2024-02-01").cast("timestamp"))


@query(f"WITH {_CHANGED} SELECT id, status, deleted FROM after")
def governance_change(spark, d):
    return _after(spark, d).select("id", "status", "deleted")


@query(f"WITH {_CHANGED} SELECT id AS group_id, old_status, status AS new_status FROM after WHERE status <> old_status")
def status_log(spark, d):
    return governance.status_log(_groups(spark, d), _after(spark, d), F.lit("2024-02-01").cast("timestamp")).select("group_id", "old_status", "new_status")


@query(f"WITH {_CHANGED} SELECT 'i' || id AS item_id, status, deleted FROM after")
def cascade(spark, d):
    items = _groups(spark, d).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("item_id"), F.col("id").alias("item_group_id"), "status", "deleted", "deleted_at")
    return governance.cascaded(items, _after(spark, d)).select("item_id", "status", "deleted")


@query(f"""WITH {_CHANGED}, tasks AS (SELECT p_partkey AS group_id, CASE WHEN p_partkey % 9 = 0 THEN 'done' ELSE 'open' END AS state FROM part WHERE p_partkey % 12 = 0), due AS (SELECT id AS group_id, status, coalesce(steward, owner) AS assignee_id FROM after WHERE status IN ('ATTENTION', 'DELETED'))
SELECT t.group_id, t.state, CASE WHEN t.state = 'open' AND d.group_id IS NOT NULL THEN d.status ELSE 'ATTENTION' END AS status, CASE WHEN t.state = 'open' AND d.group_id IS NOT NULL THEN d.assignee_id END AS assignee_id FROM tasks t LEFT JOIN due d ON d.group_id = t.group_id
UNION ALL SELECT group_id, 'open', status, assignee_id FROM due WHERE group_id NOT IN (SELECT group_id FROM tasks WHERE state = 'open')""")
def task_dedupe(spark, d):
    from orrery.schemas import TASKS

    n = F.col("p_partkey")
    own = {"id": n.cast("string"), "group_id": n, "state": F.when(n % 9 == 0, "done").otherwise("open"), "status": F.lit("ATTENTION")}
    tasks = star.table(spark, d, "part").where("p_partkey % 12 = 0").select(*((own[f.name] if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in TASKS))
    return governance.synced_tasks(tasks, _after(spark, d), F.lit("2024-02-01").cast("timestamp")).select("group_id", "state", "status", "assignee_id")


@query(f"""WITH {_GROUPS}, people AS (SELECT c_custkey AS id, lower(trim(c_mktsegment || ' ' || c_custkey % 40)) AS name FROM customer), own AS (SELECT name, min(id) AS id FROM people GROUP BY name HAVING count(*) = 1),
rows AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN upper(p_type) ELSE 'BUILDING ' || p_partkey % 60 END AS owner FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 4 = 0)
SELECT g.id, coalesce(o.id, g.owner) AS ownership_person_id FROM g LEFT JOIN rows r ON r.id = g.id LEFT JOIN own o ON o.name = lower(trim(r.owner))""")
def governance_import(spark, d):
    n, text = F.col("p_partkey"), F.lit("").cast("string")
    owner = F.when(n % 4 == 0, "").when(n % 4 == 1, F.upper("p_type")).otherwise(F.concat(F.lit("BUILDING "), (n % 60).cast("string")))
    fields = {"group_pk": n.cast("string"), "owner": owner}
    rows = star.table(spark, d, "part").where("p_partkey % 2 = 1 OR p_partkey % 4 = 0").select(*(fields.get(c, text).alias(c) for c in ("group_pk", "group_id", "status", "owner", "steward", "department", "category", "custom_description")))
    people = star.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 40).cast("string")).alias("name"), F.lit(None).cast("long").alias("organization_id"))
    return governance.imported(_groups(spark, d), rows, people, people.limit(0), people.limit(0))[0].select("id", "ownership_person_id")


# Names and extraction


@query("SELECT s_suppkey, md5(regexp_replace(lower(concat_ws('_', s_name, '', 'A \"b\"')), '[\\s''\"`]+', '', 'g')) AS with_blanks, md5(regexp_replace(lower(concat_ws('_', s_name, 'A \"b\"')), '[\\s''\"`]+', '', 'g')) AS without_blanks FROM supplier")
def custom_id(spark, d):
    parts = [F.col("s_name"), F.lit(""), F.lit('A "b"'), F.lit(None).cast("string")]
    return star.table(spark, d, "supplier").select("s_suppkey", names.custom_id(*parts).alias("with_blanks"), names.custom_id_skipping_blanks(*parts).alias("without_blanks"))


@query("SELECT p_partkey, lower(trim(trim(trim(trim('  `\"' || p_name || '\"` '), '`'), '\"'), '''')) AS bridge_name, regexp_replace(lower('  `\"' || p_name || '\"` '), '[\\s''\"`]+', '', 'g') AS relation_name FROM part")
def normalize_names(spark, d):
    messy = F.concat(F.lit('  `"'), F.col("p_name"), F.lit('"` '))
    return star.table(spark, d, "part").select("p_partkey", names.bridge_name(messy).alias("bridge_name"), names.relation_name(messy).alias("relation_name"))


@query("""SELECT page_id, list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(h, '"Property"\\s*:\\s*"([^"]+)"', 1), regexp_extract_all(h, '"Name"\\s*:\\s*"([^"]+)"', 1)), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^[0-9]+$')))) AS fields
FROM (SELECT page_id, '{"Property": "' || replace(url, '"', '') || '", "Name" : "' || page_id || '"}, {"Name":"ab"}' AS h FROM pages)""")
def field_extract(spark, d):
    config = F.concat(F.lit('{"Property": "'), F.replace("url", F.lit('"'), F.lit("")), F.lit('", "Name" : "'), F.col("page_id").cast("string"), F.lit('"}, {"Name":"ab"}'))
    return star.table(spark, d, "pages").select("page_id", extract.visual_fields(config).alias("fields"))


@query("SELECT doc_id, coalesce(len(regexp_extract_all(text, '\\[([^\\]]+)\\]', 1)), 0) AS tokens, coalesce(len(regexp_extract_all(text, '[a-zA-Z0-9_]+', 0)), 0) AS words FROM documents")
def bracket_tokens(spark, d):
    own = star.table(spark, d, "documents")
    return own.select("doc_id", F.size(extract.bracket_tokens(F.col("text"))).cast("long").alias("tokens"), F.size(extract.words(F.col("text"))).cast("long").alias("words"))


@query("SELECT event_type, CAST(props->>'k' AS INTEGER) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_properties(spark, d):
    k = F.from_json("props", "k int")["k"]
    return star.table(spark, d, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


# Artifacts


@query("""SELECT DISTINCT p_type AS table_name, 'measure' AS kind, p_name AS name, 'SUM([' || p_name || '])' AS expression, 'tag-' || p_name AS lineage_tag FROM part""")
def tmdl_parse(spark, d):
    from orrery.sources import tmdl

    block = F.concat(F.lit("\n\tmeasure '"), F.col("p_name"), F.lit("' = SUM(["), F.col("p_name"), F.lit("])\n\t\tlineageTag: tag-"), F.col("p_name"), F.lit("\n\t\tformatString: 0"))
    files = star.table(spark, d, "part").select("p_type", block.alias("block")).distinct().groupBy(F.col("p_type").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("block")), "\n").alias("blocks"))
    files = files.select("path", F.concat(F.lit("table '"), "path", F.lit("'\n"), "blocks").alias("content"))
    return tmdl.tmdl_blocks(files).select("table_name", "kind", "name", "expression", "lineage_tag")


@query("""SELECT * FROM (VALUES ('lineitem', 'l_extendedprice', 'revenue', 'amount', 'transformation'), ('lineitem', 'l_discount', 'revenue', 'amount', 'transformation'), ('orders', 'o_custkey', 'revenue', 'customer', 'rename'),
('lineitem', 'l_orderkey', 'revenue', 'l_orderkey', 'pass-through'), ('customer', 'c_name', 'ranked', 'c_name', 'pass-through'), ('revenue', 'amount', 'ranked', 'total', 'pass-through')) t(source, source_column, target, target_column, lineage_type)""")
def column_lineage(spark, d):
    from orrery.operators import column_lineage as lineage

    relations = {t: {f.name: f.dataType.simpleString() for f in star.table(spark, d, t).schema} for t in ("lineitem", "orders", "customer")}
    relations["revenue"] = {"l_orderkey": "bigint", "customer": "bigint", "amount": "double"}
    models = {
        "revenue": ("SELECT l_orderkey, o_custkey AS customer, l_extendedprice * (1 - l_discount) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey", None),
        "ranked": ("WITH t AS (SELECT customer, sum(amount) AS total FROM revenue GROUP BY customer) SELECT c.c_name, t.total FROM customer c JOIN t ON t.customer = c.c_custkey", None),
    }
    return lineage.project_lineage(spark, models, relations)[0]


def _generated_models(spark, d):
    """A model for each part: a chain of WITH of p_size % 5 more steps over its brand's table, then one of four ends, three of which read the model before. Some have a template or broken SQL first."""
    part = star.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 5).alias("n"), F.lower(F.translate("p_brand", "#", "_")).alias("brand"))
    link = lambda i: F.format_string(", c%d AS (SELECT a, b%d AS b%d, m%d + b%d AS m%d FROM c%d)", i, i - 1, i, i - 1, i - 1, i, i - 1)
    links = F.when(F.col("n") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), link), "")).otherwise("")
    before = F.concat(F.lit("wh.mart.m"), F.col("k") - 1)
    of = lambda text, *names: F.format_string(text, *names)
    end = (
        F.when(F.col("k") % 4 == 0, of("SELECT a AS key, b%d AS value, m%d AS total FROM c%d", "n", "n", "n"))
        .when(F.col("k") % 4 == 1, of("SELECT x.a AS key, x.b%d AS value, (SELECT MAX(total) FROM %s) AS total FROM c%d AS x WHERE x.a > 0", "n", before, "n"))
        .when(F.col("k") % 4 == 2, of("SELECT * FROM (SELECT a AS key, b%d AS value, m%d AS total FROM c%d) UNION ALL SELECT key, value, total FROM %s", "n", "n", "n", before))
        .otherwise(of("SELECT y.key, c.b%d AS value, CASE WHEN c.m%d > 1 THEN 0 ELSE y.value END AS total -- FROM c0\nFROM c%d c JOIN %s y ON y.key = c.a", "n", "n", "n", before))
    )
    sql = F.concat(of("WITH c0 AS (SELECT a, b AS b0, COALESCE(a, d) AS m0 FROM `wh`.`raw`.`%s`)", "brand"), links, F.lit(" "), end)
    texts = F.when(F.col("k") % 7 == 0, F.array(F.lit(None), F.lit("SELECT {{ macro() }} AS key FROM c0"))).when(F.col("k") % 11 == 0, F.array(F.lit("SELECT FROM WHERE ;;; not valid"), sql)).otherwise(F.array(sql))
    own = lambda relation, *columns: F.explode(F.array(*(F.struct(relation.alias("relation"), F.lit(c).alias("column"), F.lit(i).alias("place")) for i, c in enumerate(columns))))
    raw = part.select("brand").distinct().select(own(F.concat(F.lit("wh.raw."), "brand"), "a", "b", "d").alias("r")).select("r.*")
    mart = part.select(F.explode(F.array("k", F.col("k") - 1)).alias("k")).distinct().select(own(F.concat(F.lit("wh.mart.m"), "k"), "key", "value", "total").alias("r")).select("r.*")
    return part.select(F.concat(F.lit("wh.mart.m"), "k").alias("model"), texts.alias("texts")), raw.unionByName(mart)


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size % 5 AS n, p_partkey % 4 AS f, 'wh.raw.' || lower(replace(p_brand, '#', '_')) AS raw, 'wh.mart.m' || p_partkey AS me, 'wh.mart.m' || (p_partkey - 1) AS before FROM part WHERE p_partkey % 7 <> 0),
s AS (SELECT k, 0 AS i, v.col, v.base FROM p, (VALUES ('a', 'a'), ('b', 'b'), ('m', 'a'), ('m', 'd')) v(col, base)
  UNION SELECT s.k, s.i + 1, w.too, s.base FROM s JOIN p ON p.k = s.k JOIN (VALUES ('a', 'a'), ('b', 'b'), ('b', 'm'), ('m', 'm')) w(col, too) ON w.col = s.col WHERE s.i < p.n),
e AS (SELECT raw AS source, base AS source_column, me AS target, CASE col WHEN 'a' THEN 'key' WHEN 'b' THEN 'value' ELSE 'total' END AS target_column, f FROM s JOIN p ON p.k = s.k AND s.i = p.n WHERE NOT (f = 1 AND col = 'm') AND NOT (f = 3 AND col = 'a')
  UNION SELECT before, v.c, me, v.too, f FROM p JOIN (VALUES (1, 'total', 'total'), (2, 'key', 'key'), (2, 'value', 'value'), (2, 'total', 'total'), (3, 'key', 'key'), (3, 'value', 'total')) v(g, c, too) ON v.g = f)
SELECT source, source_column, target, target_column, CASE WHEN count(*) OVER (PARTITION BY target, target_column) > 1 OR target_column = 'total' THEN 'transformation' WHEN f = 3 AND target_column = 'key' THEN 'pass-through' ELSE 'rename' END AS lineage_type FROM e""")
def column_lineage_of_models(spark, d):
    from orrery.operators import column_lineage as lineage

    return lineage.lineage(*_generated_models(spark, d))[0]


@query("SELECT 'wh.mart.m' || p_partkey AS model, 'template' AS reason FROM part WHERE p_partkey % 7 = 0")
def column_lineage_skipped(spark, d):
    from orrery.operators import column_lineage as lineage

    return lineage.lineage(*_generated_models(spark, d))[1]


@query("""WITH RECURSIVE r AS (SELECT lower(p_brand) AS brand, lower(p_type) AS type, max(p_size) > 45 AS active FROM part GROUP BY ALL),
s AS (SELECT brand AS "at", type AS next, 'm:o' AS card, active FROM r UNION ALL SELECT type, brand, 'o:m', active FROM r),
w AS (SELECT ['brand#1'] AS p, CAST([] AS VARCHAR[]) AS c, 0 AS inactive, 0 AS hops UNION ALL
  SELECT list_append(p, next), list_append(c, card), inactive + CASE WHEN active THEN 0 ELSE 1 END, hops + 1 FROM w JOIN s ON s."at" = p[-1] WHERE hops < 4 AND NOT list_contains(p, next))
SELECT array_to_string(p, '>') AS path, array_to_string(c, '>') AS cardinalities, inactive AS inactive_hops, hops FROM w WHERE p[-1] IN ('promo', 'brand#9', 'brand#17')
QUALIFY row_number() OVER (PARTITION BY p[-1] ORDER BY hops, inactive, p) = 1""")
def relationship_path(spark, d):
    from orrery.operators import relationships

    pairs = star.table(spark, d, "part").groupBy(F.col("p_brand").alias("from_table"), F.col("p_type").alias("to_table")).agg((F.max("p_size") > 45).alias("is_active"))
    one = {"dataset_id": "star", "from_column": "p_type", "to_column": "p_type", "from_cardinality": "many", "to_cardinality": "one", "cross_filter": "single"}
    rel = pairs.select(*(F.lit(v).alias(k) for k, v in one.items()), "from_table", "to_table", "is_active")
    found = [relationships.paths(rel, "star", "Brand#1", end) for end in ("PROMO", "Brand#9", "Brand#17")]
    rows = functools.reduce(DataFrame.unionByName, found)
    return rows.select(F.array_join("path", ">").alias("path"), F.array_join("cardinalities", ">").alias("cardinalities"), "inactive_hops", "hops")


@query("SELECT c_custkey AS id, upper(substr(split_part(c_name, '#', 1), 1, 2)) AS initials, regexp_replace(lower(trim(c_mktsegment || ' ' || c_custkey)), '[^a-z0-9_.-]+', '_', 'g') AS slug, '0::' || lower(trim(c_name)) AS measure_key FROM customer")
def scalar_names(spark, d):
    none = F.lit(None).cast("string")
    name = F.substring_index("c_name", "#", 1)
    return star.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), names.initials(name, none).alias("initials"), names.slug(F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey").cast("string"))).alias("slug"), names.measure_key(none, F.lit("PB_MEASURE"), F.col("c_name")).alias("measure_key"))


@query("""SELECT p_partkey, CASE WHEN p_type LIKE '%bool%' THEN 'boolean' WHEN regexp_matches(lower(p_type), '(date|time|timestamp)') THEN 'date' WHEN regexp_matches(lower(p_type), '(int|num|dec|float|double|real|money|serial|big)') THEN 'numeric'
WHEN regexp_matches(lower(p_type), '(char|text|string|uuid|json|byte|enum)') THEN 'text' ELSE 'other' END AS kind, CASE WHEN regexp_matches(lower(p_type), '(char|text|string|uuid|json|byte|enum)') THEN 'Aa' WHEN regexp_matches(lower(p_type), '(int|num|dec|float|double|real|money|serial|big)') THEN '#'
WHEN regexp_matches(lower(p_type), '(date|time|timestamp)') THEN '◷' WHEN p_type LIKE '%bool%' THEN '⊨' ELSE '•' END AS glyph FROM part""")
def data_kinds(spark, d):
    return star.table(spark, d, "part").select("p_partkey", rules.data_kind(F.col("p_type")).alias("kind"), rules.data_glyph(F.col("p_type")).alias("glyph"))


@query("""WITH e AS (SELECT 'T::' || (p_partkey % 50) AS source, 'C::' || p_partkey AS target, 'contains' AS kind FROM part UNION ALL SELECT 'C::' || p_partkey, 'C::' || (p_partkey + 50), 'column' FROM part WHERE p_partkey % 3 = 0)
SELECT target AS node_id FROM (SELECT target, min(source) AS source FROM e WHERE kind = 'contains' GROUP BY target) WHERE source = 'T::7'""")
def container_members(spark, d):
    n = F.col("p_partkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    part = star.table(spark, d, "part")
    boxes = part.select(text("T::", n % 50).alias("source"), text("C::", n).alias("target"), F.lit("contains").alias("kind"))
    return graph.members(boxes.unionByName(part.where("p_partkey % 3 = 0").select(text("C::", n).alias("source"), text("C::", n + 50).alias("target"), F.lit("column").alias("kind"))), "T::7")


# Reductions, fills and staging


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def keep_last(spark, d):
    return groups.keep_last(star.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, o_orderdate, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_runs(spark, d):
    runs = star.table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("started_at"), "o_orderstatus", "o_orderkey")
    return load.latest(runs, "o_custkey").select("o_custkey", F.col("started_at.o_orderdate").alias("o_orderdate"), "o_orderstatus", "o_orderkey")


@query("""WITH l AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS size FROM part), r AS (SELECT p_brand, max(p_size) AS size FROM part GROUP BY p_brand)
SELECT p_partkey, l.p_brand, coalesce(l.size, r.size) AS size FROM l LEFT JOIN r USING (p_brand)""")
def stat_fill(spark, d):
    from orrery.operators import activity

    part = star.table(spark, d, "part")
    left = part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("size"))
    return activity.filled(left, part.select(F.concat(F.col("p_brand"), F.lit(" ")).alias("p_brand"), F.col("p_size").alias("size")), ["p_brand"], ["size"])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS item_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS item_name, CAST(round(c_acctbal) AS INTEGER) AS connected_reports, c_custkey % 2 = 0 AS is_unused FROM customer""")
def typed_staging(spark, d):
    from pyspark.sql import types as T

    n = F.col("c_custkey")
    staged = star.table(spark, d, "customer").select(n.cast("string").alias("item_id"), F.when(n % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("c_name"))).alias("item_name"), F.concat(F.lit(" "), F.col("c_acctbal").cast("decimal(20,4)").cast("string")).alias("connected_reports"), F.when(n % 2 == 0, "T").otherwise("no").alias("is_unused"))
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_name", T.StringType()), T.StructField("connected_reports", T.IntegerType()), T.StructField("is_unused", T.BooleanType())])
    return load.typed(staged, schema)


@query("""WITH g AS (SELECT p_partkey AS id, p_partkey % 5 AS owner FROM part), p AS (SELECT c_custkey AS id, c_name AS name FROM customer)
SELECT CAST(g.id AS VARCHAR) AS group_pk, 'g' || g.id AS group_id, p.name AS owner FROM g LEFT JOIN p ON p.id = g.owner""")
def governance_export(spark, d):
    people = star.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    none = spark.createDataFrame([], "item_group_id long, item_name string, service string, item_type string")
    return governance.exported(_groups(spark, d), none, people, people.limit(0), people.limit(0)).select("group_pk", "group_id", "owner")


@query(f"""WITH {star.NODES_SQL}, old AS (SELECT * FROM nodes WHERE "group" <> 'PB_REPORT'), new AS (SELECT node_id, upper(name) AS name, "group" FROM nodes WHERE "group" IN ('PB_REPORT', 'PB_MEASURE'))
SELECT coalesce(n.node_id, o.node_id) AS node_id, coalesce(n.name, o.name) AS name, coalesce(n."group", o."group") AS "group" FROM old o FULL JOIN new n ON n.node_id = o.node_id""")
def graph_merge(spark, d):
    nodes, edges = star.nodes(spark, d), star.edges(spark, d).withColumn("kind", F.lit("model"))
    new = nodes.where("group IN ('PB_REPORT', 'PB_MEASURE')").withColumn("name", F.upper("name"))
    return graph.merged(nodes.where("group <> 'PB_REPORT'"), edges, new, edges)[0]


@query(f"""WITH {star.MEASURES_SQL} SELECT workspace_name, dataset_name, count(DISTINCT item_name) AS names, count(DISTINCT table_name) AS tables FROM measures GROUP BY ALL""")
def workspace_datasets(spark, d):
    return star.measures(spark, d).groupBy("workspace_name", "dataset_name").agg(F.countDistinct("item_name").alias("names"), F.countDistinct("table_name").alias("tables"))


@query("""WITH t AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) SELECT host, count(*) AS pages FROM t GROUP BY host""")
def pages_by_host(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return star.table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("pages"))
