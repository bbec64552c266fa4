"""More queries over the star tables, each with SQL for the same rows: names and guards, filters, activity, loads and the graph in detail."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import extract, names, rules
from orrery.operators import activity, bridge, catalog, governance, graph, groups, load, relationships
from orrery.plans import starmap as star
from orrery.plans.queries import _groups, query

NOISE = r"""'[\s''"`]+'"""


def _text(*parts) -> F.Column:
    return F.concat(*(p.cast("string") if hasattr(p, "cast") else F.lit(p) for p in parts))


def _one(spark, node: str) -> DataFrame:
    return spark.createDataFrame([(node,)], "node_id string")


# Names, rules and guards


@query(f"""WITH k AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN concat_ws('_', p_brand, 'tag ' || p_partkey) WHEN p_size % 7 = 0 THEN concat_ws('_', p_brand, p_name) ELSE concat_ws('_', p_brand, p_type, p_name) END AS raw FROM part)
SELECT p_partkey, md5(regexp_replace(lower(raw), {NOISE}, '', 'g')) AS item_id, 'PB_TABLE::' || md5(regexp_replace(lower(raw), {NOISE}, '', 'g')) AS node_id, 'a::' || p_partkey AS inner_id FROM k""")
def node_identity(spark, d):
    size = F.col("p_size")
    key = names.item_id(F.col("p_brand"), F.when(size % 3 == 0, _text("tag ", F.col("p_partkey"))), F.col("p_type"), F.col("p_name"), size % 7 == 0)
    return star.table(spark, d, "part").select("p_partkey", key.alias("item_id"), names.node_id(F.lit("PB_TABLE"), key).alias("node_id"), names.id_of_node(_text("X::a::", F.col("p_partkey"))).alias("inner_id"))


@query("""SELECT c_custkey, c_mktsegment || '|' || c_name AS distinct_names, 'AB-' || c_custkey AS guid, split_part(c_name, '#', -1) AS tail, CASE WHEN c_custkey % 2 = 0 THEN 'db.' || c_mktsegment ELSE 'db.al' || c_custkey END AS fqn,
CASE WHEN length(c_name || ' ' || c_mktsegment) > 24 THEN rtrim(substr(c_name || ' ' || c_mktsegment, 1, 23)) || '…' ELSE c_name || ' ' || c_mktsegment END AS line, c_name AS label, substr(md5('1,' || c_custkey), 1, 10) AS scope FROM customer WHERE c_custkey >= 10""")
def name_functions(spark, d):
    n, segment, name = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_name")
    alias = F.when(n % 2 == 1, _text("al", n))
    return star.table(spark, d, "customer").where("c_custkey >= 10").select(
        "c_custkey", F.array_join(names.distinct_names(F.array(segment, F.lower(segment), F.lit(" "), name, F.upper(name))), "|").alias("distinct_names"), names.guid(_text(" {ab-", n, "} ")).alias("guid"),
        names.last_segment(name, "#").alias("tail"), names.qualified_name(F.lit("db"), F.lit(" "), alias, segment).alias("fqn"), names.one_line(_text(name, "\n \r\n", segment), 24).alias("line"),
        names.clean_label(_text("PB_TABLE::", name, " (0123abcdef)")).alias("label"), names.scope_key(F.array(n, F.lit(1))).alias("scope"),
    )


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('month', o_orderdate) - INTERVAL 5 MONTH AS DATE) AS before FROM orders")
def month_functions(spark, d):
    day = F.col("o_orderdate")
    return star.table(spark, d, "orders").select("o_orderkey", names.month_of(F.date_format(day, "yyyy-MM-dd")).alias("month"), names.months_ago(5, day.cast("date")).alias("before"))


_PREFIX = "CASE p_size % 6 WHEN 0 THEN 'stg_' WHEN 1 THEN 'int_' WHEN 2 THEN 'fct_' WHEN 3 THEN 'db.dim_' WHEN 4 THEN 'fact_' ELSE '' END || p_partkey"
_GROUP = "CASE p_partkey % 5 WHEN 0 THEN 'DBT_SOURCE' WHEN 1 THEN 'PB_TABLE' WHEN 2 THEN 'DBT_SEED' ELSE 'DBT_MODEL' END"


@query(f"""WITH t AS (SELECT p_partkey, p_size, {_PREFIX} AS name, {_GROUP} AS g FROM part)
SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'measures' WHEN p_size % 13 = 0 THEN 'reports' WHEN g = 'DBT_SOURCE' THEN 'source' WHEN g = 'DBT_SEED' THEN 'seed' WHEN g = 'PB_TABLE' THEN 'powerbi' WHEN name LIKE 'stg\\_%' ESCAPE '\\' THEN 'staging' WHEN name LIKE 'int\\_%' ESCAPE '\\' THEN 'intermediate'
  WHEN regexp_matches(name, '^(fct_|fact_|dim_)') THEN 'marts' ELSE 'model' END AS layer,
  CASE WHEN regexp_matches(name, '(^|\\.)dim_') THEN 'dimension' WHEN name LIKE 'fact%' THEN 'fact' WHEN name LIKE 'int%' THEN 'intermediate' WHEN name LIKE 'stg%' THEN 'staging' ELSE 'unknown' END AS model_type,
  CASE WHEN p_size % 2 = 0 THEN 'join' ELSE 'contains' END AS kind, g <> 'PB_TABLE' AS is_bridge, CASE WHEN p_size % 4 = 0 THEN 'unknown' WHEN p_size % 4 = 1 THEN 'pass-through' ELSE 'transformation' END AS lineage FROM t""")
def layer_functions(spark, d):
    size, group, name = F.col("p_size"), F.expr(_GROUP), F.expr(_PREFIX.replace("|| p_partkey", "|| cast(p_partkey as string)"))
    kind = F.when(size % 11 == 0, "measures").when(size % 13 == 0, "report")
    return star.table(spark, d, "part").select(
        "p_partkey", rules.card_layer(group, name, kind).alias("layer"), rules.model_type(name).alias("model_type"), rules.edge_kind_or_explicit(F.when(size % 2 == 0, "join").otherwise(" "), F.lit("PB_TABLE"), F.lit("PB_COLUMN")).alias("kind"),
        rules.is_bridge(_text(group, "::1"), F.lit("PB_COLUMN::2")).alias("is_bridge"), rules.estimated_lineage(size % 4).alias("lineage"),
    )


_SQLS = "CASE p_size % 6 WHEN 0 THEN 'SELECT ' || p_partkey || ';' WHEN 1 THEN '-- x' || chr(10) || 'with a as (select 1) select * from a' WHEN 2 THEN 'drop table t' WHEN 3 THEN 'select 1; select 2' WHEN 4 THEN '/* c */ SELECT delete FROM t' ELSE ' ' END"
_DAXES = "CASE p_size % 6 WHEN 0 THEN 'EVALUATE T' WHEN 1 THEN 'evaluate FILTER(DateTable, 1)' WHEN 2 THEN 'ROW(1)' WHEN 3 THEN 'EVALUATE A; EVALUATE B;' WHEN 4 THEN 'EVALUATE FILTER(T, T[a] < b && c > DATE(2019, 1, 1))' ELSE 'EVALUATE ROW(\"x\", DATE( 2024 , 2, 3))' END"


@query(f"""WITH t AS (SELECT p_partkey, {_SQLS} AS q, {_DAXES} AS x FROM part), c AS (SELECT *, trim(regexp_replace(regexp_replace(q, '/\\*.*?\\*/', '', 'gs'), '--[^\\n]*\\n', '', 'g')) AS s FROM t)
SELECT p_partkey, CASE WHEN s = '' THEN 'empty' WHEN NOT regexp_matches(lower(s), '^(select|with)\\b') THEN 'not read-only' WHEN regexp_matches(lower(s), '\\b(drop|delete)\\b') THEN 'write verb' WHEN contains(rtrim(s, ';'), ';') THEN 'several statements' ELSE 'ok' END AS sql_verdict,
CASE WHEN NOT starts_with(upper(x), 'EVALUATE') THEN 'not EVALUATE' WHEN contains(x, 'DateTable') THEN 'placeholder' WHEN contains(rtrim(x, ';'), ';') THEN 'several statements' WHEN contains(x, '2019') THEN 'year' ELSE 'ok' END AS dax_verdict FROM c""")
def guards(spark, d):
    chars = lambda s: s.replace("chr(10)", "char(10)").replace("|| p_partkey", "|| cast(p_partkey as string)")
    return star.table(spark, d, "part").select("p_partkey", extract.read_only_verdict(F.expr(chars(_SQLS))).alias("sql_verdict"), extract.dax_verdict(F.expr(_DAXES), 2024).alias("dax_verdict"))


@query("""SELECT p_partkey, p_type || '.' || p_name || '|' || p_brand || '.x' AS pairs, p_size % 2 = 0 AS is_wrapper, 'M ' || p_partkey AS measure, p_brand AS dataset, p_type || '.a=' || p_brand || '.b' AS activated FROM part""")
def dax_targets(spark, d):
    dax = _text("SUM('", F.col("p_type"), "'[", F.col("p_name"), "]) + ", "MAX('", F.col("p_brand"), "'[x])")
    wrapper = _text('EXTERNALMEASURE("M ', F.col("p_partkey"), '", INTEGER, "DirectQuery to AS - ', F.col("p_brand"), '")', F.when(F.col("p_size") % 2 == 0, "").otherwise(" + 'T'[c]"))
    use = _text("CALCULATE(1, USERELATIONSHIP('", F.col("p_type"), "'[a], '", F.col("p_brand"), "'[b]))")
    pair = lambda x: F.concat_ws(".", x["table"], x["column"])
    target = extract.external_target(wrapper)
    active = F.transform(extract.activated_relationships(use), lambda r: F.concat(r["a_table"], F.lit("."), r["a_column"], F.lit("="), r["b_table"], F.lit("."), r["b_column"]))
    return star.table(spark, d, "part").select("p_partkey", F.array_join(F.transform(extract.table_columns(dax), pair), "|").alias("pairs"), target["is_wrapper"].alias("is_wrapper"), target["measure"].alias("measure"), target["dataset"].alias("dataset"), F.array_join(active, "|").alias("activated"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 2 THEN 'proj' || s_suppkey % 3 END AS project, CASE WHEN s_suppkey % 3 <> 2 THEN 'sch' END AS schema, CASE WHEN s_suppkey % 3 <> 2 THEN 't' || s_suppkey END AS object,
CASE s_suppkey % 3 WHEN 0 THEN 'SQL Query' WHEN 1 THEN 'View' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'calculated' WHEN 2 THEN 'm' ELSE 'calculated' END AS partition FROM supplier""")
def warehouse_sources(spark, d):
    n = F.col("s_suppkey")
    native = _text('Value.NativeQuery(GoogleBigQuery.Database(), "select * from proj', n % 3, ".sch.t", n, '")')
    steps = _text('GoogleBigQuery.Database(){[Name="proj', n % 3, '"]}[Data]{[Name="sch",Kind="Schema"]}[Data]{[Name="t', n, '",Kind="View"]}')
    m = extract.warehouse_source(F.when(n % 3 == 0, native).when(n % 3 == 1, steps).otherwise("Sql.Database()"))
    part = extract.partition_kind(F.when(n % 4 == 0, "let x = 1 in x").when(n % 4 == 1, "= CALENDAR(1, 2)").when(n % 4 == 2, " ").otherwise("UNION(a, b)"))
    return star.table(spark, d, "supplier").select("s_suppkey", *(m[c].alias(c) for c in ("project", "schema", "object", "kind")), part.alias("partition"))


# Filters, lists and profiles


def _items(spark, d) -> DataFrame:
    n = F.col("p_partkey")
    return star.measures(spark, d).join(star.table(spark, d, "part").select(n.cast("string").alias("item_id"), F.when(n % 3 > 0, n % 3).alias("organization_id"), (n % 5).alias("item_group_id"), F.when(n % 4 > 0, _text("o", n % 4)).alias("owner")), "item_id")


_ITEMS = f"{star.MEASURES_SQL}, items AS (SELECT m.*, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 END AS organization_id, p_partkey % 5 AS item_group_id, CASE WHEN p_partkey % 4 > 0 THEN 'o' || p_partkey % 4 END AS owner FROM measures m JOIN part ON CAST(p_partkey AS VARCHAR) = item_id)"


@query(f"WITH {_ITEMS} SELECT item_id, coalesce(organization_id = 1, FALSE) AS strict FROM items WHERE organization_id = 1 OR organization_id IS NULL")
def organization_items(spark, d):
    return _items(spark, d).where(catalog.in_organization(1)).select("item_id", catalog.in_organization(1, strict=True).alias("strict"))


@query(f"""WITH {_ITEMS}, g AS (SELECT n_nationkey AS id, n_regionkey AS dep, n_nationkey + 1 AS owner FROM nation WHERE n_nationkey < 4)
SELECT item_id, r_name AS department, n_name AS owner, coalesce(item_id = CAST(g.id * 10 + g.id AS VARCHAR), FALSE) AS is_primary, NOT is_unused AS is_used FROM (SELECT * EXCLUDE (owner) FROM items) i LEFT JOIN g ON g.id = i.item_group_id LEFT JOIN region ON r_regionkey = dep LEFT JOIN nation n ON n.n_nationkey = g.owner""")
def governed_items(spark, d):
    n, none = F.col("n_nationkey"), F.lit(None)
    nation = star.table(spark, d, "nation")
    own = nation.where("n_nationkey < 4").select(n.cast("long").alias("id"), F.col("n_regionkey").alias("ownership_department_id"), (n + 1).alias("ownership_person_id"), none.cast("long").alias("steward_id"), none.cast("long").alias("category_id"), F.lit("VERIFIED").alias("status"), none.cast("string").alias("custom_description"), (n * 10 + n).cast("string").alias("primary_item_id"))
    people = nation.select(n.alias("id"), F.col("n_name").alias("name"))
    departments = star.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    items = _items(spark, d).drop("custom_description", "owner")
    return catalog.with_governance(items, own, people, departments, people.limit(0)).select("item_id", "department", "owner", "is_primary", "is_used")


@query("""WITH g AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'measure_name' ELSE 'singleton' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'VERIFIED' END AS status, p_size % 5 > 0 AS used, p_size % 7 > 0 AS described, p_size % 4 AS instances FROM part)
SELECT id, 'unverified' AS filter FROM g WHERE used AND coalesce(status, 'UNVERIFIED') = 'UNVERIFIED' UNION ALL SELECT id, 'several' FROM g WHERE kind = 'measure_name' AND instances > 1 AND described UNION ALL SELECT id, 'single' FROM g WHERE kind = 'measure_name' AND NOT instances > 1""")
def group_filters(spark, d):
    size = F.col("p_size")
    own = star.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(size % 2 == 0, "measure_name").otherwise("singleton").alias("kind"), F.when(size % 3 == 0, "VERIFIED").alias("status"), (size % 5 > 0).alias("used"), (size % 7 > 0).alias("described"), (size % 4).alias("instances"))
    part = lambda label, **asked: catalog.group_filtered(own, **asked).select("id", F.lit(label).alias("filter"))
    return part("unverified", used=True, status="UNVERIFIED").unionByName(part("several", multiple=True, described=True)).unionByName(part("single", multiple=False))


@query("""SELECT c_custkey AS id, 'people' AS what FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey = 3 UNION ALL SELECT p_partkey, 'tasks' FROM part WHERE p_size % 3 = 0""")
def people_and_tasks(spark, d):
    customer = star.table(spark, d, "customer")
    people = customer.select(F.col("c_custkey").cast("long").alias("id"), (F.col("c_custkey") % 2 == 0).alias("is_owner"))
    links = customer.select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("department_id"))
    tasks = star.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.when(F.col("p_size") % 3 == 0, "open").otherwise("done").alias("state"))
    found = catalog.people_in(people, links.unionByName(links), 3, "owner").select("id", F.lit("people").alias("what"))
    return found.unionByName(catalog.tasks_in(tasks).select("id", F.lit("tasks").alias("what")))


@query(f"""WITH {star.MEASURES_SQL}, name AS (SELECT min(lower(item_name)) AS n FROM measures), own AS (SELECT * FROM measures, name WHERE lower(item_name) = n), ws AS (SELECT * FROM own WHERE workspace_name = 'ws1' OR NOT EXISTS (SELECT 1 FROM own WHERE workspace_name = 'ws1'))
SELECT item_id, workspace_name, dataset_name FROM ws""")
def disambiguation(spark, d):
    own = star.measures(spark, d)
    name = own.agg(F.min(F.lower("item_name"))).first()[0]
    return catalog.disambiguated(own, f" {name.upper()} ", "WS1", "no such dataset")[1].select("item_id", "workspace_name", "dataset_name")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name, p_type AS table_name FROM part WHERE contains(lower(p_name), 'e') AND p_brand = (SELECT min(p_brand) FROM part) ORDER BY table_name, item_name, item_id LIMIT 100""")
def column_search(spark, d):
    own = star.measures(spark, d).withColumn("item_type", F.lit("PB_COLUMN")).withColumn("description", F.lit(None).cast("string"))
    brand = own.agg(F.min("dataset_name")).first()[0]
    return catalog.columns_of(own, "E", dataset=brand.upper()).select("item_id", "item_name", "table_name")


@query(f"WITH {_ITEMS} SELECT 'owner' AS part, owner AS name, count(*) AS items FROM items WHERE workspace_id = 'ws1' AND owner IS NOT NULL GROUP BY ALL UNION ALL SELECT 'type', 'PB_MEASURE', count(*) FROM items WHERE workspace_id = 'ws1' HAVING count(*) > 0 UNION ALL SELECT 'dataset', dataset_name, 1 FROM (SELECT DISTINCT dataset_name FROM items WHERE workspace_id = 'ws1')")
def workspace_profile(spark, d):
    found = activity.workspace_profile(_items(spark, d), "ws1")
    row = lambda df, part, name, n: df.select(F.lit(part).alias("part"), F.col(name).alias("name"), n.cast("long").alias("items"))
    return row(found["owners"], "owner", "owner", F.col("items")).unionByName(row(found["types"], "type", "item_type", F.col("items"))).unionByName(row(found["datasets"], "dataset", "dataset_name", F.lit(1)))


# Runs and tool calls: orders stand for runs


def _runs(spark, d) -> DataFrame:
    n = F.col("o_orderkey")
    state = F.when(n % 4 == 0, "queued").when(n % 4 == 1, "scheduled").when(n % 4 == 2, "success").otherwise("failed")
    return star.table(spark, d, "orders").select(n.alias("id"), F.col("o_custkey").alias("source_id"), state.alias("state"), F.col("o_orderdate").cast("timestamp").alias("ended_at"), F.struct(F.col("o_orderdate").cast("timestamp").alias("t"), n.alias("n")).alias("started_at"), (F.col("o_totalprice") > 150000).alias("is_error"), F.col("o_orderpriority").alias("tool"))


_RUNS = "runs AS (SELECT o_orderkey AS id, o_custkey AS source_id, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'success' ELSE 'failed' END AS state, CAST(o_orderdate AS TIMESTAMP) AS ended_at FROM orders)"


@query(f"""WITH {_RUNS} SELECT count(*) FILTER (WHERE state = 'queued') AS queued, count(*) FILTER (WHERE state = 'scheduled') AS scheduled, count(*) FILTER (WHERE state = 'success') AS success, count(*) FILTER (WHERE state = 'failed') AS failed,
count(*) FILTER (WHERE state = 'success' AND ended_at >= TIMESTAMP '1997-01-01') AS success_last_day, count(*) FILTER (WHERE state = 'failed' AND ended_at >= TIMESTAMP '1997-01-01') AS failed_last_day FROM runs""")
def queue_counters(spark, d):
    return activity.queue_counters(_runs(spark, d), F.lit(datetime(1997, 1, 2)))


@query(f"WITH {_RUNS} SELECT source_id, last(state ORDER BY ended_at, id) AS state, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) AS runs FROM runs GROUP BY source_id")
def run_status(spark, d):
    return activity.run_status(_runs(spark, d)).drop("started_at")


@query(f"WITH {_RUNS} SELECT id, state FROM runs ORDER BY ended_at DESC, id DESC LIMIT 20")
def last_runs(spark, d):
    return activity.last_runs(_runs(spark, d), 20, "ended_at").select("id", "state")


@query("SELECT o_orderpriority AS tool, count(*) AS calls, count(*) FILTER (WHERE o_totalprice > 150000) AS errors, round(avg(o_custkey), 6) AS mean_seconds FROM orders GROUP BY ROLLUP (o_orderpriority)")
def tool_calls(spark, d):
    return activity.tool_calls(_runs(spark, d).withColumn("seconds", F.col("source_id").cast("double")))


@query("SELECT user_id, event_type AS kind, CASE WHEN user_id % 2 = 0 THEN '10.0.0.' || user_id % 9 ELSE 'local' END AS address, count(*) AS n FROM events GROUP BY ALL")
def activity_log(spark, d):
    n = F.col("user_id")
    events = star.table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), F.lit("/").alias("path"), F.when(n % 2 == 0, _text(" 10.0.0.", n % 9, " , 9.9.9.9")).otherwise(" ").alias("forwarded_for"), F.lit("local").alias("address"), F.col("ts").alias("at"))
    log = events.limit(0).select("user_id", "kind", "path", "address", "at")
    return activity.activity(log, events).groupBy("user_id", "kind", "address").agg(F.count(F.lit(1)).alias("n"))


# Groups


@query(f"WITH {star.MEASURES_SQL} SELECT group_id, first(item_id ORDER BY CASE WHEN CAST(item_id AS BIGINT) % 50 = 0 THEN 0 ELSE 1 END, coalesce(connected_visuals, 0) DESC, CASE WHEN description IS NOT NULL THEN 0 ELSE 1 END, item_id) AS item_id FROM measures GROUP BY group_id")
def chat_representatives(spark, d):
    own = star.measures(spark, d).withColumn("connected_reports", F.lit(None).cast("int"))
    return groups.chat_representatives(own, F.col("item_id").cast("long") % 50 == 0).select("group_id", "item_id")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, first(o_totalprice ORDER BY o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def keep_first(spark, d):
    return groups.keep_first(star.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query(f"WITH {star.MEASURES_SQL} SELECT group_id, first(dataset_name ORDER BY CASE WHEN workspace_name = 'ws3' THEN 0 ELSE 1 END, {star.ORDER_SQL}) AS dataset_name, count(*) AS instances FROM measures GROUP BY group_id")
def surface_of_a_match(spark, d):
    return groups.surface(star.measures(spark, d), ("dataset_name",), match=F.col("workspace_name") == "ws3")


@query("""WITH r AS (SELECT '0::' || lower(trim(p_name)) AS group_id, unnest([{'id': 'r' || p_size % 3, 'name': 'Report ' || p_size % 3}, {'id': ' ', 'name': p_brand}]) AS r FROM part)
SELECT group_id, coalesce(nullif(trim(r.id), ''), r.name) AS key, min(r.name) AS name, CAST(NULL AS VARCHAR) AS url FROM r GROUP BY ALL""")
def merged_reports(spark, d):
    size, none = F.col("p_size"), F.lit(None).cast("string").alias("url")
    reports = F.array(F.struct(_text("r", size % 3).alias("id"), _text("Report ", size % 3).alias("name"), none), F.struct(F.lit(" ").alias("id"), F.col("p_brand").alias("name"), none))
    own = star.table(spark, d, "part").select(names.measure_key(F.lit(None).cast("long"), F.lit("PB_MEASURE"), F.col("p_name")).alias("group_id"), reports.alias("connected_reports_json"))
    return groups.merged_reports(own)


@query(f"WITH {star.MEASURES_SQL} SELECT item_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY connected_visuals DESC, item_id) AS INTEGER) AS position FROM measures")
def ranked_measures(spark, d):
    return groups.ranked(star.measures(spark, d), [F.desc("connected_visuals"), F.col("item_id")], ["dataset_id"]).select("item_id", "position")


# Loads


@query(f"""WITH {star.EDGES_SQL}, b AS (SELECT *, CASE WHEN source LIKE 'DBT%' AND target LIKE '%7' THEN 'name_full' END AS bridge_reason FROM edges)
SELECT source, target FROM b WHERE bridge_reason IS NULL AND NOT (starts_with(source, 'DBT_') OR starts_with(target, 'DBT_'))""")
def graph_without_a_tool(spark, d):
    own = star.edges(spark, d).withColumn("bridge_reason", F.when(F.col("source").startswith("DBT") & F.col("target").endswith("7"), "name_full"))
    return load.graph_without(own, "DBT_").select("source", "target")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-12-03'")
def retained_runs(spark, d):
    runs = star.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("started_at"))
    return load.retained(runs, 30, now=F.lit(datetime(1997, 1, 2))).select("o_orderkey")


@query(f"WITH {star.EDGES_SQL} SELECT source, target, CASE WHEN target LIKE '%3' THEN 'new' ELSE 'old' END AS origin FROM edges")
def edges_upserted(spark, d):
    old = star.edges(spark, d).withColumn("origin", F.lit("old"))
    return load.edges_upserted(old, star.edges(spark, d).where(F.col("target").endswith("3")).withColumn("origin", F.lit("new")))


@query("""WITH g AS (SELECT DISTINCT '0::' || lower(trim(p_name)) AS k FROM part WHERE p_size % 2 = 0 UNION ALL SELECT DISTINCT 'item::' || p_partkey FROM part WHERE p_size % 2 = 1)
SELECT k AS group_key, CASE WHEN k LIKE 'item::%' THEN 'singleton' ELSE 'measure_name' END AS kind, CASE WHEN k = (SELECT min(k) FROM g) THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status,
 (SELECT count(*) FROM part WHERE CASE WHEN p_size % 2 = 0 THEN '0::' || lower(trim(p_name)) ELSE 'item::' || p_partkey END = k) AS items FROM g""")
def linked_groups(spark, d):
    n = F.col("p_partkey")
    key = F.when(F.col("p_size") % 2 == 0, names.measure_key(F.lit(None).cast("long"), F.lit("PB_MEASURE"), F.col("p_name")))
    items = star.table(spark, d, "part").select(n.cast("string").alias("item_id"), key.alias("group_id"), F.lit(None).cast("long").alias("organization_id"), F.lit(None).cast("long").alias("item_group_id"), F.lit("UNVERIFIED").alias("status"))
    first = items.agg(F.min(F.coalesce("group_id", F.concat(F.lit("item::"), "item_id"))).alias("group_key"))
    old = _groups(spark, d).limit(0)
    known = first.select(*((F.col("group_key") if c == "group_key" else F.lit("VERIFIED") if c == "status" else F.lit(7) if c == "id" else F.when(F.col("group_key").startswith("item::"), "singleton").otherwise("measure_name") if c == "kind" else F.lit(None)).cast(old.schema[c].dataType).alias(c) for c in old.columns))
    linked, every = load.with_groups(items, known)
    counts = linked.groupBy(F.col("item_group_id").alias("id")).agg(F.count(F.lit(1)).alias("items"))
    return every.join(counts, "id").select("group_key", "kind", "status", "items")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 3 = 0 THEN 'done' ELSE 'open' END AS state, p_size % 3 = 0 AS stamped FROM part")
def tasks_done(spark, d):
    part = star.table(spark, d, "part")
    tasks = part.select(F.col("p_partkey").cast("string").alias("id"), F.lit("open").alias("state"), F.lit(None).cast("timestamp").alias("done_at"))
    return governance.done(tasks, part.where("p_size % 3 = 0").select(F.col("p_partkey").cast("string").alias("id")), F.lit(datetime(2024, 2, 1))).select("id", "state", F.col("done_at").isNotNull().alias("stamped"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey = 7 THEN 'i7' END AS primary_item_id FROM part")
def pinned_instance(spark, d):
    return governance.with_primary(_groups(spark, d), 7, "i7").select("id", "primary_item_id")


@query("SELECT o_custkey AS group_id, max(o_orderdate) AS deleted_at FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def last_deletion(spark, d):
    log = star.table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), F.when(F.col("o_orderstatus") == "F", "DELETED").otherwise("VERIFIED").alias("new_status"), F.col("o_orderdate").alias("changed_at"))
    return governance.last_deletion(log)


# Bridges


def _bridged(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of matched tables, and the columns of both sides."""
    part = star.table(spark, d, "part")
    n = F.col("p_partkey")
    pairs = part.where("p_partkey <= 50").select(_text("p", n).alias("pbi_item_id"), _text("d", n).alias("dbt_item_id"), F.when(n % 2 == 0, "bq_fqn").otherwise("name_tail").alias("reason"))
    column = lambda owner, name: part.select(_text(owner, n % 60).alias("owner"), _text(owner, "c", n).alias("item_id"), name.alias("item_name"))
    return pairs, column("p", _text('"C', n % 7, '"')), column("d", _text(" c", n % 7, " "))


_BRIDGED = """pairs AS (SELECT 'p' || p_partkey AS p, 'd' || p_partkey AS d, CASE WHEN p_partkey % 2 = 0 THEN 'bq_fqn' ELSE 'name_tail' END AS reason FROM part WHERE p_partkey <= 50),
pc AS (SELECT 'p' || p_partkey % 60 AS owner, p_partkey % 7 AS k, min('pc' || p_partkey) AS id FROM part GROUP BY ALL), dc AS (SELECT 'd' || p_partkey % 60 AS owner, p_partkey % 7 AS k, 'dc' || p_partkey AS id FROM part),
cols AS (SELECT dc.id AS dbt_column, pc.id AS pbi_column FROM pairs JOIN dc ON dc.owner = d JOIN pc ON pc.owner = p AND pc.k = dc.k)"""


@query(f"WITH {_BRIDGED} SELECT * FROM cols")
def bridge_columns(spark, d):
    return bridge.bridge_columns(*_bridged(spark, d))


@query(f"""WITH {_BRIDGED}, {star.EDGES_SQL} SELECT source, target, NULL AS bridge_reason, NULL AS kind FROM edges UNION ALL SELECT 'DBT_MODEL::' || d, 'PB_TABLE::' || p, reason, 'model' FROM pairs UNION ALL SELECT 'DBT_COLUMN::' || dbt_column, 'PB_COLUMN::' || pbi_column, 'column_name', 'column' FROM cols""")
def built_bridges(spark, d):
    pairs, pbi, dbt = _bridged(spark, d)
    none = F.lit(None).cast("string")
    old = star.edges(spark, d).select("source", "target", *(none.alias(c) for c in ("bridge_reason", "kind", "level", "lineage_type")))
    columns = bridge.bridge_columns(pairs, pbi, dbt)
    once = bridge.build_bridges(old, pairs, columns)
    return bridge.build_bridges(once, pairs, columns).select("source", "target", "bridge_reason", "kind")


@query(f"WITH {_BRIDGED} SELECT reason AS bridge_reason, count(*) AS edges FROM pairs GROUP BY reason UNION ALL SELECT 'column_name', count(*) FROM cols")
def bridge_reasons(spark, d):
    pairs, pbi, dbt = _bridged(spark, d)
    none = F.lit(None).cast("string")
    old = star.edges(spark, d).select("source", "target", *(none.alias(c) for c in ("bridge_reason", "kind", "level", "lineage_type")))
    return bridge.reasons(bridge.build_bridges(old, pairs, bridge.bridge_columns(pairs, pbi, dbt)))


@query("""WITH m AS (SELECT s_suppkey AS id, 'db' || s_nationkey % 3 || '.s.t' || s_suppkey % 40 AS three, 's.t' || s_suppkey % 40 AS two FROM supplier)
SELECT three AS key, min(CAST(id AS VARCHAR)) AS item_id FROM m GROUP BY three UNION ALL SELECT two, min(CAST(id AS VARCHAR)) FROM m GROUP BY two HAVING count(*) = 1""")
def relation_index(spark, d):
    n = F.col("s_suppkey")
    models = star.table(spark, d, "supplier").select(n.cast("string").alias("item_id"), _text("`DB", F.col("s_nationkey") % 3, "`").alias("database_name"), F.lit(" s").alias("schema_name"), _text('"T', n % 40, '"').alias("alias"))
    return bridge.relation_index(models)


# The graph in detail


def _start_node(spark, d) -> str:
    return star.table(spark, d, "supplier").agg(F.concat(F.lit("DBT_MODEL::"), F.min("s_suppkey").cast("string"))).first()[0]


@query(f"WITH {star.EDGES_SQL} SELECT 'up' AS side, source AS other, 'model' AS kind FROM edges WHERE target = 'PB_REPORT::3' UNION ALL SELECT 'down', target, 'model' FROM edges WHERE source = 'PB_REPORT::3'")
def neighbours_of_a_report(spark, d):
    return graph.neighbours(star.edges(spark, d).withColumn("kind", F.lit("model")), "PB_REPORT::3")


@query(f"WITH {star.NODES_SQL} SELECT node_id, p_brand AS brand FROM nodes LEFT JOIN part ON \"group\" = 'PB_MEASURE' AND node_id = 'PB_MEASURE::' || p_partkey")
def described_nodes(spark, d):
    items = star.table(spark, d, "part").select(_text("", F.col("p_partkey")).alias("item_id"), F.col("p_brand").alias("brand"))
    both = graph.described(star.nodes(spark, d).where("group = 'PB_MEASURE'"), items).select("node_id", "brand")
    return both.unionByName(star.nodes(spark, d).where("group <> 'PB_MEASURE'").select("node_id", F.lit(None).cast("string").alias("brand")))


@query(f"""WITH {star.NODES_SQL} SELECT node_id, name, "group", 2 AS stage FROM nodes WHERE contains(lower(name), 'customer#00000001') ORDER BY lower(name), node_id LIMIT 25""")
def node_names(spark, d):
    return graph.name_search(star.nodes(spark, d), "Customer#00000001")


_BOXES = "boxes AS (SELECT 'PB_TABLE::' || p_size % 9 AS source, 'PB_COLUMN::' || p_partkey AS target FROM part UNION SELECT 'PB_TABLE::' || p_size % 4, 'PB_COLUMN::' || p_partkey FROM part WHERE p_partkey % 5 = 0)"


def _boxes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Tables that hold columns, some of them two tables; and the nodes of both."""
    part, n = star.table(spark, d, "part"), F.col("p_partkey")
    box = lambda rows, k: rows.select(_text("PB_TABLE::", F.col("p_size") % k).alias("source"), _text("PB_COLUMN::", n).alias("target"), F.lit("contains").alias("kind"))
    edges = box(part, 9).unionByName(box(part.where("p_partkey % 5 = 0"), 4)).distinct()
    columns = part.select(_text("PB_COLUMN::", n).alias("node_id"), F.col("p_name").alias("name"), F.lit("PB_COLUMN").alias("group"))
    tables = edges.select(F.col("source").alias("node_id")).distinct().select("node_id", F.col("node_id").alias("name"), F.lit("PB_TABLE").alias("group"))
    return columns.unionByName(tables), edges


@query(f"WITH {_BOXES} SELECT source AS node_id, source AS name, 'PB_TABLE' AS \"group\", count(DISTINCT target) AS members FROM boxes GROUP BY source")
def asset_directory(spark, d):
    return graph.directory(*_boxes(spark, d))


@query(f"WITH {_BOXES} SELECT 'PB_COLUMN::' || p_partkey AS node_id, p_name AS name, (SELECT min(source) FROM boxes WHERE target = 'PB_COLUMN::' || p_partkey) AS container FROM part WHERE contains(lower(p_name), 'ol') ORDER BY lower(p_name), node_id LIMIT 50")
def member_names(spark, d):
    return graph.member_search(*_boxes(spark, d), "OL")


@query(f"WITH {_BOXES} SELECT target AS node_id, min(source) AS card, 'model' AS card_kind FROM boxes GROUP BY target UNION ALL SELECT DISTINCT source, source, 'model' FROM boxes")
def graph_cards(spark, d):
    return graph.cards(*_boxes(spark, d))


@query(f"WITH {_BOXES} SELECT source, target FROM boxes WHERE source <> 'PB_TABLE::3'")
def visible_graph(spark, d):
    return graph.visible(*_boxes(spark, d), hidden_groups=("PB_VISUAL",), hidden_ids=("PB_TABLE::3",))[1].select("source", "target")


@query("""WITH s AS (SELECT 'PB_MEASURE::' || min(l_partkey) AS n FROM lineitem) SELECT 1 AS depth, node_id, name, "group" FROM (SELECT DISTINCT 'DBT_MODEL::' || s_suppkey AS node_id, s_name AS name, 'DBT_MODEL' AS "group" FROM lineitem JOIN supplier ON s_suppkey = l_suppkey, s WHERE 'PB_MEASURE::' || l_partkey = s.n)""")
def upstream_tree(spark, d):
    start = star.table(spark, d, "lineitem").agg(F.concat(F.lit("PB_MEASURE::"), F.min("l_partkey").cast("string"))).first()[0]
    return graph.upstream_tree(star.edges(spark, d), star.nodes(spark, d), start)


@query("""WITH r AS (SELECT l_suppkey, count(DISTINCT c_nationkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY l_suppkey)
SELECT 'DBT_MODEL::' || s_suppkey AS node_id, n IS NULL AS is_unused, coalesce(n, 0) AS connected_reports FROM supplier LEFT JOIN r ON l_suppkey = s_suppkey""")
def usage_backfill(spark, d):
    return graph.backfilled(star.edges(spark, d), star.nodes(spark, d), ["DBT_MODEL"], ["PB_MEASURE", "PB_TABLE"])


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey <= 20), n AS (SELECT min(a) AS m FROM e)
SELECT 'uses' AS side, 'PB_MEASURE::' || b AS node_id, p_name AS name FROM e, n, part WHERE a = m AND p_partkey = b UNION ALL SELECT 'home', 'PB_TABLE::1', 'T1' FROM n UNION ALL SELECT 'used by', 'PB_MEASURE::' || a, p_name FROM e, n, part WHERE b = m AND p_partkey = a""")
def measure_dependencies(spark, d):
    pairs = star.table(spark, d, "lineitem").where("l_partkey <= 20").select("l_partkey", "l_suppkey").distinct()
    node = lambda c: _text("PB_MEASURE::", F.col(c))
    first = pairs.agg(F.min("l_partkey")).first()[0]
    edges = pairs.select(node("l_suppkey").alias("source"), node("l_partkey").alias("target")).unionByName(spark.createDataFrame([("PB_TABLE::1", f"PB_MEASURE::{first}")], "source string, target string"))
    nodes = star.nodes(spark, d).where("group = 'PB_MEASURE'").unionByName(spark.createDataFrame([("PB_TABLE::1", "T1", "PB_TABLE")], "node_id string, name string, `group` string"))
    return graph.measure_dependencies(nodes, edges, f"PB_MEASURE::{first}")


@query("""WITH n AS (SELECT 'PB_PAGE::' || c_custkey AS node_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'other' WHEN c_custkey % 3 = 1 THEN 'own' ELSE ' ' END AS ws, c_nationkey FROM customer)
SELECT node_id, 1 AS distance, 'PB_PAGE' AS "group", name FROM n WHERE c_nationkey = 3 AND ws <> 'other' UNION ALL SELECT 'PB_REPORT::3', 0, 'PB_REPORT', n_name FROM nation WHERE n_nationkey = 3""")
def reachable_in_a_workspace(spark, d):
    nodes = star.nodes(spark, d)
    key = names.id_of_node(F.col("node_id")).try_cast("long") % 3
    placed = nodes.withColumn("workspace_name", F.when(F.col("group") != "PB_PAGE", None).when(key == 0, "other").when(key == 1, "own").otherwise(" "))
    found = graph.reachable(star.edges(spark, d), _one(spark, "PB_REPORT::3"), "up", 1, blocked=graph.outside_workspace(placed, "own"))
    return graph.reached_in_order(found, nodes)


@query("""WITH e AS (SELECT 'DBT_COLUMN::' || l_suppkey AS source, 'PB_COLUMN::' || l_partkey AS target FROM lineitem GROUP BY ALL), s AS (SELECT 'PB_COLUMN::' || min(l_partkey) AS n FROM lineitem)
SELECT source AS node_id, 1 AS distance FROM e, s WHERE target = n UNION ALL SELECT n, 0 FROM s""")
def column_trace(spark, d):
    pairs = star.table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    edges = pairs.select(_text("DBT_COLUMN::", F.col("l_suppkey")).alias("source"), _text("PB_COLUMN::", F.col("l_partkey")).alias("target"), F.lit("column").alias("kind"))
    first = pairs.agg(F.min("l_partkey")).first()[0]
    return graph.trace(edges, f"PB_COLUMN::{first}")[0]


@query(f"""WITH RECURSIVE {star.EDGES_SQL}, walk AS (SELECT (SELECT 'DBT_MODEL::' || min(s_suppkey) FROM supplier) AS node_id, 0 AS distance UNION SELECT e.target, w.distance + 1 FROM walk w JOIN edges e ON e.source = w.node_id WHERE w.distance < 15),
near AS (SELECT node_id, min(distance) AS distance FROM walk GROUP BY node_id HAVING min(distance) > 0) SELECT split_part(node_id, '::', 1) AS "group", count(*) AS nodes, min(distance) AS nearest FROM near GROUP BY ALL""")
def used_where_counts(spark, d):
    return graph.used_where(star.edges(spark, d), _one(spark, _start_node(spark, d)))[0]


@query(f"""WITH RECURSIVE {star.EDGES_SQL}, walk AS (SELECT (SELECT 'DBT_MODEL::' || min(s_suppkey) FROM supplier) AS node_id, 0 AS distance UNION SELECT e.target, w.distance + 1 FROM walk w JOIN edges e ON e.source = w.node_id WHERE w.distance < 15),
near AS (SELECT node_id, min(distance) AS distance FROM walk GROUP BY node_id HAVING min(distance) > 0), placed AS (SELECT *, split_part(node_id, '::', 1) AS g, row_number() OVER (PARTITION BY split_part(node_id, '::', 1) ORDER BY distance, node_id) AS place FROM near)
SELECT g AS "group", string_agg(node_id, ',' ORDER BY place) AS ids FROM placed WHERE place <= 60 GROUP BY g""")
def used_where_ids(spark, d):
    return graph.used_where(star.edges(spark, d), _one(spark, _start_node(spark, d)))[1].select("group", F.array_join("ids", ",").alias("ids"))


@query("""WITH i AS (SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_brand) AS ds, lower(p_type) AS t, lower(p_name) AS n, p_partkey AS k FROM part), r AS (SELECT k, CASE WHEN k % 4 < 2 THEN ds ELSE 'none' END AS ds, CASE WHEN k % 2 = 0 THEN t ELSE 'none' END AS t, CASE WHEN k % 11 = 0 THEN 'missing' ELSE n END AS n FROM i)
SELECT k AS ref, 'PB_MEASURE::' || coalesce((SELECT min(id) FROM i WHERE i.ds = r.ds AND i.t = r.t AND i.n = r.n), (SELECT min(id) FROM i WHERE i.t = r.t AND i.n = r.n), (SELECT min(id) FROM i WHERE i.ds = r.ds AND i.n = r.n), (SELECT min(id) FROM i WHERE i.n = r.n)) AS node_id,
CASE WHEN k % 11 = 0 THEN NULL WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 2 THEN 1 WHEN k % 4 = 1 THEN 2 ELSE 3 END AS rank FROM r""")
def node_resolution(spark, d):
    k = F.col("p_partkey")
    refs = star.table(spark, d, "part").select(k.alias("ref"), F.when(k % 4 < 2, F.col("p_brand")).otherwise("none").alias("dataset"), F.when(k % 2 == 0, F.upper("p_type")).otherwise("none").alias("table"), F.when(k % 11 == 0, "missing").otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("name"))
    return graph.resolved_nodes(refs, star.measures(spark, d))


@query("""WITH l AS (SELECT DISTINCT 'ds' || l_linenumber % 3 AS ds, 't' || l_suppkey % 6 AS f, 't' || l_partkey % 6 AS t FROM lineitem)
SELECT ds AS dataset_id, this AS table_name, 'id' AS column_name, count(*) AS relationships FROM (SELECT ds, f AS this, 'from' AS role, t AS other FROM l UNION SELECT ds, t, 'to', f FROM l) GROUP BY ALL""")
def relationship_index(spark, d):
    part = star.table(spark, d, "lineitem").select(_text("ds", F.col("l_linenumber") % 3).alias("dataset_id"), _text("t", F.col("l_suppkey") % 6).alias("from_table"), _text("t", F.col("l_partkey") % 6).alias("to_table")).distinct()
    rel = part.select("dataset_id", "from_table", F.lit("id").alias("from_column"), "to_table", F.lit("id").alias("to_column"), F.lit("many").alias("from_cardinality"), F.lit("one").alias("to_cardinality"), F.lit("single").alias("cross_filter"), F.lit(True).alias("is_active"))
    return relationships.indexed(rel).select("dataset_id", "table_name", "column_name", F.size("relationships_json").cast("long").alias("relationships"))


@query("""WITH RECURSIVE m AS (SELECT p_partkey AS k, p_partkey % 8 AS r, 'M' || (p_partkey // 8) AS name, 'set ' || (p_partkey % 8) AS dataset FROM part),
asks AS (SELECT k, name, CASE r WHEN 6 THEN 'set 5' WHEN 5 THEN 'set 4' WHEN 4 THEN 'set 3' WHEN 2 THEN 'set 1' WHEN 1 THEN 'set 2' WHEN 0 THEN 'et 3' WHEN 7 THEN 'set' END AS label FROM m WHERE r <> 3),
near AS (SELECT a.k, m.k AS target, m.dataset <> a.label AS held FROM asks a JOIN m ON m.name = a.name AND contains(m.dataset, a.label)),
direct AS (SELECT k, held, min(CAST(target AS VARCHAR)) AS target, count(*) AS candidates FROM near GROUP BY k, held QUALIFY row_number() OVER (PARTITION BY k ORDER BY held) = 1),
walk AS (SELECT CAST(k AS VARCHAR) AS item, target AS z, 1 AS hops FROM direct UNION ALL SELECT w.item, d.target, hops + 1 FROM walk w JOIN direct d ON CAST(d.k AS VARCHAR) = w.z WHERE hops < 10),
ends AS (SELECT item, z, hops FROM walk WHERE z NOT IN (SELECT CAST(k AS VARCHAR) FROM direct))
SELECT CAST(k AS VARCHAR) AS item_id, target AS target_id, CASE WHEN held THEN 'contained' ELSE 'exact' END AS matched, candidates, z AS source_id, CAST(hops AS BIGINT) AS hops FROM direct LEFT JOIN ends ON item = CAST(k AS VARCHAR)""")
def wrapper_sources(spark, d):
    k, r = F.col("p_partkey"), F.col("p_partkey") % 8
    label = F.when(r == 6, "Set 5").when(r == 5, "SET 4").when(r == 4, "set 3").when(r == 2, "Set 1").when(r == 1, "Set 2").when(r == 0, "et 3").otherwise("Set")
    name = _text("M", F.floor(k / 8))
    wrapper = _text('EXTERNALMEASURE("', name, '", DOUBLE, "DirectQuery to AS - ', label, '")')
    part = star.table(spark, d, "part")
    return catalog.wrapper_sources(part.select(k.cast("string").alias("item_id"), name.alias("item_name"), _text("Set ", r).alias("dataset_name"), F.when(r == 3, "SUM('T'[c])").otherwise(wrapper).alias("expression")))
