"""Queries over the star tables for profiles, tiles, report health, updates of items and their groups, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import bridge, catalog, governance, groups, profiles
from orrery.plans import starmap as star
from orrery.plans.queries import query


def _part(spark, d, *columns: str) -> DataFrame:
    """Columns of part by expressions that both engines read alike."""
    return star.table(spark, d, "part").selectExpr(*columns)


def _cast(sql: str) -> str:
    return sql.replace("VARCHAR", "STRING")


_FOOTED = """CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_size % 3 > 0 THEN p_brand END AS owner, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_type END AS steward, CASE WHEN p_size % 5 > 0 THEN p_name END AS department,
CASE WHEN p_size % 7 = 0 THEN p_name || ' ' END AS custom_description, CASE WHEN p_size % 2 = 0 THEN p_type END AS description, p_size % 6 AS connected_reports, p_size % 4 AS connected_visuals, 0 AS connected_measures, p_size % 6 * (p_size % 4) AS connected_columns, CASE WHEN p_size % 3 = 0 THEN TRUE END AS is_unused"""


@query(f"""WITH i AS (SELECT {_FOOTED} FROM part), n AS (SELECT *, concat_ws(', ', CASE WHEN connected_reports > 0 THEN connected_reports || ' reports' END, CASE WHEN connected_visuals > 0 THEN connected_visuals || ' visuals' END, CASE WHEN connected_columns > 0 THEN connected_columns || ' columns' END) AS bits FROM i)
SELECT item_id, coalesce(owner, '—') AS owner, CASE WHEN trim(steward) = '' THEN '—' ELSE steward END AS steward, coalesce(department, '—') AS department, trim(coalesce(custom_description, description)) AS description, CASE WHEN bits = '' THEN 'no connections recorded' ELSE bits END AS usage, coalesce(is_unused, FALSE) AS is_unused FROM n""")
def item_footers(spark, d):
    return profiles.footers(_part(spark, d, *_split(_cast(_FOOTED))))


def _split(columns: str) -> list[str]:
    """The columns of a select list: cut at commas outside brackets."""
    out, depth = [""], 0
    for sign in columns:
        depth += {"(": 1, ")": -1}.get(sign, 0)
        if sign == "," and not depth:
            out.append("")
        else:
            out[-1] += sign
    return [c.strip() for c in out]


@query(f"""WITH {star.MEASURES_SQL}, {star.EDGES_SQL}, {star.NODES_SQL}, asked AS (SELECT item_id, group_id, 'PB_MEASURE::' || item_id AS own FROM measures ORDER BY connected_visuals DESC, item_name, item_id LIMIT 3)
SELECT item_id, 'uses' AS section, source AS other, name FROM asked JOIN edges ON target = own LEFT JOIN nodes ON node_id = source UNION ALL SELECT item_id, 'used by', target, name FROM asked JOIN edges ON source = own LEFT JOIN nodes ON node_id = target
UNION ALL SELECT a.item_id, 'group', m.item_id, m.item_name FROM asked a JOIN measures m ON m.group_id = a.group_id AND m.item_id <> a.item_id""")
def item_sections(spark, d):
    items = star.measures(spark, d)
    return profiles.sections(catalog.top(items, "connected_visuals", 3), items, star.edges(spark, d), star.nodes(spark, d))


_TILED = """CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name, CASE p_partkey % 5 WHEN 0 THEN 'PB_TABLE' WHEN 1 THEN 'PB_MEASURE' WHEN 2 THEN 'PB_COLUMN' WHEN 3 THEN 'PB_PAGE' ELSE 'PB_REPORT' END AS item_type, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS table_name, p_brand AS dataset_name,
CASE WHEN p_size % 4 > 0 THEN 'int' END AS datatype, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS expression, CASE WHEN p_size % 5 = 0 THEN 'Calculated' END AS column_type, p_size % 9 AS connected_measures, CASE WHEN p_size % 8 > 0 THEN p_size % 8 END AS connected_columns"""


@query(f"""WITH i AS (SELECT {_TILED} FROM part), t AS (SELECT *, nullif(table_name, '') AS tn, nullif(expression, '') AS ex, lower(coalesce(column_type, '')) = 'calculated' AS calc FROM i WHERE item_type <> 'PB_REPORT')
SELECT item_id, CASE item_type WHEN 'PB_TABLE' THEN 't_' WHEN 'PB_MEASURE' THEN 'm_' WHEN 'PB_COLUMN' THEN 'c_' ELSE 'p_' END || item_id AS key, CASE item_type WHEN 'PB_TABLE' THEN 'table' WHEN 'PB_MEASURE' THEN 'measure' WHEN 'PB_COLUMN' THEN CASE WHEN calc THEN 'calc_column' ELSE 'column' END ELSE 'page' END AS element_type, item_name AS label,
CASE item_type WHEN 'PB_TABLE' THEN connected_measures || ' m, ' || coalesce(connected_columns, 0) || ' c' WHEN 'PB_MEASURE' THEN coalesce(tn, dataset_name) WHEN 'PB_COLUMN' THEN nullif(concat_ws(' · ', tn, datatype), '') END AS sub,
CASE item_type WHEN 'PB_TABLE' THEN coalesce(tn, dataset_name) WHEN 'PB_MEASURE' THEN ex WHEN 'PB_COLUMN' THEN coalesce(ex, datatype) ELSE dataset_name END AS tooltip FROM t""")
def catalog_tiles(spark, d):
    return profiles.tiles(_part(spark, d, *_split(_cast(_TILED))))


@query("""WITH r AS (SELECT *, unnest([0, 1]) AS i FROM part WHERE p_size % 3 > 0)
SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'r_' || p_partkey || '_' || i AS key, 'relationship' AS element_type, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END || ' → ' || CASE WHEN i = 0 THEN p_brand || '.id' ELSE '?' END AS label, CASE WHEN i = 0 THEN 'many → one' END AS sub, CASE WHEN i = 0 AND p_size % 5 = 0 THEN 'inactive relationship' ELSE 'active relationship' END AS tooltip FROM r""")
def relationship_tiles(spark, d):
    many = "named_struct('other_table', p_brand, 'other_column', 'id', 'cardinality', 'many', 'other_cardinality', 'one', 'is_active', p_size % 5 <> 0)"
    none = "named_struct('other_table', '', 'other_column', cast(NULL AS string), 'cardinality', '', 'other_cardinality', cast(NULL AS string), 'is_active', cast(NULL AS boolean))"
    items = _part(spark, d, "cast(p_partkey AS string) AS item_id", "p_name AS item_name", "CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS table_name", f"CASE WHEN p_size % 3 > 0 THEN array({many}, {none}) END AS relationships_json")
    return profiles.relationship_tiles(items)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS item_id, CASE WHEN s_suppkey % 6 = 0 THEN 'Unknown' ELSE s_name END AS name, CASE WHEN s_nationkey % 5 = 0 THEN '—' ELSE 'ws' || s_nationkey % 5 END AS workspace, CAST(s_nationkey % 4 AS BIGINT) AS pages, CAST(s_suppkey % 17 AS BIGINT) AS visuals, CAST(coalesce(nullif(s_suppkey % 5, 2), 0) AS BIGINT) AS measures, CAST(s_suppkey % 3 AS BIGINT) AS columns,
CAST(s_suppkey % 17 + coalesce(nullif(s_suppkey % 5, 2), 0) AS BIGINT) AS complexity, CAST(s_suppkey % 17 AS DOUBLE) / greatest(s_nationkey % 4, 1) AS ratio FROM supplier""")
def report_complexity(spark, d):
    reports = star.table(spark, d, "supplier").selectExpr(
        "cast(s_suppkey AS string) AS item_id", "CASE WHEN s_suppkey % 6 > 0 THEN s_name END AS item_name", "'PB_REPORT' AS item_type", "CASE WHEN s_nationkey % 5 > 0 THEN concat('ws', cast(s_nationkey % 5 AS string)) ELSE '' END AS workspace_name",
        "s_nationkey % 4 AS connected_pages", "s_suppkey % 17 AS connected_visuals", "nullif(s_suppkey % 5, 2) AS connected_measures", "s_suppkey % 3 AS connected_columns",
    )
    return profiles.report_health(reports)


@query("""WITH i AS (SELECT CAST(s_suppkey AS VARCHAR) AS item_id, s_name AS item_name, 'DBT_MODEL' AS item_type, s_suppkey % 4 = 0 AS is_unused, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'text' END AS description, s_suppkey % 11 = 0 AS deleted FROM supplier
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, CASE WHEN c_custkey % 2 = 0 THEN 'DBT_SEED' ELSE 'DBT_SOURCE' END, c_custkey % 3 = 0, NULL, FALSE FROM customer)
SELECT 'unused ' || CASE item_type WHEN 'DBT_MODEL' THEN 'models' WHEN 'DBT_SEED' THEN 'seeds' ELSE 'sources' END AS list, item_id, item_name FROM i WHERE NOT deleted AND is_unused
UNION ALL SELECT 'untested models', item_id, item_name FROM i WHERE NOT deleted AND item_type = 'DBT_MODEL' AND CAST(item_id AS INT) % 3 > 0 UNION ALL SELECT 'undocumented models', item_id, item_name FROM i WHERE NOT deleted AND item_type = 'DBT_MODEL' AND coalesce(description, '') = ''""")
def cleanup_lists(spark, d):
    models = star.table(spark, d, "supplier").selectExpr("cast(s_suppkey AS string) AS item_id", "s_name AS item_name", "'DBT_MODEL' AS item_type", "s_suppkey % 4 = 0 AS is_unused", "CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'text' END AS description", "s_suppkey % 11 = 0 AS deleted")
    others = star.table(spark, d, "customer").selectExpr("cast(c_custkey AS string) AS item_id", "c_name AS item_name", "CASE WHEN c_custkey % 2 = 0 THEN 'DBT_SEED' ELSE 'DBT_SOURCE' END AS item_type", "c_custkey % 3 = 0 AS is_unused", "cast(NULL AS string) AS description", "false AS deleted")
    tests = star.table(spark, d, "supplier").selectExpr("concat('DBT_MODEL::', cast(s_suppkey AS string)) AS source", "concat(CASE WHEN s_suppkey % 3 = 0 THEN 'DBT_TEST' ELSE 'DBT_MODEL' END, '::t', cast(s_suppkey AS string)) AS target")
    return profiles.cleanup_lists(models.unionByName(others), tests)


@query(f"""WITH {star.USAGE_SQL}, i AS (SELECT CASE WHEN r_name <> 'ASIA' THEN r_name ELSE '' END AS ws, 1 AS report, 0 AS page FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT CASE WHEN c_custkey % 3 = 0 THEN 'lab' ELSE r_name END, 0, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'),
a AS (SELECT ws, sum(report) AS reports, sum(page) AS pages FROM i WHERE ws <> '' GROUP BY ws), u AS (SELECT workspace_name AS ws, sum(view_count) AS views, sum(CASE WHEN month = (SELECT max(month) FROM usage) THEN view_count END) AS recent FROM usage GROUP BY 1)
SELECT coalesce(a.ws, u.ws) AS workspace_name, CAST(coalesce(reports, 0) AS BIGINT) AS reports, CAST(coalesce(pages, 0) AS BIGINT) AS pages, CAST(coalesce(views, 0) AS BIGINT) AS views, CAST(coalesce(recent, 0) AS BIGINT) AS views_recent_month FROM a FULL JOIN u ON a.ws = u.ws""")
def workspace_stats(spark, d):
    where = star.table(spark, d, "nation").join(star.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    reports = where.selectExpr("CASE WHEN r_name <> 'ASIA' THEN r_name ELSE '' END AS workspace_name", "'PB_REPORT' AS item_type", "false AS deleted")
    pages = star.table(spark, d, "customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("CASE WHEN r_name = 'ASIA' THEN NULL WHEN c_custkey % 3 = 0 THEN 'lab' ELSE r_name END AS workspace_name", "'PB_PAGE' AS item_type", "false AS deleted")
    return profiles.workspace_stats(reports.unionByName(pages), star.usage(spark, d))


@query(f"""WITH {star.MEASURES_SQL} SELECT group_id, CAST(max(connected_visuals) AS BIGINT) AS visuals FROM measures WHERE connected_visuals % 9 > 0 AND (CAST(item_id AS INT) % 30 = 3 OR connected_visuals % 20 = 7) GROUP BY group_id""")
def measures_of_a_report(spark, d):
    size, n = F.col("connected_visuals"), F.col("item_id").cast("int")
    entry = F.struct(F.concat(F.lit("r"), (n % 30).cast("string")).alias("id"), F.concat(F.lit(" Report "), (size % 20).cast("string")).alias("name"))
    blank = F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"))
    return profiles.measures_of_report(star.measures(spark, d).withColumn("connected_reports_json", F.when(size % 9 > 0, F.array(blank, entry))), "r3", "REPORT 7")


@query("""WITH m AS (SELECT s_suppkey AS id, 'db' || s_nationkey % 3 || '.s.t' || s_suppkey % 40 AS three, 's.t' || s_suppkey % 40 AS two FROM supplier), k AS (SELECT three AS key, min(CAST(id AS VARCHAR)) AS item_id FROM m GROUP BY three UNION ALL SELECT two, min(CAST(id AS VARCHAR)) FROM m GROUP BY two HAVING count(*) = 1),
r AS (SELECT s_suppkey AS n, s_suppkey % 45 AS t FROM supplier) SELECT CASE n % 4 WHEN 0 THEN 'host.DB' || n % 4 || '.S.T' || t WHEN 1 THEN 'DB' || n % 3 || '.`s`.T' || t WHEN 2 THEN 's.t' || t ELSE 't' || t END AS ref, n,
coalesce((SELECT item_id FROM k WHERE key = CASE n % 4 WHEN 0 THEN 'db' || n % 4 || '.s.t' || t WHEN 1 THEN 'db' || n % 3 || '.s.t' || t END), (SELECT item_id FROM k WHERE key = 's.t' || t AND n % 4 < 3)) AS item_id FROM r""")
def relations_resolved(spark, d):
    n, text = F.col("s_suppkey"), lambda c: c.cast("string")
    supplier = star.table(spark, d, "supplier")
    models = supplier.select(text(n).alias("item_id"), F.concat(F.lit("db"), text(F.col("s_nationkey") % 3)).alias("database_name"), F.lit("s").alias("schema_name"), F.concat(F.lit("t"), text(n % 40)).alias("alias"))
    t = text(n % 45)
    ref = F.when(n % 4 == 0, F.concat(F.lit("host.DB"), text(n % 4), F.lit(".S.T"), t)).when(n % 4 == 1, F.concat(F.lit("DB"), text(n % 3), F.lit(".`s`.T"), t)).when(n % 4 == 2, F.concat(F.lit("s.t"), t)).otherwise(F.concat(F.lit("t"), t))
    return bridge.resolved_relations(supplier.select(ref.alias("ref"), n.alias("n")), bridge.relation_index(models))


@query("""WITH p AS (SELECT TRUE AS by_name, n_nationkey AS k, 'c' || p_size % 30 AS key, min('pc' || p_partkey) AS id FROM part JOIN nation ON n_nationkey % 10 = p_partkey % 10 GROUP BY ALL UNION ALL SELECT FALSE, n_nationkey, 'c' || p_size % 30, min('pc' || p_partkey) FROM part JOIN nation ON n_nationkey % 10 = p_partkey % 10 AND n_regionkey = p_partkey % 5 GROUP BY ALL)
SELECT by_name, 'dc' || s_suppkey AS dbt_column, id AS pbi_column FROM supplier JOIN p ON k = s_suppkey % 25 AND key = 'c' || s_suppkey % 30""")
def bridge_columns_by_table_name(spark, d):
    nation = star.table(spark, d, "nation")
    tables = nation.selectExpr("concat('p', cast(n_nationkey AS string)) AS item_id", "concat('T', cast(n_nationkey % 10 AS string)) AS item_name", "concat('ds', cast(n_regionkey AS string)) AS dataset_id")
    models = nation.selectExpr("concat('d', cast(n_nationkey AS string)) AS item_id", "concat('dd', cast(n_nationkey AS string)) AS dataset_id")
    pairs = nation.selectExpr("concat('p', cast(n_nationkey AS string)) AS pbi_item_id", "concat('d', cast(n_nationkey AS string)) AS dbt_item_id")
    pbi = _part(spark, d, "concat('pc', cast(p_partkey AS string)) AS item_id", "concat('c', cast(p_size % 30 AS string)) AS item_name", "concat('T', cast(p_partkey % 10 AS string)) AS table_name", "concat('ds', cast(p_partkey % 5 AS string)) AS dataset_id")
    dbt = star.table(spark, d, "supplier").selectExpr("concat('dc', cast(s_suppkey AS string)) AS item_id", "concat('c', cast(s_suppkey % 30 AS string)) AS item_name", "concat('dd', cast(s_suppkey % 25 AS string)) AS dataset_id")
    one = lambda by_name: bridge.bridge_columns(pairs, *bridge.owned_columns(tables, models, pbi, dbt, by_name)).withColumn("by_name", F.lit(by_name))
    return one(True).unionByName(one(False))


_UPDATED = """CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_size % 10 > 0 THEN p_partkey % 200 END AS item_group_id, 'UNVERIFIED' AS status, p_size % 17 = 0 AS deleted, CASE WHEN p_size % 17 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS deleted_at"""
_CHANGES = """CAST(p_partkey AS VARCHAR) AS item_id, CASE p_size % 3 WHEN 0 THEN 'ATTENTION' WHEN 1 THEN 'bogus' END AS status, CASE p_size % 9 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS deleted"""
_OWN_GROUPS = """p_partkey % 200 AS id, CASE WHEN p_partkey % 4 = 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status, FALSE AS deleted, CAST(NULL AS TIMESTAMP) AS deleted_at"""


@query(f"""WITH i AS (SELECT {_UPDATED} FROM part), c AS (SELECT {_CHANGES} FROM part WHERE p_size > 40), g AS (SELECT DISTINCT {_OWN_GROUPS} FROM part),
w AS (SELECT i.*, CASE WHEN c.status = 'ATTENTION' THEN c.status END AS s, c.deleted AS d, coalesce(c.deleted, i.deleted) AS new FROM i LEFT JOIN c ON c.item_id = i.item_id),
a AS (SELECT item_group_id AS id, arg_max(s, item_id) FILTER (WHERE s IS NOT NULL) AS s, bool_or(new AND NOT deleted) AS gone FROM w WHERE item_group_id IS NOT NULL GROUP BY 1),
h AS (SELECT g.id, g.status AS old, CASE WHEN gone THEN 'DELETED' ELSE coalesce(s, g.status) END AS status FROM g LEFT JOIN a ON a.id = g.id)
SELECT 'item' AS what, item_id AS id, CASE WHEN h.status <> h.old THEN h.status WHEN item_group_id IS NULL THEN coalesce(s, w.status) ELSE w.status END AS status, new AS deleted, CASE WHEN new AND w.deleted THEN 2024 WHEN new THEN 2025 END AS since FROM w LEFT JOIN h ON h.id = item_group_id
UNION ALL SELECT 'group', CAST(id AS VARCHAR), status, status = 'DELETED', CASE WHEN status = 'DELETED' THEN 2025 END FROM h""")
def items_updated(spark, d):
    changes = star.table(spark, d, "part").where("p_size > 40").selectExpr(*_split(_cast(_CHANGES)))
    items, after = governance.items_updated(_part(spark, d, *_split(_cast(_UPDATED))), _part(spark, d, *_split(_OWN_GROUPS)).distinct(), changes, F.expr("TIMESTAMP '2025-06-01 00:00:00'"))
    row = lambda df, what, key: df.select(F.lit(what).alias("what"), F.col(key).cast("string").alias("id"), "status", "deleted", F.year("deleted_at").alias("since"))
    return row(items, "item", "item_id").unionByName(row(after, "group", "id"))


_LIFTED = """CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_partkey % 3 > 0 THEN 'PB_MEASURE' ELSE 'PB_TABLE' END AS item_type, 'g' || p_partkey % 300 AS group_id, 1 AS organization_id, p_brand AS dataset_name, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS expression, CAST(NULL AS VARCHAR) AS description,
CASE p_size % 6 WHEN 0 THEN 'Finance EU' WHEN 1 THEN 'commercial' WHEN 2 THEN 'Operations' WHEN 3 THEN 'Marketing' WHEN 4 THEN 'lab' END AS workspace_name, p_size % 11 = 0 AS is_group_primary, CASE WHEN p_size % 3 = 0 THEN p_size END AS ownership_person_id, CASE WHEN p_size % 4 = 0 THEN p_size END AS steward_id, CASE WHEN p_size % 7 = 0 THEN p_size END AS ownership_department_id,
CASE WHEN p_size % 13 = 0 THEN p_size END AS category_id, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_name END AS custom_description, CASE p_size % 5 WHEN 1 THEN 'UNVERIFIED' WHEN 2 THEN 'VERIFIED' WHEN 3 THEN 'ATTENTION' END AS status"""


@query(f"""WITH i AS (SELECT {_LIFTED} FROM part), k AS (SELECT *, CASE WHEN item_type = 'PB_MEASURE' THEN group_id ELSE 'item::' || item_id END AS key, CASE WHEN is_group_primary THEN 0 ELSE 1 END AS o0, CASE WHEN trim(expression) = '' OR regexp_matches(lower(expression), 'external\\s*measure') THEN 1 ELSE 0 END AS o1,
  CASE WHEN workspace_name = 'Finance EU' THEN 0 WHEN workspace_name = 'commercial' THEN 1 WHEN workspace_name = 'Operations' THEN 2 WHEN workspace_name = 'Marketing' THEN 3 ELSE 4 END AS o2 FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o0, o1, o2, dataset_name, item_id) AS n FROM k)
SELECT key AS group_key, CASE WHEN starts_with(key, 'item::') THEN 'singleton' ELSE 'measure_name' END AS kind, 1 AS organization_id, arg_min(ownership_department_id, n) FILTER (WHERE ownership_department_id IS NOT NULL) AS ownership_department_id, arg_min(ownership_person_id, n) FILTER (WHERE ownership_person_id IS NOT NULL) AS ownership_person_id,
arg_min(steward_id, n) FILTER (WHERE steward_id IS NOT NULL) AS steward_id, arg_min(category_id, n) FILTER (WHERE category_id IS NOT NULL) AS category_id, arg_min(custom_description, n) FILTER (WHERE custom_description <> '') AS custom_description, coalesce(arg_min(status, n) FILTER (WHERE status <> 'UNVERIFIED'), 'UNVERIFIED') AS status, arg_min(item_id, n) AS primary_item_id FROM r GROUP BY key""")
def groups_lifted(spark, d):
    return governance.lifted(_part(spark, d, *_split(_cast(_LIFTED))), groups.instance_order(F.col("is_group_primary")))


@query("""WITH m AS (SELECT p_brand AS ds, 't' || p_partkey % 8 AS home FROM part ORDER BY p_size DESC, p_partkey LIMIT 5), n AS (SELECT ds, home AS t FROM m UNION SELECT ds, 't5' FROM m),
rel AS (SELECT DISTINCT p_brand AS ds, 't0' AS ft, 'c1' AS fc, 't1' AS tt, 'c2' AS tc FROM part UNION SELECT DISTINCT p_brand, 't5', 'c3', 't6', 'c4' FROM part), e AS (SELECT ds, ft AS t, tt AS o FROM rel UNION ALL SELECT ds, tt, ft FROM rel),
tb AS (SELECT ds, t FROM n UNION SELECT e.ds, e.o FROM e JOIN n ON n.ds = e.ds AND n.t = e.t), k AS (SELECT ds, ft AS t, fc AS c FROM rel UNION SELECT ds, tt, tc FROM rel),
col AS (SELECT p_brand AS ds, 't' || p_partkey % 8 AS t, 'c' || p_size % 20 AS c, CAST(p_partkey AS VARCHAR) AS id FROM part), r AS (SELECT col.*, row_number() OVER (PARTITION BY col.ds, col.t ORDER BY CASE WHEN k.c IS NULL THEN 1 ELSE 0 END, col.c, id) AS n FROM col JOIN tb ON tb.ds = col.ds AND tb.t = col.t LEFT JOIN k ON k.ds = col.ds AND k.t = col.t AND k.c = col.c)
SELECT 'table' AS part, ds AS dataset_id, t AS table_name, NULL AS item_id FROM tb UNION ALL SELECT 'column', ds, t, id FROM r WHERE n <= 3 UNION ALL SELECT 'relationship', ds, ft, tt FROM rel WHERE ds IN (SELECT ds FROM m)""")
def measure_bundle(spark, d):
    part = star.table(spark, d, "part")
    measure = part.orderBy(F.desc("p_size"), "p_partkey").limit(5).selectExpr("cast(p_partkey AS string) AS item_id", "p_brand AS dataset_id", "concat('t', cast(p_partkey % 8 AS string)) AS table_name", "\"SUM('t5'[x])\" AS expression")
    items = part.selectExpr("cast(p_partkey AS string) AS item_id", "'PB_COLUMN' AS item_type", "p_brand AS dataset_id", "concat('t', cast(p_partkey % 8 AS string)) AS table_name", "concat('c', cast(p_size % 20 AS string)) AS item_name")
    joined = lambda *names: part.select(F.col("p_brand").alias("dataset_id"), *(F.lit(v).alias(c) for c, v in zip(("from_table", "from_column", "to_table", "to_column"), names, strict=True))).distinct()
    found = catalog.schema_bundle(measure, items, joined("t0", "c1", "t1", "c2").unionByName(joined("t5", "c3", "t6", "c4")), most_columns=3)
    row = lambda name, table, other: found[f"{name}s"].select(F.lit(name).alias("part"), "dataset_id", F.col(table).alias("table_name"), other.alias("item_id"))
    return row("table", "table", F.lit(None).cast("string")).unionByName(row("column", "table", F.col("item_id"))).unionByName(row("relationship", "from_table", F.col("to_table")))


@query(f"""WITH {star.MEASURES_SQL}, g AS (SELECT m.*, CASE WHEN p_size % 4 > 0 THEN p_partkey % 300 END AS grp, p_size % 6 AS reports FROM measures m JOIN part ON CAST(p_partkey AS VARCHAR) = item_id WHERE workspace_id <> 'ws3')
SELECT item_id, item_name, status FROM (SELECT item_id, item_name, 'S' || grp AS status, row_number() OVER (PARTITION BY coalesce(CAST(grp AS VARCHAR), 'name::' || item_name) ORDER BY reports DESC, connected_visuals DESC, item_name, item_id) AS k FROM g) WHERE k = 1""")
def context_listing(spark, d):
    more = _part(spark, d, "cast(p_partkey AS string) AS item_id", "CASE WHEN p_size % 4 > 0 THEN p_partkey % 300 END AS item_group_id", "p_size % 6 AS connected_reports").withColumn("status", F.concat(F.lit("S"), F.col("item_group_id").cast("string")))
    return groups.context_listing(star.measures(spark, d).join(more, "item_id"), ("ws0", "ws1", "ws2")).select("item_id", "item_name", "status")
