"""Text searches over the star tables as a project: suppliers are models and seeds, customers sources, parts tests. Each query has SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.text_search import TextIndex
from orrery.plans import starmap as star
from orrery.plans.queries import query

#: The projection of a table to items, the same text for both engines.
_ITEMS = {
    "supplier": """SELECT 'S' || s_suppkey AS item_id, s_name AS item_name, CASE WHEN s_suppkey % 7 = 0 THEN 'DBT_SEED' ELSE 'DBT_MODEL' END AS item_type, CASE WHEN s_suppkey % 3 = 0 THEN 'Account of NATION_' || s_nationkey || ' ' || repeat('- ', 90) || 'widget' END AS description,
  't_' || s_nationkey AS table_name, CASE WHEN s_suppkey % 4 > 0 THEN 'db' || s_suppkey % 4 END AS database_name, CASE WHEN s_suppkey % 5 > 0 THEN 'SELECT * FROM Widget_' || s_nationkey || ' WHERE brand = ''Brand#' || s_suppkey % 25 || '''' ELSE '' END AS expression, s_suppkey % 11 = 0 AS deleted FROM supplier""",
    "customer": "SELECT 'C' || c_custkey, c_name, 'DBT_SOURCE', c_mktsegment, 'raw.' || lower(c_mktsegment), 'NATION_' || c_nationkey, NULL, FALSE FROM customer",
    "part": "SELECT 'P' || p_partkey, p_name || ' ' || p_brand, 'DBT_TEST', CASE WHEN p_size % 2 = 0 THEN p_type END, NULL, NULL, 'select count(*) from t where name <> ''' || p_name || '''', FALSE FROM part",
}
_ASKS = """SELECT DISTINCT text AS ask_id, CASE WHEN text <> '(null)' THEN text END AS text FROM (SELECT n_name AS text FROM nation UNION ALL SELECT p_brand FROM part UNION ALL SELECT split(p_name, ' ')[{0}] FROM part UNION ALL SELECT upper(substr(split(p_name, ' ')[{0}], 1, 2)) FROM part
  UNION ALL SELECT substr(p_name, 3, 1) FROM part UNION ALL SELECT lower(p_name) FROM part UNION ALL SELECT '' UNION ALL SELECT '(null)' UNION ALL SELECT '100% no')"""
_CODES = "SELECT DISTINCT text AS ask_id, text FROM (SELECT upper(s_name) AS text FROM supplier UNION ALL SELECT ' S' || s_suppkey || ' ' FROM supplier UNION ALL SELECT p_name || ' ' || p_brand FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'T_' || n_nationkey FROM nation UNION ALL SELECT ' ')"
_ALL_SQL = "items AS (" + " UNION ALL ".join(_ITEMS.values()) + f"), asks AS ({_ASKS.format(1)})"


def _index(spark, d) -> TextIndex:
    items = None
    names = "item_id, item_name, item_type, description, table_name, database_name, expression, deleted"
    for name, sql in _ITEMS.items():
        one = spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=star.table(spark, d, name)).toDF(*names.split(", "))
        items = one if items is None else items.unionByName(one.withColumn("expression", F.col("expression").cast("string")))
    return TextIndex.build(items)


def _asked(spark, d, sql: str) -> DataFrame:
    tables = {name: star.table(spark, d, name) for name in ("nation", "part", "supplier")}
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **{k: v for k, v in tables.items() if f"{{{k}}}" in sql})


def _found(types: str, columns: tuple[str, ...], long: int) -> str:
    held = " OR ".join(f"contains(lower({c}), lower(text))" for c in columns)
    return f"""WITH {_ALL_SQL}, f AS (SELECT ask_id, text, item_id, item_name, item_type, database_name, table_name, substr(description, 1, 180) AS description, substr(expression, 1, {long}) AS sql,
 row_number() OVER (PARTITION BY ask_id ORDER BY database_name NULLS LAST, table_name NULLS LAST, item_name NULLS LAST, item_id) AS position FROM items JOIN asks ON coalesce(text, '') = '' OR {held} WHERE NOT deleted AND item_type IN ({types})) SELECT * FROM f WHERE position <= 10"""


_NAMES = ("item_name", "description", "table_name", "database_name")


@query(_found("'DBT_MODEL', 'DBT_SEED'", _NAMES, 240))
def search_models(spark, d):
    return _index(spark, d).search(_asked(spark, d, _ASKS.format(0)), "models")


@query(_found("'DBT_SOURCE'", _NAMES, 220))
def search_sources(spark, d):
    return _index(spark, d).search(_asked(spark, d, _ASKS.format(0)), "sources")


@query(_found("'DBT_TEST'", ("item_name", "description"), 220))
def search_tests(spark, d):
    return _index(spark, d).search(_asked(spark, d, _ASKS.format(0)), "tests")


@query(_found("'DBT_MODEL', 'DBT_SEED', 'DBT_TEST'", ("expression",), 220))
def search_bodies(spark, d):
    return _index(spark, d).search(_asked(spark, d, _ASKS.format(0)), "bodies")


@query(f"""WITH {_ALL_SQL}, c AS ({_CODES}), own AS (SELECT * FROM items WHERE NOT deleted AND item_type IN ('DBT_MODEL', 'DBT_SEED', 'DBT_TEST') AND expression <> ''),
s AS (SELECT ask_id, text, o.*, CASE WHEN item_id = trim(text) THEN 0 WHEN lower(item_name) = lower(trim(text)) THEN 1 ELSE 2 END AS stage FROM c JOIN own o ON trim(text) <> '' AND (item_id = trim(text) OR contains(lower(item_name), lower(trim(text))) OR contains(lower(table_name), lower(trim(text))) OR contains(lower(database_name), lower(trim(text))))),
k AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY item_name, item_id) AS place FROM s WHERE stage = (SELECT min(stage) FROM s t WHERE t.ask_id = s.ask_id)), n AS (SELECT *, count(*) OVER (PARTITION BY ask_id) AS n FROM k WHERE place <= CASE stage WHEN 0 THEN 2 ELSE 10 END)
SELECT c.ask_id, c.text, CASE WHEN n IS NULL THEN 'NONE' WHEN n = 1 THEN 'ONE' ELSE 'MANY' END AS status, stage, item_id, item_name, item_type, table_name, CASE WHEN n = 1 THEN expression END AS sql FROM c LEFT JOIN n ON n.ask_id = c.ask_id""")
def project_code(spark, d):
    return _index(spark, d).code(_asked(spark, d, _CODES))
