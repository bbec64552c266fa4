import json

import pytest
from pyspark.sql import functions as F

from orrery import schemas
from orrery.operators import column_lineage, load
from orrery.sources import dbt, files, registry, reports, tmdl
from orrery.sources import usage as usage_sources

TABLE = """table 'Sales Facts'
\tlineageTag: tag-table

\t/// All that was sold
\t/// in euros
\tmeasure 'Total Sales' = SUM('Sales Facts'[Amount])
\t\tformatString: 0.00
\t\tlineageTag: tag-total

\tmeasure Margin =
\t\t\tVAR x = [Total Sales]
\t\t\tRETURN x - SUM(Costs[Cost])
\t\tdescription: "what is left"

\tcolumn Amount
\t\tdataType: double
\t\tlineageTag: tag-amount
\t\tsummarizeBy: sum
\t\tsourceColumn: Amount

\tcolumn Double = [Amount] * 2
\t\tdataType: double

\tpartition Sales = m
\t\tmode: import
\t\tsource =
\t\t\t\tlet
\t\t\t\t\tSource = GoogleBigQuery.Database()
\t\t\t\tin
\t\t\t\t\tSource
"""
RELATIONSHIPS = """relationship 1111
\tfromColumn: 'Sales Facts'.Day
\ttoColumn: Dates.Day

relationship 2222
\tisActive: false
\tfromCardinality: one
\tcrossFilteringBehavior: bothDirections
\tfromColumn: Costs.Day
\ttoColumn: Dates.'The Day'

relationship broken
\tfromColumn: x
"""


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tmdl(spark):
    blocks = tmdl.tmdl_blocks(spark.createDataFrame([("a/b.tmdl", TABLE), ("a/c.tmdl", "table Empty\r\n")], "path string, content string")).collect()
    by = {(r.kind, r.name): r for r in blocks}
    assert set(by) == {("measure", "Total Sales"), ("measure", "Margin"), ("column", "Amount"), ("column", "Double"), ("partition", "Sales")}
    assert {r.table_name for r in blocks} == {"Sales Facts"} and {r.table_tag for r in blocks} == {"tag-table"}
    total, margin, amount, double, part = (by[k] for k in (("measure", "Total Sales"), ("measure", "Margin"), ("column", "Amount"), ("column", "Double"), ("partition", "Sales")))
    assert (total.expression, total.description, total.lineage_tag, total.format_string) == ("SUM('Sales Facts'[Amount])", "All that was sold in euros", "tag-total", "0.00")
    assert margin.expression == "VAR x = [Total Sales]\nRETURN x - SUM(Costs[Cost])" and margin.description == "what is left"
    assert (amount.type, amount.data_type, amount.lineage_tag, double.type, double.expression) == ("data", "double", "tag-amount", "calculated", "[Amount] * 2")
    assert part.type == "m" and "GoogleBigQuery" in part.expression


def test_tmdl_relationships(spark):
    found = tmdl.tmdl_relationships(spark.createDataFrame([("r", RELATIONSHIPS)], "path string, content string"))
    assert rows(found, "guid", "from_table", "from_column", "to_table", "to_column", "from_cardinality", "cross_filtering", "is_active") == [
        ("1111", "Sales Facts", "Day", "Dates", "Day", "many", "single", True), ("2222", "Costs", "Day", "Dates", "The Day", "one", "bothDirections", False),
    ]


def test_bim_comes_before_tmdl_and_dependencies(spark):
    bim = {"model": {"tables": [
        {"name": "Sales", "columns": [{"name": "Amount", "dataType": "double"}, {"name": "Secret", "isHidden": True}, {"name": "Twice", "type": "calculated", "expression": ["[Amount]", "* 2"]}], "measures": [{"name": "Total", "expression": "SUM('Sales'[Amount])"}, {"name": "Ratio", "expression": "DIVIDE([total], COUNTROWS(Sales))"}]},
        {"name": "LocalDateTable_1", "columns": [{"name": "Date"}]}]}}
    of = F.regexp_extract("path", "^([^/]+)/", 1)
    own = tmdl.bim_blocks(spark.createDataFrame([("one/model.bim", json.dumps(bim))], "path string, content string"))
    text = tmdl.tmdl_blocks(spark.createDataFrame([("one/x.tmdl", TABLE), ("two/x.tmdl", TABLE)], "path string, content string"))
    blocks = tmdl.models(text, own, of)
    assert rows(blocks.where("model = 'one'"), "kind", "name") == [("column", "Amount"), ("column", "Twice"), ("measure", "Ratio"), ("measure", "Total")]
    assert blocks.where("model = 'two'").count() == 5
    assert blocks.where("name = 'Twice'").first().expression == "[Amount]\n* 2"
    found = rows(tmdl.dependencies(blocks).where("model = 'one'"), "object", "referenced", "referenced_type", F.coalesce("referenced_table", F.lit("")))
    assert found == sorted([
        ("Ratio", "Total", "PB_MEASURE", ""), ("Ratio", "Sales", "PB_TABLE", ""), ("Total", "Amount", "PB_COLUMN", ""), ("Total", "Amount", "PB_COLUMN", "Sales"), ("Total", "Sales", "PB_TABLE", ""), ("Twice", "Amount", "PB_COLUMN", ""),
    ])


def test_reports_in_both_formats(spark):
    visual = {"name": "v1", "singleVisual": {"vcObjects": {"title": [{"properties": {"text": {"expr": {"Literal": {"Value": "'Sales'"}}}}}]}, "x": [{"Property": "Amount"}, {"Name": "Sales.Total"}, {"Name": "m"}, {"Property": "123"}]}}
    old = {"sections": [{"displayName": "P1", "visualContainers": [{"config": json.dumps(visual), "filters": '[{"Property": "Region"}]'}, {"config": "{}"}]}, {"displayName": "P2", "visualContainers": []}]}
    new = json.dumps({"name": "v9", "visual": {"visualContainerObjects": {"title": []}, "query": {"Name": "A.B.Cost"}}})
    paths = [("w/R1.Report/report.json", json.dumps(old)), ("w/R2.Report/definition/report.json", "{}"), ("w/R2.Report/definition/pages/p/page.json", '{"displayName": "Main"}'), ("w/R2.Report/definition/pages/p/visuals/f/visual.json", new), ("w/R1.Report/definition/pages/p/page.json", "{}"), ("w/R2.Report/definition/pages/q/visuals/f/visual.json", new)]
    every = spark.createDataFrame(paths, "path string, content string")
    of = F.regexp_extract("path", r"([^/]+)\.Report/", 1)
    found = reports.reports(reports.legacy(every.where(F.col("path").endswith("report.json")), of), reports.folders(every, of))
    text = lambda c: F.coalesce(F.col(c), F.lit("-")).alias(c)
    assert rows(found, "report", "page_name", text("visual_id"), text("field_name")) == sorted([
        ("R1", "P1", "Sales (v1)", "Amount"), ("R1", "P1", "Sales (v1)", "Region"), ("R1", "P1", "Sales (v1)", "Sales.Total"), ("R1", "P1", "Unknown (P1_visual_1)", "-"), ("R1", "P2", "-", "-"), ("R2", "Main", "Unknown (v9)", "A.B.Cost"),
    ])
    members = spark.createDataFrame([("Total", "PB_MEASURE"), ("Amount", "PB_COLUMN"), ("B.Cost", "PB_COLUMN"), ("Total", "PB_COLUMN")], "name string, type string")
    resolved = reports.resolved_fields(found, members)
    assert rows(resolved, "field_name", "member", "member_type") == [("A.B.Cost", "B.Cost", "PB_COLUMN"), ("Amount", "Amount", "PB_COLUMN"), ("Region", "Region", "PB_FIELD"), ("Sales.Total", "Total", "PB_MEASURE")]
    edges = reports.report_edges(found, resolved)
    assert edges.count() == edges.select("source_id", "target_id").distinct().count() == 3 + 3 + 4
    assert rows(edges.groupBy("target_type").count(), "target_type", "count") == [("PB_PAGE", 3), ("PB_REPORT", 3), ("PB_VISUAL", 4)]


MANIFEST = {
    "metadata": {"project_name": "shop"},
    "nodes": {
        "model.shop.stg": {"unique_id": "model.shop.stg", "resource_type": "model", "name": "stg", "alias": "stg_a", "database": "db", "schema": "s", "description": "staged", "raw_code": "select 1", "access": "public", "depends_on": {"nodes": ["source.shop.raw.orders"]}, "columns": {"id": {"name": "id", "description": "key"}}},
        "model.shop.fact": {"unique_id": "model.shop.fact", "resource_type": "model", "name": "fact", "database": "db", "schema": "s", "raw_code": "select 2", "depends_on": {"nodes": ["model.shop.stg"]}, "columns": {}},
        "test.shop.t": {"unique_id": "test.shop.t", "resource_type": "test", "name": "t", "depends_on": {"nodes": ["model.shop.fact"]}},
        "analysis.shop.x": {"unique_id": "analysis.shop.x", "resource_type": "analysis", "name": "x"},
    },
    "sources": {"source.shop.raw.orders": {"unique_id": "source.shop.raw.orders", "resource_type": "source", "name": "orders", "source_name": "raw", "identifier": "ORDERS", "loader": "stitch", "columns": {}}},
}
CATALOG = {"nodes": {"model.shop.stg": {"columns": {"ID": {"name": "ID", "type": "INT64", "index": 1, "comment": "other"}, "EXTRA": {"name": "EXTRA", "type": "STRING", "index": 2, "comment": "more"}}, "stats": {"rows": {"label": "Rows", "value": "10", "include": True}, "x": {"label": "X", "value": "1", "include": False}}}}, "sources": {}}


def test_project(spark, tmp_path):
    (tmp_path / "target").mkdir()
    (tmp_path / "target/manifest.json").write_text(json.dumps(MANIFEST))
    (tmp_path / "manifest.json").write_text("{}")
    (tmp_path / "catalog.json").write_text(json.dumps(CATALOG))
    tables = registry.SOURCES["dbt"](spark, {"folder": f"file://{tmp_path}"})
    items = tables["items"]
    assert rows(items.groupBy("item_type").count(), "item_type", "count") == [("DBT_COLUMN", 2), ("DBT_MODEL", 2), ("DBT_SOURCE", 1), ("DBT_TEST", 1), ("DBT_WORKSPACE", 1)]
    assert rows(items.where("item_type = 'DBT_COLUMN'"), "item_name", "datatype", "description") == [("EXTRA", "STRING", "more"), ("id", "INT64", "key")]
    stg = items.where("item_name = 'stg'").first()
    assert stg.description == "staged\nRows: 10" and stg.alias == "stg_a" and stg.meta == {"access": "public"}
    assert items.where("item_name = 'raw.ORDERS'").first().meta == {"loader": "stitch"}
    assert rows(tables["edges"], "source", "target", "target_type") == [("fact", "t", "DBT_TEST"), ("raw.ORDERS", "stg", "DBT_MODEL"), ("stg", "EXTRA", "DBT_COLUMN"), ("stg", "fact", "DBT_MODEL"), ("stg", "id", "DBT_COLUMN")]
    broken = dbt.parsed(spark.createDataFrame([("p", "{not json")], "path string, content string"), dbt.MANIFEST).first()
    assert broken.nodes is None


def test_resolved_refs(spark):
    df = spark.createDataFrame([("{{ config(a=1) }} select * from {{ ref('a') }} join {{ source('r', 'b') }}",), ("select {{ ref('no') }}",), ("{% if x %}1{% endif %}",)], "sql string")
    refs, sources = F.create_map(F.lit("a"), F.lit("db.s.a")), F.create_map(F.lit("r.b"), F.lit("db.r.b"))
    assert [r[0] and r[0].strip() for r in df.select(dbt.resolved_refs(F.col("sql"), refs, sources)).collect()] == ["select * from db.s.a join db.r.b", None, None]


def test_column_lineage(spark):
    relations = {"wh.raw.orders": {"id": "bigint", "amount": "double", "tax": "double"}, "wh.s.stg": {"id": "bigint", "amount": "double", "tax": "double"}}
    models = {
        "wh.s.stg": ("SELECT id, amount AS value, CASE WHEN tax > 0 THEN amount ELSE tax END AS net, SAFE_CAST(id AS INT64) AS n FROM `wh`.`raw`.`orders`", None),
        "wh.s.fact": ("WITH x AS (SELECT id, amount FROM wh.s.stg) SELECT x.id, sum(x.amount) AS total, count(*) AS n FROM x JOIN wh.s.stg s ON s.id = x.id GROUP BY x.id", None),
        "wh.s.union": (None, "SELECT id FROM wh.s.stg UNION ALL SELECT id FROM wh.raw.orders"),
        "wh.s.bad": ("SELEC nothing", "still {{ nothing }}"),
    }
    edges, skipped = column_lineage.project_lineage(spark, models, relations)
    assert skipped == ["wh.s.bad"]
    assert rows(edges, "source", "source_column", "target", "target_column", "lineage_type") == sorted([
        ("wh.raw.orders", "id", "wh.s.stg", "id", "pass-through"), ("wh.raw.orders", "amount", "wh.s.stg", "value", "rename"), ("wh.raw.orders", "amount", "wh.s.stg", "net", "transformation"),
        ("wh.raw.orders", "tax", "wh.s.stg", "net", "transformation"), ("wh.raw.orders", "id", "wh.s.stg", "n", "transformation"), ("wh.s.stg", "id", "wh.s.fact", "id", "pass-through"),
        ("wh.s.stg", "amount", "wh.s.fact", "total", "transformation"), ("wh.raw.orders", "id", "wh.s.union", "id", "transformation"), ("wh.s.stg", "id", "wh.s.union", "id", "transformation"),
    ])


def test_names_that_are_no_relations(spark):
    relations = {"wh.raw.orders": {"o_id": "bigint", "placed": "timestamp"}, "wh.s.stg_orders": {"o_id": "bigint", "placed": "timestamp"}}
    models = {
        "hidden": ("WITH orders AS (SELECT o_id AS id FROM wh.s.stg_orders), more AS (SELECT id FROM orders) SELECT id FROM more", None),
        "quoted": ("SELECT o_id, 'x FROM orders' AS note -- all FROM stg_orders\nFROM wh.raw.orders /* JOIN wh.s.stg_orders */", None),
        "field": ("SELECT EXTRACT(YEAR FROM placed) AS y FROM wh.raw.orders", None),
    }
    edges, skipped = column_lineage.project_lineage(spark, models, relations)
    assert skipped == []
    assert rows(edges, "source", "source_column", "target", "target_column", "lineage_type") == sorted([
        ("wh.s.stg_orders", "o_id", "hidden", "id", "pass-through"), ("wh.raw.orders", "o_id", "quoted", "o_id", "pass-through"), ("wh.raw.orders", "placed", "field", "y", "transformation"),
    ])


def test_column_lineage_of_a_project(spark):
    """A source, a staging model and a mart, and what may go wrong with their SQL."""
    source, stg, fct = "db.raw.orders", "db.analytics.stg_orders", "db.analytics.fct_revenue"
    relations = {source: dict.fromkeys(("order_id", "amount", "is_cancelled"), ""), stg: dict.fromkeys(("order_id", "amount", "is_cancelled"), ""), fct: dict.fromkeys(("order_id", "revenue"), "")}
    staging = "SELECT order_id, amount, is_cancelled FROM `db`.`raw`.`orders`"
    mart = "SELECT order_id, CASE WHEN is_cancelled THEN 0 ELSE amount END AS revenue FROM `db`.`analytics`.`stg_orders`"
    plain = [(source, c, stg, c, "pass-through") for c in ("order_id", "amount", "is_cancelled")]
    derived = [(stg, "order_id", fct, "order_id", "pass-through"), (stg, "amount", fct, "revenue", "transformation"), (stg, "is_cancelled", fct, "revenue", "transformation")]
    cases = (
        ((staging, None), (mart, None), plain + derived, []),
        (("", None), (mart, None), derived, [stg]),
        ((None, staging), (None, mart), plain + derived, []),
        ((staging, None), (None, "SELECT order_id, {{ my_macro() }} AS revenue FROM stg_orders"), plain, [fct]),
        ((staging, None), ("SELECT FROM WHERE ;;; not valid", None), plain, [fct]),
        ((staging.replace("`db`.`raw`.`orders`", "raw.orders"), None), (mart, None), plain + derived, []),
    )
    # Case i stands in a database of its own.
    put = lambda text, i: text and text.replace("db", f"db{i}").replace("raw.orders", f"`db{i}`.raw.orders").replace("FROM stg", f"FROM db{i}.analytics.stg")
    models = {name.replace("db", f"db{i}"): tuple(put(t, i) for t in case[of]) for i, case in enumerate(cases) for of, name in enumerate((stg, fct))}
    known = {name.replace("db", f"db{i}"): columns for i in range(len(cases)) for name, columns in relations.items()}
    edges, skipped = column_lineage.project_lineage(spark, models, known)
    assert skipped == sorted(name.replace("db", f"db{i}") for i, case in enumerate(cases) for name in case[3])
    want = [(a.replace("db", f"db{i}"), b, c.replace("db", f"db{i}"), d, e) for i, case in enumerate(cases) for a, b, c, d, e in case[2]]
    assert rows(edges, "source", "source_column", "target", "target_column", "lineage_type") == sorted(want)


def test_column_lineage_of_scopes(spark):
    """One model for each shape of SQL, as the table of its edges (target column: source columns) or the reason against it."""
    relations = {"w.r.t": dict.fromkeys(("id", "a", "b", "day"), ""), "w.r.u": dict.fromkeys(("id", "c"), ""), "w.s.u": {"z": ""}}
    cases = {
        "WITH t AS (SELECT id AS x FROM w.r.t), v AS (SELECT x FROM t) SELECT (x) FROM v": {"x": None, "": "ok"},
        "WITH t AS (SELECT * FROM t) SELECT * EXCEPT (id, day) FROM t": {"a": {"t.a"}, "b": {"t.b"}},
        "SELECT * FROM (SELECT id, a FROM t) q JOIN w.r.u USING (id)": {"id": {"t.id"}, "a": {"t.a"}, "c": {"u.c"}},
        "SELECT id, c FROM t JOIN w.r.u USING (id)": {"id": {"t.id"}, "c": {"u.c"}},
        "SELECT DATE_TRUNC(a, DAY) AS d, CAST(b AS DECIMAL(10, 2)) n, EXTRACT(DAY FROM a) AS e FROM t": {"d": {"t.a"}, "n": {"t.b"}, "e": {"t.a"}},
        "SELECT SUM(a) OVER (PARTITION BY b ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM t": {"s": {"t.a", "t.b", "t.id"}},
        "SELECT a.x.y AS f, T.b FROM w.r.t": {"f": {"t.a"}, "b": {"t.b"}},
        "SELECT x.id FROM w.r.t x, w.r.u AS y WHERE x.id IN (SELECT id FROM w.r.u)": {"id": {"t.id"}},
        "SELECT a FROM t UNION ALL (SELECT c FROM w.r.u EXCEPT DISTINCT SELECT b FROM t)": {"a": {"t.a", "t.b", "u.c"}},
        "SELECT ')' AS p, a /* ( */ FROM t -- (": {"a": {"t.a"}},
        "SELECT id FROM t, w.r.u": "ambiguous column id",
        "SELECT nothing FROM t": "unknown column nothing",
        "SELECT a FROM nowhere": "unknown relation nowhere",
        "SELECT z FROM u": "ambiguous relation u",
        "SELECT a FROM t, UNNEST(t.b) AS e": "source that is no name",
        "SELECT (a FROM t": "parentheses",
        "SELECT ')(' , a) FROM (t": "parentheses",
        "WITH RECURSIVE n AS (SELECT a FROM t) SELECT a FROM n": "recursion",
        "SELECT 'a FROM t": "open quote",
        "WITH u(x, y) AS (SELECT id, c FROM w.r.u) SELECT z FROM u": "column list of with",
        "SELECT SUM(a) OVER v AS s FROM t WINDOW v AS (PARTITION BY b)": "named window",
        "SELECT t.* REPLACE (1 AS a) FROM t": "changed star",
    }
    models = spark.createDataFrame([(f"m{i}", [sql]) for i, sql in enumerate(cases)] * 2 + [("none", None), (None, ["SELECT a FROM t"]), ("empty", [None, " "])], "model string, texts array<string>")
    columns = spark.createDataFrame([(r, c, i) for r, cs in relations.items() for i, c in enumerate(cs)] + [(None, "a", 0), ("w.r.t", None, 0), ("w.r.t", "a", 1)], "relation string, column string, place int")
    edges, reasons = column_lineage.lineage(models.withColumn("extra", F.lit(1)), columns.withColumn("model", F.lit("x")))
    got: dict[str, dict] = {}
    for r in edges.collect():
        got.setdefault(r.target, {}).setdefault(r.target_column, set()).add(r.source.split(".")[-1] + "." + r.source_column)
    why = {r.model: r.reason for r in reasons.collect()}
    for i, (sql, want) in enumerate(cases.items()):
        if isinstance(want, str):
            assert (sql, why.get(f"m{i}"), got.get(f"m{i}")) == (sql, want, None)
        elif "" not in want:
            assert (sql, got.get(f"m{i}"), why.get(f"m{i}")) == (sql, want, None)
    assert why["none"] == why["empty"] == "no sql" and len(why) == 2 + sum(isinstance(w, str) for w in cases.values())
    none = column_lineage.lineage(models.limit(0), columns.limit(0))
    assert none[0].count() == none[1].count() == 0


def test_usage_sources(spark):
    views = spark.createDataFrame([("A", "2026-05-02", 1, "web", "app", 5), ("A", "2026-05-09", 1, "web", "app", 3), ("A", "2026-05-02", 2, "web", "app", 3), ("B", "2026-05-02", 1, "web", "app", 0)], "report string, date string, user_key long, consumption string, distribution string, views int")
    users = spark.createDataFrame([(1, "{u-alice}", None), (2, None, "bob@x.org")], "user_key long, guid string, email string")
    found = usage_sources.modern(views, users, spark.createDataFrame([("bob@x.org", "Bob")], "email string, display_name string"), "2026-05-01")
    assert rows(found, F.col("month").cast("string"), "report_name", "user_email", "view_count") == [("2026-05-01", "A", "U-ALICE", 8), ("2026-05-01", "A", "bob@x.org", 3)]
    assert found.where("user_email = 'bob@x.org'").first().user_display_name == "Bob"
    keyed = lambda w: found.limit(0 if w is None else 9).withColumn("workspace_id", F.lit(w or ""))
    assert usage_sources.first_with_rows([keyed(None), keyed("w")], "workspace_id").count() == 2
    assert usage_sources.first_with_rows([keyed("w"), keyed("w")], "workspace_id").count() == 2


def test_uploads_staging_and_sinks(spark, tmp_path):
    text = "sep=;\ngroup_pk;owner\n1;Αλίκη\n2;\"Bob; B\"\n"
    for data in (b"\xef\xbb\xbf" + text.encode(), text.encode("cp1253")):
        assert rows(files.uploaded_csv(spark, data), "group_pk", "owner") == [("1", "Αλίκη"), ("2", "Bob; B")]
    (tmp_path / "a.csv").write_bytes("﻿item_id,item_name,is_unused,connected_reports\nx, Name ,T,12.7\ny,,no,\n".encode())
    staged = files.staged_csv(spark, f"file://{tmp_path}/a.csv")
    items = load.typed(staged, schemas.ITEMS)
    assert items.schema == schemas.ITEMS or [f.dataType for f in items.schema] == [f.dataType for f in schemas.ITEMS]
    assert [(r.item_id, r.item_name, r.is_unused, r.connected_reports, r.tags) for r in items.orderBy("item_id").collect()] == [("x", "Name", True, 13, None), ("y", None, False, 0, None)]
    registry.DESTINATIONS["csv"](items.limit(0), "My Items", {"path": f"file://{tmp_path}/out"})
    (out,) = (tmp_path / "out/my_items").glob("*.csv")
    assert out.read_text().startswith("item_id,lineage_tag,")
    registry.DESTINATIONS["parquet"](items, "items", {"path": f"file://{tmp_path}/out"})
    assert spark.read.parquet(f"file://{tmp_path}/out/items").count() == 2
    assert files.zipped([str(tmp_path)])[:2] == b"PK"


def test_schema_blocks_and_raw_sql(spark):
    text = "models:\n  - name: stg\n    columns:\n      - name: id\n  - name: other\nsources:\n  - name: raw\n"
    found = dbt.schema_blocks(spark.createDataFrame([("a.yml", text), ("bad.yml", "a: [")], "path string, content string"))
    assert rows(found, "kind", "name") == [("models", "other"), ("models", "stg"), ("sources", "raw")]
    assert found.where("name = 'stg'").first().properties_yaml == "name: stg\ncolumns:\n- name: id\n"
    own = spark.createDataFrame([("m/a.sql", None, "old"), ("m/b.sql", "kept", None)], "original_file_path string, raw_code string, raw_sql string")
    assert rows(dbt.with_raw_sql(own, spark.createDataFrame([("/p/m/a.sql", "select 1")], "path string, content string"), "/p"), "raw_code") == [("kept",), ("select 1",)]


def test_csv_with_a_byte_order_mark_reads_back(spark, tmp_path):
    from orrery.sources import files

    rows = spark.createDataFrame([(2, 'a "b", c'), (1, "é")], "id int, name string")
    files.write_csv(rows, str(tmp_path / "out"), ["id"], mark=True)
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,name")
    assert [tuple(r) for r in files.staged_csv(spark, str(part)).orderBy("id").collect()] == [("1", "é"), ("2", 'a "b", c')]


def test_warehouse_lists_and_guards(spark, tmp_path):
    from orrery.sources import warehouse

    spark.range(1000).write.parquet(str(tmp_path / "t"))
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    sql = f"SELECT a.id FROM parquet.`{tmp_path}/t` a JOIN parquet.`{tmp_path}/t` b ON a.id = b.id;"
    assert 0.9 * 2 * size < warehouse.estimated_bytes(spark, sql) < 1.1 * 2 * size
    assert warehouse.queried(spark, sql, 3 * size).count() == 1000
    for refused in (sql, "DROP TABLE t", ""):
        with pytest.raises(ValueError):
            warehouse.queried(spark, refused, size)
    spark.range(1).createOrReplaceTempView("listed_view")
    assert "default" in warehouse.databases(spark) and "listed_view" in warehouse.tables(spark, "`default`") and warehouse.columns(spark, "listed_view") == [("id", "bigint")]


def test_manifests_of_many_projects_and_above_the_size_of_a_variant(spark):
    import json

    def manifest(project, text):
        node = {"unique_id": f"model.{project}.a", "resource_type": "model", "name": "a", "raw_code": text, "meta": {"n": 1, "deep": {"x": [1]}}, "depends_on": {"nodes": []}, "columns": {}}
        return json.dumps({"metadata": {"project_name": project}, "nodes": {node["unique_id"]: node}, "sources": {}})

    files = spark.createDataFrame([("p", manifest("p", "select 1")), ("q", manifest("q", "x" * (17 << 20))), ("r", "{no"), ("s", None), ("t", "[]"), ("u", "{}")], "path string, content string")
    rows = {r["project"]: r for r in dbt.nodes(dbt.manifest_rows(files)).selectExpr("project", "item_type", "length(raw_code) AS n", "meta").collect()}
    assert {k: (r["item_type"], r["n"]) for k, r in rows.items()} == {"p": ("DBT_MODEL", 8), "q": ("DBT_MODEL", 17 << 20)}
    assert rows["p"]["meta"] == rows["q"]["meta"] == {"n": "1", "deep": '{"x":[1]}'}
    assert "r" in [r["path"] for r in dbt.broken(files).collect()]
