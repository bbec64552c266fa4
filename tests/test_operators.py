from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orrery import schemas
from orrery.functions import extract, names, rules
from orrery.operators import bridge, catalog, governance, graph, groups, load, profiles, relationships
from orrery.operators import usage as use

def now():
    return F.lit("2026-05-01 10:00:00").cast("timestamp")


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_names(spark):
    n = F.lit(None).cast("string")
    a, b, c = one(spark, names.custom_id(F.lit("Da ta"), F.lit("'X'")), names.custom_id(F.lit("data"), F.lit("x"), n), names.custom_id(F.lit("data"), F.lit(""), F.lit("x")))
    assert a == b != c and len(a) == 32
    assert one(spark, names.custom_id_skipping_blanks(F.lit("data"), F.lit(" "), F.lit("x")))[0] == a
    got = one(spark, names.bridge_name(F.lit(" `A b` ")), names.bridge_name(n), names.relation_name(F.lit("`Db`.`My T`")), names.guid(F.lit(" {ab-1} ")), names.qualified_name(F.lit("d"), F.lit(" "), n, F.lit("t")), names.qualified_name(n, n, n, F.lit("")), names.clean_label(F.lit("PB_TABLE::Sales (c9f60527)")), names.one_line(F.lit("a\nbcdef"), 5), names.slug(F.lit(" My File! ")), names.initials(F.lit(""), F.lit("ada.love@x")), names.initials(F.lit("Bo"), n), names.id_of_node(F.lit("PB_A::x::y")), names.type_of_node(F.lit("PB_A::x::y")))
    assert tuple(got) == ("a b", "", "db.myt", "AB-1", "d.t", "(no FQN)", "Sales", "a bc…", "my_file", "AL", "BO", "x::y", "PB_A")
    assert one(spark, names.distinct_names(F.array(F.lit(" Sales"), F.lit("sales "), F.lit(""), n, F.lit("Costs"))))[0] == ["Sales", "Costs"]
    assert [str(x) for x in one(spark, names.month_of(F.lit("2026-05-17")), names.months_ago(3, F.lit("2026-01-31").cast("date")))] == ["2026-05-01", "2025-10-01"]


def test_rules(spark):
    kinds = {"INT64": ("numeric", "#"), "VARCHAR": ("text", "Aa"), "timestamp": ("date", "◷"), "boolean": ("boolean", "⊨"), "datestring": ("date", "Aa"), "": ("other", "•"), "geo": ("other", "•")}
    df = spark.createDataFrame([(k,) for k in kinds], "t string")
    assert {r[0]: (r[1], r[2]) for r in df.select("t", rules.data_kind(F.col("t")), rules.data_glyph(F.col("t"))).collect()} == kinds
    text = lambda *x: [F.lit(v) for v in x]
    assert tuple(one(spark, rules.card_layer(*text("DBT_MODEL", "stg_x", None)), rules.card_layer(*text("DBT_MODEL", "dim_x", "")), rules.card_layer(*text("PB_TABLE", "x", "measures")), rules.model_type(F.lit("db.s.fact_x")), rules.model_type(F.lit("other")))) == ("staging", "marts", "measures", "fact", "unknown")
    assert tuple(one(spark, rules.is_external_measure(F.lit(" "), F.lit("x")), rules.is_external_measure(F.lit("1"), F.lit("An External  measure")), rules.is_external_measure(F.lit("1"), F.lit(None)))) == (True, True, False)


def test_extraction(spark):
    m = F.lit('let S = GoogleBigQuery.Database(), a = S{[Name="proj"]}[Data], b = a{[Name="ds",Kind="Schema"]}[Data], c = b{[Name="v",Kind="View"]}[Data] in c')
    sql = F.lit("Value.NativeQuery(x, \"select * from `p-1`.`d`.`t` where 1\")")
    other = F.lit('Excel.Workbook(File.Contents("a.xlsx")){[Name="Sheet1"]}')
    assert [tuple(x) for x in one(spark, *(extract.warehouse_source(x) for x in (m, sql, other)))] == [("proj", "ds", "v", "View"), ("p-1", "d", "t", "SQL Query"), (None, None, None, None)]
    dax = F.lit("CALCULATE([A], USERELATIONSHIP('My T'[x], Dates[ y ]))")
    assert [tuple(r) for r in one(spark, extract.activated_relationships(dax))[0]] == [("My T", "x", "Dates", "y")]
    wrapper, mixed = one(spark, extract.external_target(F.lit('EXTERNALMEASURE("Sales", INTEGER, "DirectQuery to AS - Finance")')), extract.external_target(F.lit('EXTERNALMEASURE("S", X, "F") + SUM(T[c])')))
    assert tuple(wrapper) == (True, "Sales", "Finance") and not mixed.is_wrapper
    cases = {"select 1;": "ok", "with a as (select 1) select * from a": "ok", "-- x\ndelete from t": "not read-only", "select 1; select 2": "several statements", "select drop from t": "write verb", " ": "empty"}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert dict(map(tuple, df.select("q", extract.read_only_verdict(F.col("q"))).collect())) == cases
    assert extract.is_read_only(spark, "select 1")[0] and not extract.is_read_only(spark, "drop table x")[0]
    assert tuple(one(spark, *(extract.dax_verdict(F.lit(x), 2026) for x in ("EVALUATE ROW(\"r\", DATE(2026,1,1))", "EVALUATE x DATE(2019, 1, 1)", "[m]")))) == ("ok", "year", "not EVALUATE")
    assert extract.cron("weekly", "3", "1") == "0 3 * * 1" and extract.cron("yearly") is None


def test_usage(spark):
    data = [("2026-05-01", "A", "alice", 5), ("2026-05-01", "A", "bob", 3), ("2026-05-01", "B", "alice", 2), ("2026-04-01", "A", "alice", 4)]
    usage = spark.createDataFrame(data, "month string, report_name string, user_email string, view_count int").withColumn("month", F.col("month").cast("date"))
    assert use.dimensions("month,nothing,report_name,month") == ["month", "report_name"] and use.dimensions("x") == list(use.DEFAULT)
    found = use.usage_pivot(usage, "month,report_name")
    assert [(r.report_name, r.views, r.users) for r in found.orderBy(F.desc("views")).collect()] == [("A", 8, 2), ("A", 4, 1), ("B", 2, 1)]
    totals = use.usage_totals(usage, "month", "report_name").where("level = 3").first()
    assert (totals.views, totals.users) == (14, 2)


def graph_of(spark, *pairs, **more):
    return spark.createDataFrame([(a, b, more.get("kind", "model"), more.get("level", "asset")) for a, b in pairs], "source string, target string, kind string, level string")


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def test_traversal_with_cycles_blocks_and_caps(spark):
    edges = graph_of(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a"))
    assert rows(graph.reachable(edges, starts(spark, "a"))) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.reachable(edges, starts(spark, "a"), "up")) == [("a", 0), ("b", 2), ("c", 1), ("x", 1)]
    assert rows(graph.reachable(edges, starts(spark, "a"), depth=1)) == [("a", 0), ("b", 1)]
    assert rows(graph.reachable(edges, starts(spark, "a"), most=2)) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.reachable(edges, starts(spark, "a"), blocked=starts(spark, "b"))) == [("a", 0)]
    assert rows(graph.closure(edges, starts(spark, "d"))) == [(n, "d") for n in ("a", "b", "c", "x")]


def test_paths(spark):
    edges = graph_of(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "x"), ("x", "y"), ("y", "e"))
    assert [tuple(r.path) for r in graph.shortest_paths(edges, "a", "e").orderBy("path").collect()] == [("a", "b", "d", "e"), ("a", "c", "d", "e"), ("a", "x", "y", "e")]
    assert [tuple(r.path) for r in graph.shortest_paths(edges, "a", "e", most=1).collect()] == [("a", "b", "d", "e")]
    assert graph.shortest_paths(edges, "a", "e", depth=2).count() == 0 and graph.shortest_paths(edges, "e", "a").count() == 0
    assert [tuple(r.path) for r in graph.shortest_paths(edges, "e", "a", "up", blocked=starts(spark, "b", "c", "e")).collect()] == [("e", "y", "x", "a")]
    assert [tuple(r.path) for r in graph.shortest_paths(edges, "a", "a").collect()] == [("a",)]


def test_paths_from_both_ends_pass_a_hub_by(spark, monkeypatch):
    """A hub leads to 400 nodes, which lead to 400 more; the target has one step into it, so the search goes back from there."""
    pairs = [("s", "hub"), ("t2", "t"), ("hub", "t1"), ("t1", "t2"), ("t", "s")] + [("hub", f"n{i}") for i in range(400)] + [(f"n{i}", f"m{i}") for i in range(400)]
    edges = spark.createDataFrame(pairs * 2, "source string, target string")
    kept, plain = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: (kept.append(df.count()) if df.columns == ["node_id"] else None, plain(df))[1])
    assert [(tuple(r.path), r.hops) for r in graph.shortest_paths(edges, "s", "t").collect()] == [(("s", "hub", "t1", "t2", "t"), 4)]
    from_both = sum(kept)
    from_one = graph.reachable(edges, spark.createDataFrame([("s",)], "node_id string"), until="t").count()
    assert from_both * 2 < from_one



def test_layers_egos_and_cards(spark):
    edges = graph_of(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("p", "q"), ("q", "p"))
    assert rows(graph.layers(edges, starts(spark, *"abcpqz"))) == [("a", 0), ("b", 1), ("c", 2), ("p", 0), ("q", 0), ("z", 0)]
    near, inside = graph.ego(edges, starts(spark, "b"), 1)
    assert rows(near) == [("a", 1), ("b", 0), ("c", 1)] and inside.count() == 3
    boxes = graph_of(spark, ("T", "T.x"), ("S", "S.x"), ("R", "T.x"), kind="contains", level="column")
    columns = graph_of(spark, ("S.x", "T.x"), kind="column", level="column").unionByName(boxes).unionByName(graph_of(spark, ("T.x", "v"), ("v", "p")))
    assert {r[0] for r in graph.column_ego(columns, "T")[0].collect()} == {"T", "T.x", "S.x", "S", "R", "v", "p"}
    nodes = spark.createDataFrame([("T", "PB_TABLE"), ("T.x", "PB_COLUMN"), ("m", "PB_MEASURE"), ("v", "PB_VISUAL"), ("lost", "PB_FIELD")], "node_id string, group string")
    assert rows(graph.cards(nodes, columns)) == [("T", "T", "model"), ("T.x", "R", "model"), ("lost", "group::PB_FIELD", "model"), ("m", "m", "measures"), ("v", "v", "report")]
    assert rows(graph.members(columns, "R")) == [("T.x",)] and rows(graph.members(columns, "T")) == []


def test_merge_and_visibility(spark):
    old, new = spark.createDataFrame([("a", "A", "g"), ("b", "B", "g")], "node_id string, name string, group string"), spark.createDataFrame([("b", "B2", None), ("c", "C", "h")], "node_id string, name string, group string")
    nodes, edges, fresh = graph.merged(old, graph_of(spark, ("a", "b")), new, graph_of(spark, ("a", "b"), ("b", "c")))
    assert rows(nodes) == [("a", "A", "g"), ("b", "B2", "g"), ("c", "C", "h")] and edges.count() == 2 and rows(fresh) == [("c",)]
    kept, links = graph.visible(nodes, edges, hidden_groups=["h"])
    assert kept.count() == 2 and rows(links, "source", "target") == [("a", "b")]


def models(spark, *data):
    return spark.createDataFrame(list(data), "item_id string, database_name string, schema_name string, alias string, table_name string")


def tables(spark, *data):
    return spark.createDataFrame(list(data), "item_id string, item_name string, bq_project string, bq_schema string, bq_source_name string")


@pytest.mark.parametrize(
    ("model_rows", "table_rows", "want"),
    [
        ([("m", "DB", "s", "orders", "x")], [("t", "renamed", "`db`", "S", "Orders")], [("t", "m", "bq_fqn")]),
        ([("m", "db", None, None, "s.orders")], [("t", "q", "db", "s", "orders")], [("t", "m", "bq_fqn")]),
        ([("m", None, None, None, "Orders")], [("t", "orders", None, None, None)], [("t", "m", "name_full")]),
        ([("m", None, None, None, "s.Orders")], [("t", "orders", None, None, None)], [("t", "m", "name_tail")]),
        ([("m", None, None, None, "s.orders"), ("n", None, None, None, "r.orders")], [("t", "orders", None, None, None)], []),
        ([("m", "d", "s", "o", "first"), ("n", "d", "s", "o", "second")], [("t", "second", "d", "s", "o")], [("t", "n", "name_full")]),
        ([("m", None, None, None, None)], [("t", None, None, None, None)], []),
    ],
)
def test_bridge_matching(spark, model_rows, table_rows, want):
    assert rows(bridge.bridge_tables(tables(spark, *table_rows), models(spark, *model_rows)), "pbi_item_id", "dbt_item_id", "reason") == want


def test_bridge_build_is_idempotent(spark):
    pairs = bridge.bridge_tables(tables(spark, ("t", "orders", None, None, None)), models(spark, ("m", None, None, None, "orders")))
    column = lambda *data: spark.createDataFrame(list(data), "owner string, item_id string, item_name string")
    columns = bridge.bridge_columns(pairs, column(("t", "c2", "ID"), ("t", "c1", "id")), column(("m", "d1", "`id`"), ("m", "d2", "other")))
    edges = graph_of(spark, ("x", "y")).withColumn("bridge_reason", F.lit(None).cast("string")).withColumn("lineage_type", F.lit(None).cast("string"))
    once = bridge.build_bridges(edges, pairs, columns)
    twice = bridge.build_bridges(once, pairs, columns)
    assert rows(once, "source", "target", "bridge_reason") == rows(twice, "source", "target", "bridge_reason")
    assert rows(bridge.reasons(once)) == [("column_name", 1), ("name_full", 1)]


def test_relationships(spark):
    data = [("ds", "Sales", "day", "Dates", "day", "many", "one", "single", True), ("ds", "Costs", "day", "Dates", "day", "many", "one", "single", False), ("ds", "Dates", "m", "Months", "m", "many", "one", "single", True), ("other", "Sales", "x", "Costs", "x", "one", "one", "single", True)]
    rel = spark.createDataFrame(data, "dataset_id string, from_table string, from_column string, to_table string, to_column string, from_cardinality string, to_cardinality string, cross_filter string, is_active boolean")
    found = relationships.paths(rel, "ds", "Sales", "Costs").first()
    assert (found.path, found.cardinalities, found.inactive_hops, found.hops) == (["sales", "dates", "costs"], ["m:o", "o:m"], 1, 2)
    status = lambda *a: relationships.verdict(relationships.paths(rel, "ds", *a)).first()[0]
    assert [status("Sales", "Sales"), status("Sales", "Months"), status("Sales", "Costs"), status("Sales", "Nowhere")] == ["OK", "OK", "INACTIVE", "REFUSED"]
    assert {(r.table_name, len(r.relationships_json)) for r in relationships.indexed(rel).where("dataset_id = 'ds'").collect()} == {("Sales", 1), ("Costs", 1), ("Dates", 2), ("Dates", 1), ("Months", 1)}


def items(spark, *data):
    df = spark.createDataFrame([dict(x) for x in data], "item_id string, item_name string, item_type string, description string, service string, organization_id long, tags array<string>")
    return load.typed(df.select(*(F.col(c) for c in df.columns)), schemas.ITEMS)


def test_loading_items_twice_changes_nothing(spark):
    old = items(spark, {"item_id": "a", "item_name": "A", "service": "bi", "item_type": "PB_MEASURE"}, {"item_id": "gone", "item_name": "G", "service": "bi"}, {"item_id": "dbt", "item_name": "D", "service": "dbt"})
    old = old.withColumn("status", F.lit("VERIFIED")).withColumn("tags", F.array(F.lit("kept")))
    new = items(spark, {"item_id": "a", "item_name": "A2", "service": "bi", "item_type": "PB_MEASURE"}, {"item_id": "b", "item_name": "B", "service": "bi"}, {"item_id": None, "item_name": "nobody", "service": "bi"})
    once = load.load_items(old, new, load.BI_POLICY, "bi", now=now())
    got = {r.item_id: r for r in once.collect()}
    assert {k: r.deleted for k, r in got.items()} == {"a": False, "b": False, "gone": True, "dbt": False}
    assert (got["a"].item_name, got["a"].status, got["a"].tags, got["a"].group_id) == ("A2", "VERIFIED", ["kept"], "0::a2") and got["b"].status == "UNVERIFIED"
    assert got["gone"].deleted_at == datetime(2026, 5, 1, 10)
    assert rows(load.load_items(once, new, load.BI_POLICY, "bi", now=now())) == rows(once)
    linked, every = load.with_groups(once, spark.createDataFrame([], schemas.GROUPS))
    again, same = load.with_groups(linked, every)
    assert rows(again) == rows(linked) and rows(same) == rows(every) and every.count() == 4


def test_months_replaced(spark):
    of = lambda *data: spark.createDataFrame(list(data), "month string, organization_id long, integration_source_id long, v int")
    old, new = of(("1", None, 1, 1), ("2", None, 1, 2), ("2", 7, 1, 3)), of(("2", None, 1, 9))
    assert rows(load.months_replaced(old, new), "month", "v") == [("1", 1), ("2", 3), ("2", 9)]
    assert load.months_replaced(old, new.limit(0)).count() == 3


def group_rows(spark, *data):
    names_ = [f.name for f in schemas.GROUPS]
    return spark.createDataFrame([tuple(d.get(n) for n in names_) for d in data], schemas.GROUPS)


def test_governance(spark):
    own = group_rows(spark, {"id": 1, "group_key": "k1", "status": "VERIFIED", "deleted": False, "steward_id": 5}, {"id": 2, "group_key": "k2", "status": "DELETED", "deleted": True, "ownership_person_id": 6})
    changes = spark.createDataFrame([(1, None, True), (2, "VERIFIED", None)], "id long, status string, deleted boolean")
    after = governance.changed(own, changes, now())
    assert rows(after, "id", "status", "deleted") == [(1, "DELETED", True), (2, "VERIFIED", False)]
    assert rows(governance.status_log(own, after, now()), "group_id", "old_status", "new_status") == [(1, "VERIFIED", "DELETED"), (2, "DELETED", "VERIFIED")]
    tasks = governance.synced_tasks(spark.createDataFrame([], schemas.TASKS), after, now())
    assert rows(tasks, "group_id", "state", "assignee_id") == [(1, "open", 5)]
    assert rows(governance.synced_tasks(tasks, after, now())) == rows(tasks)
    done = governance.done(tasks, tasks.select("id"), now())
    assert rows(governance.synced_tasks(done, after, now()), "group_id", "state") == [(1, "done"), (1, "open")]
    linked = items(spark, {"item_id": "a"}, {"item_id": "z"}).withColumn("item_group_id", F.when(F.col("item_id") == "a", 1).cast("long"))
    assert rows(governance.cascaded(linked, after), "item_id", "status", "deleted") == [("a", "DELETED", True), ("z", None, False)]


def test_governance_import(spark):
    own = group_rows(spark, {"id": 1, "group_key": "k1", "status": "UNVERIFIED", "ownership_person_id": 9}, {"id": 2, "group_key": "k2", "status": "UNVERIFIED", "category_id": 3})
    people = spark.createDataFrame([(1, "Alice", 7), (2, "alice", None), (3, "Bob", None), (4, "bob ", None)], "id long, name string, organization_id long")
    csv = [("1", "", "", "", " ALICE ", "Nobody", "", "", "new words"), ("", "k2", "", "verified", "", "bob", "", "", ""), ("77", "", "", "", "", "", "", "", ""), ("2", "", "", "wrong", "", "", "", "", "")]
    sheet = spark.createDataFrame(csv, "group_pk string, group_id string, kind string, status string, owner string, steward string, department string, category string, custom_description string")
    done, report = governance.imported(own, sheet, people, people.limit(0), people.limit(0))
    assert rows(done, "id", "ownership_person_id", "status", "category_id", "custom_description") == [(1, 1, "UNVERIFIED", None, "new words"), (2, None, "VERIFIED", 3, None)]
    assert rows(report, "field", "outcome") == [("group", "unknown"), ("status", "invalid"), ("steward", "ambiguous"), ("steward", "unknown")]


def test_groups_and_catalog(spark):
    data = [("1", "A", "x", "external measure", "Finance", "d1"), ("2", "A", "SUM(x)", "", "Marketing", "d2"), ("3", "A", "SUM(y)", "text", "Commercial", "d1")]
    measures = spark.createDataFrame(data, "item_id string, group_id string, expression string, description string, workspace_name string, dataset_name string").withColumn("dataset_id", F.col("dataset_name")).withColumn("workspace_id", F.col("workspace_name"))
    assert groups.representatives(measures).first().item_id == "3" and groups.representatives(measures, F.col("item_id") == "2").first().item_id == "2"
    assert groups.surface(measures, primary=F.col("item_id") == "2").first().description == "text"
    assert rows(groups.spans(measures)) == [("A", 3, 2)]
    named = spark.createDataFrame([("1", "Sales", "PB_TABLE"), ("2", "sales total", "PB_MEASURE"), ("3", "Sales", "PB_MEASURE")], "item_id string, item_name string, item_type string")
    look = lambda t: [(r.item_id, r.stage) for r in catalog.staged_lookup(named, t).collect()]
    assert look("2") == [("2", 0)] and look("SALES") == [("3", 1), ("1", 1)] and look("tot") == [("2", 2)] and look("50%") == []
    assert catalog.by_text(named, "(", "regex").count() == 3 and catalog.by_text(named, "^sales$", "regex").count() == 2
    assert catalog.disambiguated(named, "sales")[0] == "MANY" and catalog.disambiguated(named, "none")[0] == "NONE"
    assert catalog.markdown(named.orderBy("item_id"), 1).endswith("| 1 | Sales | PB_TABLE |")
    assert ("a.b", "int") in catalog.flat_schema(spark.createDataFrame([], "a struct<b: int>"))


def test_activity(spark):
    from orrery.operators import activity

    runs = spark.createDataFrame([(1, "s", "failed", "2026-04-30 12:00:00"), (2, "s", "success", "2026-05-01 09:00:00"), (3, "t", "queued", None)], "id int, source_id string, state string, at string")
    runs = runs.withColumn("ended_at", F.col("at").cast("timestamp")).withColumn("started_at", F.col("ended_at"))
    got = activity.queue_counters(runs, now()).first()
    assert (got.queued, got.success, got.failed, got.success_last_day, got.failed_last_day) == (1, 1, 1, 1, 1)
    assert rows(activity.run_status(runs), "source_id", "state", "failed") == [("s", "success", 1), ("t", None, 0)] or rows(activity.run_status(runs), "source_id", "failed") == [("s", 1), ("t", 0)]
    left = spark.createDataFrame([(" a", None, 1), ("b", 5, 2)], "k string, v int, w int")
    assert rows(activity.filled(left, spark.createDataFrame([("a ", 7), ("b", 9)], "k string, v int"), ["k"], ["v"])) == [(" a", 7, 1), ("b", 5, 2)]
    calls = spark.createDataFrame([("x", False, 1.0), ("x", True, 3.0)], "tool string, is_error boolean, seconds double")
    assert rows(activity.tool_calls(calls)) == [("x", 2, 1, 2.0), (None, 2, 1, 2.0)] or rows(activity.tool_calls(calls)) == sorted([(None, 2, 1, 2.0), ("x", 2, 1, 2.0)], key=repr)


def test_stream_rollup(spark, tmp_path):
    from orrery.streaming import usage as stream

    data = [("2026-05-01 10:00:00", "A", "u"), ("2026-05-01 11:00:00", "A", "v"), ("2026-05-09 11:00:00", "B", "v")]
    spark.createDataFrame(data, "ts string, report_name string, user_email string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"file://{tmp_path}/in")
    events = spark.readStream.schema("ts timestamp, report_name string, user_email string").parquet(f"file://{tmp_path}/in")
    stream.keep(stream.daily_views(events), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(120)
    assert rows(spark.read.parquet(f"file://{tmp_path}/out"), "report_name", "views", "users") == [("A", 2, 2)]


def test_report_health_is_ordered_by_any_column(spark):
    items = spark.createDataFrame([("a", "Beta", "w", 2, 4, 1), ("b", "Alpha", None, 0, 9, 0), ("c", None, "w", 1, 1, 1), ("d", "x", "w", 1, 1, 1)], "item_id string, item_name string, workspace_name string, connected_pages int, connected_visuals int, connected_measures int").withColumn("item_type", F.when(F.col("item_id") == "d", "PB_PAGE").otherwise("PB_REPORT"))
    ids = lambda **how: [r["item_id"] for r in profiles.report_health(items, **how).collect()]
    assert ids() == ["b", "a", "c"] and ids(by="name") == ["b", "a", "c"] and ids(by="pages", descending=False) == ["b", "c", "a"] and ids(workspace="w") == ["a", "c"]
    rows = {r["item_id"]: r for r in profiles.report_health(items).collect()}
    assert rows["b"]["ratio"] == 9.0 and rows["b"]["workspace"] == "—" and rows["c"]["name"] == "Unknown" and rows["a"]["complexity"] == 5 and rows["a"]["columns"] == 0
    with pytest.raises(ValueError):
        profiles.report_health(items, by="salary")


def test_an_update_reaches_the_group_and_its_items(spark):
    now = F.expr("TIMESTAMP '2025-06-01 00:00:00'")
    items = spark.createDataFrame([("a", 1, "VERIFIED", False, None), ("b", 1, "VERIFIED", False, None), ("c", None, "VERIFIED", True, datetime(2024, 1, 1)), ("d", 2, "ATTENTION", None, None)], "item_id string, item_group_id int, status string, deleted boolean, deleted_at timestamp")
    own = spark.createDataFrame([(1, "VERIFIED", False, None), (2, "ATTENTION", False, None)], "id int, status string, deleted boolean, deleted_at timestamp")
    changes = spark.createDataFrame([("a", None, True), ("c", "ATTENTION", False), ("d", "nonsense", None)], "item_id string, status string, deleted boolean")
    got, after = governance.items_updated(items, own, changes, now)
    got = {r["item_id"]: (r["status"], r["deleted"], r["deleted_at"] and r["deleted_at"].year) for r in got.collect()}
    assert got == {"a": ("DELETED", True, 2025), "b": ("DELETED", False, None), "c": ("ATTENTION", False, None), "d": ("ATTENTION", False, None)}
    assert {r["id"]: (r["status"], r["deleted"]) for r in after.collect()} == {1: ("DELETED", True), 2: ("ATTENTION", False)}
    empty, same = governance.items_updated(items.limit(0), own, changes.limit(0), now)
    assert empty.isEmpty() and sorted(same.collect()) == sorted(own.collect())


def plain_reach(pairs):
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    found = {}
    for start in {x for p in pairs for x in p}:
        seen, todo = set(), list(ahead.get(start, ()))
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo.extend(ahead.get(x, ()))
        found[start] = seen
    return found


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 24, 30), (4, 12, 11)])
def test_reached_counts_with_cycles(spark, seed, n, m):
    import random

    rng = random.Random(seed)
    name = lambda i: f"{'AB'[i % 2]}::{i}"
    pairs = [(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(m)] + [("A::x", "A::x"), ("A::y", "A::x")]
    edges = spark.createDataFrame(pairs * 2, "source string, target string")
    nodes = spark.createDataFrame([(name(i), f"n{i % 7}", "AB"[i % 2]) for i in range(n)] + [("A::x", "x", "A")], "node_id string, name string, group string")
    want = {}
    for node, seen in plain_reach(pairs).items():
        for x in seen:
            i = x.split("::")[1]
            ids, names_ = want.setdefault((node, x[0]), (set(), set()))
            if i != "y":
                ids.add(x)
                names_.add("x" if i == "x" else f"n{int(i) % 7}")
    got = {(r["node_id"], r["group"]): (r["ids"], r["names"]) for r in graph.downstream_counts(edges, nodes, ["A", "B"]).collect()}
    assert got == {k: (len(a), len(b)) for k, (a, b) in want.items()}


def test_marks_with_near_names_share_blocks(spark):
    from orrery.operators import reach

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(640).select(F.lit("a").alias("node_id"), F.lit("k").alias("kind"), F.format_string("x%04d", "id").alias("what"))
        blocks = reach.marks(rows).groupBy("block").agg(F.bit_count(F.bit_or("bits")).alias("n")).collect()
        few = reach.marks(rows.withColumn("node_id", F.when(F.col("what") < "x0064", "near").otherwise("far"))).where("node_id = 'near'").select("block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["n"] for r in blocks) == 640
    assert few <= 2


def test_a_name_of_one_node_and_a_shared_one_are_counted(spark):
    edges = spark.createDataFrame([("r", x) for x in "abcd"], "source string, target string")
    nodes = spark.createDataFrame([("a", "one", "A"), ("b", "two", "A"), ("c", "two", "A"), ("d", None, "A"), ("d", "one more", "A"), ("a", "one", "A")], "node_id string, name string, group string")
    assert [tuple(r) for r in graph.downstream_counts(edges, nodes, ["A"]).select("node_id", "group", "names", "ids").collect()] == [("r", "A", 3, 4)]


def test_reached_counts_of_nothing(spark):
    edges = spark.createDataFrame([], "source string, target string")
    nodes = spark.createDataFrame([("A::1", "x", "A")], "node_id string, name string, group string")
    assert graph.downstream_counts(edges, nodes, ["A"]).collect() == []


def test_layers_write_no_more_rows_than_nodes_and_edges(spark, monkeypatch):
    from orrery import storage
    from orrery.operators import reach

    written = []
    add = storage.Rounds.add
    monkeypatch.setattr(reach.Rounds, "add", lambda self, k, df: (written.append(df.count()), add(self, k, df))[1])
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [(f"n{i}", f"n{i + 3}") for i in range(3)] + [("c1", "c2"), ("c2", "c1"), ("c2", "n0x"), ("n3", "c1")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "node_id string")
    got = dict(tuple(r) for r in graph.layers(edges, nodes).collect())
    assert got == {f"n{i}": i for i in range(7)} | {"c1": 0, "c2": 0, "n0x": 0}
    assert sum(written) <= nodes.count() + len(pairs)
