from pyspark.sql import functions as F

from orrery.operators.text_search import SEARCHES, TextIndex

SCHEMA = "item_id string, item_name string, item_type string, description string, table_name string, database_name string, expression string, deleted boolean, more int"


def _items():
    names = ["orders_daily", "ORDERS", "o", "or", "", None, "a\U0001f600bc", "\U0001f600bc", "x\ny ord", "été Orders", "aaaaaa", "100%_sure", "100x_sure"]
    out = []
    for i, name in enumerate(names):
        for j, kind in enumerate(("DBT_MODEL", "DBT_SEED", "DBT_SOURCE", "DBT_TEST", "PB_MEASURE")):
            out.append((f"i{i}-{j}", name, kind, None if i % 2 else f"about {name}", f"t{i % 3}", None if i % 4 == 0 else "db", "" if i % 5 == 0 else f"select {i} from orders where x = '{name}'", i == 9 and j == 0, 1))
    return out


ASKS = ["ord", "ORD", "orders", "o", "R", "or", "\U0001f600", "\U0001f600b", "a\U0001f600bc", "", None, "%", "100%_", "aaa", "aaaa", "y\nx", "\ny", "été", "ÉTÉ", "nothing", "t1", "db", "from orders where x = 'o'", "\x00", "o\x00\x00"]


def test_searches_find_what_a_scan_finds(spark):
    items = _items()
    index = TextIndex.build(spark.createDataFrame(items, SCHEMA))
    asks = spark.createDataFrame(list(enumerate(ASKS)), "ask_id int, text string")
    place = {"item_name": 1, "description": 3, "table_name": 4, "database_name": 5, "expression": 6}
    last = lambda x: (x is None, x or "")
    for kind, (types, columns) in SEARCHES.items():
        want = set()
        for n, text in enumerate(ASKS):
            hit = [r for r in items if not r[7] and r[2] in types and (not text or any(r[place[c]] is not None and text.lower() in r[place[c]].lower() for c in columns))]
            hit.sort(key=lambda r: (last(r[5]), last(r[4]), last(r[1]), r[0]))
            want |= {(n, k, r[0]) for k, r in enumerate(hit[:7], 1)}
        got = index.search(asks, kind, 7).select("ask_id", "position", "item_id").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want, kind


def test_code_by_id_name_and_part(spark):
    index = TextIndex.build(spark.createDataFrame(_items(), SCHEMA))
    asks = ["i1-0", "orders", " ORDERS_DAILY ", "rders_d", "i9-0", "i1-4", "i0-0", "no such", " ", None, "aaaaa"]
    rows = index.code(spark.createDataFrame(list(enumerate(asks)), "ask_id int, text string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.ask_id, []).append(r)
    assert [(r.status, r.item_id, r.sql) for r in by[0]] == [("ONE", "i1-0", "select 1 from orders where x = 'ORDERS'")]
    assert {(r.status, r.stage, r.item_id, r.sql) for r in by[1]} == {("MANY", 1, f"i1-{j}", None) for j in (0, 1, 3)}
    # orders_daily has no SQL; deleted items, measures and unknown or blank texts find nothing
    for n in (2, 3, 4, 5, 6, 7, 8, 9):
        assert [(r.status, r.item_id) for r in by[n]] == [("NONE", None)], n
    assert by[10][0].status == "NONE" and len(by) == len(asks)


def test_an_empty_catalogue(spark):
    index = TextIndex.build(spark.createDataFrame([], SCHEMA))
    asks = spark.createDataFrame([(1, "abc"), (2, ""), (3, "a")], "ask_id int, text string")
    assert index.search(asks, "models").count() == 0
    assert [r.status for r in index.code(asks).collect()] == ["NONE"] * 3


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    from orrery.operators import text_search

    monkeypatch.setattr(text_search, "ROWS", 50)
    items = spark.range(200).select(F.format_string("i%03d", "id").alias("item_id"), F.format_string("big box %03d", "id").alias("item_name"), F.lit("DBT_TEST").alias("item_type"),
        *(F.lit(None).cast("string").alias(c) for c in ("description", "table_name", "database_name", "expression")), F.lit(False).alias("deleted")).coalesce(1)
    index = TextIndex.build(items)
    assert len(index.grams.where("gram = 'box'").inputFiles()) > 4 and index._read(1_000_000).rdd.getNumPartitions() >= text_search.PARTS
    asks = spark.createDataFrame([("a", "BOX"), ("b", "x 01"), ("c", "9")], "ask_id string, text string")
    hits = index.hits(asks, ["DBT_TEST"], ["item_name", "description"])
    assert hits.groupBy("ask_id").count().orderBy("ask_id").collect() == [("a", 200), ("b", 10), ("c", 38)]
    assert index._candidates(asks, ["item_name"]).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
