from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orrery.operators.buckets import BUCKET, BucketTable
from orrery.operators.load import COALESCE, PRESERVE, merged

SCHEMA = "k string, n int, name string, status string, tags array<string>, meta map<string,string>"


def _files(table):
    rows = Path(table.path.removeprefix("file://")) / "rows"
    out = {}
    for p in rows.rglob("*.parquet"):
        out.setdefault(int(p.parent.name.split("=")[1]), set()).add(p.name)
    return out


def _plain(df):
    return sorted((tuple(sorted(x.items()) if isinstance(x, dict) else x for x in r) for r in df.collect()), key=repr)


def test_only_changed_buckets_are_written(spark):
    rows = [(f"k{i}", i, f"name {i}", "old", ["a"] if i % 2 else None, {"x": "1", "y": "2"} if i % 3 else None) for i in range(400)]
    old = spark.createDataFrame(rows, SCHEMA)
    table = BucketTable.create(old, ["k"], 32)
    before = _files(table)
    new = spark.createDataFrame([("k3", 3, "new", "x", ["a"], None), ("k7", 7, None, "x", ["a"], {"y": "2", "x": "1"}), ("z", 1, "z", "x", None, None), (None, 1, "gone", "x", None, None)], SCHEMA)
    policy = {"name": COALESCE, "status": PRESERVE}
    number = lambda k: spark.createDataFrame([(k,)], "k string").select(table._bucket()).collect()[0][0]
    # k7's name stays by COALESCE, its status by PRESERVE, and its map has the same entries in another order: no change
    changed = table.merge(new, policy)
    assert changed == sorted({number("k3"), number("z")})
    after = _files(table)
    assert {b for b in after if after[b] != before.get(b)} == set(changed)
    assert all(not after[b] & before[b] for b in changed if b in before)
    assert _plain(table.rows()) == _plain(merged(old, new, ["k"], policy))
    assert table.merge(new, policy) == [] and _files(table) == after
    # opened by its path alone, with the same keys, buckets and types
    again = BucketTable(spark, table.path)
    assert (again.keys, again.buckets, again.schema) == (["k"], 32, table.schema) and again.rows().schema == old.schema


def test_columns_that_new_lacks_stay_and_a_key_of_another_type_meets(spark):
    table = BucketTable.create(spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], "k long, name string, status string"), ["k"], 8)
    assert len(table.merge(spark.createDataFrame([(1, "A"), (1, "B"), (3, "c")], "k int, name string"), {})) <= 2
    assert sorted(map(tuple, table.rows().collect())) == [(1, "B", "s"), (2, "b", "s"), (3, "c", None)]


def test_empty_tables_and_one_hot_bucket(spark):
    empty = spark.createDataFrame([], SCHEMA)
    table = BucketTable.create(empty, ["k"], 4)
    assert table.rows().count() == 0 and table.merge(empty, {}) == []
    assert len(table.merge(spark.createDataFrame([("a", 1, "x", None, None, None)], SCHEMA), {})) == 1
    pairs = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"))
    one = BucketTable.create(pairs(0, 5000), ["k"], 1)
    assert one.merge(pairs(4999, 5001), {}) == [0] and one.rows().count() == 5001
    with pytest.raises(ValueError):
        BucketTable.create(spark.range(1).withColumn(BUCKET, F.lit(1)), ["id"])
    with pytest.raises(ValueError):
        one.merge(spark.range(1).select(F.col("id").cast("string").alias("k")), {})


def test_a_merge_shuffles_each_side_once(spark, monkeypatch):
    from orrery.operators import buckets

    joins = []
    monkeypatch.setattr(buckets, "merged", lambda *a, **k: joins.append(merged(*a, **k)) or joins[-1])
    pairs = lambda a, b, n: spark.range(a, b).select(F.col("id").cast("string").alias("k"), F.lit(n).alias("n"))
    table = BucketTable.create(pairs(0, 300, 1), ["k"], 8)
    assert table.merge(pairs(290, 310, 2), {})
    plan = joins[0]._jdf.queryExecution().executedPlan().toString()
    # Dealt by buckets, neither side is shuffled again for the join or for repeated keys.
    assert len(joins) == 1 and "ENSURE_REQUIREMENTS" not in plan and plan.count("Exchange") == 2, plan
    assert {r.k: r.n for r in table.rows().collect()} == {str(i): 1 if i < 290 else 2 for i in range(310)}


def test_rows_that_differ_are_told_by_the_join_itself(spark):
    old = spark.createDataFrame([("a", 1, {"x": "1", "y": "2"}), ("b", None, None), ("c", 3, None), ("d", 4, None)], "k string, n int, m map<string,string>")
    new = spark.createDataFrame([("a", 1, {"y": "2", "x": "1"}), ("b", 2, None), ("c", None, None), ("e", None, None)], old.schema)
    told = lambda policy: {r.k: r.other for r in merged(old, new, ["k"], policy, differs="other").collect()}
    assert told({}) == {"a": False, "b": True, "c": True, "d": False, "e": True}
    assert told({"n": COALESCE}) == {"a": False, "b": True, "c": False, "d": False, "e": True}
    assert told({"n": PRESERVE}) == {"a": False, "b": False, "c": False, "d": False, "e": True}


def test_parts_of_buckets_give_the_same_rows(spark, monkeypatch):
    from orrery.operators import buckets

    monkeypatch.setattr(buckets, "_ROWS", 20)
    pairs = lambda a, b, n: spark.range(a, b).select(F.col("id").cast("string").alias("k"), F.lit(n).alias("n"))
    table = BucketTable.create(pairs(0, 300, 1), ["k"], 4)
    assert table.merge(pairs(100, 400, 2), {}) == [0, 1, 2, 3] and table.merge(pairs(100, 400, 2), {}) == []
    assert {r.k: r.n for r in table.rows().collect()} == {str(i): 1 if i < 100 else 2 for i in range(400)} and table.rows().count() == 400
    assert all(len(files) > 1 for files in _files(table).values())
