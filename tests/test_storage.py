from pyspark.sql import functions as F

from orrery.operators import reach
from orrery.sources import tmdl
from orrery.storage import FEW, few, stored


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stored_table_of_many_rows_is_not_sent(spark):
    table = stored(spark.range(10).withColumnRenamed("id", "k"))
    assert "BroadcastHashJoin" not in _plan(spark.range(99).join(few(table, 5), F.col("id") == F.col("k")))
    assert "BroadcastHashJoin" in _plan(spark.range(99).join(few(table, 10), F.col("id") == F.col("k")))
    big = stored(spark.range(FEW + 1).withColumnRenamed("id", "k"))
    assert "BroadcastHashJoin" not in _plan(spark.range(99).join(reach._sent(big), F.col("id") == F.col("k")))


def test_names_of_a_model_are_looked_up_by_a_shuffle(spark):
    columns = ("model", "kind", "type", "table_name", "name", "expression")
    blocks = stored(spark.createDataFrame([("x", "measure", None, "T", "a", "1"), ("x", "column", "calculated", "T", "b", "[a] + SUM(T[c])")], ", ".join(f"{c} string" for c in columns)))
    found = tmdl.dependencies(blocks)
    assert sorted((r["object"], r["referenced"]) for r in found.collect()) == [("b", "T"), ("b", "a"), ("b", "c")]
    assert "BroadcastHashJoin" not in _plan(found)
