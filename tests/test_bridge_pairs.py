from pyspark.sql import functions as F

from orrery.operators import bridge


def test_pairs_of_one_name_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(bridge, "PAIRS", 500, raising=False)
    none = F.lit(None).cast("string")
    tables = spark.range(300).select(F.col("id").cast("string").alias("item_id"), F.when(F.col("id") == 7, "other").otherwise("T").alias("item_name"), *(none.alias(f"bq_{c}") for c in ("project", "schema", "source_name")))
    models = spark.range(40).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("item_id"), *(none.alias(c) for c in ("database_name", "schema_name", "alias")), F.when(F.col("id") < 2, "t").otherwise("wh.x.t").alias("table_name"))
    found = bridge.bridge_preview(tables, models)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted((str(i), f"m{j}", "name_full" if j < 2 else "name_tail") for i in range(300) if i != 7 for j in range(40))
    most = found.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most < len(got) / 2
    assert bridge.bridge_preview(tables.limit(0), models).count() == 0
