from orrery.plans import artifact_queries
from orrery.sources import tmdl

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def test_more_parts_make_more_model_files(spark, tmp_path):
    parts = [(k, f"n{k}", "Brand#1", t, 1) for k, t in ((1, "A"), (2, "B"), (70_001, "A"), (200_002, "A"), (200_003, "C"))]
    spark.createDataFrame(parts, PART).write.parquet(f"{tmp_path}/part.parquet")
    files = artifact_queries._bim(spark, str(tmp_path))
    assert files.count() == 3 and files.select("path").distinct().count() == 3
    blocks = tmdl.bim_blocks(files)
    assert sorted(r["name"] for r in blocks.where("kind = 'measure'").collect()) == sorted(f"m{p[0]}" for p in parts)
    assert sorted(r["table_name"] for r in blocks.where("kind = 'partition'").collect()) == ["A", "B", "C"]
    assert tmdl.bim_relationships(files).count() == 2


def test_entries_of_a_model_do_not_carry_their_table(spark):
    content = '{"model": {"tables": [{"name": "T", "columns": [{"name": "c"}], "measures": [{"name": "m", "expression": ["1", "2"]}], "partitions": []}]}}'
    blocks = tmdl.bim_blocks(spark.createDataFrame([("x.bim", content)], "path string, content string"))
    assert sorted((r["kind"], r["name"], r["table_name"], r["expression"]) for r in blocks.select("kind", "name", "table_name", "expression").fillna("").collect()) == [("column", "c", "T", ""), ("measure", "m", "T", "1\n2")]
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(list" in plan and "posexplode(t" not in plan
