"""Items that lie side by side share rows of the gram index, and a search reads those of its types alone."""

from pyspark.sql import functions as F

from orrery.operators.text_search import TextIndex


def test_neighbours_share_rows_of_grams(spark):
    kinds = F.when(F.col("id") % 2 == 0, "DBT_SOURCE").otherwise("DBT_TEST")
    items = spark.range(640).select(F.format_string("i%03d", "id").alias("item_id"), F.concat(F.lit("big box "), F.col("id").cast("string")).alias("item_name"), kinds.alias("item_type"),
        F.when(F.col("id") % 64 == 63, "big end").alias("description"), *(F.lit(None).cast("string").alias(c) for c in ("table_name", "database_name", "expression")), F.lit(False).alias("deleted")).coalesce(1)
    index = TextIndex.build(items)
    assert index.grams.where("gram = 'box' AND place = 'item_name'").count() == 20
    asks = spark.createDataFrame([(1, "big box 6"), (2, "big"), (3, "63"), (4, "IG END"), (5, "big box big")], "ask_id int, text string")
    for types, own in ((["DBT_SOURCE"], 0), (["DBT_TEST"], 1), (["DBT_SOURCE", "DBT_TEST"], None)):
        names = {i: (f"big box {i}", "big end" if i % 64 == 63 else "") for i in range(640) if own is None or i % 2 == own}
        want = {(k, f"i{i:03d}") for k, text in ((1, "big box 6"), (2, "big"), (3, "63"), (4, "ig end"), (5, "big box big")) for i, held in names.items() if any(text in h for h in held)}
        hits = index.hits(asks, types, ["item_name", "description"]).select("ask_id", "item_id").collect()
        assert len(hits) == len(want) and {tuple(r) for r in hits} == want
        assert index._candidates(asks, ["item_name"], types).where("ask_id = 2").count() == len(names)
