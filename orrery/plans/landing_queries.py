"""Merges into tables of buckets and reads of landed pages, over the star tables. Each query has SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import load
from orrery.operators.buckets import BucketTable
from orrery.plans import starmap as star
from orrery.plans.artifact_queries import _bim
from orrery.plans.queries import ORACLE_SQL, query
from orrery.sources import landing, tmdl, workspace
from orrery.storage import shared_dir, stored


@query(ORACLE_SQL["item_upsert"])
def items_merged_in_buckets(spark, d):
    """The rows of item_upsert by two merges into a stored table, the second of which changes nothing."""
    orders = star.table(spark, d, "orders")
    table = BucketTable.create(orders.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus"), ["o_orderkey"], 64)
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.lower("o_orderpriority")).alias("o_orderpriority"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    table.merge(new, {"o_orderpriority": load.COALESCE})
    again = table.merge(new, {"o_orderpriority": load.COALESCE})
    if again:
        raise RuntimeError(f"a merge that was repeated rewrote buckets {again}")
    return table.rows()


@query(ORACLE_SQL["edges_upserted"])
def edges_merged_in_buckets(spark, d):
    table = BucketTable.create(star.edges(spark, d).withColumn("origin", F.lit("old")), ["source", "target"], 64)
    table.merge(star.edges(spark, d).where(F.col("target").endswith("3")).withColumn("origin", F.lit("new")), {})
    return table.rows()


@query(ORACLE_SQL["graph_merge"])
def nodes_merged_in_buckets(spark, d):
    nodes = star.nodes(spark, d)
    table = BucketTable.create(nodes.where("group <> 'PB_REPORT'"), ["node_id"], 64)
    table.merge(nodes.where("group IN ('PB_REPORT', 'PB_MEASURE')").withColumn("name", F.upper("name")), {})
    return table.rows()


def _landed(spark, d) -> str:
    """Events as landed runs, one for each day, in several pages of JSON lines each; a run without its mark beside them."""
    folder = shared_dir(spark)
    events = star.table(spark, d, "events").select(F.date_format("ts", "yyyyMMdd").alias("run"), (F.col("event_id") % 4).alias("page"), F.to_json(F.struct("event_id", "user_id", "event_type", "props")).alias("value"))
    events.repartition("run", "page").select("run", "value").write.partitionBy("run").text(f"{folder}/written")
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/written")
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for run in store.listStatus(base):
        name = run.getPath().getName()
        if run.isDirectory() and name != "run=20240102":
            store.create(spark._jvm.org.apache.hadoop.fs.Path(run.getPath(), "_SUCCESS")).close()
    return f"{folder}/written"


_LANDED = """WITH e AS (SELECT 'run=' || strftime(ts, '%Y%m%d') AS run, * FROM events WHERE strftime(ts, '%Y%m%d') <> '20240102')
SELECT run, event_type, count(*) AS events, count(DISTINCT user_id) AS users, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM e GROUP BY ALL"""


def _counted(pages):
    e = pages.select("run", F.from_json("record", "event_id long, user_id long, event_type string, props string").alias("e")).select("run", "e.*")
    return e.groupBy("run", "event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query(_LANDED)
def landed_pages(spark, d):
    """Whole runs by the registered format, a partition for each page."""
    landing.register(spark)
    return _counted(spark.read.format(landing.FORMAT).load(_landed(spark, d)))


@query(_LANDED)
def landed_stream(spark, d):
    """The same runs by a stream of what is there, written once and counted."""
    landing.register(spark)
    rows, marks = shared_dir(spark), shared_dir(spark)
    stream = spark.readStream.format(landing.FORMAT).load(_landed(spark, d)).writeStream.format("parquet").option("path", rows).option("checkpointLocation", marks)
    stream.trigger(availableNow=True).start().awaitTermination()
    return _counted(spark.read.parquet(rows))


@query("""WITH u AS (SELECT 'R' || c_nationkey AS report, c_mktsegment AS page, 'v' || c_custkey AS visual, CASE c_custkey % 3 WHEN 0 THEN 'm' || c_custkey WHEN 1 THEN 'c' || c_custkey ELSE 'band' || c_custkey % 9 END AS field FROM customer),
m AS (SELECT 'PB_MEASURE' AS item_type, 'm' || p_partkey AS item_name, p_brand AS dataset_id, p_type AS table_name, p_partkey % 4 = 0 AND p_partkey % 5 <> 0 AS spoken, FALSE AS named_only FROM part
  UNION ALL SELECT 'PB_COLUMN', 'c' || p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END, CASE WHEN p_partkey % 5 <> 0 THEN p_type END, TRUE, p_partkey % 5 = 0 FROM part
  UNION ALL SELECT 'PB_COLUMN', 'id', NULL, NULL, FALSE, TRUE FROM (SELECT DISTINCT p_brand FROM part), range(3)),
n AS (SELECT field, count(DISTINCT report) AS r, count(DISTINCT report || '/' || page) AS p, count(*) AS v FROM u GROUP BY field)
SELECT item_type, item_name, dataset_id, NULL AS dataset_name, table_name, CAST(CASE WHEN named_only THEN 0 ELSE coalesce(r, 0) END AS INTEGER) AS connected_reports, CAST(CASE WHEN named_only THEN 0 ELSE coalesce(p, 0) END AS INTEGER) AS connected_report_pages, CAST(CASE WHEN named_only THEN 0 ELSE coalesce(v, 0) END AS INTEGER) AS connected_visuals, r IS NULL AND NOT spoken AS is_unused, named_only FROM m LEFT JOIN n ON field = item_name
UNION ALL SELECT DISTINCT 'PB_TABLE', p_type, p_brand, NULL, NULL, NULL, NULL, NULL, NULL, FALSE FROM part
UNION ALL SELECT 'PB_REPORT', report, NULL, NULL, NULL, NULL, CAST(count(DISTINCT page) AS INTEGER), CAST(count(*) AS INTEGER), NULL, FALSE FROM u GROUP BY report
UNION ALL SELECT DISTINCT 'PB_PAGE', page, NULL, report, NULL, NULL, NULL, NULL, NULL, FALSE FROM u UNION ALL SELECT 'PB_VISUAL', visual, NULL, report, page, NULL, NULL, NULL, NULL, FALSE FROM u
UNION ALL SELECT 'PB_FIELD', field, NULL, NULL, NULL, CAST(r AS INTEGER), CAST(p AS INTEGER), CAST(v AS INTEGER), NULL, FALSE FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE item_name = field AND NOT named_only)
UNION ALL SELECT 'PB_WORKSPACE', 'W', NULL, NULL, NULL, NULL, NULL, NULL, NULL, FALSE""")
def workspace_catalogue(spark, d):
    """Models of brands and reports of nations as one catalogue: columns that are hidden or only in relationships are items by name."""
    n, files = F.col("c_custkey"), _bim(spark, d)
    text = lambda mark, value: F.concat(F.lit(mark), value.cast("string"))
    field = F.when(n % 3 == 0, text("m", n)).when(n % 3 == 1, text("c", n)).otherwise(text("band", n % 9))
    rows = star.table(spark, d, "customer").select(text("R", F.col("c_nationkey")).alias("report"), F.col("c_mktsegment").alias("page_name"), text("v", n).alias("visual_id"), field.alias("field_name"))
    of = F.regexp_extract("path", r"/([^/]+)\.SemanticModel/", 1)
    blocks = stored(tmdl.bim_blocks(files).withColumn("model", of))
    needs = stored(tmdl.dependencies(blocks))
    items, _ = workspace.catalogue(blocks, rows, stored(tmdl.bim_relationships(files).withColumn("model", of)), needs, "W")
    return items.select("item_type", "item_name", "dataset_id", "dataset_name", "table_name", "connected_reports", "connected_report_pages", "connected_visuals", "is_unused", "named_only")
