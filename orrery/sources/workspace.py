"""A BI workspace as one catalogue: workspace, tables, columns, measures, reports, pages, visuals and fields in one union, and edges whose ends all are items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.names import custom_id
from orrery.sources import reports
from orrery.storage import many

MEMBERS = ("PB_MEASURE", "PB_COLUMN")


def _members(blocks: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "measure", "PB_MEASURE").otherwise("PB_COLUMN")
    return blocks.where("kind <> 'partition'").withColumn("type_of", kind).withColumn("item_id", custom_id(F.col("model"), F.col("table_name"), F.col("name")))


def _ids(members: DataFrame) -> DataFrame:
    """(member, member_type, member_id): of a name that several tables or models have, the first by model and table."""
    return members.groupBy(F.col("name").alias("member"), F.col("type_of").alias("member_type")).agg(F.min_by("item_id", F.struct("model", "table_name")).alias("member_id"))


def _with_ids(uses: DataFrame, ids: DataFrame) -> DataFrame:
    """uses (member, member_type) with member_id: a member's own id, or that of a field that no model has."""
    own = F.coalesce("member_id", custom_id(F.lit("PB_FIELD"), F.col("member")))
    return uses.join(ids, ["member", "member_type"], "left").withColumn("member_id", own)


def _placed(dependencies: DataFrame) -> DataFrame:
    """Dependencies without those by a bare name that the same object also names with its table."""
    same = ["model", "object", "object_type", "object_table", "referenced", "referenced_type"]
    placed = dependencies.where("referenced_table IS NOT NULL")
    return placed.unionByName(dependencies.where("referenced_table IS NULL").join(placed.select(*same).distinct(), same, "left_anti").select(*placed.columns))


def catalogue(blocks: DataFrame, rows: DataFrame, relationships: DataFrame, dependencies: DataFrame, workspace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, edges) of a workspace's models (tmdl.models, its relationships and dependencies) and report rows (reports.reports).

    Ids are resolved in one pass: a field of a report gets the id of the member that it names, else one of its own, and edges take the same. What only an edge names (a
    hidden column of a relationship, a table that an expression speaks of) is an item too, with `named_only` true. An item occurs once, with the first of its rows.
    Statistics are filled afterwards: reports, pages and visuals that use a member or field, pages and visuals of a report, is_unused of members (no visual and no
    expression in any model has the name), is_related of columns and tables.
    """
    blocks, dependencies, relationships = many(blocks), many(dependencies), many(relationships)
    dependencies = _placed(dependencies)
    members = _members(blocks)
    ids = _ids(members)
    names = members.select("name", F.col("type_of").alias("type"))
    resolved = reports.resolved_fields(rows, names)
    uses = _with_ids(rows.where("field_name IS NOT NULL AND visual_id IS NOT NULL").join(resolved, "field_name"), ids)

    key = lambda *c: custom_id(*map(F.col, c))
    named = lambda item_id, name, kind: (item_id.alias("item_id"), name.alias("item_name"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("item_type"))
    tables = blocks.groupBy("model", "table_name").agg(F.min("table_tag").alias("lineage_tag")).select(*named(key("model", "table_name"), F.col("table_name"), "PB_TABLE"), F.col("model").alias("dataset_id"), "lineage_tag")
    inside = members.select(*named(F.col("item_id"), F.col("name"), F.col("type_of")), F.col("model").alias("dataset_id"), "table_name", F.col("data_type").alias("datatype"), F.col("type").alias("column_type"), "expression", "description", "lineage_tag", F.col("format_string").alias("formatstring"))
    own = rows.select("report", "page_name", "visual_id").distinct()
    of_report = own.where("report IS NOT NULL").groupBy("report").agg(F.countDistinct("page_name").alias("connected_report_pages"), F.countDistinct("page_name", "visual_id").alias("connected_visuals"))
    of_report = of_report.select(*named(key("report"), F.col("report"), "PB_REPORT"), F.col("connected_report_pages").cast("int"), F.col("connected_visuals").cast("int"))
    pages = own.where("page_name IS NOT NULL").select(*named(key("report", "page_name"), F.col("page_name"), "PB_PAGE"), F.col("report").alias("dataset_name"))
    visuals = own.where("visual_id IS NOT NULL").select(*named(key("report", "page_name", "visual_id"), F.col("visual_id"), "PB_VISUAL"), F.col("report").alias("dataset_name"), F.col("page_name").alias("table_name"))
    fields = uses.where("member_type = 'PB_FIELD'").select(*named(F.col("member_id"), F.col("member"), "PB_FIELD"))
    every = tables
    for part in (inside, of_report, pages, visuals, fields):
        every = every.unionByName(part, allowMissingColumns=True)
    if workspace is not None:
        whole = blocks.sparkSession.range(1).select(*named(custom_id(F.lit(workspace)), F.lit(workspace), "PB_WORKSPACE"))
        every = every.unionByName(whole, allowMissingColumns=True)

    model = reports.model_edges(blocks, dependencies, relationships)
    report = _with_ids(reports.report_edges(rows, resolved).withColumn("member", F.when(F.col("target_type") == "PB_VISUAL", F.col("source"))).withColumn("member_type", F.col("source_type")), ids)
    report = report.withColumn("source_id", F.when(F.col("member").isNotNull(), F.col("member_id")).otherwise(F.col("source_id"))).drop("member", "member_type", "member_id")
    edges = report.unionByName(model, allowMissingColumns=True)

    end = lambda side: edges.select(F.col(f"{side}_id").alias("item_id"), F.col(side).alias("item_name"), F.col(f"{side}_type").alias("item_type"), F.lit(True).alias("named_only"))
    every = every.withColumn("named_only", F.lit(False)).unionByName(end("source").unionByName(end("target")).distinct(), allowMissingColumns=True)
    # The least by named_only stays: an item's own row where it has one.
    others = [c for c in every.columns if c != "item_id"]
    first = every.groupBy("item_id").agg(F.min(F.struct("named_only", *(c for c in others if c != "named_only"))).alias("r")).select("item_id", "r.*")

    counts = uses.groupBy(F.col("member_id").alias("item_id")).agg(F.countDistinct("report").alias("_reports"), F.countDistinct("report", "page_name").alias("_pages"), F.countDistinct("report", "page_name", "visual_id").alias("_visuals"))
    related = relationships.select(F.explode(F.array(key("model", "from_table", "from_column"), key("model", "from_table"), key("model", "to_table", "to_column"), key("model", "to_table"))).alias("item_id")).distinct().withColumn("_related", F.lit(True))
    used = uses.select(F.col("member").alias("item_name")).unionByName(dependencies.select(F.col("referenced").alias("item_name"))).distinct().withColumn("_used", F.lit(True))
    member = F.col("item_type").isin(*MEMBERS)
    full = first.join(counts, "item_id", "left").join(related, "item_id", "left").join(used, "item_name", "left")
    counted = member | (F.col("item_type") == "PB_FIELD")
    filled = full.withColumn("connected_reports", F.when(counted, F.coalesce("_reports", F.lit(0)).cast("int")))
    for column, count in (("connected_report_pages", "_pages"), ("connected_visuals", "_visuals")):
        filled = filled.withColumn(column, F.when(counted, F.coalesce(count, F.lit(0)).cast("int")).otherwise(F.col(column)))
    filled = filled.withColumn("is_unused", F.when(member, F.col("_used").isNull())).withColumn("is_related", F.when(F.col("item_type").isin("PB_COLUMN", "PB_TABLE"), F.col("_related").isNotNull()))
    place = F.lit(workspace).cast("string")
    filled = filled.withColumn("service", F.lit("powerbi")).withColumn("workspace_name", place).withColumn("workspace_id", F.when(place.isNotNull(), custom_id(place)))
    return filled.drop("_reports", "_pages", "_visuals", "_related", "_used"), edges
