"""Report definitions in both formats as rows of (report, page, visual, field), and the edges that they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.extract import found, visual_fields
from orrery.functions.names import blank_to_null, custom_id
from orrery.operators.bridge import cascade
from orrery.operators.groups import keep_first

VISUAL_NAME = r'"name"\s*:\s*"([^"]+)"'
LEGACY = "struct<sections: array<struct<displayName: string, visualContainers: array<struct<config: string, filters: string>>>>>"
FIELDS = ("report", "page_name", "visual_id", "field_name")


def _title(config: Column, parent: str) -> Column:
    """A visual's title from its JSON; Unknown where it has none or the text is no JSON."""
    value = F.get_json_object(config, f"$.{parent}.title[0].properties.text.expr.Literal.Value")
    return F.coalesce(F.btrim(value, F.lit("'")), F.lit("Unknown"))


def _rows(visuals: DataFrame) -> DataFrame:
    """visuals (report, page_name, visual, title, text) as FIELDS: a row for each field, or one with none."""
    name = F.when(F.col("visual").isNotNull(), F.concat(F.col("title"), F.lit(" ("), F.col("visual"), F.lit(")")))
    return visuals.select("report", "page_name", name.alias("visual_id"), F.explode_outer(visual_fields(F.col("text"))).alias("field_name"))


def legacy(files: DataFrame, report_of: Column) -> DataFrame:
    """report.json files (path, content); those without sections, or that are no JSON, give nothing. Pages without visuals give a row with nulls."""
    pages = files.select(report_of.alias("report"), F.explode(F.from_json("content", LEGACY)["sections"]).alias("s")).select("report", F.col("s.displayName").alias("page_name"), F.posexplode_outer("s.visualContainers").alias("i", "v"))
    visual = F.coalesce(found(F.col("v.config"), VISUAL_NAME, 1), F.when(F.col("i").isNotNull(), F.concat_ws("_", F.col("page_name"), F.lit("visual"), F.col("i").cast("string"))))
    return _rows(pages.select("report", "page_name", visual.alias("visual"), _title(F.col("v.config"), "singleVisual.vcObjects").alias("title"), F.concat_ws("\n", "v.config", "v.filters").alias("text")))


def folders(files: DataFrame, report_of: Column) -> DataFrame:
    """page.json and visual.json files of the folder format; a page counts if its own file does, a visual if its page does."""
    place = F.regexp_extract("path", r"/definition/pages/([^/]+)/", 1)
    own = files.select(report_of.alias("report"), place.alias("page"), F.regexp_extract("path", r"/visuals/([^/]+)/visual\.json$", 1).alias("folder"), "path", "content").where("page <> ''")
    pages = own.where(F.col("path").rlike(r"/pages/[^/]+/page\.json$")).select("report", "page", F.coalesce(blank_to_null(F.get_json_object("content", "$.displayName")), F.col("page")).alias("page_name"))
    visuals = own.where("folder <> ''").select("report", "page", F.coalesce(found(F.col("content"), VISUAL_NAME, 1), F.col("folder")).alias("visual"), _title(F.col("content"), "visual.visualContainerObjects").alias("title"), F.col("content").alias("text"))
    return _rows(pages.join(visuals, ["report", "page"], "left"))


def reports(legacy_rows: DataFrame, folder_rows: DataFrame) -> DataFrame:
    """Both formats; a report that has the legacy file is read from that alone."""
    return legacy_rows.unionByName(folder_rows.join(legacy_rows.select("report").distinct(), "report", "left_anti").select(*legacy_rows.columns))


def stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("report").agg(F.countDistinct("page_name").alias("pages"), F.countDistinct("page_name", "visual_id").alias("visuals"))


def workspace_name(info: Column, connection: Column) -> Column:
    """From workspace_info.json, else from a connection string, else Unknown."""
    return F.coalesce(blank_to_null(F.get_json_object(info, "$.displayName")), blank_to_null(F.get_json_object(info, "$.name")), found(connection, r'myorg/([^";]+)', 1), F.lit("Unknown"))


def resolved_fields(fields: DataFrame, members: DataFrame) -> DataFrame:
    """(field_name, member, member_type): exact measure, exact column, then the last part, then the last two; what is left is a field.

    fields (field_name), members (name, type PB_MEASURE or PB_COLUMN). Measures come before columns. Names that several members have are one member here.
    """
    tail = lambda c, n: F.substring_index(c, ".", -n)
    rank = F.when(F.col("type") == "PB_MEASURE", 0).otherwise(1)
    whole = members.groupBy(F.col("name").alias("key")).agg(F.min_by(F.struct("name", "type"), rank).alias("m"))
    short = members.select(tail("name", 1).alias("key"), "name", "type").groupBy("key").agg(F.min_by(F.struct("name", "type"), F.struct(rank, F.when(F.col("name") == F.col("key"), 0).otherwise(1), F.col("name"))).alias("m"))
    keyed = fields.select("field_name").distinct().where("field_name IS NOT NULL").select("field_name", F.col("field_name").alias("k1"), tail("field_name", 1).alias("k2"), F.when(F.col("field_name").contains("."), tail("field_name", 2)).alias("k3"))
    found = cascade(keyed, "field_name", [("exact", "k1", whole), ("last", "k2", short), ("last two", "k3", whole)])
    out = fields.select("field_name").distinct().where("field_name IS NOT NULL").join(found, "field_name", "left")
    return out.select("field_name", F.coalesce("match.name", "field_name").alias("member"), F.coalesce("match.type", F.lit("PB_FIELD")).alias("member_type"))


def report_edges(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Staged edges field or member to visual to page to report (source_id, source, source_type, target_id, target, target_type), each once; the first stays."""
    page, visual = custom_id(F.col("report"), F.col("page_name")), custom_id(F.col("report"), F.col("page_name"), F.col("visual_id"))
    joined = rows.join(resolved, "field_name", "left")
    end = lambda side, key, name, kind: [key.alias(f"{side}_id"), name.alias(side), kind.alias(f"{side}_type")]
    pages = rows.select(*end("source", page, F.col("page_name"), F.lit("PB_PAGE")), *end("target", custom_id(F.col("report")), F.col("report"), F.lit("PB_REPORT")))
    visuals = rows.where("visual_id IS NOT NULL").select(*end("source", visual, F.col("visual_id"), F.lit("PB_VISUAL")), *end("target", page, F.col("page_name"), F.lit("PB_PAGE")))
    fields = joined.where("field_name IS NOT NULL AND visual_id IS NOT NULL").select(*end("source", custom_id(F.col("member")), F.col("member"), F.col("member_type")), *end("target", visual, F.col("visual_id"), F.lit("PB_VISUAL")))
    every = pages.withColumn("seq", F.lit(0)).unionByName(visuals.withColumn("seq", F.lit(1))).unionByName(fields.withColumn("seq", F.lit(2)))
    return keep_first(every, ["source_id", "target_id"], "seq").drop("seq")


def model_edges(blocks: DataFrame, dependencies: DataFrame, relationships: DataFrame) -> DataFrame:
    """Staged edges of semantic models: producer to consumer by DAX, table to member, and foreign to primary key (kind join). A dependency outlives a join of the same pair."""
    key = lambda *c: custom_id(*map(F.col, c))
    members = blocks.where("kind <> 'partition'").select("model", F.col("table_name").alias("table"), "name", F.when(F.col("kind") == "measure", "PB_MEASURE").otherwise("PB_COLUMN").alias("type"))
    homes = members.groupBy("model", F.col("name").alias("referenced"), F.col("type").alias("referenced_type")).agg(F.min("table").alias("home"))
    needs = dependencies.join(homes, ["model", "referenced", "referenced_type"], "left").withColumn("home", F.coalesce("referenced_table", "home"))
    of = lambda kind, table, name: F.when(kind == "PB_TABLE", key("model", name)).otherwise(key("model", table, name))
    none = F.lit(None).cast("string")
    needs = needs.select(of(F.col("referenced_type"), "home", "referenced").alias("source_id"), F.col("referenced").alias("source"), F.col("referenced_type").alias("source_type"), of(F.col("object_type"), "object_table", "object").alias("target_id"), F.col("object").alias("target"), F.col("object_type").alias("target_type"), none.alias("edge_kind"), F.when((F.col("referenced_type") != "PB_TABLE") & (F.col("object_type") != "PB_TABLE"), "transformation").alias("lineage_type"), F.lit(0).alias("seq"))
    inside = members.select(key("model", "table").alias("source_id"), F.col("table").alias("source"), F.lit("PB_TABLE").alias("source_type"), key("model", "table", "name").alias("target_id"), F.col("name").alias("target"), F.col("type").alias("target_type"), none.alias("edge_kind"), none.alias("lineage_type"), F.lit(1).alias("seq"))
    joins = relationships.select(key("model", "from_table", "from_column").alias("source_id"), F.col("from_column").alias("source"), F.lit("PB_COLUMN").alias("source_type"), key("model", "to_table", "to_column").alias("target_id"), F.col("to_column").alias("target"), F.lit("PB_COLUMN").alias("target_type"), F.lit("join").alias("edge_kind"), none.alias("lineage_type"), F.lit(2).alias("seq"))
    every = needs.unionByName(inside).unionByName(joins).where("source_id <> target_id")
    return keep_first(every, ["source_id", "target_id"], "seq").drop("seq")


def used_names(rows: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Names that a report or a dependency uses, in all models at once."""
    return rows.select(F.col("field_name").alias("name")).unionByName(dependencies.select(F.col("referenced").alias("name"))).where("name IS NOT NULL").distinct()


def with_unused(items: DataFrame, used: DataFrame, keys: Sequence[str] = ("item_name",)) -> DataFrame:
    """items with is_unused: by name over all models, or by other keys (dataset_id, item_name) where `used` has them."""
    flag = used.select(*keys).distinct().withColumn("_used", F.lit(True))
    return items.drop("is_unused").join(flag, list(keys), "left").withColumn("is_unused", F.col("_used").isNull()).drop("_used")
