"""Semantic models: TMDL text and BIM JSON as tables of tables, columns, measures, partitions and relationships.

TMDL is line by line. Lines are exploded with their numbers, a running count of block headers over each (small) file tells to which
block a line belongs, and blocks are put together by grouping; no parser state leaves Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.extract import partition_kind
from orrery.storage import many

# Line forms.
HEADER = r"^\s*(column|measure|partition)\s+'?([^=']+?)'?\s*(?:=\s*(.*))?$"
RELATIONSHIP = r"^\s*relationship\s+(\S+)\s*$"
COLUMN_OF = r"^\s*(?:'([^']+)'|([^.\s]+))\.(.+?)\s*$"
#: Tables that a model makes for itself.
OWN_TABLES = ("DateTableTemplate%", "LocalDateTable%")


def _lines(files: DataFrame) -> DataFrame:
    """(path, n, line, s) of the lines that are neither blank nor plain comments."""
    rows = files.select("path", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("n", "line")).withColumn("s", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    return rows.where("s <> ''").where(~F.col("s").startswith("//") | F.col("s").startswith("///"))


def _property(name: str) -> Column:
    """The last value of a property among a group's lines, outer quotation marks gone; null where blank."""
    value = F.regexp_extract("s", rf"^{name}:\s*(.*)$", 1)
    value = F.nullif(F.btrim(F.trim(value), F.lit("\"'")), F.lit(""))
    return F.max_by(value, F.when(F.col("s").startswith(f"{name}:"), F.col("n")))


def _joined(text: Column, when: Column, mark: str) -> Column:
    found = F.array_sort(F.collect_list(F.when(when, F.struct(F.col("n").alias("n"), text.alias("t")))))
    return F.array_join(F.transform(found, lambda x: x["t"]), mark)


def tmdl_blocks(files: DataFrame) -> DataFrame:
    """(path, table_name, table_tag, block, kind, name, expression, type, description, lineage_tag, data_type, format_string) of TMDL table files (path, content).

    Comments of three slashes before a block describe it; `= expression` in a column's header makes it calculated; other `key: value`
    lines of columns and measures are properties; a partition's text decides whether it is m or calculated.
    """
    whole = Window.partitionBy("path").orderBy("n")
    lines = _lines(files).withColumn("is_header", F.col("line").rlike(HEADER) & ~F.col("s").startswith("///"))
    lines = lines.withColumn("before", F.sum(F.col("is_header").cast("int")).over(whole)).withColumn("is_note", F.col("s").startswith("///"))
    lines = lines.withColumn("block", F.col("before") + F.col("is_note").cast("int"))
    is_table = F.col("line").rlike(r"^table\s")
    head = lines.where("before = 0").groupBy("path").agg(
        F.max(F.when(is_table, F.regexp_extract("line", r"^table\s+'?([^']+)'?", 1))).alias("table_name"), _property("lineageTag").alias("table_tag")
    )
    kind = F.max(F.when(F.col("is_header"), F.regexp_extract("line", HEADER, 1)))
    inline = F.max(F.when(F.col("is_header"), F.trim(F.regexp_extract("line", HEADER, 3))))
    is_property = F.col("s").rlike(r"^(lineageTag|description|dataType|formatString):")
    body = ~F.col("is_header") & ~F.col("is_note") & ~is_table & ~is_property & (F.col("s") != "source =")
    blocks = lines.where("block > 0").groupBy("path", "block").agg(
        kind.alias("kind"), F.max(F.when(F.col("is_header"), F.trim(F.regexp_extract("line", HEADER, 2)))).alias("name"), inline.alias("inline"),
        _joined(F.col("s"), body & (~F.col("s").contains(":") | F.col("s").startswith("let")), "\n").alias("plain"), _joined(F.col("s"), body, "\n").alias("whole"),
        _joined(F.trim(F.regexp_replace("s", "^/+", "")), F.col("is_note"), " ").alias("notes"), _property("description").alias("said"), _property("lineageTag").alias("lineage_tag"),
        _property("dataType").alias("data_type"), _property("formatString").alias("format_string"),
    ).where("kind IS NOT NULL")
    text = F.when(F.col("kind") == "partition", F.col("whole")).otherwise(F.col("plain"))
    expression = F.trim(F.concat_ws("\n", F.nullif("inline", F.lit("")), F.nullif(text, F.lit(""))))
    kinds = F.when(F.col("kind") == "partition", partition_kind(expression)).when((F.col("kind") == "column") & (F.col("inline") != ""), "calculated").when(F.col("kind") == "column", "data")
    done = blocks.select("path", "block", "kind", "name", expression.alias("expression"), kinds.alias("type"), F.coalesce("said", "notes").alias("description"), "lineage_tag", "data_type", "format_string")
    return files.select("path").join(head, "path", "left").join(done, "path").withColumn("table_name", F.coalesce("table_name", F.lit("Unknown")))


def tmdl_relationships(files: DataFrame) -> DataFrame:
    """(path, guid, from_table, from_column, to_table, to_column, from_cardinality, to_cardinality, cross_filtering, is_active); what a block leaves out has the model's defaults, blocks without both tables go."""
    lines = _lines(files).where(~F.col("s").startswith("//")).withColumn("guid", F.when(F.col("line").rlike(RELATIONSHIP), F.regexp_extract("line", RELATIONSHIP, 1)))
    lines = lines.withColumn("block", F.count("guid").over(Window.partitionBy("path").orderBy("n"))).where("block > 0")
    wide = lines.groupBy("path", "block").agg(F.max("guid").alias("guid"), *(_property(p).alias(p) for p in ("fromColumn", "toColumn", "fromCardinality", "toCardinality", "crossFilteringBehavior", "isActive")))

    def side(name: str) -> list[Column]:
        ref = F.col(f"{name}Column")
        table = F.coalesce(F.nullif(F.regexp_extract(ref, COLUMN_OF, 1), F.lit("")), F.nullif(F.regexp_extract(ref, COLUMN_OF, 2), F.lit("")))
        return [table.alias(f"{name}_table"), F.btrim(F.trim(F.regexp_extract(ref, COLUMN_OF, 3)), F.lit("'")).alias(f"{name}_column")]

    # The outer quotation marks of a property are gone by now: 'My table'.Date has come as My table'.Date.
    fixed = wide
    for c in ("fromColumn", "toColumn"):
        fixed = fixed.withColumn(c, F.when(F.col(c).rlike(r"^[^']+'\."), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)))
    done = fixed.select("path", "guid", *side("from"), *side("to"), F.coalesce("fromCardinality", F.lit("many")).alias("from_cardinality"), F.coalesce("toCardinality", F.lit("one")).alias("to_cardinality"), F.coalesce("crossFilteringBehavior", F.lit("single")).alias("cross_filtering"), (~F.coalesce(F.lower("isActive").isin("false", "0", "no"), F.lit(False))).alias("is_active"))
    return done.where("from_table IS NOT NULL AND to_table IS NOT NULL")


BIM = """model struct<tables: array<struct<name: string, description: string, lineageTag: string, isHidden: boolean,
  columns: array<struct<name: string, dataType: string, type: string, expression: string, description: string, lineageTag: string, formatString: string, isHidden: boolean>>,
  measures: array<struct<name: string, expression: string, description: string, lineageTag: string, formatString: string, isHidden: boolean>>,
  partitions: array<struct<name: string, mode: string, source: struct<type: string, expression: string>>>>>,
  relationships: array<struct<name: string, fromTable: string, fromColumn: string, toTable: string, toColumn: string, fromCardinality: string, toCardinality: string, crossFilteringBehavior: string, isActive: boolean>>>"""


def _text(expression: Column) -> Column:
    """An expression that JSON gives as a string or as a list of lines."""
    lines = F.from_json(expression, "array<string>")
    return F.when(expression.startswith("["), F.coalesce(F.array_join(lines, "\n"), expression)).otherwise(expression)


def bim_blocks(files: DataFrame) -> DataFrame:
    """The columns of tmdl_blocks for BIM files; the model's own date tables and hidden columns go."""
    tables = files.select("path", F.from_json("content", BIM)["model"].alias("m")).select("path", F.explode("m.tables").alias("t"))
    for like in OWN_TABLES:
        tables = tables.where(~F.col("t.name").like(like))
    none = F.lit(None).cast("string")

    def part(name: str, kind: str, *more: Column) -> DataFrame:
        # The list is taken out of its table first, else each of its entries would carry the whole table with it.
        lists = tables.select("path", F.col("t.name").alias("table_name"), F.col("t.lineageTag").alias("table_tag"), F.col(f"t.{name}").alias("list"))
        rows = lists.select("path", "table_name", "table_tag", F.posexplode("list").alias("block", "b"))
        rows = rows.where(~F.coalesce("b.isHidden", F.lit(False))) if kind == "column" else rows
        return rows.select("path", "table_name", "table_tag", "block", F.lit(kind).alias("kind"), F.col("b.name").alias("name"), *more)

    b = lambda c: F.col(f"b.{c}")
    columns = part("columns", "column", _text(b("expression")).alias("expression"), F.when(b("type") == "calculated", "calculated").otherwise("data").alias("type"), b("description").alias("description"), b("lineageTag").alias("lineage_tag"), b("dataType").alias("data_type"), b("formatString").alias("format_string"))
    measures = part("measures", "measure", _text(b("expression")).alias("expression"), none.alias("type"), b("description").alias("description"), b("lineageTag").alias("lineage_tag"), none.alias("data_type"), b("formatString").alias("format_string"))
    source = _text(b("source.expression"))
    partitions = part("partitions", "partition", source.alias("expression"), F.coalesce(b("source.type"), partition_kind(source)).alias("type"), none.alias("description"), none.alias("lineage_tag"), none.alias("data_type"), none.alias("format_string"))
    return columns.unionByName(measures).unionByName(partitions)


def bim_relationships(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.from_json("content", BIM)["model"].alias("m")).select("path", F.explode("m.relationships").alias("r"))
    r = lambda c, default: F.coalesce(f"r.{c}", F.lit(default))
    return rows.select("path", F.col("r.name").alias("guid"), F.col("r.fromTable").alias("from_table"), F.col("r.fromColumn").alias("from_column"), F.col("r.toTable").alias("to_table"), F.col("r.toColumn").alias("to_column"), r("fromCardinality", "many").alias("from_cardinality"), r("toCardinality", "one").alias("to_cardinality"), r("crossFilteringBehavior", "single").alias("cross_filtering"), r("isActive", True).alias("is_active"))


def models(tmdl: DataFrame, bim: DataFrame, model_of: Column) -> DataFrame:
    """Blocks of all models; a model that has a BIM file is read from that alone. model_of: the model's key, from path."""
    keyed = lambda df: df.withColumn("model", model_of)
    return keyed(bim).unionByName(keyed(tmdl).join(keyed(bim).select("model").distinct(), "model", "left_anti").select(*keyed(bim).columns))


def dependencies(blocks: DataFrame) -> DataFrame:
    """(object, object_type, object_table, referenced, referenced_type, referenced_table) of all measures, calculated columns and calculated tables, each once.

    [x] is a measure where the model has one of the name, else a column; 'T'[c] is a table and its column; a bare word is a table where there is one, but not the object itself.
    Takes tmdl_blocks() with a column `model`; names are looked up within a model.
    """
    from orrery.functions import extract

    blocks = many(blocks)
    is_column, is_part = F.col("kind") == "column", F.col("kind") == "partition"
    asked = blocks.where((F.col("kind") == "measure") | (is_column & (F.col("type") == "calculated")) | (is_part & (F.col("type") == "calculated")))
    asked = asked.select("model", F.when(is_part, F.col("table_name")).otherwise(F.col("name")).alias("object"), F.when(is_part, "PB_TABLE").when(is_column, "PB_COLUMN").otherwise("PB_MEASURE").alias("object_type"), F.col("table_name").alias("object_table"), F.col("expression").alias("dax"))
    found = lambda name: blocks.where("kind = 'measure'").groupBy("model", F.lower("name").alias("key")).agg(F.min("name").alias(name))
    tables = blocks.groupBy("model", F.lower("table_name").alias("key")).agg(F.min("table_name").alias("table"))
    owner = ["object", "object_type", "object_table"]
    none = F.lit(None).cast("string")
    bare = asked.select("model", *owner, F.explode(F.array_distinct(extract.bracket_tokens(F.col("dax")))).alias("x")).withColumn("key", F.lower("x")).join(found("measure"), ["model", "key"], "left")
    brackets = bare.select("model", *owner, F.coalesce("measure", "x").alias("referenced"), F.when(F.col("measure").isNotNull(), "PB_MEASURE").otherwise("PB_COLUMN").alias("referenced_type"), none.alias("referenced_table"))
    pairs = asked.select("model", *owner, F.explode(extract.table_columns(F.col("dax"))).alias("p"))
    whole = pairs.select("model", *owner, F.col("p.table").alias("referenced"), F.lit("PB_TABLE").alias("referenced_type"), none.alias("referenced_table"))
    parts = pairs.select("model", *owner, F.col("p.column").alias("referenced"), F.lit("PB_COLUMN").alias("referenced_type"), F.col("p.table").alias("referenced_table"))
    said = asked.select("model", *owner, F.explode(F.array_distinct(extract.words(F.col("dax")))).alias("x")).withColumn("key", F.lower("x")).where(F.col("key") != F.lower("object")).join(tables, ["model", "key"])
    named = said.select("model", *owner, F.col("table").alias("referenced"), F.lit("PB_TABLE").alias("referenced_type"), none.alias("referenced_table"))
    return brackets.unionByName(whole).unionByName(parts).unionByName(named).distinct()
