"""Footers, tiles, report health, cleanup lists and statistics by workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.names import blank_to_null, node_id
from orrery.operators import catalog, graph

# Counts of connections and their labels, in the order in which they are listed.
CONNECTIONS = (("connected_reports", "reports"), ("connected_visuals", "visuals"), ("connected_measures", "measures"), ("connected_columns", "columns"), ("connected_tables", "tables"))
# Columns by which report health may be sorted; numbers descend unless asked otherwise.
HEALTH_TEXT, HEALTH_NUMBERS = ("name", "workspace"), ("pages", "visuals", "measures", "columns", "complexity", "ratio")
MISSING, NO_CONNECTIONS, MOST_TEXT = "—", "no connections recorded", 600


def _count(items: DataFrame, column: str) -> Column:
    return F.coalesce(column, F.lit(0)).cast("long") if column in items.columns else F.lit(0).cast("long")


def footers(items: DataFrame) -> DataFrame:
    """(item_id, owner, steward, department, description, usage, is_unused) of items that catalog.with_governance() has joined.

    Missing people and departments are dashes; an item's own text wins over its description; usage lists the connections that are not zero.
    """
    named = lambda c: F.coalesce(blank_to_null(F.col(c)), F.lit(MISSING)).alias(c)
    text = F.substring(F.trim(F.coalesce(blank_to_null(F.col("custom_description")), F.col("description"))), 1, MOST_TEXT)
    bits = F.concat_ws(", ", *(F.when(_count(items, c) > 0, F.concat(_count(items, c).cast("string"), F.lit(f" {label}"))) for c, label in CONNECTIONS))
    return items.select("item_id", named("owner"), named("steward"), named("department"), blank_to_null(text).alias("description"), F.when(bits == "", NO_CONNECTIONS).otherwise(bits).alias("usage"), F.coalesce("is_unused", F.lit(False)).alias("is_unused"))


def sections(asked: DataFrame, items: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_id, section, other, name) of the asked items: what they use, what uses them, and the rest of their group.

    A row for each neighbour, so that a hub is no long array; asked items are few, and sent to every executor where they are.
    """
    own = asked.select("item_id", node_id(F.col("item_type"), F.col("item_id")).alias("_own"), "group_id")
    one = catalog.few(own)
    named = nodes.select(F.col("node_id").alias("other"), "name")
    side = lambda end, other, label: edges.join(one.select("item_id", F.col("_own").alias(end)), end).select("item_id", F.lit(label).alias("section"), F.col(other).alias("other")).distinct()
    linked = side("target", "source", "uses").unionByName(side("source", "target", "used by")).join(named, "other", "left")
    rest = items.select("group_id", F.col("item_id").alias("other"), F.col("item_name").alias("name")).join(one.select("group_id", "item_id"), "group_id").where("other <> item_id")
    return linked.select("item_id", "section", "other", "name").unionByName(rest.select("item_id", F.lit("group").alias("section"), "other", "name"))


def tiles(items: DataFrame) -> DataFrame:
    """(item_id, key, element_type, label, sub, tooltip) of tables, measures, columns and pages; other types give none."""
    kind = F.col("item_type")
    or_null = lambda *cs: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cs))
    calculated = F.lower(F.coalesce("column_type", F.lit(""))) == "calculated"
    pick = lambda table, measure, column, page: F.when(kind == "PB_TABLE", table).when(kind == "PB_MEASURE", measure).when(kind == "PB_COLUMN", column).when(kind == "PB_PAGE", page)
    none = F.lit(None).cast("string")
    held = F.concat(_count(items, "connected_measures").cast("string"), F.lit(" m, "), _count(items, "connected_columns").cast("string"), F.lit(" c"))
    sub = pick(held, or_null("table_name", "dataset_name"), F.nullif(F.concat_ws(" · ", or_null("table_name"), or_null("datatype")), F.lit("")), none)
    tooltip = pick(or_null("table_name", "dataset_name"), or_null("expression"), or_null("expression", "datatype"), or_null("dataset_name"))
    element = pick(F.lit("table"), F.lit("measure"), F.when(calculated, "calc_column").otherwise("column"), F.lit("page"))
    letter = pick(F.lit("t_"), F.lit("m_"), F.lit("c_"), F.lit("p_"))
    return items.where(element.isNotNull()).select("item_id", F.concat(letter, "item_id").alias("key"), element.alias("element_type"), F.col("item_name").alias("label"), sub.alias("sub"), tooltip.alias("tooltip"))


def relationship_tiles(items: DataFrame) -> DataFrame:
    """tiles() of the items' relationships_json, an array of (other_table, other_column, cardinality, other_cardinality, is_active), numbered from 0."""
    filled = lambda *cs: [F.nullif(c, F.lit("")) for c in cs]
    rows = items.select("item_id", F.coalesce(*filled(F.col("table_name"), F.col("item_name"))).alias("_from"), F.posexplode("relationships_json").alias("_i", "r"))
    to = F.concat_ws(".", *filled(F.col("r.other_table"), F.col("r.other_column")))
    both = F.concat_ws(" → ", *filled(F.col("r.cardinality"), F.col("r.other_cardinality")))
    label = F.concat(F.col("_from"), F.lit(" → "), F.when(to == "", "?").otherwise(to))
    active = F.when(F.col("r.is_active").eqNullSafe(F.lit(False)), "inactive relationship").otherwise("active relationship")
    return rows.select("item_id", F.concat_ws("_", F.lit("r"), "item_id", F.col("_i").cast("string")).alias("key"), F.lit("relationship").alias("element_type"), label.alias("label"), F.nullif(both, F.lit("")).alias("sub"), active.alias("tooltip"))


def report_health(items: DataFrame, by: str = "complexity", descending: bool | None = None, workspace: str | None = None) -> DataFrame:
    """Reports with pages, visuals, measures, columns, complexity (visuals + measures) and ratio (visuals a page), in the order of a column."""
    if by not in (*HEALTH_TEXT, *HEALTH_NUMBERS):
        raise ValueError(f"unknown column {by}")
    own = items.where("item_type = 'PB_REPORT'")
    own = own.where(F.col("workspace_name") == workspace) if workspace else own
    n = {name: _count(items, f"connected_{name}") for name in ("pages", "visuals", "measures", "columns")}
    text = lambda c, missing: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(missing))
    ratio = n["visuals"] / F.when(n["pages"] == 0, 1).otherwise(n["pages"])
    rows = own.select("item_id", text("item_name", "Unknown").alias("name"), text("workspace_name", MISSING).alias("workspace"), *(c.alias(k) for k, c in n.items()), (n["visuals"] + n["measures"]).alias("complexity"), ratio.alias("ratio"))
    down = by in HEALTH_NUMBERS if descending is None else descending
    return rows.orderBy(F.desc(by) if down else F.asc(by), "item_id")


def cleanup_lists(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(list, item_id, item_name) of unused models, seeds and sources, untested and undocumented models; each list by name."""
    own = items.where(catalog.not_deleted())
    models = own.where("item_type = 'DBT_MODEL'")
    unused = lambda kind, label: own.where((F.col("item_type") == kind) & F.col("is_unused")).withColumn("list", F.lit(label))
    untested = graph.untested(edges, models.withColumn("node_id", node_id(F.col("item_type"), F.col("item_id")))).withColumn("list", F.lit("untested models"))
    blank = models.where(F.coalesce("description", F.lit("")) == "").withColumn("list", F.lit("undocumented models"))
    every = [unused("DBT_MODEL", "unused models"), unused("DBT_SEED", "unused seeds"), unused("DBT_SOURCE", "unused sources"), untested, blank]
    out = every[0].select("list", "item_id", "item_name")
    for more in every[1:]:
        out = out.unionByName(more.select("list", "item_id", "item_name"))
    return out.orderBy("list", "item_name", "item_id")


def workspace_stats(items: DataFrame, usage: DataFrame) -> DataFrame:
    """(workspace_name, reports, pages, views, views_recent_month): items and usage count where they name a workspace; the month is the last of all usage.

    Both sides are counted by workspace before they meet, so only as many rows as there are workspaces are joined.
    """
    has = F.coalesce("workspace_name", F.lit("")) != ""
    is_a = lambda kind: F.count_if(F.col("item_type") == kind)
    counted = items.where(catalog.not_deleted() & has & F.col("item_type").isin("PB_REPORT", "PB_PAGE")).groupBy("workspace_name").agg(is_a("PB_REPORT").alias("reports"), is_a("PB_PAGE").alias("pages"))
    by_month = usage.groupBy("workspace_name", "month").agg(F.sum("view_count").alias("n"))
    last = by_month.agg(F.max("month").alias("_last"))
    viewed = by_month.crossJoin(F.broadcast(last)).where(has).groupBy("workspace_name").agg(F.sum("n").alias("views"), F.sum(F.when(F.col("month") == F.col("_last"), F.col("n"))).alias("views_recent_month"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return counted.join(viewed, "workspace_name", "full").select("workspace_name", *map(zero, ("reports", "pages", "views", "views_recent_month")))


def measures_of_report(measures: DataFrame, report_id: str, report_name: str) -> DataFrame:
    """(group_id, visuals) of measures whose connected_reports_json holds the report by id or, in any case, by name; most visuals first."""
    hit = F.exists("connected_reports_json", lambda r: F.coalesce((r["id"] == report_id) | (F.lower(F.trim(r["name"])) == report_name.strip().lower()), F.lit(False)))
    own = measures.where(F.coalesce(hit, F.lit(False)))
    return own.groupBy("group_id").agg(F.max(F.coalesce("connected_visuals", F.lit(0))).cast("long").alias("visuals")).orderBy(F.desc("visuals"), "group_id")
