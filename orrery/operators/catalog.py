"""Searches, filters, lists and counts over items."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.extract import external_target
from orrery.functions.names import blank_to_null, qualified_name
from orrery.storage import drop, few, many, stored

#: Columns that may be filtered by equality and by which lists may be ordered.
FILTERS = ("item_type", "service", "workspace_id", "workspace_name", "dataset_id", "dataset_name", "table_name", "status", "is_unused", "datatype", "column_type", "item_group_id", "database_name", "schema_name")
ORDERS = ("item_name", "item_type", "workspace_name", "dataset_name", "connected_reports", "connected_visuals", "status")
PAGE, MOST = 50, 100_000
#: Types in the order in which a lookup prefers them.
TYPE_RANK = ("PB_MEASURE", "PB_REPORT", "PB_TABLE", "DBT_MODEL", "DBT_SOURCE", "PB_COLUMN", "DBT_COLUMN")


def contains(column: Column, text: str) -> Column:
    """In any case; the text's signs mean themselves."""
    return F.coalesce(F.contains(F.lower(column), F.lower(F.lit(text))), F.lit(False))


def any_contains(columns: Sequence[str], text: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | contains(F.col(c), text)
    return out


def in_organization(organization_id: int | None, strict: bool = False) -> Column:
    own = F.col("organization_id").eqNullSafe(F.lit(organization_id))
    return own if strict else own | F.col("organization_id").isNull()


def not_deleted(include: bool = False) -> Column:
    return F.lit(True) if include else ~F.coalesce("deleted", F.lit(False))


def filtered(items: DataFrame, asked: Mapping[str, object]) -> DataFrame:
    """Equality filters on known columns; others and blank values are ignored."""
    for c, v in asked.items():
        if c in FILTERS and c in items.columns and v not in (None, ""):
            items = items.where(F.col(c) == F.lit(v))
    return items


def page(items: DataFrame, order: str = "item_name", number: int = 1, size: int = PAGE, key: str = "item_id") -> DataFrame:
    """One page in a known order (- for descending), ties by id."""
    name = order.lstrip("-")
    if name not in ORDERS or name not in items.columns:
        name, order = "item_name", "item_name"
    size = max(1, min(size, MOST))
    return items.orderBy(F.desc(name) if order.startswith("-") else F.asc(name), key).offset((max(1, number) - 1) * size).limit(size)


def by_text(items: DataFrame, text: str, mode: str = "contains", column: str = "item_name") -> DataFrame:
    """contains, exact or regex, in any case; a regular expression that is none filters nothing."""
    if mode == "exact":
        return items.where(F.lower(column) == text.lower())
    if mode == "regex":
        try:
            re.compile(text)
        except re.error:
            return items
        return items.where(F.col(column).rlike(f"(?i){text}"))
    return items.where(contains(F.col(column), text))


def staged_lookup(items: DataFrame, text: str, most: int = 25, key: str = "item_id", column: str = "item_name") -> DataFrame:
    """Exact id (stage 0), else exact name in any case (1), else names that contain it (2): the first stage that finds any. Ranked by type, reports, visuals.

    One pass: each row gets its stage, and the least stage of all is found by an aggregate of one row.
    """
    name = F.lower(F.trim(column))
    stage = F.when(F.col(key) == text, 0).when(name == text.strip().lower(), 1).when(contains(F.col(column), text.strip()), 2)
    hits = items.withColumn("stage", stage).where("stage IS NOT NULL")
    least = hits.agg(F.min("stage").alias("least"))
    found = hits.join(F.broadcast(least), F.col("stage") == F.col("least")).drop("least")
    return found.orderBy(*_ranks(items), F.lower(column), key).limit(most)


def _ranks(items: DataFrame) -> list[Column]:
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TYPE_RANK)), F.col("item_type")), F.lit(0))
    out = [F.when(rank == 0, len(TYPE_RANK) + 1).otherwise(rank)] if "item_type" in items.columns else []
    return out + [F.desc(F.coalesce(c, F.lit(0))) for c in ("connected_reports", "connected_visuals") if c in items.columns]


def disambiguated(items: DataFrame, name: str, workspace: str | None = None, dataset: str | None = None) -> tuple[str, DataFrame]:
    """(NONE, ONE or MANY, candidates): a name's items narrowed by workspace and then by dataset, as far as something is left."""
    found = items.where(F.lower("item_name") == name.strip().lower())
    for column, value in (("workspace_name", workspace), ("dataset_name", dataset)):
        if value:
            narrower = found.where(contains(F.col(column), value))
            found = narrower if not narrower.isEmpty() else found
    some = found.orderBy(*(c for c in ("workspace_name", "dataset_name") if c in items.columns), "item_id").limit(MOST)
    n = some.limit(2).count()
    return ("NONE", "ONE", "MANY")[n], some


def columns_of(items: DataFrame, text: str, dataset: str | None = None, workspace: str | None = None, table: str | None = None, most: int = 100) -> DataFrame:
    found = items.where(F.col("item_type").isin("PB_COLUMN", "DBT_COLUMN") & any_contains(("item_name", "description"), text))
    for c, v in (("dataset_name", dataset), ("workspace_name", workspace), ("table_name", table)):
        found = found.where(F.lower(c) == v.lower()) if v else found
    return found.orderBy("dataset_name", "table_name", "item_name", "item_id").limit(most)


def cascade(items: DataFrame, workspace: str | None = None, dataset: str | None = None) -> dict[str, DataFrame]:
    """Distinct workspaces; datasets of a workspace; tables of a workspace and dataset: each truly distinct, in order."""
    own = items.where(F.col("item_type").isin("PB_TABLE", "PB_COLUMN", "PB_MEASURE", "PB_REPORT"))
    in_workspace = own.where(F.col("workspace_id") == workspace) if workspace else own
    in_dataset = in_workspace.where(F.col("dataset_id") == dataset) if dataset else in_workspace
    listed = lambda df, *c: df.select(*c).where(F.col(c[0]).isNotNull()).distinct().orderBy(*c)
    return {"workspaces": listed(items, "workspace_id", "workspace_name"), "datasets": listed(in_workspace, "dataset_id", "dataset_name"), "tables": listed(in_dataset, "table_name")}


def with_governance(items: DataFrame, groups: DataFrame, people: DataFrame, departments: DataFrame, categories: DataFrame) -> DataFrame:
    """Items with their group's governance under flat names."""
    named = lambda df, key, alias: df.select(F.col("id").alias(key), F.col("name").alias(alias), *([F.col("slack_handle").alias(f"{alias}_slack")] if "slack_handle" in df.columns else []))
    own = groups.select(F.col("id").alias("item_group_id"), "ownership_department_id", "ownership_person_id", "steward_id", "category_id", F.col("status").alias("group_status"), "custom_description", "primary_item_id")
    out = items.join(own, "item_group_id", "left")
    for df, key, alias in ((departments, "ownership_department_id", "department"), (people, "ownership_person_id", "owner"), (people, "steward_id", "steward"), (categories, "category_id", "category")):
        out = out.join(named(df, key, alias), key, "left")
    return out.withColumn("is_primary", F.col("primary_item_id").eqNullSafe(F.col("item_id"))).withColumn("is_used", ~F.coalesce("is_unused", F.lit(False)))


def narrow(items: DataFrame) -> DataFrame:
    return items.select("item_id", "item_name", "item_type", "service", "workspace_name", "dataset_name", "description")


def group_filtered(groups: DataFrame, used: bool | None = None, described: bool | None = None, status: str | None = None, multiple: bool | None = None) -> DataFrame:
    """Groups (kind, status, used, described, instances) by predicates; multiple or single applies to measure groups alone, status counts as UNVERIFIED where missing."""
    for flag, c in ((used, "used"), (described, "described")):
        groups = groups.where(F.col(c) == flag) if flag is not None else groups
    if status:
        groups = groups.where(F.coalesce("status", F.lit("UNVERIFIED")) == status)
    if multiple is not None:
        groups = groups.where((F.col("kind") == "measure_name") & ((F.col("instances") > 1) == multiple))
    return groups


def people_in(people: DataFrame, bridge: DataFrame, department_id: int | None = None, role: str | None = None) -> DataFrame:
    """People by role flag (owner, steward, other) and department; each once."""
    people = people.where(F.col(f"is_{role}")) if role in ("owner", "steward", "other") else people
    return people.join(bridge.where(F.col("department_id") == department_id).select(F.col("person_id").alias("id")), "id", "left_semi") if department_id is not None else people


def tasks_in(tasks: DataFrame, state: str = "open") -> DataFrame:
    return tasks if state == "all" else tasks.where(F.col("state") == state)


def type_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("item_type").agg(F.count(F.lit(1)).alias("items"))


def summary(items: DataFrame) -> DataFrame:
    """One row of counts by type, in one pass."""
    n = lambda kind, name: F.count_if(F.col("item_type") == kind).alias(name)
    return items.where(not_deleted()).agg(n("PB_REPORT", "reports"), n("PB_MEASURE", "measures"), n("PB_TABLE", "tables"), n("PB_COLUMN", "columns"), n("DBT_MODEL", "models"))


def cleanup_counts(items: DataFrame, workspace_id: str | None = None, dataset_id: str | None = None) -> DataFrame:
    """One row: unused measures, columns and tables, measures without a description (their own or their group's), external measures."""
    from orrery.functions.rules import is_external_measure

    own = items.where(not_deleted())
    for c, v in (("workspace_id", workspace_id), ("dataset_id", dataset_id)):
        own = own.where(F.col(c) == v) if v else own
    kind = lambda k: F.col("item_type") == k
    blank = blank_to_null(F.col("description")).isNull() & blank_to_null(F.col("custom_description")).isNull()
    return own.agg(
        F.count_if(kind("PB_MEASURE") & F.col("is_unused")).alias("unused_measures"), F.count_if(kind("PB_COLUMN") & F.col("is_unused")).alias("unused_columns"), F.count_if(kind("PB_TABLE") & F.col("is_unused")).alias("unused_tables"),
        F.count_if(kind("PB_MEASURE") & blank).alias("missing_docs"), F.count_if(kind("PB_MEASURE") & is_external_measure(F.col("expression"), F.col("description"))).alias("external_measures"),
    )


def undocumented(items: DataFrame, item_type: str) -> DataFrame:
    return items.where((F.col("item_type") == item_type) & blank_to_null(F.col("description")).isNull()).orderBy("item_name", "item_id")


def top(items: DataFrame, by: str, most: int = 15, key: str = "item_id") -> DataFrame:
    return items.orderBy(F.desc(F.coalesce(by, F.lit(0))), "item_name", key).limit(most)


def profile(item: DataFrame, edges: DataFrame, nodes: DataFrame, siblings: DataFrame) -> dict[str, DataFrame]:
    """One item's parts: identity, what it uses and what uses it, and the rest of its group."""
    from orrery.functions.names import node_id

    own = few(item.select(node_id(F.col("item_type"), F.col("item_id")).alias("own")))
    named = nodes.select(F.col("node_id").alias("other"), "name", "group")
    up = edges.join(own.withColumnRenamed("own", "target"), "target").select(F.col("source").alias("other"), "kind").join(named, "other", "left")
    down = edges.join(own.withColumnRenamed("own", "source"), "source").select(F.col("target").alias("other"), "kind").join(named, "other", "left")
    rest = siblings.join(few(item.select("group_id", F.col("item_id").alias("_own"))), "group_id").where("item_id <> _own").drop("_own")
    return {"identity": item, "uses": up, "used_by": down, "siblings": rest}


def schema_bundle(measure: DataFrame, items: DataFrame, relationships: DataFrame, most_columns: int = 40, most_siblings: int = 15) -> dict[str, DataFrame]:
    """What is needed to query a measure: its tables (home, named in its expression, one join away), their columns with join keys first, their
    relationships, those that the expression activates, and sibling measures of the home table.
    """
    from orrery.functions import extract

    home = measure.select("dataset_id", F.col("table_name").alias("table"), "expression", F.col("item_id").alias("_own"))
    said = home.select("dataset_id", F.explode(extract.table_columns(F.col("expression"))["table"]).alias("table"))
    named = home.select("dataset_id", "table").unionByName(said).where("table IS NOT NULL").distinct()
    named = few(stored(named))
    ends = relationships.select("dataset_id", F.col("from_table").alias("table"), F.col("to_table").alias("other")).unionByName(relationships.select("dataset_id", F.col("to_table").alias("table"), F.col("from_table").alias("other")))
    tables = few(stored(named.unionByName(ends.join(named, ["dataset_id", "table"]).select("dataset_id", F.col("other").alias("table"))).distinct()))
    own = relationships.join(few(home.select("dataset_id").distinct()), "dataset_id", "left_semi")
    keys = own.select("dataset_id", F.col("from_table").alias("table"), F.col("from_column").alias("item_name")).unionByName(own.select("dataset_id", F.col("to_table").alias("table"), F.col("to_column").alias("item_name"))).distinct().withColumn("is_key", F.lit(True))
    columns = items.where("item_type = 'PB_COLUMN'").withColumnRenamed("table_name", "table").join(tables, ["dataset_id", "table"], "left_semi").join(keys, ["dataset_id", "table", "item_name"], "left")
    place = Window.partitionBy("dataset_id", "table").orderBy(F.when(F.col("is_key"), 0).otherwise(1), "item_name", "item_id")
    columns = columns.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most_columns)
    siblings = items.where("item_type = 'PB_MEASURE'").withColumnRenamed("table_name", "table").join(few(home.select("dataset_id", "table", "_own")), ["dataset_id", "table"]).where("item_id <> _own").orderBy("item_name", "item_id").limit(most_siblings)
    activated = home.select("dataset_id", F.explode(extract.activated_relationships(F.col("expression"))).alias("r")).select("dataset_id", "r.*")
    return {"tables": tables, "columns": columns, "relationships": own, "activated": activated, "siblings": siblings}


def default_workspace(organizations: DataFrame, users: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(user_id, workspace_id): an organisation's only workspace, else the user's default, else the organisation's, else none."""
    only = workspaces.groupBy("organization_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("workspace_id")).alias("only"))
    joined = users.join(organizations.select(F.col("id").alias("organization_id"), F.col("default_workspace").alias("org_default")), "organization_id", "left").join(only, "organization_id", "left")
    return joined.select("user_id", F.coalesce("only", blank_to_null(F.col("default_workspace")), blank_to_null(F.col("org_default"))).alias("workspace_id"))


def listing(models: DataFrame, cap: int = 180) -> DataFrame:
    """Models as a reader of the catalogue sees them: qualified name, one line of description."""
    from orrery.functions.names import one_line

    return models.select(qualified_name(F.col("database_name"), F.col("schema_name"), F.col("alias"), F.col("table_name")).alias("name"), one_line(F.coalesce("description", F.lit("")), cap).alias("description")).orderBy("name")


def flat_schema(df: DataFrame) -> list[tuple[str, str]]:
    """(a.b.c, type) of all columns, nested ones included."""
    from pyspark.sql import types as T

    def walk(prefix: str, kind: T.DataType):
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if isinstance(kind, T.StructType):
            for f in kind:
                yield from ((f"{prefix}{f.name}", f.dataType.simpleString()),)
                yield from walk(f"{prefix}{f.name}.", f.dataType)

    return list(walk("", df.schema))


def markdown(df: DataFrame, most: int = 50) -> str:
    """The first rows as a table of text."""
    rows = df.limit(most).collect()
    line = lambda values: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in values) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def wrapper_targets(measures: DataFrame) -> DataFrame:
    """(item_id, target_id, matched, candidates) of measures (item_id, item_name, dataset_name, expression) that only stand for one of another dataset.

    Candidates have the measure's name, in the dataset that the connection names (in any case); where there is none, in datasets whose name holds it. The
    first by item_id is the target; `candidates` counts them. Both are found for distinct names, datasets and labels, so many wrappers of one measure are one row.
    """
    link = measures.select("item_id", external_target(F.col("expression")).alias("x")).where("x.is_wrapper")
    link = link.select("item_id", F.col("x.measure").alias("name"), F.lower("x.dataset").alias("label"))
    known = measures.groupBy(F.col("item_name").alias("name"), F.lower("dataset_name").alias("dataset")).agg(F.min("item_id").alias("target_id"), F.count(F.lit(1)).alias("n"))
    asked = link.select("name", "label").distinct()
    near = asked.join(known, "name").where(F.contains("dataset", F.col("label")))
    best = near.groupBy("name", "label", (F.col("dataset") != F.col("label")).alias("held")).agg(F.min("target_id").alias("target_id"), F.sum("n").alias("candidates"))
    best = best.groupBy("name", "label").agg(F.min_by(F.struct("held", "target_id", "candidates"), "held").alias("b"))
    found = link.join(best, ["name", "label"])
    return found.select("item_id", "b.target_id", F.when(F.col("b.held"), "contained").otherwise("exact").alias("matched"), F.col("b.candidates").alias("candidates"))


def wrapper_sources(measures: DataFrame) -> DataFrame:
    """(item_id, target_id, matched, candidates, source_id, hops) of wrapper_targets() with the measure at the end of each chain of wrappers, null (hops too) where it runs into a cycle.

    By pointer jumping: each round every pointer goes on to where its target points, so chains of any length need as many rounds as their length has binary
    digits. More hops than there are wrappers mean a cycle.
    """
    direct = stored(wrapper_targets(measures))
    n = direct.count()
    ends = stored(direct.select("item_id", F.col("target_id").alias("at"), F.lit(1).cast("long").alias("hops")))
    while True:
        ahead = ends.select(F.col("item_id").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"))
        moving = ends.join(few(ahead), "at", "left")
        before, ends = ends, stored(moving.select("item_id", F.when(F.col("hops") > n, F.col("at")).otherwise(F.coalesce("next", "at")).alias("at"), F.when(F.col("hops") > n, F.col("hops")).otherwise(F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
        still = ends.where(F.col("hops") <= n).join(few(ends.select(F.col("item_id").alias("at"))), "at", "left_semi").isEmpty()
        drop(before)
        if still:
            break
    done = direct.join(many(ends), "item_id")
    whole = F.col("hops") <= n
    return done.select("item_id", "target_id", "matched", "candidates", F.when(whole, F.col("at")).alias("source_id"), F.when(whole, F.col("hops")).alias("hops"))
