"""Bridges between models of the transformation tool and tables of the BI tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.names import bridge_name, node_id, relation_name
from orrery.storage import drop, few, stored

# Reasons of a match, in the order of the passes.
REASONS = ("bq_fqn", "name_full", "name_tail")
#: Pairs that one cell of a join gives, and the most tasks of one join.
PAIRS, MOST_TASKS = 2_000_000, 10_000


def unique_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) for keys that belong to one value alone."""
    counted = df.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_last"))
    return counted.where(F.col(value) == F.col("_last")).select(key, value)


def cascade(left: DataFrame, left_id: str, passes: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """left's id with the first pass's unique match: each pass is (reason, key column of left, (key, match) with unique keys).

    Keys that are missing or ambiguous on the right fall through to the next pass. Passes are joins of the rows that are
    still open, so a row that matched early is not looked up again.
    """
    todo, done = left, None
    for reason, key, right in passes:
        joined = stored(todo.join(right.select(F.col(right.columns[0]).alias(key), F.col(right.columns[1]).alias("_match")), key, "left"))
        found = joined.where("_match IS NOT NULL").select(left_id, F.col("_match").alias("match"), F.lit(reason).alias("reason"))
        done = found if done is None else done.unionByName(found)
        todo = joined.where("_match IS NULL").drop("_match").select(*left.columns)
    return done


def _triple(a: Column, b: Column, c: Column) -> Column:
    return F.when((a != "") & (b != "") & (c != ""), F.concat_ws("\x1f", a, b, c))


def model_keys(models: DataFrame) -> DataFrame:
    """item_id, fqn, full, tail of models (item_id, database_name, schema_name, alias, table_name); parts of the name stand in for a missing schema or alias."""
    parts = F.split("table_name", r"\.")
    schema = F.coalesce(F.nullif(bridge_name(F.col("schema_name")), F.lit("")), F.when(F.size(parts) >= 2, bridge_name(F.element_at(parts, -2))), F.lit(""))
    alias = F.coalesce(F.nullif(bridge_name(F.col("alias")), F.lit("")), bridge_name(F.element_at(parts, -1)))
    return models.select("item_id", _triple(bridge_name(F.col("database_name")), schema, alias).alias("fqn"), bridge_name(F.col("table_name")).alias("full"), bridge_name(F.substring_index("table_name", ".", -1)).alias("tail"))


def table_keys(tables: DataFrame) -> DataFrame:
    """item_id, fqn, name of BI tables (item_id, item_name, bq_project, bq_schema, bq_source_name)."""
    own = [bridge_name(F.col(c)) for c in ("bq_project", "bq_schema", "bq_source_name")]
    return tables.select("item_id", _triple(*own).alias("fqn"), F.nullif(bridge_name(F.col("item_name")), F.lit("")).alias("name"))


def bridge_tables(tables: DataFrame, models: DataFrame) -> DataFrame:
    """(pbi_item_id, dbt_item_id, reason): every table's unique model by qualified name, else full name, else last part."""
    right = stored(model_keys(models))
    left = table_keys(tables)
    found = cascade(
        left.select("item_id", "fqn", F.col("name"), F.col("name").alias("tail")), "item_id",
        [("bq_fqn", "fqn", unique_by(right, "fqn", "item_id")), ("name_full", "name", unique_by(right, "full", "item_id")), ("name_tail", "tail", unique_by(right, "tail", "item_id"))],
    )
    return found.select(F.col("item_id").alias("pbi_item_id"), F.col("match").alias("dbt_item_id"), "reason")


def bridge_preview(tables: DataFrame, models: DataFrame) -> DataFrame:
    """All candidates of all passes, unique or not; a model whose full name matches is no tail match as well."""
    right, left = stored(model_keys(models).withColumnRenamed("item_id", "dbt_item_id")), stored(table_keys(tables).withColumnRenamed("item_id", "pbi_item_id"))

    def one(key: str, on: str, reason: str, more: Column | None = None) -> DataFrame:
        own = right.select("dbt_item_id", F.col(on).alias("_key"), F.col("full").alias("_full"))
        found = _all_pairs(left.select("pbi_item_id", F.col(key).alias("_key")), own, "_key", "pbi_item_id", "dbt_item_id")
        return (found if more is None else found.where(more)).select("pbi_item_id", "dbt_item_id", F.lit(reason).alias("reason"))

    by_tail = one("name", "tail", "name_tail", F.col("_key") != F.col("_full"))
    return one("fqn", "fqn", "bq_fqn").unionByName(one("name", "full", "name_full")).unionByName(by_tail)


def _all_pairs(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """left joined with right by key, where a key of few may give most rows: a key's pairs are dealt over as many cells as they need, cells over as many tasks.

    The pairs are counted by key first. The table with fewer rows has a copy for each cell of a key, the other's rows lie in one each, by a hash of their ids.
    """
    count = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n))
    each = stored(count(left, "_l").join(count(right, "_r"), key).withColumn("_cells", F.ceil(F.col("_l") * F.col("_r") / PAIRS).cast("int")))
    total = each.agg(F.sum("_cells"), F.sum(F.col("_l") * F.col("_r")), F.sum("_l"), F.sum("_r")).first()
    if total[0] is None:
        drop(each)
        return left.join(right, key)
    tasks = min(MOST_TASKS, max(1, -(-int(total[1]) // PAIRS)))
    cells = few(each.select(key, "_cells"))
    dealt = lambda df, of: df.join(cells, key).withColumn("_cell", F.pmod(F.xxhash64(of), F.col("_cells")).cast("int")).drop("_cells")
    copied = lambda df: df.join(cells, key).withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).drop("_cells")
    a, b = (dealt(left, left_id), copied(right)) if total[3] <= total[2] else (copied(left), dealt(right, right_id))
    spread = lambda df: df.repartition(tasks, key, "_cell")
    return spread(a).join(spread(b).hint("shuffle_hash"), [key, "_cell"]).drop("_cell")


def bridge_columns(pairs: DataFrame, pbi_columns: DataFrame, dbt_columns: DataFrame) -> DataFrame:
    """(dbt_column, pbi_column) of matched tables whose names agree. Columns are (owner, item_id, item_name); of BI columns with one name the first id counts."""
    pbi = pbi_columns.select(F.col("owner").alias("pbi_item_id"), bridge_name(F.col("item_name")).alias("key"), "item_id").where("key <> ''").groupBy("pbi_item_id", "key").agg(F.min("item_id").alias("pbi_column"))
    dbt = dbt_columns.select(F.col("owner").alias("dbt_item_id"), bridge_name(F.col("item_name")).alias("key"), F.col("item_id").alias("dbt_column"))
    return pairs.join(dbt, "dbt_item_id").join(pbi, ["pbi_item_id", "key"]).select("dbt_column", "pbi_column")


def build_bridges(edges: DataFrame, pairs: DataFrame, column_pairs: DataFrame) -> DataFrame:
    """Edges with old bridges replaced by new ones: tables with their reason, columns as pass-through. Running it again changes nothing."""
    schema = ["source", "target", "bridge_reason", "kind", "level", "lineage_type"]
    none = F.lit(None).cast("string")
    tables = pairs.select(node_id(F.lit("DBT_MODEL"), F.col("dbt_item_id")).alias("source"), node_id(F.lit("PB_TABLE"), F.col("pbi_item_id")).alias("target"), F.col("reason").alias("bridge_reason"), F.lit("model").alias("kind"), F.lit("asset").alias("level"), none.alias("lineage_type"))
    columns = column_pairs.select(node_id(F.lit("DBT_COLUMN"), F.col("dbt_column")).alias("source"), node_id(F.lit("PB_COLUMN"), F.col("pbi_column")).alias("target"), F.lit("column_name").alias("bridge_reason"), F.lit("column").alias("kind"), F.lit("column").alias("level"), F.lit("pass-through").alias("lineage_type"))
    new = tables.unionByName(columns).dropDuplicates(["source", "target"])
    old = edges.where("bridge_reason IS NULL").select(*schema).join(new, ["source", "target"], "left_anti")
    return old.unionByName(new.select(*schema))


def reasons(edges: DataFrame) -> DataFrame:
    return edges.where("bridge_reason IS NOT NULL").groupBy("bridge_reason").agg(F.count(F.lit(1)).alias("edges"))


def relation_index(models: DataFrame) -> DataFrame:
    """(key, item_id): qualified names in three parts always, in two parts where only one model has them."""
    three = F.concat_ws(".", *(relation_name(F.col(c)) for c in ("database_name", "schema_name", "alias")))
    two = F.concat_ws(".", relation_name(F.col("schema_name")), relation_name(F.col("alias")))
    keyed = models.select("item_id", three.alias("three"), two.alias("two"))
    return keyed.groupBy(F.col("three").alias("key")).agg(F.min("item_id").alias("item_id")).unionByName(unique_by(keyed, "two", "item_id").withColumnRenamed("two", "key"))


def resolved_relations(refs: DataFrame, index: DataFrame) -> DataFrame:
    """refs (ref) with item_id: the last three parts of the name as relation_index() has them, else the last two; null where neither is known."""
    parts = F.transform(F.split("ref", r"\."), relation_name)
    tail = lambda n: F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, -n, n)))
    known = lambda n: index.select(F.col("key").alias(f"_k{n}"), F.col("item_id").alias(f"_i{n}"))
    asked = refs.withColumn("_k3", tail(3)).withColumn("_k2", tail(2))
    return asked.join(known(3), "_k3", "left").join(known(2), "_k2", "left").select(*refs.columns, F.coalesce("_i3", "_i2").alias("item_id"))


def owned_columns(tables: DataFrame, models: DataFrame, pbi_columns: DataFrame, dbt_columns: DataFrame, by_name: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both tools' columns with their owners, as bridge_columns() takes them.

    A model owns the columns of its dataset_id. A BI table owns the columns of its name, of any dataset unless by_name is off. BI columns of one
    table name and column name are reduced to the first by id before the join.
    """
    keys = ["table_name"] if by_name else ["dataset_id", "table_name"]
    first = pbi_columns.groupBy(*keys, bridge_name(F.col("item_name")).alias("item_name")).agg(F.min("item_id").alias("item_id"))
    owners = tables.select(F.col("item_id").alias("owner"), F.col("item_name").alias("table_name"), *keys[:-1])
    pbi = first.join(owners, keys).select("owner", "item_id", "item_name")
    dbt = dbt_columns.join(models.select(F.col("item_id").alias("owner"), "dataset_id"), "dataset_id").select("owner", "item_id", "item_name")
    return pbi, dbt
