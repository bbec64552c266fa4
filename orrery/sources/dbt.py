"""Transformation-project artifacts: manifest and catalog as items and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.extract import merged_meta, stats_text
from orrery.functions.names import blank_to_null, custom_id_skipping_blanks
from orrery.operators.groups import keep_first
from orrery.sources.files import text_files

_COLUMN = "struct<name: string, description: string, data_type: string, meta: map<string,string>, tags: array<string>, constraints: array<struct<type: string>>>"
_NODE = f"""struct<unique_id: string, resource_type: string, name: string, alias: string, identifier: string, database: string, schema: string, source_name: string, description: string, raw_code: string, raw_sql: string,
  compiled_code: string, compiled_sql: string, original_file_path: string, patch_path: string, access: string, loader: string, tags: array<string>, meta: map<string,string>, config: struct<materialized: string>,
  depends_on: struct<nodes: array<string>>, columns: map<string, {_COLUMN}>>"""
MANIFEST = f"metadata struct<project_name: string, dbt_schema_version: string>, nodes map<string, {_NODE}>, sources map<string, {_NODE}>, _corrupt string"
_SEEN = "struct<columns: map<string, struct<name: string, type: string, index: int, comment: string>>, stats: map<string, struct<label: string, value: string, include: boolean>>>"
CATALOG = f"nodes map<string, {_SEEN}>, sources map<string, {_SEEN}>, _corrupt string"
KINDS = {"model": "DBT_MODEL", "snapshot": "DBT_MODEL", "seed": "DBT_SEED", "source": "DBT_SOURCE", "test": "DBT_TEST"}


def find_artifacts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(path, content) of the files of a name below a folder; those in a target folder come alone where there are any."""
    found = text_files(spark, folder, name)
    target = found.where(F.col("path").contains("/target/"))
    return found.join(F.broadcast(target.agg((F.count(F.lit(1)) > 0).alias("_has")))).where(~F.col("_has") | F.col("path").contains("/target/")).drop("_has")


def parsed(files: DataFrame, schema: str) -> DataFrame:
    """The JSON of files (path, content) by a schema; what is not valid is kept in _corrupt with nulls, and stops nothing."""
    return files.select("path", F.from_json("content", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j")).select("path", "j.*")


def _entries(files: DataFrame, part: str, schema: str, whole: str) -> DataFrame:
    """(path, project, unique_id, v) of one object of each file's JSON, an entry a row.

    Files are parsed to variants and exploded before an entry gets its type, so a task holds no map of a whole project. What a variant cannot hold (Spark
    ends them at 16 MB) is read by its whole schema, with the same rows.
    """
    files = files.select("path", "content")
    sql = f"""SELECT path, variant_get(j, '$.metadata.project_name', 'string') AS project, e.key AS unique_id, from_json(to_json(e.value), '{schema}') AS v
        FROM (SELECT path, try_parse_json(content) AS j FROM {{files}}), LATERAL variant_explode(variant_get(j, '$.{part}', 'variant')) AS e"""
    large = parsed(files.where(F.try_parse_json("content").isNull()), whole)
    project = F.col("metadata.project_name") if "metadata" in large.columns else F.lit(None).cast("string")
    return files.sparkSession.sql(sql, files=files).unionByName(large.select("path", project.alias("project"), F.explode(part).alias("unique_id", "v")))


def manifest_rows(files: DataFrame) -> DataFrame:
    """(path, project, n) of all nodes and sources of manifest files (path, content) of any number of projects. A file that is no JSON gives no rows: see broken()."""
    return _entries(files, "nodes", _NODE, MANIFEST).unionByName(_entries(files, "sources", _NODE, MANIFEST)).select("path", "project", F.col("v").alias("n"))


def catalog_rows(files: DataFrame) -> DataFrame:
    """(path, unique_id, v) of all nodes and sources of catalog files."""
    return _entries(files, "nodes", _SEEN, CATALOG).unionByName(_entries(files, "sources", _SEEN, CATALOG)).select("path", "unique_id", "v")


def broken(files: DataFrame) -> DataFrame:
    """(path) of the files that are no JSON."""
    return parsed(files.where(F.try_parse_json("content").isNull()), MANIFEST).where("_corrupt IS NOT NULL").select("path")


def _seen(catalog: DataFrame) -> DataFrame:
    """(unique_id, v) of catalog_rows(), or of a catalog that parsed() gave."""
    if "v" in catalog.columns:
        return catalog.select("unique_id", "v")
    return catalog.select(F.explode("nodes").alias("unique_id", "v")).unionByName(catalog.select(F.explode("sources").alias("unique_id", "v")))


def nodes(manifest: DataFrame) -> DataFrame:
    """One row for each node and source of manifest_rows(), or of a manifest that parsed() gave, with its item's id and type."""
    if "n" in manifest.columns:
        rows = manifest.select("project", "n.*")
    else:
        one = lambda part: manifest.select(F.col("metadata.project_name").alias("project"), F.explode(F.map_values(part)).alias("n")).select("project", "n.*")
        rows = one("nodes").unionByName(one("sources"))
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("resource_type")]
    table = F.coalesce(blank_to_null(F.col("identifier")), F.col("name"))
    return rows.withColumn("item_type", kind).where("item_type IS NOT NULL").withColumn("table_name", F.when(F.col("resource_type") == "source", F.concat_ws(".", "source_name", table)).otherwise(F.col("name"))).withColumn("item_id", custom_id_skipping_blanks(F.col("unique_id")))


def described_columns(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Columns of all nodes: the manifest's in its order, then those that only the catalog has, by index. The catalog's type comes first, the manifest's description comes first."""
    said = rows.select("unique_id", F.posexplode(F.map_values("columns")).alias("place", "c")).select("unique_id", F.lower("c.name").alias("key"), "place", "c.*")
    seen = _seen(catalog).select("unique_id", F.explode(F.map_values("v.columns")).alias("k")).select("unique_id", F.lower("k.name").alias("key"), F.col("k.name").alias("seen_name"), F.col("k.type").alias("type"), F.col("k.index").alias("index"), F.col("k.comment").alias("comment"))
    joined = said.join(seen, ["unique_id", "key"], "full")
    return joined.select(
        "unique_id", F.coalesce("name", "seen_name").alias("column_name"), F.coalesce(blank_to_null(F.col("type")), blank_to_null(F.col("data_type"))).alias("datatype"),
        F.coalesce(blank_to_null(F.col("description")), blank_to_null(F.col("comment"))).alias("description"), "tags",
        merged_meta(F.col("meta"), F.when(F.size("constraints") > 0, F.create_map(F.lit("constraints"), F.array_join(F.transform("constraints", lambda x: x["type"]), ",")))).alias("meta"),
        F.coalesce(F.col("place"), F.lit(1_000_000) + F.col("index")).alias("ordinal"),
    )


def items(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalogue's items of a project: one workspace, its sources, models, seeds, tests and columns, in one union of ITEMS' columns."""
    rows = nodes(manifest)
    stats = _seen(catalog).select("unique_id", stats_text(F.map_values("v.stats")).alias("stats"))
    code = F.coalesce(blank_to_null(F.col("raw_code")), F.col("raw_sql"))
    own = rows.join(stats, "unique_id", "left").select(
        "item_id", F.col("table_name").alias("item_name"), "item_type", F.lit("dbt").alias("service"), F.concat_ws("\n", blank_to_null(F.col("description")), blank_to_null(F.col("stats"))).alias("description"),
        custom_id_skipping_blanks(F.col("project")).alias("workspace_id"), F.col("project").alias("workspace_name"), F.col("unique_id").alias("dataset_id"), "table_name", code.alias("expression"),
        F.coalesce("compiled_code", "compiled_sql").alias("compiled_expression"), F.col("database").alias("database_name"), F.col("schema").alias("schema_name"), F.coalesce("alias", "identifier", "name").alias("alias"), "tags",
        merged_meta(F.col("meta"), F.when(F.col("loader") != "", F.create_map(F.lit("loader"), F.col("loader"))), F.when(F.col("access") != "", F.create_map(F.lit("access"), F.col("access")))).alias("meta"),
    )
    columns = described_columns(rows, catalog).join(rows.select("unique_id", F.col("table_name"), "project"), "unique_id")
    columns = columns.select(custom_id_skipping_blanks(F.col("unique_id"), F.col("column_name")).alias("item_id"), F.col("column_name").alias("item_name"), F.lit("DBT_COLUMN").alias("item_type"), F.lit("dbt").alias("service"), "description", custom_id_skipping_blanks(F.col("project")).alias("workspace_id"), F.col("project").alias("workspace_name"), F.col("unique_id").alias("dataset_id"), "table_name", "datatype", "tags", "meta")
    workspace = rows.select(custom_id_skipping_blanks(F.col("project")).alias("item_id"), F.col("project").alias("item_name"), F.lit("DBT_WORKSPACE").alias("item_type"), F.lit("dbt").alias("service")).distinct()
    return own.unionByName(columns, allowMissingColumns=True).unionByName(workspace, allowMissingColumns=True)


def edges(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Staged edges: from nodes to the columns in them, from dependencies to models and tests. The first of a pair stays."""
    rows = nodes(manifest)
    own = rows.select("unique_id", "item_id", "table_name", "item_type")
    end = lambda side: own.select(F.col("unique_id").alias(f"{side}_key"), F.col("item_id").alias(f"{side}_id"), F.col("table_name").alias(side), F.col("item_type").alias(f"{side}_type"))
    needs = rows.select(F.col("unique_id").alias("target_key"), F.explode("depends_on.nodes").alias("source_key")).join(end("source"), "source_key").join(end("target"), "target_key").drop("source_key", "target_key")
    inside = described_columns(rows, catalog).withColumnRenamed("unique_id", "source_key").join(end("source"), "source_key")
    inside = inside.select("source_id", "source", "source_type", custom_id_skipping_blanks(F.col("source_key"), F.col("column_name")).alias("target_id"), F.col("column_name").alias("target"), F.lit("DBT_COLUMN").alias("target_type"))
    every = inside.withColumn("seq", F.lit(0)).unionByName(needs.withColumn("seq", F.lit(1)))
    return keep_first(every, ["source_id", "target_id"], "seq").drop("seq")


def resolved_refs(sql: Column, refs: Column, sources: Column) -> Column:
    """SQL with {{ ref('x') }} and {{ source('a', 'b') }} replaced by their relations (map<string,string>, sources keyed a.b) and other
    braces of config gone; null where a reference is unknown or a brace is left."""
    text = F.regexp_replace(F.regexp_replace(sql, r"(?s)\{#.*?#\}", ""), r"(?s)\{\{\s*config\(.*?\)\s*\}\}", "")
    ref, source = r"\{\{\s*ref\(\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}", r"\{\{\s*source\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}"
    called = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ref), 1), lambda x: x))
    text = F.aggregate(called, F.regexp_replace(text, ref, "\x01$1\x01"), lambda t, x: F.replace(t, F.concat(F.lit("\x01"), x, F.lit("\x01")), F.coalesce(refs[x], F.lit("{{"))))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(source), 1).alias("a"), F.regexp_extract_all(text, F.lit(source), 2).alias("b"))
    text = F.aggregate(pairs, F.regexp_replace(text, source, "\x01$1.$2\x01"), lambda t, x: F.replace(t, F.concat(F.lit("\x01"), x["a"], F.lit("."), x["b"], F.lit("\x01")), F.coalesce(sources[F.concat_ws(".", x["a"], x["b"])], F.lit("{{"))))
    return F.when(~text.contains("{{") & ~text.contains("{%"), text)


def with_raw_sql(rows: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """nodes() with raw_code from the project's own file (path, content below root) where there is one, else from the manifest."""
    own = files.select(F.replace("path", F.lit(f"{root.rstrip('/')}/"), F.lit("")).alias("original_file_path"), F.col("content").alias("_file"))
    joined = rows.join(own, "original_file_path", "left")
    return joined.withColumn("raw_code", F.coalesce(blank_to_null(F.col("_file")), blank_to_null(F.col("raw_code")), F.col("raw_sql"))).drop("_file")


def schema_blocks(files: DataFrame) -> DataFrame:
    """(path, kind, name, properties_yaml): each model's, seed's and source's own block of the property files, written anew as YAML. Files that are no YAML give none.

    YAML has no reader in Spark; files are parsed in Arrow batches, each by itself.
    """
    import pyarrow as pa

    def run(batches):
        import yaml

        for b in batches:
            out: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    data = yaml.safe_load(content or "")
                except yaml.YAMLError:
                    continue
                for kind in ("models", "seeds", "snapshots", "sources") if isinstance(data, dict) else ():
                    for block in data.get(kind) or []:
                        if isinstance(block, dict) and block.get("name"):
                            out.append((path, kind, str(block["name"]), yaml.safe_dump(block, sort_keys=False, allow_unicode=True)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(4)], names=["path", "kind", "name", "properties_yaml"])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, name string, properties_yaml string")
