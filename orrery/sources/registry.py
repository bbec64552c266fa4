"""Sources and destinations by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources import dbt, files, reports, tmdl, workspace
from orrery.storage import stored

Reader = Callable[[SparkSession, Mapping[str, str]], dict[str, DataFrame]]
SOURCES: dict[str, Reader] = {}
DESTINATIONS: dict[str, Callable[[DataFrame, str, Mapping[str, str]], None]] = {}


def source(name: str):
    """Registers a reader of (spark, settings) that gives tables by name."""

    def register(f: Reader) -> Reader:
        SOURCES[name] = f
        return f

    return register


def destination(name: str):
    def register(f):
        DESTINATIONS[name] = f
        return f

    return register


@source("dbt")
def read_project(spark: SparkSession, settings: Mapping[str, str]) -> dict[str, DataFrame]:
    """A project's landing folder: items and staged edges of its manifest and catalog."""
    manifest = dbt.manifest_rows(dbt.find_artifacts(spark, settings["folder"], "manifest.json"))
    catalog = dbt.catalog_rows(dbt.find_artifacts(spark, settings["folder"], "catalog.json"))
    return {"items": dbt.items(manifest, catalog), "edges": dbt.edges(manifest, catalog)}


@source("bi")
def read_workspace(spark: SparkSession, settings: Mapping[str, str]) -> dict[str, DataFrame]:
    """A BI landing folder: <item>.SemanticModel with TMDL or BIM files, <item>.Report in either format; items of all kinds and the edges between them."""
    folder = settings["folder"]
    model_of, report_of = F.regexp_extract("path", r"([^/]+)\.SemanticModel/", 1), F.regexp_extract("path", r"([^/]+)\.Report/", 1)
    own = files.text_files(spark, folder, "*.tmdl")
    blocks = tmdl.models(tmdl.tmdl_blocks(own.where(F.col("path").contains("/tables/"))), tmdl.bim_blocks(files.text_files(spark, folder, "*.bim")), model_of)
    relationships = tmdl.tmdl_relationships(own.where(F.col("path").endswith("relationships.tmdl"))).withColumn("model", model_of)
    needs = tmdl.dependencies(blocks)
    json_files = files.text_files(spark, folder, "*.json")
    rows = reports.reports(reports.legacy(json_files.where(F.col("path").endswith("report.json")), report_of), reports.folders(json_files, report_of))
    # Each is read many times below, and parsed once.
    blocks, relationships, needs, rows = (stored(x) for x in (blocks, relationships, needs, rows))
    items, every = workspace.catalogue(blocks, rows, relationships, needs, settings.get("workspace"))
    return {"blocks": blocks, "relationships": relationships, "dependencies": needs, "report_fields": rows, "items": items, "edges": every}


@source("csv")
def read_csv(spark: SparkSession, settings: Mapping[str, str]) -> dict[str, DataFrame]:
    return {"rows": files.staged_csv(spark, settings["path"])}


@source("jdbc")
def read_jdbc(spark: SparkSession, settings: Mapping[str, str]) -> dict[str, DataFrame]:
    return {"rows": spark.read.format("jdbc").options(**settings).load()}


@destination("parquet")
def to_parquet(df: DataFrame, name: str, settings: Mapping[str, str]) -> None:
    files.replace_table(df, f"{settings['path']}/{files.slug(name)}")


@destination("csv")
def to_csv(df: DataFrame, name: str, settings: Mapping[str, str]) -> None:
    files.write_csv(df, f"{settings['path']}/{files.slug(name)}")
