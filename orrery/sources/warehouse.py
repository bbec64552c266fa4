"""The session's catalogue as a warehouse: databases, tables and columns, and read-only queries below a limit of bytes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.extract import read_only_verdict

UNITS = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40, "PiB": 1 << 50, "EiB": 1 << 60}


def databases(spark: SparkSession, most: int = 50) -> list[str]:
    return sorted(x.name for x in spark.catalog.listDatabases())[:most]


def tables(spark: SparkSession, database: str, most: int = 100) -> list[str]:
    return sorted(x.name for x in spark.catalog.listTables(database.strip().strip("`")))[:most]


def columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    """(name, type) in the table's order."""
    return [(x.name, x.dataType) for x in spark.catalog.listColumns(table.strip().replace("`", ""))]


def estimated_bytes(spark: SparkSession, sql: str) -> int:
    """Bytes that the leaves of the optimised plan are estimated to read; nothing runs. Only a read-only statement is explained."""
    verdict = spark.range(1).select(read_only_verdict(F.lit(sql))).first()[0]
    if verdict != "ok":
        raise ValueError(f"query refused: {verdict}")
    plan = spark.sql(f"EXPLAIN COST {sql.strip().rstrip(';')}").first()[0].split("== Physical Plan ==")[0]
    # A line deeper than the next one's equal has no child below it: the leaves of the tree.
    found = [(len(re.match(r"[\s:+|-]*", x)[0]), re.search(r"sizeInBytes=([0-9.E+]+) (\w+)", x)) for x in plan.splitlines() if "sizeInBytes=" in x]
    leaves = [m for (depth, m), after in zip(found, [d for d, _ in found[1:]] + [0], strict=True) if after <= depth]
    return int(sum(float(m[1]) * UNITS[m[2]] for m in leaves if m))


def queried(spark: SparkSession, sql: str, most_bytes: int) -> DataFrame:
    """The rows of a read-only query whose estimate is within the limit."""
    if (size := estimated_bytes(spark, sql)) > most_bytes:
        raise ValueError(f"query refused: about {size} bytes, {most_bytes} allowed")
    return spark.sql(sql.strip().rstrip(";"))
