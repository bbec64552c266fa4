"""Extraction from JSON, M, DAX and SQL text by regular expressions that run in the JVM."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The patterns by which references are recognised.
PROPERTY, NAME = r'"Property"\s*:\s*"([^"]+)"', r'"Name"\s*:\s*"([^"]+)"'
BRACKET, TABLE_COLUMN, WORD = r"\[([^\]]+)\]", r"'([^']+)'\[([^\]]+)\]", r"[a-zA-Z0-9_]+"
SQL_FROM = r"(?i)FROM\s+`?([\w-]+)`?\.`?([\w-]+)`?\.`?([\w-]+)`?"
M_PROJECT = r'\[Name\s*=\s*"?([^",\]]+)"?'
M_SCHEMA = r'\{\[Name\s*=\s*"?([^",]+)"?\s*,\s*Kind\s*=\s*"?Schema"?\s*\]\}'
M_OBJECT = r'\{\[Name\s*=\s*"?([^",]+)"?\s*,\s*Kind\s*=\s*"?(View|Table)"?\s*\]\}'
USE_RELATIONSHIP = r"USERELATIONSHIP\s*\(\s*'?([^'\[]+?)'?\s*\[\s*([^\]]+?)\s*\]\s*,\s*'?([^'\[]+?)'?\s*\[\s*([^\]]+?)\s*\]\s*\)"
EXTERNAL_MEASURE = r'EXTERNALMEASURE\s*\(\s*"([^"]+)"\s*,\s*\w+\s*,\s*"([^"]+)"\s*\)'
EXTERNAL_CALL, LOCAL_QUOTED, LOCAL_PLAIN = r"EXTERNALMEASURE\s*\([^)]*\)", r"'[^']+'\s*\[", r"(?:^|[^\w'])[A-Za-z_]\w*\s*\["
CONNECTION_LABEL = r"(?i)^\s*(?:DirectQuery|Import)\s+to\s+(?:AS\s*-\s*)?"
DAX_PLACEHOLDER, DAX_YEAR = r"DateTable|MeasureName|Table'\[Col\]|\[MeasureName\]", r"\bDATE\s*\(\s*(\d{4})\s*,"
WRITE_VERBS = "insert|update|delete|merge|create|alter|drop|truncate|grant|revoke|call|execute|begin|commit|rollback|load|export"


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    """array<string> of a group of all matches; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), group), F.array().cast("array<string>"))


def found(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def visual_fields(config: Column) -> Column:
    """Distinct names under Property and Name in a visual's JSON: over two characters, not digits alone; sorted."""
    names = F.concat(matches(config, PROPERTY), matches(config, NAME))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: (F.char_length(x) > 2) & ~x.rlike(r"^\d+$"))))


def warehouse_source(m: Column) -> Column:
    """struct(project, schema, object, kind) of a warehouse query in M; nulls for other connectors. Native SQL comes first."""
    is_source = F.coalesce(m, F.lit("")).contains("GoogleBigQuery") | F.coalesce(m, F.lit("")).contains("Value.NativeQuery")
    native = is_source & m.rlike(SQL_FROM)
    one = lambda sql_group, pattern, group=1: F.when(native, F.regexp_extract(m, SQL_FROM, sql_group)).when(is_source, found(m, pattern, group))
    kind = F.when(native, F.lit("SQL Query")).when(is_source, found(m, M_OBJECT, 2))
    return F.struct(one(1, M_PROJECT).alias("project"), one(2, M_SCHEMA).alias("schema"), one(3, M_OBJECT).alias("object"), kind.alias("kind"))


def bracket_tokens(dax: Column) -> Column:
    return matches(dax, BRACKET)


def table_columns(dax: Column) -> Column:
    """array<struct<table, column>> of 'Table'[Column]."""
    return F.arrays_zip(matches(dax, TABLE_COLUMN, 1).alias("table"), matches(dax, TABLE_COLUMN, 2).alias("column"))


def words(dax: Column) -> Column:
    return matches(dax, WORD, 0)


def activated_relationships(dax: Column) -> Column:
    """array<struct<a_table, a_column, b_table, b_column>> that USERELATIONSHIP names."""
    group = lambda k, name: F.transform(matches(dax, USE_RELATIONSHIP, k), lambda x: F.trim(x)).alias(name)
    return F.arrays_zip(group(1, "a_table"), group(2, "a_column"), group(3, "b_table"), group(4, "b_column"))


def external_target(dax: Column) -> Column:
    """struct(is_wrapper, measure, dataset) of the first EXTERNALMEASURE; a wrapper has no reference to a table of its own."""
    rest = F.regexp_replace(F.coalesce(dax, F.lit("")), EXTERNAL_CALL, "")
    local = rest.rlike(LOCAL_QUOTED) | rest.rlike(LOCAL_PLAIN)
    has = F.coalesce(dax, F.lit("")).rlike(EXTERNAL_MEASURE)
    dataset = F.trim(F.regexp_replace(found(dax, EXTERNAL_MEASURE, 2), CONNECTION_LABEL, ""))
    return F.struct((has & ~local).alias("is_wrapper"), found(dax, EXTERNAL_MEASURE, 1).alias("measure"), dataset.alias("dataset"))


def partition_kind(body: Column) -> Column:
    """m or calculated, by a table partition's text."""
    text = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", ""))
    marked = body.contains("mode: calculated") | text.startswith("=") | text.startswith("EVALUATE") | text.startswith("DATATABLE") | text.startswith("CALENDAR")
    return F.when(text == "", "m").when(marked, "calculated").when(body.rlike(r"(^|\s)let(\s|$)"), "m").otherwise("calculated")


def stats_text(stats: Column) -> Column:
    """`k: v | k: v` of array<struct<label, value, include>> entries that are included and have a value."""
    kept = F.filter(stats, lambda s: F.coalesce(s["include"], F.lit(False)) & s["value"].isNotNull())
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(": ", s["label"], s["value"])), " | ")


def _without_keys(out: Column, other: Column) -> Column:
    return F.map_filter(out, lambda k, v: ~F.map_contains_key(other, k))


def merged_meta(*maps: Column) -> Column:
    """map<string, string>: later maps win; nulls are empty."""
    empty = F.create_map().cast("map<string,string>")
    out = empty
    for m in maps:
        m = F.coalesce(m, empty)
        out = F.map_concat(_without_keys(out, m), m)
    return out


def read_only_verdict(sql: Column) -> Column:
    """ok, or why a statement is refused: empty, not read-only, write verb, several statements."""
    text = F.regexp_replace(F.coalesce(sql, F.lit("")), r"(?s)/\*.*?\*/", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"--[^\n]*", ""), r"^\s+|\s+$", ""))
    inner = F.rtrim(F.regexp_replace(text, r";$", ""))
    return (
        F.when(text == "", "empty")
        .when(~text.rlike(r"(?i)^(select|with)\b"), "not read-only")
        .when(text.rlike(rf"(?i)\b({WRITE_VERBS})\b"), "write verb")
        .when(inner.contains(";"), "several statements")
        .otherwise("ok")
    )


def is_read_only(spark: SparkSession, sql: str) -> tuple[bool, str]:
    """The same for one statement, and Spark's own parser must take it for a query, not a command."""
    verdict = spark.range(1).select(read_only_verdict(F.lit(sql))).first()[0]
    if verdict != "ok":
        return False, verdict
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    kind = plan.getClass().getSimpleName()
    return ("Command" not in kind and "Insert" not in kind and "Create" not in kind), kind


def dax_verdict(dax: Column, year: int | None = None) -> Column:
    """ok, or why a DAX query is refused. DATE(y, ...) must lie within a year of this one."""
    year = year or datetime.now(UTC).year
    text = F.trim(F.coalesce(dax, F.lit("")))
    years = F.transform(matches(text, f"(?i){DAX_YEAR}"), lambda y: y.cast("int"))
    inner = F.rtrim(F.regexp_replace(text, r";$", ""))
    return (
        F.when(text == "", "empty")
        .when(~F.upper(text).startswith("EVALUATE"), "not EVALUATE")
        .when(text.rlike(f"(?i){DAX_PLACEHOLDER}"), "placeholder")
        .when(inner.contains(";"), "several statements")
        .when(F.exists(years, lambda y: ~y.between(year - 1, year + 1)), "year")
        .otherwise("ok")
    )


def cron(frequency: str, hour: str = "2", day: str = "1") -> str | None:
    """A schedule as a cron line."""
    if not re.fullmatch(r"\d{1,2}", hour) or not re.fullmatch(r"\d", day):
        raise ValueError("hour and day are numbers")
    return {"daily": f"0 {hour} * * *", "weekly": f"0 {hour} * * {day}"}.get(frequency)
