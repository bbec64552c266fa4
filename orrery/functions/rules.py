"""Classification rules as ordered CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node types.
REPORT_TYPES = ("PB_VISUAL", "PB_PAGE", "PB_REPORT")
CONTAINER_TYPES = ("DBT_MODEL", "DBT_SEED", "DBT_SOURCE", "PB_TABLE")
COLUMN_TYPES = ("DBT_COLUMN", "PB_COLUMN")
MEMBER_TYPES = (*COLUMN_TYPES, "PB_FIELD", "PB_MEASURE")
ALL_TYPES = ("PB_WORKSPACE", "PB_TABLE", "PB_COLUMN", "PB_MEASURE", "PB_REPORT", "PB_PAGE", "PB_VISUAL", "PB_FIELD", "DBT_WORKSPACE", "DBT_SOURCE", "DBT_MODEL", "DBT_SEED", "DBT_COLUMN", "DBT_TEST")

# Data type families, as regular expressions over the lower-cased type.
_BOOLEAN, _DATE, _NUMERIC, _TEXT = "bool", "(date|time|timestamp)", "(int|num|dec|float|double|real|money|serial|big)", "(char|text|string|uuid|json|byte|enum)"


def _first(cases: Sequence[tuple[Column, str]], otherwise: str | None) -> Column:
    out = F.lit(otherwise)
    for condition, value in reversed(cases):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def edge_kind(source_type: Column, target_type: Column) -> Column:
    s, t = F.trim(F.coalesce(source_type, F.lit(""))), F.trim(F.coalesce(target_type, F.lit("")))
    either = lambda kinds: s.isin(*kinds) | t.isin(*kinds)
    return _first([(either(REPORT_TYPES), "model"), (s.isin(*CONTAINER_TYPES) & t.isin(*MEMBER_TYPES), "contains"), (either(MEMBER_TYPES), "column")], "model")


def edge_level(source_type: Column, target_type: Column) -> Column:
    """The view in which an edge shows: asset, column or both. Measures, and links of fields with measures, hang in both."""
    s, t = F.trim(F.coalesce(source_type, F.lit(""))), F.trim(F.coalesce(target_type, F.lit("")))
    boxed = s.isin(*CONTAINER_TYPES) & t.isin(*MEMBER_TYPES)
    hinge = ((s == "PB_FIELD") & (t == "PB_MEASURE")) | ((s == "PB_MEASURE") & (t == "PB_FIELD"))
    return _first(
        [
            (s.isin(*REPORT_TYPES) | t.isin(*REPORT_TYPES), "asset"), (boxed & (t == "PB_MEASURE"), "both"), (boxed, "column"),
            (hinge, "both"), (s.isin(*MEMBER_TYPES) | t.isin(*MEMBER_TYPES), "column"),
        ],
        "asset",
    )


def edge_kind_or_explicit(explicit: Column, source_type: Column, target_type: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), edge_kind(source_type, target_type))


def is_bridge(source: Column, target: Column) -> Column:
    """The edge leaves one tool for the other."""
    return source.startswith("PB_") != target.startswith("PB_")


def data_kind(datatype: Column) -> Column:
    t = F.lower(F.coalesce(datatype, F.lit("")))
    return _first([(t == "", "other"), (t.rlike(_BOOLEAN), "boolean"), (t.rlike(_DATE), "date"), (t.rlike(_NUMERIC), "numeric"), (t.rlike(_TEXT), "text")], "other")


def data_glyph(datatype: Column) -> Column:
    """Text comes first here, and boolean last."""
    t = F.lower(F.coalesce(datatype, F.lit("")))
    return _first([(t == "", "•"), (t.rlike(_TEXT), "Aa"), (t.rlike(_NUMERIC), "#"), (t.rlike(_DATE), "◷"), (t.rlike(_BOOLEAN), "⊨")], "•")


def card_layer(item_type: Column, name: Column, card_kind: Column) -> Column:
    kind, group, low = F.coalesce(card_kind, F.lit("")), F.upper(F.coalesce(item_type, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return _first(
        [
            (kind == "measures", "measures"), (kind == "report", "reports"), (group == "DBT_SOURCE", "source"), (group == "DBT_SEED", "seed"), (group == "PB_TABLE", "powerbi"),
            (low.startswith("stg_"), "staging"), (low.startswith("int_"), "intermediate"), (low.rlike("^(fct_|fact_|dim_|mart_|mrt_)"), "marts"),
        ],
        "model",
    )


def model_type(name: Column) -> Column:
    """By the prefix of the last dotted part of a model's name."""
    tail = F.lower(F.trim(F.substring_index(F.coalesce(name, F.lit("")), ".", -1)))
    return _first([(tail.startswith(p), t) for p, t in (("dim_", "dimension"), ("fact_", "fact"), ("int_", "intermediate"), ("stg_", "staging"))], "unknown")


def is_external_measure(expression: Column, description: Column) -> Column:
    e, d = F.coalesce(expression, F.lit("")), F.coalesce(description, F.lit(""))
    return (F.trim(e) == "") | F.lower(F.concat(e, F.lit(" "), d)).rlike(r"external\s*measure")


def workspace_rank(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.contains("finance"), 0).when(low.contains("commercial"), 1).when(low.contains("operation") | low.contains("ops"), 2).when(low.contains("marketing"), 3).otherwise(4)


def identity_kind(identity: Column) -> Column:
    c = F.trim(F.coalesce(identity, F.lit("")))
    return _first([(c == "", "empty"), (c.contains("@"), "email"), (c.rlike(r"(?i)^\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?$"), "guid")], "opaque")


def complexity(visuals: Column, measures: Column) -> Column:
    return F.coalesce(visuals, F.lit(0)) + F.coalesce(measures, F.lit(0))


def visuals_per_page(visuals: Column, pages: Column) -> Column:
    return F.coalesce(visuals, F.lit(0)) / F.when(F.coalesce(pages, F.lit(0)) == 0, F.lit(1)).otherwise(pages)


def health_band(ratio: Column) -> Column:
    return _first([(ratio > 20, "Complex"), (ratio > 10, "Moderate")], "Healthy")


def spread_bucket(n: Column) -> Column:
    """In how many reports a measure is, as a band."""
    return _first([(n == 0, "0"), (n == 1, "1"), (n <= 4, "2-4"), (n <= 9, "5-9")], "10+")


def estimated_lineage(producers: Column) -> Column:
    """By the number of upstream columns alone."""
    return _first([(producers <= 0, "unknown"), (producers == 1, "pass-through")], "transformation")
