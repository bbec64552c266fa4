"""Identity and names. Columns in, columns out; no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what identifiers lose.
ID_NOISE = r"""[\s'"`]+"""
ELLIPSIS = "…"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _hashed(parts: list[Column]) -> Column:
    return F.md5(F.regexp_replace(F.lower(F.concat_ws("_", *parts)), ID_NOISE, "").cast("binary"))


def custom_id(*parts: Column) -> Column:
    """MD5 of the parts that are not null, joined by _, in lower case, without white space and quotation marks. Blank parts count."""
    return _hashed([p.cast("string") for p in parts])


def custom_id_skipping_blanks(*parts: Column) -> Column:
    """The same, but blank parts do not count."""
    return _hashed([F.when(F.trim(p.cast("string")) != "", p.cast("string")) for p in parts])


def item_id(dataset_id: Column, lineage_tag: Column, table_name: Column, name: Column, is_table: Column) -> Column:
    """By lineage tag where there is one, else by name, for members below their table."""
    return (
        F.when(F.coalesce(lineage_tag, F.lit("")) != "", custom_id(dataset_id, lineage_tag))
        .when(is_table, custom_id(dataset_id, name))
        .otherwise(custom_id(dataset_id, table_name, name))
    )


def node_id(item_type: Column, hashed: Column) -> Column:
    return F.concat(item_type, F.lit("::"), hashed)


def id_of_node(node: Column) -> Column:
    """What follows the first :: of a node's id, or all of it."""
    return F.when(F.instr(node, "::") > 0, F.regexp_extract(node, r"(?s)^.*?::(.*)$", 1)).otherwise(node)


def type_of_node(node: Column) -> Column:
    return F.substring_index(node, "::", 1)


def bridge_name(c: Column) -> Column:
    """Trimmed, outer backticks, then double, then single quotes gone, lower case; null: empty. White space inside stays."""
    stripped = F.trim(c)
    for mark in ("`", '"', "'"):
        stripped = F.btrim(stripped, F.lit(mark))
    return F.coalesce(F.lower(stripped), F.lit(""))


def relation_name(c: Column) -> Column:
    """Lower case without any white space, quotation mark or backtick; null: empty."""
    return F.coalesce(F.regexp_replace(F.lower(c), ID_NOISE, ""), F.lit(""))


def distinct_names(names: Column) -> Column:
    """array<string>: names trimmed, blanks gone, distinct in any case; the first spelling stays."""
    clean = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.aggregate(clean, F.array().cast("array<string>"), lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.concat(seen, F.array(x))))


def guid(c: Column) -> Column:
    return F.upper(F.btrim(F.trim(c), F.lit("{}")))


def month_of(date: Column) -> Column:
    """First day of the month of a date string that begins with yyyy-mm."""
    return F.try_to_date(F.concat(F.substring(date, 1, 7), F.lit("-01")), "yyyy-MM-dd")


def months_ago(n: int, today: Column | None = None) -> Column:
    """First day of the month n months before this one."""
    return F.add_months(F.trunc(F.current_date() if today is None else today, "MM"), -n).cast("date")


def measure_key(organization_id: Column, item_type: Column, name: Column) -> Column:
    """organization::name in lower case, for measures that have a name."""
    named = F.lower(F.trim(name))
    return F.when((item_type == "PB_MEASURE") & (named != ""), F.concat(F.coalesce(organization_id.cast("string"), F.lit("0")), F.lit("::"), named))


def last_segment(c: Column, mark: str = ".") -> Column:
    return F.substring_index(c, mark, -1)


def qualified_name(database: Column, schema: Column, alias: Column, table: Column) -> Column:
    """database.schema.(alias or table) without blank parts."""
    joined = F.concat_ws(".", blank_to_null(database), blank_to_null(schema), F.coalesce(blank_to_null(alias), blank_to_null(table)))
    return F.coalesce(blank_to_null(joined), F.lit("(no FQN)"))


def one_line(c: Column, cap: int) -> Column:
    """Line breaks as spaces, cut to `cap` code points with an ellipsis where longer."""
    flat = F.regexp_replace(F.trim(c), r"\s*[\r\n]+\s*", " ")
    return F.when(F.char_length(flat) > cap, F.concat(F.rtrim(F.substring(flat, 1, cap - 1)), F.lit(ELLIPSIS))).otherwise(flat)


def clean_label(c: Column) -> Column:
    """Without a TYPE:: in front and a hexadecimal id in parentheses at the end; unchanged where nothing would be left."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "^[A-Z_]+::", "")
    out = F.trim(F.regexp_replace(out, r"(?i)\s*\(([0-9a-f]{8,}|[0-9a-f-]{12,})\)\s*$", ""))
    return F.when(out != "", out).otherwise(F.coalesce(c, F.lit("")))


def scope_key(ids: Column) -> Column:
    """Ten characters that name a set of ids."""
    return F.substring(F.md5(F.array_join(F.array_sort(ids.cast("array<string>")), ",").cast("binary")), 1, 10)


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_.-]+", "_"), F.lit("_"))


def initials(name: Column, email: Column) -> Column:
    """Of the first and last part of a name (or of the address before its @), else its first two characters."""
    source = F.coalesce(blank_to_null(name), blank_to_null(F.substring_index(email, "@", 1)), F.lit("?"))
    parts = F.filter(F.split(source, r"[\s._-]+"), lambda w: w != "")
    first = lambda w: F.substring(w, 1, 1)
    return F.upper(F.when(F.size(parts) >= 2, F.concat(first(F.get(parts, F.lit(0))), first(F.element_at(parts, -1)))).otherwise(F.substring(source, 1, 2)))
