"""Column lineage from SQL, as rows and joins.

A statement is a row. Native functions blank out quotes and comments and peel its parentheses from the inside: a query in
parentheses becomes a block of its own, any other pair only marks its commas. Blocks, their branches (of UNION), sources and
projected items are then rows; names in WITH are found in the scope that a block stands in, others in an index of all relations
by their last one, two or more parts. Columns follow by rounds of joins: a round resolves all blocks, of all statements, whose
sources have been resolved. What the rules cannot take is no edge but a reason, so that nothing is guessed in silence.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.storage import Rounds, drop, spread, stored

# Words of the SQL dialect that are no columns, and parts of dates.
KEYWORDS = "all and any array as asc between both by case cross current current_date current_datetime current_time current_timestamp desc distinct div else end escape except exists false filter first following for from full group having ignore ilike in inner intersect interval into is join last leading left like limit natural not null nulls offset on or order outer over partition preceding qualify range regexp respect right rlike row rows select separator similar struct then to trailing true unbounded union unknown using when where window with within".split()
DATE_PARTS = "microsecond millisecond second minute hour day dayofweek dayofyear week isoweek month quarter year isoyear".split()
NO_ALIAS = "on using join left right inner full cross natural outer tablesample pivot unpivot lateral for window".split()

NAME = r"[\p{L}_][\p{L}\p{N}_$]*+"
RELATION = r"[\p{L}_][\p{L}\p{N}_$.-]*+"
QUOTED = r"(?is)(?:\b[rb]{1,2})?(')[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|(?:\b[rb]{1,2})?(\")[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|(`[^`]*`)|--[^\n]*+|#[^\n]*+|/\*.*?\*/"
INNER = r"\(([^()]*)\)"
TOKEN = rf"(?<![\p{{L}}\p{{N}}_$.]){NAME}(?:\.{NAME})*+(?!\s*❨)"
SOURCE = rf"(?i)(?:^|,|\bJOIN\b)\s*(⟦\d+⟧|{RELATION}(?!\s*❨))(?:\s+(?:AS\s+)?(?!(?:{'|'.join(NO_ALIAS)})\b)({NAME}))?"
CTE = rf"(?i)(?:\bWITH|,)\s*({NAME})\s+AS\s+(?:NOT\s+)?(?:MATERIALIZED\s+)?⟦(\d+)⟧"
BRANCH = r"(?is)^\s*SELECT\s+(?:(?:ALL|DISTINCT)\s+)?(.*?)(?:\s+FROM\s+(.*?))?(?:\s+(?:WHERE|GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT|QUALIFY|WINDOW\s+\w+\s+AS)\b.*)?$"
SET_OPERATION = r"(?i)\b(?:UNION|INTERSECT|EXCEPT)\b(?!\s*❨)(?:\s+(?:ALL|DISTINCT)\b)?"
STAR = rf"(?i)^(?:({NAME}(?:\.{NAME})*+)\.)?\*(?:\s*EXCEPT\s*❨([^❨❩]*)❩)?$"
PLAIN = rf"(?i)^((?:{NAME}\.)*+{NAME})(?:\s+(?:AS\s+)?({NAME}))?$"
NAMED = rf"(?i)^(.*?)(?:\bAS\s+|(?<=[❩⟧\p{{N}}\]])\s+|(?<=\bEND)\s+)({NAME})$"

EDGES = "source string, source_column string, target string, target_column string, lineage_type string"
KEY = ["model", "nth"]
#: Texts, blocks or branches for each task that matches patterns: their cost is in processor time, and their files are small.
TEXTS = 10_000
BASES = "array<struct<relation:string,column:string>>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _got(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: within a fold an expression that is named several times is worked out for each, and within a lambda for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unquoted(sql: Column) -> Column:
    """One line without comments; each string is a 0, names lose their backticks."""
    text = F.regexp_replace(F.regexp_replace(sql, QUOTED, " $1$1$2$2$3 "), "''|\"\"", "0")
    text = F.regexp_replace(F.regexp_replace(text, r"`([\p{L}\p{N}_$.-]+)`", "$1"), r"\s+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?<=[\p{L}\p{N}_$]) ?\. ?(?=[\p{L}_*])", "."), r"[\s;]+$", "")
    text = F.regexp_replace(text, r"(?i)\b(?:DATE|TIME|DATETIME|TIMESTAMP|NUMERIC|JSON) 0\b", "0")
    return F.regexp_replace(text, r"(?i)\bINTERVAL ([^ ()]+) \w+", "$1")


def _argument(text: Column, before: Column) -> Column:
    """A group that is no query, between marks of its own: its commas no longer part items, its types, date parts and words that part a query are gone."""
    dated = F.when(F.contains(text, F.lit(",")) & before.rlike(r"(?i)(?:\b(?:date|time|datetime|timestamp)_\w+|\blast_day)\s*$"), F.regexp_replace(text, rf"(?i),\s*(?:{'|'.join(DATE_PARTS)})\s*$", "")).otherwise(text)
    typed = F.regexp_replace(dated, r"(?i)\bAS\s+[\w<>]+(?:\s*❨[^❨❩]*❩)?", " ")
    return F.concat(F.lit("❨"), F.translate(F.regexp_replace(F.regexp_replace(typed, r"(?i)^\s*\w+ FROM\b", " "), r"(?i)\b(?:FROM|WHERE|HAVING|ORDER BY|LIMIT|QUALIFY)\b", " , "), ",", "¦"), F.lit("❩"))


def _peeled(text: Column) -> Column:
    """(text, blocks): the text without parentheses, and the queries within them; a fold of as many steps as parentheses are deep."""
    signs = _all(text, "[()]")
    deep = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, p: F.struct((s["now"] + F.when(p == "(", 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(p == "(", 1).otherwise(-1)).alias("most")), lambda s: s["most"])
    start = F.struct(text.alias("text"), F.array().cast("array<struct<block:int,body:string>>").alias("blocks"))
    is_query = lambda g: g.rlike(r"(?i)^\s*(?:SELECT|WITH)\b|^\s*⟦\d+⟧\s*(?:UNION|INTERSECT|EXCEPT)\b")

    def step(s: Column, k: Column) -> Column:
        number = lambda i: k * 100_000 + i

        def told(cut: Column) -> Column:
            said = lambda g, i, query: F.when(query, F.concat(F.lit("⟦"), number(i).cast("string"), F.lit("⟧"))).when(g.rlike(r"^\s*⟦\d+⟧\s*$"), F.trim(g)).otherwise(_argument(g, F.get(cut["around"], i)))
            return F.transform(cut["groups"], lambda g, i: _let(is_query(g), lambda query: F.struct(F.when(query, number(i)).alias("block"), g.alias("body"), said(g, i, query).alias("said"))))

        def joined(cut: Column, groups: Column) -> Column:
            text = F.array_join(F.zip_with(cut["around"], groups, lambda a, g: F.concat(a, F.coalesce(g["said"], F.lit("")))), "")
            made = F.transform(F.filter(groups, lambda g: g["block"].isNotNull()), lambda g: F.struct(g["block"].alias("block"), g["body"].alias("body")))
            return F.struct(text.alias("text"), F.concat(s["blocks"], made).alias("blocks"))

        cut = F.struct(_all(s["text"], INNER, 1).alias("groups"), F.split(s["text"], r"\([^()]*\)").alias("around"))
        return _let(cut, lambda cut: _let(told(cut), lambda groups: joined(cut, groups)))

    steps = F.when(deep > 0, F.sequence(F.lit(1), deep)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step)


def _scopes(blocks: Column) -> Column:
    """For each block the names of WITH that it may read, outermost first: those of the blocks around it, of its own list only what stands before it. Blocks come from the outside in."""
    pairs = "array<struct<name:string,block:int>>"
    start = F.create_map().cast(f"map<int,{pairs}>")

    def step(s: Column, b: Column) -> Column:
        whole = lambda pattern, group: F.transform(_all(b["body"], pattern, group), lambda i: i.cast("int"))
        found = F.struct(F.transform(_all(b["body"], CTE, 1), F.lower).alias("names"), whole(CTE, 2).alias("ids"), whole(r"⟦(\d+)⟧", 1).alias("inside"), F.coalesce(s[b["block"]], F.array().cast(pairs)).alias("around"))
        own = lambda f: F.arrays_zip(f["names"].alias("name"), f["ids"].alias("block")).cast(pairs)
        seen = lambda f, own, i: _let(F.array_position(f["ids"], i).cast("int"), lambda at: F.when(at > 0, F.slice(own, F.lit(1), at - 1)).otherwise(own))
        told = lambda f, own: F.map_from_entries(F.transform(f["inside"], lambda i: F.struct(i, F.concat(f["around"], seen(f, own, i)))))
        # A block without blocks in it adds nothing.
        return F.when(F.contains(b["body"], F.lit("⟦")), F.map_concat(s, _let(found, lambda f: _let(own(f), lambda o: told(f, o))))).otherwise(s)

    return F.aggregate(blocks, start, step)


def _blocks(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with scope, reasons) of statements (model, nth, sql)."""
    statements = stored(statements)
    statements = spread(statements, statements.count(), *KEY, each=TEXTS)
    text = statements.select(*KEY, "sql", _unquoted(F.col("sql")).alias("text")).withColumn("up", F.upper("text"))
    # A word or sign that a pattern cannot do without is looked for first, which costs a hundredth of the pattern.
    near = lambda c, pattern, *signs: functools.reduce(Column.__or__, (F.contains(c, F.lit(x)) for x in signs)) & F.col("sql" if c == "sql" else "text").rlike(pattern)
    bad = (
        F.when(near("sql", r"\{\{|\{%|\{#", "{"), "template").when(near("text", "['\"]", "'", '"'), "open quote").when(F.col("text").contains("`") | near("sql", rf"(?i)`(?:{'|'.join(KEYWORDS)})`", "`"), "quoted name")
        .when(F.length(F.translate("text", "(", "")) != F.length(F.translate("text", ")", "")), "parentheses").when(near("up", r"(?i)\bWITH RECURSIVE\b", "RECURSIVE"), "recursion").when(near("up", r"(?i)\b(?:UNION|EXCEPT|INTERSECT)\b.{0,20}\bBY NAME\b", "BY NAME"), "union by name")
        .when(near("up", r"(?i)\b(?:PIVOT|UNPIVOT)\b ?\(", "PIVOT"), "pivot").when(near("up", r"(?i)\bSELECT AS (?:STRUCT|VALUE)\b|\bDISTINCT ON\b", "SELECT AS", "DISTINCT ON"), "select as").when(near("up", r"(?i)\bOVER [\p{L}_]", "OVER "), "named window")
    )
    text = stored(text.select(*KEY, "text", bad.alias("reason")))
    rows = spread(text.where("reason IS NULL"), text.count(), *KEY, each=TEXTS).select(*KEY, _peeled(F.col("text")).alias("p"))
    every = F.concat(F.array(F.struct(F.lit(0).alias("block"), F.col("p.text").alias("body"))), F.reverse("p.blocks"))
    rows = rows.select(*KEY, every.alias("blocks")).select(*KEY, "blocks", _scopes(F.col("blocks")).alias("scopes"))
    # Outer, though there is always a block: else Spark asks beforehand, below the shuffle, whether there is one, and so works everything out twice.
    rows = rows.select(*KEY, F.explode_outer("blocks").alias("b"), "scopes").select(*KEY, "b.*", F.col("scopes")[F.col("b.block")].alias("around"))
    own = F.arrays_zip(F.transform(_all(F.col("body"), CTE, 1), F.lower).alias("name"), F.transform(_all(F.col("body"), CTE, 2), lambda i: i.cast("int")).alias("block"))
    scope = F.concat(F.coalesce("around", F.array().cast(own_type := "array<struct<name:string,block:int>>")), own.cast(own_type))
    return stored(rows.select(*KEY, "block", "body", scope.alias("scope"))), text.where("reason IS NOT NULL").select(*KEY, "reason")


def _branches(blocks: DataFrame) -> DataFrame:
    """(model, nth, block, branch, items, sources, using, scope, reason) of each SELECT; sources are names and aliases as they stand."""
    main = F.regexp_replace("body", r"(?is)^\s*WITH\b.*?⟦\d+⟧\s*(?=SELECT\b)", "")
    listed = F.col("body").rlike(rf"(?i)(?:\bWITH|,)\s*{NAME}\s*❨[^❨❩]*❩\s*AS\s+(?:NOT\s+)?(?:MATERIALIZED\s+)?⟦")
    rows = blocks.select(*KEY, "block", "scope", listed.alias("listed"), F.posexplode_outer(F.split(main, SET_OPERATION)).alias("branch", "part"))
    part = F.regexp_replace("part", r"^\s*(⟦\d+⟧)", "SELECT * FROM $1")
    rows = rows.select(*KEY, "block", "scope", "listed", "branch", part.alias("part"))
    rows = rows.select(*KEY, "block", "branch", "scope", "listed", "part", _got(F.col("part"), BRANCH, 1).alias("items"), F.coalesce(_got(F.col("part"), BRANCH, 2), F.lit("")).alias("origin"))
    found = F.arrays_zip(_all(F.col("origin"), SOURCE, 1).alias("name"), _all(F.col("origin"), SOURCE, 2).alias("alias"))
    rows = rows.withColumn("sources", found)
    wanted = F.when(F.col("origin") == "", 0).otherwise(F.size(_all(F.col("origin"), r"(?i)(?:^|,|\bJOIN\b)")))
    bad = F.when(F.col("part").rlike("[()]"), "parentheses").when(F.col("listed"), "column list of with").when(~F.col("part").rlike(r"(?i)^\s*SELECT\s") | F.col("items").isNull() | F.col("items").rlike(r"(?i)^(?:FROM|WHERE|GROUP|ORDER)\b"), "no select").when(F.size("sources") != wanted, "source that is no name").when(F.col("origin").rlike(r"(?i)\bNATURAL\b"), "natural join")
    using = F.flatten(F.transform(_all(F.col("origin"), r"(?i)\bUSING\s*❨([^❨❩]*)❩", 1), lambda t: F.transform(F.split(t, "¦"), lambda c: F.lower(F.trim(c)))))
    return rows.select(*KEY, "block", "branch", "scope", "items", "sources", using.alias("using"), bad.alias("reason"))


def _sources(branches: DataFrame, relations: DataFrame) -> DataFrame:
    """(model, nth, block, branch, src, alias, full, child, relation, reason): a source is a block (child) or a relation. A whole name comes first; a shorter one counts if one relation alone ends in it."""
    rows = branches.select(*KEY, "block", "branch", "scope", F.posexplode("sources").alias("src", "s"))
    full = F.lower("s.name")
    mark = F.regexp_extract("s.name", r"^⟦(\d+)⟧$", 1)
    known = F.element_at(F.filter("scope", lambda c: c["name"] == full), -1)["block"]
    alias = F.coalesce(F.nullif(F.lower("s.alias"), F.lit("")), F.when(mark == "", F.substring_index(full, ".", -1)))
    child = F.when(mark != "", mark.cast("int")).otherwise(F.when(F.size(F.filter("scope", lambda c: c["name"] == full)) > 0, known))
    # Stored, since rows with and without a child go separate ways and would be matched for each.
    rows = stored(rows.select(*KEY, "block", "branch", "src", alias.alias("alias"), F.when(mark == "", full).alias("full"), child.alias("child")))
    parts = F.split("whole", r"\.")
    names = relations.select("relation", F.lower(F.regexp_replace("relation", r"[\s'\"`]+", "")).alias("whole")).distinct()
    names = names.select("relation", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.size(parts) - k + 1, k), ".").alias("full"), (k == F.size(parts)).alias("exact")))).alias("n")).select("relation", "n.*")
    index = names.groupBy("full").agg(F.min(F.when(F.col("exact"), F.col("relation"))).alias("exact"), F.min("relation").alias("one"), F.count_distinct("relation").alias("many"))
    index = index.select("full", F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("many") == 1, F.col("one")).alias("relation"), F.lit(True).alias("met"))
    reached = rows.where("child IS NULL").join(index, "full", "left")
    bad = F.when(F.col("met").isNull(), F.concat(F.lit("unknown relation "), "full")).when(F.col("relation").isNull(), F.concat(F.lit("ambiguous relation "), "full"))
    out = [*KEY, "block", "branch", "src", "alias", "full"]
    return reached.select(*out, F.lit(None).cast("int").alias("child"), "relation", bad.alias("reason")).unionByName(rows.where("child IS NOT NULL").select(*out, "child", F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("reason")))


def _items(branches: DataFrame) -> DataFrame:
    """(model, nth, block, branch, pos, name, shape, star, star_of, except, tokens, inner, using, reason) of each projected item."""
    # Step by step, so that each pattern runs once for an item, and only for items that may match it.
    rows = branches.where("items IS NOT NULL").select(*KEY, "block", "branch", "using", F.posexplode_outer(F.split("items", ",")).alias("pos", "item")).withColumn("item", F.trim("item"))
    item, has = F.col("item"), lambda c, sign: F.contains(c, F.lit(sign))
    rows = rows.withColumn("star", has("item", "*") & item.rlike(STAR))
    rows = rows.withColumn("plain", F.when(~F.col("star"), _got(item, PLAIN, 1)))
    star, plain = F.col("star"), F.col("plain").isNotNull()
    rows = rows.withColumns({"column": F.substring_index("plain", ".", -1), "name": F.when(star, None).when(plain, F.coalesce(_got(item, PLAIN, 2), F.substring_index("plain", ".", -1))).otherwise(_got(item, NAMED, 2))})
    rows = rows.withColumn("body", F.when(star, "").when(plain, F.col("plain")).otherwise(F.coalesce(_got(item, NAMED, 1), item)))
    words = F.array_distinct(F.filter(F.transform(_all(F.col("body"), TOKEN), F.lower), lambda w: ~w.isin(KEYWORDS)))
    rows = rows.withColumn("tokens", words)
    shape = F.when(star, "pass-through").when(plain & (F.size("tokens") > 0), F.when(F.lower("name") == F.lower("column"), "pass-through").otherwise("rename")).otherwise("transformation")
    inner = F.when(has("body", "⟦"), F.transform(_all(F.col("body"), r"⟦(\d+)⟧", 1), lambda i: i.cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.select(
        *KEY, "block", "branch", "pos", "name", shape.alias("shape"), "star", F.when(star, F.lower(_got(item, STAR, 1))).alias("star_of"),
        F.transform(F.split(F.coalesce(F.when(star, _got(item, STAR, 2)), F.lit("")), "¦"), lambda c: F.lower(F.trim(c))).alias("except"), "tokens", inner.alias("inner"), "using",
        F.when(~star & has("item", "*") & item.rlike(rf"(?i)^(?:{NAME}\.)*+\*"), "changed star").alias("reason"),
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _levels(needs: DataFrame) -> DataFrame:
    """(model, nth, block, level) for needs (model, nth, block, child, null where there is none): a block stands one level above its highest child. A statement's blocks are folded within its row."""
    rows = needs.groupBy(*KEY).agg(F.collect_set(F.struct("block", "child")).alias("needs"))
    below = lambda b: F.transform(F.filter("needs", lambda n: (n["block"] == b) & n["child"].isNotNull()), lambda n: n["child"])
    rows = rows.select(*KEY, F.transform(F.array_distinct(F.transform("needs", lambda n: n["block"])), lambda b: F.struct(b.alias("block"), below(b).alias("children"))).alias("blocks"))
    start = F.map_from_entries(F.transform("blocks", lambda b: F.struct(b["block"], F.lit(1))))
    above = lambda levels, b: F.aggregate(b["children"], F.lit(1), lambda most, c: F.greatest(most, levels[c] + 1))
    raised = lambda levels: F.map_from_entries(F.transform("blocks", lambda b: F.struct(b["block"], above(levels, b))))
    # As many steps as blocks suffice: a step settles a level at least.
    settled = F.aggregate(F.sequence(F.lit(1), F.size("blocks")), start, lambda levels, _: raised(levels))
    return rows.select(*KEY, F.explode(settled).alias("block", "level"))


def _looked_up(items: DataFrame, columns: DataFrame) -> DataFrame:
    """(model, nth, block, branch, pos, bases, reason) of each word in each item, among the columns of the item's branch."""
    branch = [*KEY, "block", "branch"]
    # A word is a qualified column, a column with fields behind it, or both in that order of preference.
    p = F.split("token", r"\.")
    said = lambda of, low, rank: F.struct(of.alias("of"), low.alias("low"), F.lit(rank).alias("rank"))
    none = F.lit(None).cast("string")
    ways = F.when(F.size(p) == 1, F.array(said(none, F.col("token"), 0))).otherwise(F.array(said(F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "."), F.element_at(p, -1), 0), said(F.get(p, F.lit(0)), F.get(p, F.lit(1)), 1), said(none, F.get(p, F.lit(0)), 2)))
    one = [*branch, "pos", "token"]
    words = items.select(*branch, "pos", "using", F.explode("tokens").alias("token")).select(*one, "using", F.explode(ways).alias("w")).select(*one, "using", "w.*")
    met = words.join(columns, [*branch, "low"], "left").withColumn("met", F.col("src").isNotNull() & _fits("of"))
    shared = F.bool_or(F.expr("met AND of IS NULL AND array_contains(using, low)"))
    hits = met.groupBy(*one, "rank").agg(F.count_distinct(F.when(F.col("met"), F.col("src"))).alias("n"), F.min_by("bases", F.when(F.col("met"), F.col("src"))).alias("bases"), shared.alias("shared"))
    hits = hits.groupBy(*one).agg(F.min_by(F.struct("n", "bases", "shared"), F.when(F.col("n") > 0, F.col("rank"))).alias("h"))
    bad = F.when(F.col("h").isNull(), F.concat(F.lit("unknown column "), "token")).when((F.col("h.n") > 1) & ~F.col("h.shared"), F.concat(F.lit("ambiguous column "), "token"))
    return hits.select(*branch, "pos", "h.bases", bad.alias("reason"))


def _fits(of: str) -> Column:
    return F.col(of).isNull() | F.coalesce(F.col(of) == F.col("alias"), F.lit(False)) | F.coalesce(F.col(of) == F.col("full"), F.lit(False))


def _read(sources: DataFrame, relations: DataFrame, done: DataFrame) -> DataFrame:
    """The columns that branches may read: those of relations, and those of blocks that are done."""
    out = [*KEY, "block", "branch", "src", "alias", "full", "place", "column", "bases"]
    own = sources.where("relation IS NOT NULL").join(relations, "relation").withColumn("bases", F.array(F.struct("relation", "column")).cast(BASES)).select(*out)
    made = sources.where("child IS NOT NULL").join(done.select(*KEY, F.col("block").alias("child"), "place", F.col("name").alias("column"), "bases"), [*KEY, "child"])
    return own.unionByName(made.where("column IS NOT NULL").select(*out)).withColumn("low", F.lower("column"))


def _starred(items: DataFrame, columns: DataFrame) -> DataFrame:
    """The columns that stars stand for, or one row without a name for a star that stands for none. Of a column in USING the first source's stays."""
    branch = [*KEY, "block", "branch"]
    kept = F.expr("NOT array_contains(except, low) AND NOT (src > 0 AND array_contains(using, low) AND star_of IS NULL)") & _fits("star_of")
    stars = items.where("star").join(columns, branch, "left").withColumn("kept", F.coalesce(kept, F.lit(False)))
    return stars.select(*branch, "pos", "src", "place", F.when(F.col("kept"), F.col("column")).alias("name"), "shape", F.when(F.col("kept"), F.col("bases")).alias("bases"), F.max("kept").over(Window.partitionBy(*branch, "pos")).alias("any"))


def _made(items: DataFrame, stars: DataFrame, words: DataFrame, done: DataFrame) -> DataFrame:
    """(model, nth, block, place, name, shape, bases): the columns of blocks; branches of one block meet place by place, the first names them."""
    branch = [*KEY, "block", "branch"]
    inner = items.select(*branch, "pos", F.explode("inner").alias("child")).join(done.select(*KEY, F.col("block").alias("child"), "bases"), [*KEY, "child"])
    found = words.select(*branch, "pos", "bases").unionByName(inner.select(*branch, "pos", "bases")).groupBy(*branch, "pos").agg(F.flatten(F.collect_list("bases")).alias("bases"))
    plain = items.where("NOT star").join(found, [*branch, "pos"], "left").select(*branch, "pos", F.lit(0).alias("src"), F.lit(0).alias("place"), "name", "shape", F.coalesce("bases", F.array().cast(BASES)).alias("bases"))
    rows = stars.where("name IS NOT NULL").drop("any").unionByName(plain)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*branch).orderBy("pos", "src", "place")))
    out = rows.groupBy(*KEY, "block", "place").agg(F.min_by(F.struct("name", "shape"), "branch").alias("f"), F.array_distinct(F.flatten(F.collect_list("bases"))).alias("bases"))
    return out.select(*KEY, "block", "place", "f.name", "f.shape", "bases")


def lineage(models: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, reasons) of models (model, texts array<string>) that read relations (relation, column, place).

    Edges: source, source_column, target, target_column, lineage_type. A model counts by the first of its texts (compiled SQL, then raw SQL) that holds
    no reason against it; reasons (model, reason) name models of which no text does: "no sql" for null, empty or blank texts. By the outermost projection
    a column under its own name is a pass-through, under another a rename, an expression or several producers a transformation; a column of
    several branches goes by the first. A model is no source of its own. Relations and columns are told apart without case. Repeated models or relations count once.
    """
    spark = models.sparkSession
    relations = stored(relations.where("relation IS NOT NULL AND column IS NOT NULL").groupBy("relation", F.lower("column").alias("low")).agg(F.min_by("column", "place").alias("column"), F.min("place").alias("place")).drop("low"))
    texts = models.where("model IS NOT NULL").select("model", "texts").distinct()
    statements = texts.select("model", F.posexplode("texts").alias("nth", "sql")).where(F.trim("sql") != "")
    blocks, early = _blocks(statements)
    dealt = lambda df: spread(df, df.count(), *KEY, "block", each=TEXTS)
    branches = stored(_branches(dealt(blocks)))
    sound = dealt(branches).where("reason IS NULL")
    items, sources = stored(_items(sound)), stored(_sources(sound, relations))
    reason = lambda df: df.where("reason IS NOT NULL").select(*KEY, "reason")
    early = stored(early.unionByName(reason(branches)).unionByName(reason(sources)).unionByName(reason(items)))
    # Blocks of sound statements by level: a level reads those below it alone.
    alone = branches.where("reason IS NULL").select(*KEY, "block", F.lit(None).cast("int").alias("child"))
    children = alone.unionByName(sources.where("child IS NOT NULL").select(*KEY, "block", "child")).unionByName(items.select(*KEY, "block", F.explode("inner").alias("child")))
    levels = stored(_levels(children.join(early, KEY, "left_anti")))
    of_level = Rounds(spark, _ddl(items)), Rounds(spark, _ddl(sources))
    for table, rows in zip(of_level, (items, sources), strict=True):
        table.deal(rows.join(levels.withColumnRenamed("level", "round"), [*KEY, "block"]))
    columns = Rounds(spark, f"model string, nth int, block int, place int, name string, shape string, bases {BASES}")
    words = Rounds(spark, f"model string, nth int, block int, branch int, pos int, bases {BASES}, reason string")
    for k in range(1, (levels.agg(F.max("level")).first()[0] or 0) + 1):
        here, read = of_level[0].only(k), of_level[1].only(k)
        done = columns.all() if k > 1 else spark.createDataFrame([], columns.schema)
        seen = _read(read, relations, done)
        stars = _starred(here, seen)
        lost = stars.where("NOT any").select(*KEY, "block", "branch", "pos", F.lit(None).cast(BASES).alias("bases"), F.lit("star without columns").alias("reason")).distinct()
        looked = words.add(k, _looked_up(here.where("NOT star"), seen).unionByName(lost))
        columns.add(k, _made(here, stars, looked, done))
    nothing = levels.isEmpty()
    reasons = early if nothing else early.unionByName(reason(words.all()))
    every = spark.createDataFrame([], columns.schema) if nothing else columns.all()
    good = statements.select(*KEY).join(reasons, KEY, "left_anti").groupBy("model").agg(F.min("nth").alias("nth"))
    clean = lambda c: F.lower(F.regexp_replace(c, r"[\s'\"`]+", ""))
    ends = every.where("block = 0 AND name IS NOT NULL").join(good, [*KEY]).select("model", F.lower("name").alias("low"), "name", "shape", "place", F.explode("bases").alias("b"))
    ends = ends.where(clean("b.relation") != clean("model")).groupBy("model", "low").agg(F.min_by(F.struct("name", "shape"), "place").alias("f"), F.collect_set("b").alias("bases"))
    edges = ends.select("model", "f.*", F.size("bases").alias("n"), F.explode("bases").alias("b"))
    edges = edges.select(F.col("b.relation").alias("source"), F.col("b.column").alias("source_column"), F.col("model").alias("target"), F.col("name").alias("target_column"), F.when(F.col("n") > 1, "transformation").otherwise(F.col("shape")).alias("lineage_type"))
    told = reasons.groupBy("model").agg(F.min_by("reason", F.struct("nth", "reason")).alias("reason"))
    skipped = texts.select("model").distinct().join(good, "model", "left_anti").join(told, "model", "left").select("model", F.coalesce("reason", F.lit("no sql")).alias("reason"))
    edges, skipped = stored(edges), stored(skipped)
    drop(relations, blocks, branches, items, sources, early, levels)
    for table in (columns, words, *of_level):
        table.drop()
    return edges, skipped


def project_lineage(spark: SparkSession, models: Mapping[str, tuple[str | None, str | None]], relations: Mapping[str, Mapping[str, str]]) -> tuple[DataFrame, list[str]]:
    """lineage() of a few models at hand: name -> (compiled SQL, raw SQL), relation -> column -> type; (edges, names of models that were skipped)."""
    texts = spark.createDataFrame([(m, list(t)) for m, t in models.items()], "model string, texts array<string>")
    columns = spark.createDataFrame([(r, c, i) for r, cs in relations.items() for i, c in enumerate(cs)], "relation string, column string, place int")
    edges, reasons = lineage(texts, columns)
    return edges, sorted(r.model for r in reasons.collect())
