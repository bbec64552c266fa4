"""The lineage graph: edges by type, traversals, paths and closures.

Traversals are loops of joins over frontiers. Each round is written to the shared folder, so a round reads only its
predecessor; a frontier is sent to all executors only while it is small, else it is joined by a shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import names, rules
from orrery.operators import reach
from orrery.storage import FEW, drop, few, many, spread, stored

REACH_DEPTH, REACH_NODES, PATH_DEPTH, MOST_PATHS, FULL_DEPTH = 15, 500, 30, 50, 1000
#: Hops through one middle that lie in one task.
HOPS = 4_000_000


def classified(graph: DataFrame) -> DataFrame:
    """Staged graph rows as edges between typed nodes, with kind (an explicit one wins) and level; of rows of one pair the first by `seq` stays, where there is such a column."""
    end = lambda side: names.node_id(F.col(f"{side}_type"), F.col(f"{side}_id"))
    rows = graph.select(
        end("source").alias("source"), end("target").alias("target"), rules.edge_kind_or_explicit(F.col("edge_kind"), F.col("source_type"), F.col("target_type")).alias("kind"),
        rules.edge_level(F.col("source_type"), F.col("target_type")).alias("level"), F.col("lineage_type"), (F.col("seq") if "seq" in graph.columns else F.lit(0)).alias("seq"),
    )
    own = F.struct("kind", "level", "lineage_type")
    return rows.groupBy("source", "target").agg(F.min_by(own, F.struct("seq", "kind", "level", "lineage_type")).alias("e")).select("source", "target", "e.*")


def reclassified(edges: DataFrame) -> DataFrame:
    """kind and level of edges anew from their nodes' types; explicit kinds outside the classifier's own stay."""
    s, t = names.type_of_node(F.col("source")), names.type_of_node(F.col("target"))
    own = F.col("kind").isin("contains", "column", "model") | F.col("kind").isNull()
    return edges.withColumn("kind", F.when(own, rules.edge_kind(s, t)).otherwise(F.col("kind"))).withColumn("level", rules.edge_level(s, t))


def nodes_of(graph: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct ends of the staged edges (node_id, name, group); nodes that are known already stay as they are."""
    end = lambda side: graph.select(names.node_id(F.col(f"{side}_type"), F.col(f"{side}_id")).alias("node_id"), F.col(side).alias("name"), F.col(f"{side}_type").alias("group"))
    # The least of strings is found by sorting: it is sorted what is left of the distinct rows, in tasks of bounded size.
    ends = stored(end("source").unionByName(end("target")).distinct())
    found = spread(ends, ends.count(), "node_id").groupBy("node_id").agg(F.min("name").alias("name"), F.min("group").alias("group"))
    return found if known is None else known.select("node_id", "name", "group").unionByName(found.join(known, "node_id", "left_anti"))


def merged(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, ids that are new): incoming fields win where they are not null, edges are one for each kind and pair."""
    fields = [c for c in old_nodes.columns if c != "node_id"]
    joined = old_nodes.alias("o").join(new_nodes.alias("n"), "node_id", "full")
    nodes = joined.select("node_id", *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in fields))
    edges = old_edges.unionByName(new_edges, allowMissingColumns=True).dropDuplicates(["kind", "source", "target"])
    return nodes, edges, new_nodes.select("node_id").join(old_nodes, "node_id", "left_anti")


def described(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """Nodes with their items' columns, by the id behind the type."""
    return nodes.withColumn("item_id", names.id_of_node(F.col("node_id"))).join(items, "item_id", "left")


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, value: totals, repeated ids, edges without a node, and nodes by type."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    repeated = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ends = edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id"))).distinct()
    by_type = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit("nodes "), "group").alias("metric"), "value")
    totals = [n(nodes, "nodes"), n(edges, "edges"), n(repeated, "repeated ids"), n(ends.join(nodes, "node_id", "left_anti"), "ends without node")]
    out = by_type
    for t in totals:
        out = out.unionByName(t)
    return out


def shared_names(nodes: DataFrame, most: int = 10) -> DataFrame:
    return nodes.groupBy("name").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").orderBy(F.desc("nodes"), "name").limit(most)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(at, next) pairs along the edges (down), against them (up) or both; edges that repeat give pairs that repeat."""
    down, up = edges.select(F.col("source").alias("at"), F.col("target").alias("next")), edges.select(F.col("target").alias("at"), F.col("source").alias("next"))
    return {"down": down, "up": up, "both": down.unionByName(up)}[direction]


def reachable(edges: DataFrame, starts: DataFrame, direction: str = "down", depth: int = REACH_DEPTH, most: int | None = None, blocked: DataFrame | None = None, until: str | None = None) -> DataFrame:
    """(node_id, distance) of all nodes within `depth` steps of the starts (node_id), the starts at 0.

    Blocked nodes are not entered; starts are exempt. With `most`, the nearest so many besides the starts, ties by id. With `until`, the search
    ends with the round that finds this node. Cycles are no matter. Edges are stored once; those of stored() are read where they lie.
    """
    own = None if hasattr(edges, "_stored_at") else stored(edges.select("source", "target"))
    steps = directed(edges if own is None else own, direction)
    if blocked is not None:
        steps = steps.join(few(stored(blocked.select(F.col("node_id").alias("next")).distinct())), "next", "left_anti").select("at", "next")
    frontier = stored(starts.select("node_id").distinct().withColumn("distance", F.lit(0)))
    seen = frontier
    for d in range(1, depth + 1):
        reached = steps.join(few(frontier.select(F.col("node_id").alias("at"))), "at").select(F.col("next").alias("node_id")).distinct()
        frontier = stored(reached.join(seen, "node_id", "left_anti").select("node_id", F.lit(d).alias("distance")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if until is not None and not frontier.where(F.col("node_id") == until).isEmpty():
            break
    drop(own)
    return seen if most is None else seen.where("distance = 0").unionByName(seen.where("distance > 0").orderBy("distance", "node_id").limit(most))


def both_ways(edges: DataFrame, starts: DataFrame, **more) -> DataFrame:
    """The least distance up or down."""
    edges = stored(edges.select("source", "target"))
    up, down = reachable(edges, starts, "up", **more), reachable(edges, starts, "down", **more)
    return up.unionByName(down).groupBy("node_id").agg(F.min("distance").alias("distance"))


def used_where(edges: DataFrame, starts: DataFrame, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """Counts and least distance of what is downstream by type, and at most so many ids of each type."""
    reached = reachable(edges, starts).where("distance > 0").withColumn("group", names.type_of_node(F.col("node_id")))
    by = reached.groupBy("group").agg(F.count(F.lit(1)).alias("nodes"), F.min("distance").alias("nearest"))
    # The first of each of some parts of a type, then the first of those: no array or task holds all ids of a type.
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "node_id"))
    some = reached.withColumn("part", F.pmod(F.xxhash64("node_id"), F.lit(256))).withColumn("place", place("group", "part")).where(F.col("place") <= most)
    some = some.withColumn("place", place("group")).where(F.col("place") <= most)
    ids = F.array_sort(F.collect_list(F.struct("place", "node_id")))
    return by, some.groupBy("group").agg(F.transform(ids, lambda x: x["node_id"]).alias("ids"))


def shortest_paths(edges: DataFrame, source: str, target: str, direction: str = "down", depth: int = PATH_DEPTH, most: int = MOST_PATHS, blocked: DataFrame | None = None) -> DataFrame:
    """(path array<string>, hops): all shortest paths, in the order of their ids, at most `most`; none if the target is out of reach.

    The search goes from both ends, a level at a time from the end whose last level has fewer steps ahead, until two last levels meet: the
    nodes that they share are the middles of all shortest paths. From there the steps on those paths are taken back to each end, and paths
    grow forward among them alone, so every prefix leads to the target and the least `most` prefixes hold the least `most` paths.
    """
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([([source], 0)], "path array<string>, hops int")
    as_column = lambda df, name: df.select(F.col("node_id").alias(name))
    # Steps that repeat are made one where a path takes them: among all they would be a hash table of the whole graph.
    steps = directed(edges, direction)
    if blocked is not None:
        closed = few(stored(blocked.select("node_id").where(~F.col("node_id").isin(source, target)).distinct()))
        steps = steps.join(as_column(closed, "at"), "at", "left_anti").join(as_column(closed, "next"), "next", "left_anti").select("at", "next")
    steps = stored(steps)
    toward = (("at", "next"), ("next", "at"))

    def ahead(side: int, level: DataFrame, size: int) -> DataFrame:
        here, there = toward[side]
        last = as_column(level, here)
        return steps.join(F.broadcast(last) if size <= FEW else last, here).select(F.col(there).alias("node_id"))

    levels, sizes = [[stored(spark.createDataFrame([(end,)], "node_id string"))] for end in (source, target)], [1, 1]
    costs = [ahead(side, levels[side][0], 1).count() for side in (0, 1)]
    met = None
    for _ in range(max(1, min(depth, PATH_DEPTH))):
        side = 0 if costs[0] <= costs[1] else 1
        reached = ahead(side, levels[side][-1], sizes[side]).distinct()
        levels[side].append(stored(reached.join(functools.reduce(DataFrame.unionByName, levels[side]), "node_id", "left_anti")))
        sizes[side] = levels[side][-1].count()
        if sizes[side] == 0:
            break
        shared = stored(levels[side][-1].join(levels[1 - side][-1], "node_id", "left_semi"))
        if not shared.isEmpty():
            met = shared
            break
        drop(shared)
        costs[side] = ahead(side, levels[side][-1], sizes[side]).count()
    if met is None:
        drop(steps, *levels[0], *levels[1])
        return spark.createDataFrame([], "path array<string>, hops int")

    def ladder(side: int) -> list[DataFrame]:
        """The steps on shortest paths from the middles to an end, a table a level."""
        far, near = toward[side]
        rungs, level = [], met
        for before in levels[side][-2::-1]:
            rungs.append(stored(steps.join(few(as_column(level, near)), near).join(as_column(before, far), far, "left_semi").select("at", "next").distinct()))
            level = rungs[-1].select(F.col(far).alias("node_id")).distinct()
        return rungs

    rungs = ladder(0)[::-1] + ladder(1)
    paths = spark.createDataFrame([([source],)], "path array<string>")
    for rung in rungs:
        grown = paths.withColumn("at", F.element_at("path", -1)).join(rung, "at").select(F.concat("path", F.array("next")).alias("path"))
        paths = stored(grown.orderBy("path").limit(most))
    drop(steps, met, *levels[0], *levels[1], *rungs)
    return paths.select("path", F.lit(len(rungs)).alias("hops"))


def ego(edges: DataFrame, start: DataFrame, depth: int = 2, direction: str = "both", levels: Sequence[str] = ("asset", "both"), full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes with distance, edges among them) around the starts, along edges of the levels (or of none), depth 0 to 5 unless full."""
    own = edges.where(F.col("level").isin(*levels) | F.col("level").isNull())
    depth = FULL_DEPTH if full else max(0, min(depth, 5))
    near = both_ways(own, start, depth=depth) if direction == "both" else reachable(own, start, direction, depth)
    near = stored(near)
    ids = near.select("node_id")
    inside = own.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return near, inside


def column_ego(edges: DataFrame, container: str, depth: int = 2, direction: str = "both", full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a container's column lineage.

    Its members are the seeds; column edges are followed; then come the containers of all members, join and filter edges one hop
    from them, and the report hierarchy four hops below.
    """
    spark = edges.sparkSession
    inside = edges.where("kind = 'contains'")
    members = inside.where(F.col("source") == container).select(F.col("target").alias("node_id"))
    seeds = members.unionByName(spark.createDataFrame([(container,)], "node_id string"))
    columns = edges.where("kind = 'column'")
    depth = FULL_DEPTH if full else max(0, min(depth, 5))
    near = stored((both_ways(columns, seeds, depth=depth) if direction == "both" else reachable(columns, seeds, direction, depth)).select("node_id"))
    boxes = inside.join(near.withColumnRenamed("node_id", "target"), "target", "left_semi").select(F.col("source").alias("node_id"))
    side = edges.where("kind IN ('join', 'filter')")
    hop = side.join(near.withColumnRenamed("node_id", "source"), "source", "left_semi").select(F.col("target").alias("node_id")).unionByName(side.join(near.withColumnRenamed("node_id", "target"), "target", "left_semi").select(F.col("source").alias("node_id")))
    reports = reachable(edges.where("kind = 'model'"), near, "down", 4).select("node_id")
    every = stored(near.unionByName(boxes).unionByName(hop).unionByName(reports).distinct())
    kept = edges.join(every.withColumnRenamed("node_id", "source"), "source", "left_semi").join(every.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return every, kept


def closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(node_id, reached) for every node from which a target (node_id) is reached in a step or more: true reachability, cycles included.

    Semi-naive: a round extends only the pairs that the one before found. Pairs are restricted to the targets, never node by node.
    """
    steps = stored(edges.select("source", "target").distinct())
    delta = stored(steps.join(targets.select(F.col("node_id").alias("target")), "target", "left_semi").select(F.col("source").alias("node_id"), F.col("target").alias("reached")))
    every = delta
    while True:
        new = steps.join(delta.withColumnRenamed("node_id", "target"), "target").select(F.col("source").alias("node_id"), "reached").distinct()
        delta = stored(new.join(every, ["node_id", "reached"], "left_anti"))
        if delta.isEmpty():
            break
        every = every.unionByName(delta)
    return every


def downstream_counts(edges: DataFrame, nodes: DataFrame, types: Sequence[str]) -> DataFrame:
    """(node_id, group, names, ids): for each node and type the distinct names of what is reached in a step or more, and the distinct ids. Nodes that reach none of a type have no row for it."""
    targets = stored(nodes.where(F.col("group").isin(*types)).select("node_id", "name", "group").distinct())
    # A node whose one name no other has is one mark for both counts.
    alone = targets.where("name IS NOT NULL").groupBy("group", "name").agg(F.count(F.lit(1)).alias("ids"), F.min("node_id").alias("node_id")).where("ids = 1").select("group", "node_id")
    once = targets.groupBy("group", "node_id").agg(F.count(F.lit(1)).alias("names")).where("names = 1").select("group", "node_id")
    own = stored(once.join(many(alone.distinct()), ["group", "node_id"]).withColumn("one", F.lit(True)))
    mark = lambda kind, what: F.struct(F.concat("group", F.lit(f"/{kind}")).alias("kind"), F.col(what).alias("what"))
    kinds = F.when(F.col("one"), F.array(mark("both", "node_id"))).otherwise(F.array(mark("ids", "node_id"), mark("names", "name")))
    rows = targets.join(few(own, reach.SENT), ["group", "node_id"], "left").select("node_id", F.inline(kinds)).where("what IS NOT NULL")
    counts = reach.counts(edges, rows)
    kind = F.substring_index("kind", "/", -1)
    of = lambda k: F.coalesce(F.sum(F.when(kind.isin(k, "both"), F.col("n"))), F.lit(0)).alias(k)
    return counts.groupBy("node_id", F.expr("left(kind, length(kind) - length(substring_index(kind, '/', -1)) - 1)").alias("group")).agg(of("names"), of("ids"))


def unused(edges: DataFrame, producers: DataFrame, consumer_types: Sequence[str]) -> DataFrame:
    """Producers (node_id) without an edge to a consumer type."""
    used = edges.where(names.type_of_node(F.col("target")).isin(*consumer_types)).select(F.col("source").alias("node_id")).distinct()
    return producers.join(used, "node_id", "left_anti")


def untested(edges: DataFrame, models: DataFrame) -> DataFrame:
    """Models (node_id) from which no edge leads to a test."""
    return unused(edges, models, ["DBT_TEST"])


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(side, other, kind) one hop up and down."""
    up = edges.where(F.col("target") == node).select(F.lit("up").alias("side"), F.col("source").alias("other"), "kind")
    return up.unionByName(edges.where(F.col("source") == node).select(F.lit("down").alias("side"), F.col("target").alias("other"), "kind"))


def two_hops_across(edges: DataFrame) -> DataFrame:
    """(first, middle, last) where the first and the last are of different tools. Edges are made distinct before they are joined; the hops of a middle with more than HOPS are dealt over tasks by their first nodes."""
    raw = stored(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL"))
    pairs = stored(spread(raw, raw.count(), "source", "target").distinct())
    drop(raw)
    tool = lambda c: F.substring_index(c, "_", 1)
    into = pairs.select(F.col("source").alias("first"), F.col("target").alias("middle"), tool("source").alias("tool"))
    out = pairs.select(F.col("source").alias("middle"), F.col("target").alias("last"), tool("target").alias("other"))
    degree = lambda df, n: df.groupBy("middle").agg(F.count(F.lit(1)).alias(n))
    cells = F.ceil(F.col("a") * F.col("b") / HOPS).cast("int")
    hubs = few(stored(degree(into, "a").join(degree(out, "b"), "middle").select("middle", cells.alias("cells")).where("cells > 1")))
    cells = F.coalesce("cells", F.lit(1))
    into = into.join(hubs, "middle", "left").select("first", "middle", "tool", F.pmod(F.xxhash64("first"), cells).cast("int").alias("cell"))
    out = out.join(hubs, "middle", "left").select("middle", "last", "other", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    rows = pairs.count()
    met = spread(into, rows, "middle", "cell").join(spread(out, rows, "middle", "cell").hint("shuffle_hash"), ["middle", "cell"])
    return met.where("tool <> other").select("first", "middle", "last")


def two_hop_counts(edges: DataFrame) -> DataFrame:
    """(middle, hops): how many rows two_hops_across() has for each middle node."""
    return two_hops_across(edges).groupBy("middle").agg(F.count(F.lit(1)).alias("hops"))


def fan_out(edges: DataFrame, source_type: str, without: Sequence[str] = ("DBT_TEST", "DBT_COLUMN"), most: int = 15) -> DataFrame:
    own = edges.where((names.type_of_node(F.col("source")) == source_type) & ~names.type_of_node(F.col("target")).isin(*without))
    return own.groupBy("source").agg(F.countDistinct("target").alias("targets")).orderBy(F.desc("targets"), "source").limit(most)


def hubs(edges: DataFrame, threshold: int) -> DataFrame:
    ends = edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id")))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > threshold)


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, layer): the longest path that ends in a node; nodes in a cycle or behind one are at 0."""
    ids, steps = reach.coded(stored(nodes.select("node_id").distinct()), edges)
    found = reach.peeled(steps, ids.select(F.col("n").alias("node_id")), reach.CODED).withColumnRenamed("node_id", "n")
    drop(steps)
    return many(ids).join(found, "n", "left").select("node_id", F.coalesce("layer", F.lit(0)).alias("layer"))


def hop_layers(edges: DataFrame, start: str) -> DataFrame:
    """Distances from one end of a path, edges taken in both directions."""
    return reachable(edges, edges.sparkSession.createDataFrame([(start,)], "node_id string"), "both", FULL_DEPTH)


def trace(edges: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that lie up and down of a column along column edges."""
    columns = edges.where("kind = 'column'")
    start = edges.sparkSession.createDataFrame([(column,)], "node_id string")
    up, down = stored(reachable(columns, start, "up", FULL_DEPTH)), stored(reachable(columns, start, "down", FULL_DEPTH))
    both = lambda ids: columns.join(ids.select(F.col("node_id").alias("source")), "source", "left_semi").join(ids.select(F.col("node_id").alias("target")), "target", "left_semi")
    return up.unionByName(down).groupBy("node_id").agg(F.min("distance").alias("distance")), both(up).unionByName(both(down)).distinct()


def cards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, card, card_kind): members lie in their first container, every measure has a card of its own, members without one lie in a card named after their parent."""
    box = edges.where("kind = 'contains'").groupBy(F.col("target").alias("node_id")).agg(F.min("source").alias("box"))
    joined = nodes.join(box, "node_id", "left")
    kind = F.col("group")
    card = F.when(kind == "PB_MEASURE", F.col("node_id")).when(kind.isin(*rules.MEMBER_TYPES), F.coalesce("box", F.concat(F.lit("group::"), kind))).otherwise(F.col("node_id"))
    return joined.select("node_id", card.alias("card"), F.when(kind == "PB_MEASURE", "measures").when(kind.isin(*rules.REPORT_TYPES), "report").otherwise("model").alias("card_kind"))


def visible(nodes: DataFrame, edges: DataFrame, hidden_groups: Sequence[str] = (), hidden_ids: Sequence[str] = (), linked_columns_only: bool = False) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(~F.col("group").isin(*hidden_groups) & ~F.col("node_id").isin(*hidden_ids))
    if linked_columns_only:
        ends = edges.where("kind = 'column'")
        linked = ends.select(F.col("source").alias("node_id")).unionByName(ends.select(F.col("target").alias("node_id"))).distinct()
        is_column = F.col("group").isin(*rules.COLUMN_TYPES)
        kept = kept.where(~is_column).unionByName(kept.where(is_column).join(linked, "node_id", "left_semi"))
    ids = kept.select("node_id")
    return kept, edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


def members(edges: DataFrame, container: str) -> DataFrame:
    """Lazily loaded members of a container, one parent each: the first by id."""
    own = edges.where("kind = 'contains'").groupBy("target").agg(F.min("source").alias("source")).where(F.col("source") == container)
    return own.select(F.col("target").alias("node_id"))


def tree(items: DataFrame, levels: Sequence[Column]) -> DataFrame:
    """Leaves below every node of a tree by levels (a rollup); level 0 is the root."""
    keys = [c.alias(f"level_{i}") for i, c in enumerate(levels)]
    rolled = items.select(*keys).rollup(*(f"level_{i}" for i in range(len(levels)))).agg(F.count(F.lit(1)).alias("leaves"), F.grouping_id().alias("gid"))
    return rolled.withColumn("depth", F.lit(len(levels)) - F.bit_count("gid")).drop("gid")



def backfilled(edges: DataFrame, nodes: DataFrame, producers: Sequence[str], consumer_types: Sequence[str], report_types: Sequence[str] = ("PB_REPORT",)) -> DataFrame:
    """(node_id, is_unused, connected_reports) of the producers' types: unused without an edge to a consumer type; distinct reports that are reached."""
    edges = reach.by_type(edges)
    own = nodes.where(F.col("group").isin(*producers)).select("node_id")
    free = unused(edges, own, consumer_types).withColumn("is_unused", F.lit(True))
    reports = nodes.where(F.col("group").isin(*report_types)).select("node_id", F.lit("reports").alias("kind"), F.col("node_id").alias("what"))
    reached = reach.counts(edges, reports).select("node_id", F.col("n").alias("connected_reports"))
    joined = own.join(free, "node_id", "left").join(reached, "node_id", "left")
    return joined.select("node_id", F.coalesce("is_unused", F.lit(False)).alias("is_unused"), F.coalesce("connected_reports", F.lit(0)).alias("connected_reports"))


def upstream_tree(edges: DataFrame, nodes: DataFrame, start: str, prefix: str = "DBT_", depth: int = 10) -> DataFrame:
    """(depth, node_id, name, group) of what lies upstream of a node along edges from one tool's nodes, nearest first, then by name."""
    own = edges.where(F.col("source").startswith(prefix))
    near = reachable(own, edges.sparkSession.createDataFrame([(start,)], "node_id string"), "up", depth).where("distance > 0")
    return near.join(nodes.select("node_id", "name", "group"), "node_id").select(F.col("distance").alias("depth"), "node_id", "name", "group").orderBy("depth", "name", "node_id")


def reached_in_order(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, distance, group, name) of what reachable() found, farthest first, then by group and name in any case."""
    return reached.join(nodes.select("node_id", "group", "name"), "node_id").select("node_id", "distance", "group", "name").orderBy(F.desc("distance"), "group", F.lower("name"), "node_id")


def outside_workspace(nodes: DataFrame, workspace: str, prefix: str = "PB_") -> DataFrame:
    """(node_id) of one tool's nodes whose workspace_name is another than this; nodes without one are not blocked."""
    return nodes.where(F.col("node_id").startswith(prefix) & (F.trim(F.coalesce("workspace_name", F.lit(""))) != "") & (F.trim("workspace_name") != workspace)).select("node_id")


def directory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Assets without the members that containers load later: (node_id, name, group, members)."""
    held = edges.where("kind = 'contains'").groupBy(F.col("source").alias("node_id")).agg(F.countDistinct("target").alias("members"))
    assets = nodes.where(~F.col("group").isin(*rules.MEMBER_TYPES))
    return assets.join(held, "node_id", "left").select("node_id", "name", "group", F.coalesce("members", F.lit(0)).alias("members"))


def member_search(nodes: DataFrame, edges: DataFrame, text: str, most: int = 50) -> DataFrame:
    """(node_id, name, container) of members whose name holds the text in any case, with their first container; by name."""
    box = edges.where("kind = 'contains'").groupBy(F.col("target").alias("node_id")).agg(F.min("source").alias("container"))
    found = nodes.where(F.col("group").isin(*rules.MEMBER_TYPES) & F.contains(F.lower("name"), F.lit(text.lower())))
    return found.join(box, "node_id", "left").select("node_id", "name", "container").orderBy(F.lower("name"), "node_id").limit(most)


def name_search(nodes: DataFrame, text: str, most: int = 25) -> DataFrame:
    """Nodes by exact id, else by exact name, else by names that hold the text, in any case; at most `most` by name."""
    low = F.lower(F.trim("name"))
    stage = F.when(F.col("node_id") == text, 0).when(low == text.strip().lower(), 1).when(F.contains(low, F.lit(text.strip().lower())), 2)
    hits = nodes.withColumn("stage", stage).where("stage IS NOT NULL")
    return hits.join(F.broadcast(hits.agg(F.min("stage").alias("stage"))), "stage").select("node_id", "name", "group", "stage").orderBy(low, "node_id").limit(most)


def measure_dependencies(nodes: DataFrame, edges: DataFrame, measure: str) -> DataFrame:
    """(side, node_id, name) of a measure: its home tables (containers), the measures it uses and the measures that use it."""
    named = nodes.select("node_id", "name", "group")
    up = edges.where(F.col("target") == measure).select(F.col("source").alias("node_id")).join(named, "node_id")
    down = edges.where(F.col("source") == measure).select(F.col("target").alias("node_id")).join(named, "node_id")
    side = lambda df, kind, label: df.where(F.col("group") == kind).select(F.lit(label).alias("side"), "node_id", "name").distinct()
    return side(up, "PB_TABLE", "home").unionByName(side(up, "PB_MEASURE", "uses")).unionByName(side(down, "PB_MEASURE", "used by"))


def resolved_nodes(refs: DataFrame, items: DataFrame) -> DataFrame:
    """refs (ref, dataset, table, name) with node_id and rank: by dataset, table and name, else table and name, else dataset and name, else name alone.

    items: (item_type, item_id, dataset_id, table_name, item_name). Of several items with one key the first by id counts; null where none matches.
    """
    out = refs
    for rank, keys in enumerate((("dataset", "table", "name"), ("table", "name"), ("dataset", "name"), ("name",))):
        of = {"dataset": "dataset_id", "table": "table_name", "name": "item_name"}
        known = items.groupBy(*(F.lower(F.trim(of[k])).alias(f"_{k}") for k in keys)).agg(F.min(F.struct("item_id", "item_type")).alias(f"_found{rank}"))
        on = F.lit(True)
        for k in keys:
            on = on & (F.lower(F.trim(k)) == F.col(f"_{k}"))
        out = out.join(known, on, "left").drop(*(f"_{k}" for k in keys))
    found = F.coalesce(*(F.when(F.col(f"_found{r}").isNotNull(), F.struct(F.lit(r).alias("rank"), F.col(f"_found{r}").alias("i"))) for r in range(4)))
    return out.withColumn("_f", found).select("ref", names.node_id(F.col("_f.i.item_type"), F.col("_f.i.item_id")).alias("node_id"), F.col("_f.rank").alias("rank"))
