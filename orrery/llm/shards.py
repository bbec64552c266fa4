"""Sharding by a hierarchical weighted hash tree (region, rack, shard)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.frames import few, named, stored

#: Blocks of hashed ids per shard within which slots are counted.
SLOT_BLOCKS = 1024
#: Descents that a key tries; where none ends in a shard that takes it, one draw among all shards decides.
TRIES = 64
#: Places of the first block; each further block has as many as all before it.
FIRST_BLOCK = 32


def block_of(shard: int) -> int:
    """Shards 0 to 31 are block 0, 32 to 63 block 1, 64 to 127 block 2 and so on."""
    return max(0, shard.bit_length() - FIRST_BLOCK.bit_length() + 1)


@dataclass(frozen=True)
class Leaf:
    """A shard's place; it takes the share weight / room of the keys that descend to it (the room is the weight, where that is more).

    Weight 0 is a place that is kept free.
    """

    region: int
    rack: int
    shard: int
    weight: float = 1.0
    room: float = 1.0


def even_tree(n_shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """Shards 0 to n-1 of weight 1, filled rack by rack and region by region."""
    return [Leaf(s // (shards_per_rack * racks_per_region), s // shards_per_rack, s) for s in range(n_shards)]


def _draw(weight: float, *parts: Column | str) -> Column:
    """An exponential draw of rate `weight` from a hash of the parts: the least of several falls to each in proportion to its weight."""
    h = F.xxhash64(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def choose(key: Column, tree: Sequence[Leaf], salt: str = "", tries: int = TRIES) -> Column:
    """int: the shard to which the key descends.

    A descent draws among the regions, then among the racks of the region drawn, then among that rack's shards, each child with the
    room of its own subtree as weight: fan-out times depth draws. The shard takes the key with probability weight / room, else the key
    descends anew with other draws. A change of one shard's weight changes nothing but whether that shard takes what descends to it:
    when a weight rises within the shard's room, keys move into that shard alone, when it falls, out of it alone, and nothing moves between other
    racks or regions.
    Keys that `tries` descents leave over draw among all shards by weight, which keeps the same law. A null key draws as a key of its own.

    Each block of places (block_of) is a tree of its own, so that there is room for any number of shards. Descents are the arrivals of a clock that
    runs at the rate of the block's room; the key lies where a shard takes it first, of all blocks. A block that opens with a new shard
    can thus only draw keys into that shard.
    """
    tree = [replace(x, room=max(x.weight, x.room)) for x in tree]
    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("the tree has no shard of positive weight")
    if len({x.shard for x in tree}) < len(tree):
        raise ValueError("two leaves are one shard")

    blocks: dict[int, list[Leaf]] = {}
    for x in tree:
        blocks.setdefault(block_of(x.shard), []).append(x)
    blocks = {b: leaves for b, leaves in blocks.items() if any(x.weight > 0 for x in leaves)}
    if len(blocks) == 1:
        (leaves,) = blocks.values()
        return _first(key, leaves, salt, tries, False)
    firsts = [_first(key, leaves, f"{salt}/{b}" if b else salt, tries, True) for b, leaves in sorted(blocks.items())]
    return F.array_min(F.array(*firsts))["name"]


def _first(key: Column, tree: Sequence[Leaf], salt: str, tries: int, timed: bool) -> Column:
    """The shard of one block that takes the key first; with its time, as a struct, where blocks are to be compared."""
    live = [x for x in tree if x.weight > 0]

    def descent(turn: Column) -> Column:
        def least(level: str, groups: dict[int, list[Leaf]]) -> Column:
            drawn = [F.struct(_draw(sum(x.room for x in below), key, f"{salt}/{level}/{name}", turn).alias("draw"), F.lit(name).alias("name")) for name, below in groups.items()]
            return F.array_min(F.array(*drawn))["name"]

        def by(field: str, leaves: Sequence[Leaf]) -> dict[int, list[Leaf]]:
            groups: dict[int, list[Leaf]] = {}
            for x in leaves:
                groups.setdefault(getattr(x, field), []).append(x)
            return groups

        def into(at: Column, groups: dict[int, list[Leaf]], body) -> Column:
            """body of the child that was drawn; only that one is computed."""
            out = F
            for name, below in groups.items():
                out = out.when(at == F.lit(name), body(below))
            return out

        def taken(leaves: list[Leaf]) -> Column:
            shards = by("shard", leaves)

            def accepted(below: list[Leaf]) -> Column:
                (x,) = below
                if x.weight in (0, x.room):
                    return F.lit(x.shard if x.weight else -1)
                return F.when(_draw(1.0, key, f"{salt}/take/{x.shard}", turn) < F.lit(_quantile(x.weight / x.room)), F.lit(x.shard)).otherwise(F.lit(-1))

            return once(least("shard", shards), lambda at: into(at, shards, accepted))

        def rack(leaves: list[Leaf]) -> Column:
            racks = by("rack", leaves)
            return once(least("rack", racks), lambda at: into(at, racks, taken))

        regions = by("region", tree)
        return once(least("region", regions), lambda at: into(at, regions, rack))

    turns = F.sequence(F.lit(0), F.lit(tries - 1))
    flat = F.array_min(F.array(*(F.struct(_draw(x.weight, key, f"{salt}/flat/{x.shard}").alias("draw"), F.lit(x.shard).alias("name")) for x in live)))
    if not timed:
        found = F.aggregate(turns, F.lit(-1), lambda at, turn: F.when(at >= 0, at).otherwise(descent(turn)))
        return once(found, lambda at: F.when(at >= 0, at).otherwise(flat["name"]))
    rate = sum(x.room for x in tree)
    state = lambda time, name: F.struct(time.alias("draw"), name.alias("name"))
    found = F.aggregate(turns, state(F.lit(0.0), F.lit(-1)), lambda s, turn: F.when(s["name"] >= 0, s).otherwise(state(s["draw"] + _draw(rate, key, f"{salt}/clock", turn), descent(turn))))
    return once(found, lambda s: F.when(s["name"] >= 0, s).otherwise(once(flat, lambda f: state(s["draw"] + f["draw"], f["name"]))))


def _quantile(share: float) -> float:
    """An exponential draw of rate 1 is below this with probability `share`."""
    from math import log1p

    return -log1p(-share)


def once(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def same_room(a: Sequence[Leaf], b: Sequence[Leaf], spare: Sequence[Leaf] = ()) -> tuple[list[Leaf], list[Leaf]]:
    """Both trees with every shard of either and of `spare` and the larger of its rooms, so that keys descend alike in both."""
    rooms: dict[int, Leaf] = {}
    for x in [*a, *b, *spare]:
        old = rooms.get(x.shard, x)
        rooms[x.shard] = replace(x, weight=0.0, room=max(x.weight, x.room, old.room, old.weight))
    fitted = lambda tree: [replace(rooms[s], weight=tree[s].weight if s in tree else 0.0) for s in sorted(rooms)]
    return fitted({x.shard: x for x in a}), fitted({x.shard: x for x in b})


def assign_shards(
    docs: DataFrame,
    tree: Sequence[Leaf] | None = None,
    grown: Sequence[Leaf] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    spare: Sequence[Leaf] = (),
) -> DataFrame:
    """docs' id with size, text_crc32, law, region, rack, shard, slot and grown_shard (the shard in the tree `grown`).

    size: UTF-8 bytes of the text plus 1 (null text: none, so 1; its crc32 is that of no bytes, 0). The law is `key`: id and
    tree decide the shard (of each shard the larger room in the two trees; places of a block that no shard has are kept free, where `spare` says or as in an even tree), so copies of a row, a hot source, equal or very long texts cannot overload anything but by equal ids.
    Rows with null ids go to one shard together. slot counts the rows of a shard from 0 without gaps. Rows
    that repeat an id each get a slot. An empty table gives no rows. Other columns are left out, whatever their names.

    Slots need no total order in one task: rows are hashed by id, size and checksum to SLOT_BLOCKS blocks, the rows of a (shard, block) are
    numbered in their own window, and blocks start where the counts of earlier blocks end. The counts
    are shards x SLOT_BLOCKS rows at most, whatever the input.
    """
    tree = list(tree) if tree is not None else even_tree(16)
    grown = list(grown) if grown is not None else even_tree(len(tree) + 1)
    last = max(block_of(x.shard) for x in [*tree, *grown])
    tree, grown = same_room(tree, grown, [*even_tree(FIRST_BLOCK << last), *spare])
    text = F.coalesce(named(text_col), F.lit(""))
    key = F.col("_id")
    rows = docs.select(named(id_col).alias("_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", choose(key, tree).alias("shard"), choose(key, grown).alias("grown_shard"), F.pmod(F.xxhash64("_id", "size", "text_crc32"), F.lit(SLOT_BLOCKS)).cast("int").alias("_block"))
    rows = stored(rows)
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy(F.xxhash64("_id"), "_id", "size", "text_crc32")
    numbered = rows.withColumn("_rank", F.row_number().over(inside))
    place = {x.shard: x for x in tree}
    at = lambda field: F.element_at(F.create_map(*(F.lit(v) for s, x in place.items() for v in (s, getattr(x, field)))), F.col("shard")).alias(field)
    return numbered.join(few(starts, len(tree) * SLOT_BLOCKS), ["shard", "_block"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_start") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard", at("region"), at("rack"),
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    from orrery.llm.frames import documents

    return assign_shards(documents(spark, sf_dir), even_tree(16), even_tree(17))
