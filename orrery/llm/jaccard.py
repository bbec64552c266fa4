"""Exact n-gram Jaccard join: size-aware, with subsets of small sets and inverted lists of large ones."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.frames import documents, drop, few, freed, named, slices, stored
from orrery.llm.graphs import components

WORDS, PERCENT = 5, 75
#: From this threshold on, sets of one or two shingles link with equal ones only, which the subsets need.
SUBSETS_FROM = 70
#: Entries of shingles that so many sets may hold skip the groups: a group holds no more of one list, beyond what HOT_SHINGLES leaves out.
LONGEST_GROUPED = 1024
#: Rows of a list that one task of the join within lists reads.
SALT_ROWS = 256
#: Lists whose largest components are sent to every executor.
SENT_LISTS = 100_000
#: A list of up to so many sets is read pair by pair; a longer one by its outliers (see `_across`).
LONG_LIST = 32
#: The most frequent shingles, so many at most, come last in the order of shingles. A hint: any order gives the same links.
HOT_SHINGLES = 1 << 18
#: Sets up to this size are candidates for the enumeration of subsets.
MOST_SMALL = 64
#: A candidate pair costs as much as so many list entries.
PAIR_COST = 2.0
PART_BYTES = 8 << 20
#: Up to so many ids are sent to every executor to pick their texts; above, texts and ids are shuffled.
SENT_IDS = 200_000

_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's set of shingles as ascending 64-bit hashes; of all its words in one where they are fewer than width."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = words.offsets.to_numpy()
    coded = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()], np.uint64)
    at = coded.indices.to_numpy()
    real = np.array([w != "" for w in coded.dictionary.to_pylist()], bool)[at]
    bounds = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
    flat = hashes[at[real]] if len(at) else np.empty(0, np.uint64)
    multiply = np.resize(_MULTIPLY, width) * (2 * np.arange(width, dtype=np.uint64) // np.uint64(5) * np.uint64(2) + np.uint64(1))
    long = np.zeros(max(0, len(flat) - width + 1), np.uint64)
    for i in range(width):
        long += flat[i : i + len(long)] * multiply[i]
    long = _mixed(long)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(long[a : b - width + 1])
        elif b > a:
            yield _mixed((flat[a:b] * multiply[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield flat[a:b]


def set_id(tokens: np.ndarray) -> bytes:
    """128 bits, which tell sets apart at any number of them."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _binary(raw: bytes) -> pa.Array:
    """16 bytes each."""
    n = len(raw) // 16
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(raw)])


def common_needed(na, nb, percent: int = PERCENT):
    """Least size of the intersection of linked sets of these sizes."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix(n: int, percent: int = PERCENT) -> int:
    """Linked sets have one of so many first shingles in common."""
    return n - -(-percent * n // 100) + 1


def _texts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for b in batches:
        row = 0
        for part in slices(b.column(1), 1 << 20):
            for tokens in shingle_sets(part, width):
                yield b, row, tokens
                row += 1


def _planes(x: np.ndarray) -> bytes:
    """The upper 48 bits of ascending numbers byte by byte, which compresses the leading ones away."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    x = np.zeros((n, 8), np.uint8)
    x[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, n).T
    return x.view(">u8").ravel().astype(np.uint64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal numbers in a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(x)]]))


def _counted(docs: DataFrame, parts: int, width: int) -> DataFrame:
    """Every document's (id, n, sh), the hot shingles with their document frequency, and sums over the others' (stored).

    Shingles are counted over all documents (copies within a task once); a task counts its own before it sends them on.
    """
    kind = docs.schema["_id"].dataType
    sent = T.StructType([T.StructField("part", T.LongType()), T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("sh", T.BinaryType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    got = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("sh", T.BinaryType()), T.StructField("key", T.LongType()), T.StructField("df", T.LongType()), T.StructField("square", T.LongType())])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        id_type = to_arrow_type(kind)
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        rows: tuple[list, list, list] = ([], [], [])
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, size
            if rows[0]:
                n = len(rows[0])
                spread = pa.array((np.arange(n) * 7919 + int.from_bytes(rows[2][0][:6])) % parts, pa.int64())
                yield pa.RecordBatch.from_arrays([spread, pa.array(rows[0], id_type), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=sent.names)
            if size:
                keys = np.sort(np.concatenate(held) & ~np.uint64(0xFFFF))
                starts, counts = _runs(keys)
                keys = keys[starts]
                part = _part(keys, parts)
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cuts[:-1]], pa.int64()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([_planes(keys[a:b]) for a, b in spans], pa.binary()), pa.array([np.minimum(counts[a:b], 65535).astype("<u2").tobytes() for a, b in spans], pa.binary())],
                    names=sent.names,
                )
            held, rows, size = [], ([], [], []), 0

        for b, row, tokens in _texts(batches, width):
            sh = set_id(tokens)
            rows[0].append(b.column(0)[row].as_py())
            rows[1].append(len(tokens))
            rows[2].append(sh)
            if sh not in seen:
                seen.add(sh)
                held.append(tokens)
                size += len(tokens)
            if size > 700_000 or len(rows[0]) >= 50_000:
                yield from flush()
                if len(seen) > 100_000:
                    seen.clear()
        yield from flush()

    def total(part: pa.Table) -> pa.Table:
        has = pc.is_valid(part["keys"])
        docs, blobs = part.filter(pc.invert(has)), part.filter(has)
        n, keys, counts = docs.num_rows, np.empty(0, np.uint64), np.empty(0, np.int64)
        if blobs.num_rows:
            keys = np.concatenate([_unplaned(x) for x in blobs["keys"].to_pylist()])
            counts = np.concatenate([np.frombuffer(x, "<u2") for x in blobs["counts"].to_pylist()]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            starts, _ = _runs(keys)
            keys, counts = keys[starts], np.add.reduceat(counts, starts)
        hot = counts > LONG_LIST
        cold = counts[~hot]
        keys, hots = keys[hot].view(np.int64), counts[hot]
        m = len(keys) + 1
        id_type = part.schema.field("id").type
        ids = docs["id"].combine_chunks() if n else pa.nulls(0, id_type)
        return pa.table(
            [
                pa.concat_arrays([ids, pa.nulls(m, id_type)]),
                pa.concat_arrays([docs["n"].combine_chunks() if n else pa.nulls(0, pa.int64()), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([docs["sh"].combine_chunks() if n else pa.nulls(0, pa.binary()), pa.nulls(m, pa.binary())]),
                pa.array([None] * n + keys.tolist() + [None], pa.int64()),
                pa.array([None] * n + hots.tolist() + [int(cold.sum())], pa.int64()),
                pa.array([None] * (n + m - 1) + [int((cold * cold).sum())], pa.int64()),
            ],
            names=got.names,
        )

    return stored(docs.mapInArrow(run, sent).repartition(parts, "part").groupBy("part").applyInArrow(total, got))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hash space, so that ascending keys have ascending parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def boundary(sizes: dict[int, int], partners: float, percent: int = PERCENT) -> int:
    """The size up to which enumerating the 2-subsets of prefixes is cheaper than scanning inverted lists.

    sizes: sets by size, up to MOST_SMALL. partners: other sets in an entry's list on average. A small set emits a row for each
    2-subset; a large one, and a small one that a large one may link with, a row and its partners for each shingle of the prefix.
    """

    def scans(n: int) -> float:
        return prefix(n, percent) * (1 + PAIR_COST * partners)

    def cost(b: int) -> float:
        light = sum(k * comb(prefix(n, percent) + 1, 2) for n, k in sizes.items() if n <= b)
        return light + sum(k * scans(n) for n, k in sizes.items() if n > b or 100 * n >= percent * (b + 1))

    return min(range(2, MOST_SMALL + 1), key=lambda b: (cost(b), b))


def _listed(docs: DataFrame, hot: object, parts: int, small: int, width: int, percent: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Candidate pairs of the short lists (kind 0 of a stored table), and the entries of the long ones; and tables to be dropped in the end.

    Small sets (up to `small` shingles) give their 2-subsets of prefix + 1 shingles, and meet each other there. All sets that may link with a
    large one give the shingles of their prefix, where pairs with a large set meet.
    """
    sent = "part long, keys binary, owner binary, place binary, sh binary, n binary"
    pair = "kind int, key long, a binary, na long, pa long, b binary, nb long, pb long, shared long"

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, rank = hot.value
        keys: list[np.ndarray] = []
        places: list[np.ndarray] = []
        widely: list[np.ndarray] = []
        owners: list[tuple[bytes, int, int]] = []
        seen: set[bytes] = set()
        size = 0

        def entry(tokens: np.ndarray, place: np.ndarray, wide: np.ndarray, sh: bytes, n: int) -> None:
            nonlocal size
            keys.append(tokens)
            places.append(place)
            widely.append(wide)
            owners.append((sh, n, len(tokens)))
            size += len(tokens)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, places, widely, owners, size
            if size:
                key, place, wide = np.concatenate(keys), np.concatenate(places), np.concatenate(widely)
                ids = np.frombuffer(b"".join(x[0] for x in owners), "V16")
                n, each = (np.array(x, np.int64) for x in list(zip(*owners, strict=True))[1:])
                owner = np.repeat(np.arange(len(each)), each)
                # Part -1: entries of very long lists, in the place of a group's result.
                part = np.where(wide, -1, _part(key, parts))
                order = np.argsort(part, kind="stable")
                key, place, owner, part = key[order], place[order], owner[order], part[order]
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                columns: list[list[bytes]] = [[], [], [], [], []]
                where: list[int] = []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    starts, lengths = _runs(owner[a:b])
                    whose = owner[a:b][starts]
                    where.append(int(part[a]))
                    for column, x in zip(columns, (key[a:b].astype("<u8"), lengths.astype("<u4"), place[a:b].astype("<u4"), ids[whose], n[whose].astype("<u4")), strict=True):
                        column.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "keys", "owner", "place", "sh", "n"])
            keys, places, widely, owners, size = [], [], [], [], 0

        for _, _, tokens in _texts(batches, width):
            n = len(tokens)
            if not n or (sh := set_id(tokens)) in seen:
                continue
            seen.add(sh)
            p = prefix(n, percent)
            common = np.zeros(n, np.int64)
            if len(hot_keys):
                key = tokens & ~np.uint64(0xFFFF)
                found = np.searchsorted(hot_keys, key)
                found[found == len(hot_keys)] = 0
                is_hot = hot_keys[found] == key
                if is_hot.any():
                    last, counts = tokens[is_hot], rank[found[is_hot]]
                    order = np.lexsort((last, counts))
                    tokens = np.concatenate([tokens[~is_hot], last[order]])
                    common[n - len(order) :] = counts[order]
            if n <= small and n > 2:
                some = tokens[: p + 1]
                i, j = np.triu_indices(len(some), 1)
                entry(_mixed(some[i] * _MULTIPLY[0] + some[j] * _MULTIPLY[1]), np.zeros(len(i), np.int64), np.minimum(common[i], common[j]) > LONGEST_GROUPED, sh, n)
            if n > small or 100 * n >= percent * (small + 1):
                entry(tokens[:p], np.arange(min(p, n)), common[:p] > LONGEST_GROUPED, sh, n)
            if size > 500_000:
                yield from flush()
                if len(seen) > 100_000:
                    seen.clear()
        yield from flush()

    def meet(part: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in part[name].to_pylist()])
        key, place, each = read("keys", "<u8"), read("place", "<u4").astype(np.int64), read("owner", "<u4")
        # Sets by number; S16 leaves out zeros at the end, which all have the same length here and so tells no fewer apart.
        ids, sh = np.unique(read("sh", "S16"), return_inverse=True)
        sh, n = np.repeat(sh, each), np.repeat(read("n", "<u4").astype(np.int64), each)
        # Only keys that occur again matter; then the same set's entries from several tasks count once.
        order = np.argsort(key, kind="stable")
        starts, lengths = _runs(key[order])
        order = order[np.repeat(lengths > 1, lengths)]
        order = order[np.lexsort((sh[order], key[order]))]
        key, place, sh, n = key[order], place[order], sh[order], n[order]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (sh[1:] != sh[:-1])]) if len(key) else np.empty(0, bool)
        key, place, sh, n = key[first], place[first], sh[first], n[first]
        starts, lengths = _runs(key)
        found: list[tuple[np.ndarray, ...]] = []

        def compact() -> tuple[np.ndarray, ...]:
            a, b, na, nb, pa_, pb, shared = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 7))
            order = np.lexsort((b, a))
            a, b, na, nb, pa_, pb, shared = (x[order] for x in (a, b, na, nb, pa_, pb, shared))
            at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
            if not len(at):
                return a, b, na, nb, pa_, pb, shared
            return a[at], b[at], na[at], nb[at], np.minimum.reduceat(pa_, at), np.minimum.reduceat(pb, at), np.add.reduceat(shared, at)

        for c in range(2, LONG_LIST + 1):
            at = starts[lengths == c]
            if len(at):
                i, j = np.triu_indices(c, 1)
                for some in np.array_split(at, max(1, len(at) * len(i) // 500_000)):
                    a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                    na, nb = n[a], n[b]
                    fit = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                    a, b = a[fit], b[fit]
                    # A shingle's pair has a large set; a subset's pair has none.
                    is_subset = np.maximum(n[a], n[b]) <= small
                    found.append((sh[a], sh[b], n[a], n[b], place[a], place[b], np.where(is_subset, 1 << 40, 1)))
                    if sum(len(x[0]) for x in found) > 1_000_000:
                        found[:] = [compact()]
        a, b, na, nb, pa_, pb, shared = compact()
        long = np.repeat(lengths > LONG_LIST, lengths)
        k, m = len(a), int(long.sum())
        null = pa.nulls(m, pa.int64())
        both = lambda x, y: pa.array(np.concatenate([x, y]), pa.int64())
        tail = lambda x: pa.concat_arrays([pa.array(x, pa.int64()), null])
        named_set = lambda x: _binary(ids[x].tobytes())
        return pa.table(
            [pa.array(np.repeat([0, 1], [k, m]), pa.int32()), pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(key[long].view(np.int64), pa.int64())]), named_set(np.concatenate([a, sh[long]])), both(na, n[long]), both(pa_, place[long]), pa.concat_arrays([named_set(b), pa.nulls(m, pa.binary())]), tail(nb), tail(pb), tail(shared)],
            names=["kind", "key", "a", "na", "pa", "b", "nb", "pb", "shared"],
        )

    @freed
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row in x.to_pylist():
                key, place, each = np.frombuffer(row["keys"], "<u8"), np.frombuffer(row["place"], "<u4"), np.frombuffer(row["owner"], "<u4")
                sh, n = np.repeat(np.frombuffer(row["sh"], "V16"), each), np.repeat(np.frombuffer(row["n"], "<u4"), each)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64), pa.int64()), _binary(sh.tobytes()), pa.array(n, pa.int64()), pa.array(place, pa.int64())], names=["key", "a", "na", "pa"])

    sent_rows = stored(docs.mapInArrow(run, sent))
    grouped = stored(sent_rows.where("part >= 0").repartition(parts, "part").groupBy("part").applyInArrow(meet, pair))
    # A set's entries come from each task that read it.
    wide = stored(sent_rows.where("part < 0").mapInArrow(spread, "key long, a binary, na long, pa long").dropDuplicates(["key", "a"]))
    return grouped, grouped.where("kind = 1").select("key", "a", "na", "pa").unionByName(wide), [sent_rows, wide]


def _needed(na: str, nb: str, percent: int):
    return F.ceil(F.lit(percent) * (F.col(na) + F.col(nb)) / F.lit(100 + percent))


def _may_link(percent: int, small: int):
    """Size and position allow a link: what comes before the first common shingle is not common."""
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return fits & ((F.greatest("na", "nb") <= small) | (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _needed("na", "nb", percent)))


def _across(entries: DataFrame, labels: DataFrame, percent: int, small: int) -> DataFrame:
    """Pairs of sets of different components in the long lists.

    A list whose sets are all in one component gives none. Else sets outside the list's largest component
    meet all sets of the list that are not of their own component, within a factor of 4/3 in size.
    """
    known = entries.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    # A little is added so that sizes at a step's very edge do not fall below it by rounding.
    step = F.floor(F.log(F.col("na").cast("double")) / F.lit(float(np.log(100 / percent))) + F.lit(1e-9)) if percent < 100 else F.lit(0)
    known = stored(known.withColumn("step", step.cast("long")))
    groups = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = groups.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("size").alias("rows")).where("roots > 1")
    largest = stored(largest.select("key", "main", F.ceil(F.col("rows") / F.lit(SALT_ROWS)).alias("salts")))
    known = known.join(few(largest, SENT_LISTS), "key")
    # A long list is dealt to several tasks by its sets; each meets all that lie outside the largest component.
    near = F.explode(F.array(*(F.col("step") + i for i in (-1, 0, 1)))).alias("step")
    outside = known.where("root <> main").select("key", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("pa").alias("pb"), F.col("root").alias("root_b"), "salts", near)
    outside = outside.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    dealt = known.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts"))).drop("salts")
    met = dealt.join(outside, ["key", "step", "salt"]).where((F.col("root") != F.col("root_b")) & ((F.col("root") == F.col("main")) | (F.col("a") < F.col("b"))) & _may_link(percent, small))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link, by exact intersection (stored)."""
    with_a = pairs.join(sets.select(F.col("sh").alias("a"), F.col("tokens").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("sh").alias("b"), F.col("tokens").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    linked = with_b.where(100 * both >= percent * (F.size("x") + F.size("y") - both))
    return stored(linked.select("a", "b"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs, plus n_same: rows with the same set.

    A text's set holds its distinct shingles of `width` words (A-Z lower-cased, words between ASCII white space; with fewer words, the whole
    sequence as one). Two rows link when 100 * intersection >= percent * union. component_id is the smallest id
    that links reach, the row's own included. Null and empty texts and those without words have no shingles and
    link with nothing. Ties and repeated rows share a component; a null id counts only where a component has no other.
    An empty table gives no rows; columns besides id and text are left out.

    Size-aware heavy-light join, exact at any size. Equal sets fall together first. Shingles are ordered by hash, the most frequent
    ones last. Sets up to a size chosen by cost() meet by common 2-subsets of their first shingles; larger ones scan
    the inverted lists of theirs. Pairs must agree in size, in the place of the first common shingle and in the
    number of common first shingles; what is left is verified on whole sets. In lists of over LONG_LIST sets every set is first held against one leader;
    once components are known, only sets of different components meet (see _across), so a group of near copies
    costs as many comparisons as it has members. Entries of very long lists are never gathered in one task, and a list is dealt to
    many tasks where its sets meet. Sets are told apart by 128 bits. Texts of any length are read whole, copies once.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent: 1 to 100")
    spark = docs.sparkSession
    work = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    size = work.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)))
    counted = _counted(work, parts, width)
    owned = counted.where("sh IS NOT NULL")
    classes = stored(owned.where("n > 0").groupBy("sh", "n").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_same")))

    top = counted.where("key IS NOT NULL").orderBy(F.desc("df"), "key").limit(HOT_SHINGLES).select("key", "df").toArrow()
    keys, df = top["key"].to_numpy().view(np.uint64), top["df"].to_numpy()
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[order], df[order]))
    sums = counted.where("square IS NOT NULL").agg(F.sum("df"), F.sum("square")).first()
    partners = (sums[1] / sums[0] - 1) if sums and sums[0] else 0.0
    sizes = dict(map(tuple, classes.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count(F.lit(1))).collect()))
    # Below, sets may link by one shingle alone, which 2-subsets do not show: then all but single shingles count as large.
    small = boundary(sizes, partners, percent) if percent >= SUBSETS_FROM else 1

    listed, entries, spare = _listed(work, hot, parts, small, width, percent)
    hot.destroy()
    in_long = entries.groupBy("a").agg(F.count(F.lit(1)).alias("h"))
    pairs = listed.where("kind = 0").groupBy("a", "b", "na", "nb").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.sum("shared").alias("shared"))
    pairs = pairs.where(_may_link(percent, small))
    pairs = pairs.join(in_long.withColumnRenamed("h", "ha"), "a", "left").join(in_long.select(F.col("a").alias("b"), F.col("h").alias("hb")), "b", "left")
    # A set's last shingles, beyond its prefix, are so many that they alone leave this many to be common in the prefixes.
    past = lambda n: F.ceil(F.lit(percent) * F.col(n) / F.lit(100)) - 1
    enough = F.col("shared") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= _needed("na", "nb", percent) - F.greatest(past("na"), past("nb"))
    pairs = pairs.where(enough).select("a", "b")
    leaders = stored(entries.groupBy("key").agg(F.min(F.struct("pa", "a", "na")).alias("leader")))
    stars = entries.join(few(leaders, SENT_LISTS), "key").select("a", "na", "pa", F.col("leader.a").alias("b"), F.col("leader.na").alias("nb"), F.col("leader.pa").alias("pb"))
    stars = stars.where((F.col("a") != F.col("b")) & _may_link(percent, small)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(pairs.unionByName(stars).distinct())

    wanted = pairs.select(F.col("a").alias("sh")).unionByName(pairs.select(F.col("b").alias("sh"))).unionByName(entries.select(F.col("a").alias("sh"))).distinct()
    ids = stored(classes.join(wanted, "sh", "left_semi").select(F.col("least").alias("_wanted")).distinct())
    sets = stored(work.join(few(ids, SENT_IDS), F.col("_id").eqNullSafe(F.col("_wanted")), "left_semi").mapInArrow(_sets(width), "sh binary, tokens array<long>"))

    links = _links(pairs, sets, percent)
    labels = components(links)
    more = _links(_across(entries, labels, percent, small), sets, percent)
    labels = stored(components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    drop(listed, *spare, leaders, pairs, ids, sets, links, more)

    linked = classes.join(labels.withColumnRenamed("node", "sh"), "sh").select("sh", "n", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    groups = stored(linked.join(least, "root").select("sh", "n", "component"))
    named_classes = stored(classes.join(groups, ["sh", "n"], "left").select("sh", "n", "n_same", F.coalesce("component", "least").alias("component")))
    drop(classes, labels, groups)
    done = owned.select("id", "n", "sh").join(named_classes, ["sh", "n"], "left")
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"), F.coalesce("n_same", F.lit(1)).cast("long").alias("n_same"))


def _sets(width: int):
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[bytes] = []
        tokens: list[np.ndarray] = []
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))], names=["sh", "tokens"])

        for _, _, x in _texts(batches, width):
            if len(x) and (sh := set_id(x)) not in seen:
                seen.add(sh)
                ids.append(sh)
                tokens.append(x)
                if sum(map(len, tokens)) > 500_000 or len(ids) >= 1000:
                    yield flush()
                    ids, tokens = [], []
        if ids:
            yield flush()

    return run


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir).select("doc_id", "text"))
