"""Ties, repeats, clashing names and very long texts, each with its defined result; the hash tree against a plain walk."""

import random
import time
from collections import Counter, defaultdict
from math import log

import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from orrery.llm import chats, fingerprints, jaccard, licenses, lines, packing, pii, quality, shards


def draw(weight, key, name, turn=None):
    h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(name.encode(), h)
    if turn is not None:
        h = xxhash.xxh64_intdigest(turn.to_bytes(4, "little", signed=True), h)
    return -log(((h >> 11) + 0.5) / (1 << 53)) / weight


def walked(key, tree, tries=shards.TRIES):
    """The shard by walking down one child at a time."""
    for turn in range(tries):
        below = tree
        for level in ("region", "rack", "shard"):
            groups = defaultdict(list)
            for x in below:
                groups[getattr(x, level)].append(x)
            below = groups[min((draw(sum(max(x.room, x.weight) for x in g), key, f"/{level}/{n}", turn), n) for n, g in groups.items())[1]]
        (x,) = below
        if x.weight > 0 and (x.weight >= x.room or 1 - 2.718281828459045 ** -draw(1.0, key, f"/take/{x.shard}", turn) < x.weight / x.room):
            return x.shard
    return min((draw(x.weight, key, f"/flat/{x.shard}"), x.shard) for x in tree if x.weight > 0)[1]


def test_the_tree_is_walked_level_by_level(spark):
    tree, _ = shards.same_room(shards.even_tree(16), shards.even_tree(17), shards.even_tree(32))
    odd = [shards.Leaf(0, 0, 0, 0.5, 2.0), shards.Leaf(0, 0, 1, 2.0, 2.0), shards.Leaf(0, 1, 2, 1.0, 4.0), shards.Leaf(1, 2, 3, 3.0, 3.0)]
    for t in (tree, odd):
        found = spark.range(600).select("id", shards.choose(F.col("id"), t).alias("s")).collect()
        assert [(r.id, r.s) for r in found] == [(r.id, walked(r.id, t)) for r in found]
    # Not a flat draw: in the flat one, every leaf draws for itself.
    flat = [min((draw(x.weight, k, f"/flat/{x.shard}"), x.shard) for x in tree if x.weight)[1] for k in range(600)]
    assert sum(a != walked(k, tree) for k, a in enumerate(flat)) > 400


def test_a_change_in_one_rack_moves_nothing_between_others(spark):
    odd = [shards.Leaf(r // 2, r, 4 * r + k, 1.0, 2.0) for r in range(4) for k in range(4)]
    changed = [shards.Leaf(x.region, x.rack, x.shard, {4: 2.0, 5: 0.0}.get(x.shard, x.weight), x.room) for x in odd]
    rows = spark.range(4000).select(shards.choose(F.col("id"), odd).alias("a"), shards.choose(F.col("id"), changed).alias("b")).collect()
    moved = Counter((r.a, r.b) for r in rows if r.a != r.b)
    assert moved and all(4 == b or 5 == a for a, b in moved)
    sizes = Counter(r.a for r in rows)
    assert max(sizes.values()) < 1.5 * min(sizes.values())


def test_windows_of_large_pieces_are_found_fast():
    for sizes in ([2100] * 1024, [2000] * 1024, [1300] * 1024):
        began = time.time()
        found = packing.differenced(sizes, 4096)
        assert time.time() - began < 5 and sorted(i for w in found for i in w) == list(range(1024))
        assert len(found) == packing.fewest_windows(sizes, 4096) and max(sum(sizes[i] for i in w) for w in found) <= 4096


def test_repeated_rows_are_packed_in_many_blocks(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 300, "doc_id long, text string")
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), docs_per_block=20).collect()
    assert len(rows) == 300 and len({(r.sequence_id, r.offset) for r in rows}) == 300
    assert len({r.sequence_id >> 32 for r in rows}) > 8


def test_line_dedup_takes_any_names_and_rows_of_one_id(spark):
    line = "x" * 50
    rows = [(k, line, 1, "d", None, 2) for k in range(4)] + [(None, line, 1, "d", None, 2), (None, line + "\nb", 1, "d", None, 2), (9, line, 1, "d", None, 2), (9, line, 1, "d", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _drops string, `a``b` int, _salt int")
    found = lines.drop_common_lines(docs).collect()
    assert Counter((r.doc_id, r.kept_text) for r in found) == Counter({**{(k, ""): 1 for k in range(4)}, (None, ""): 1, (None, "b"): 1, (9, line): 2})
    assert all((r["_id"], r["_drops"], r["a`b"], r["_salt"]) == (1, "d", None, 2) for r in found)


def test_ties_come_in_one_order_whatever_the_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(3), rng.choice(["user", "assistant"]), f"text {rng.randrange(40)}") for _ in range(300)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    old, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = chats.format_chats(docs, rows_per_piece=11).collect()
            by_conv = defaultdict(list)
            for r in got:
                by_conv[r.conv_id].append(r)
            for own in by_conv.values():
                own.sort(key=lambda r: r.position)
                assert [r.position for r in own] == list(range(len(own)))
            found.append({c: (sum(r.cost for r in own), [(r.turn, r.role_in, r.rendered.split("text ")[1].split("<")[0].strip()) for r in own]) for c, own in by_conv.items()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0] == found[1]


def test_the_rest_of_a_text_is_judged(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice(["th", "an", "er", "on", "re", "ti", "in"]) for _ in range(rng.randrange(1, 4))) for _ in range(900)).encode()[:2048].decode()
    check = quality._checker()
    assert check(prose.encode())[2] == 0 and check((prose + "ab " * 150).encode())[2] == 450 / 2498
    assert check(("ab " * 150).encode())[2] == 1


def test_links_below_the_subsets_threshold(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w := t.split()) >= 5 else frozenset([tuple(w)]) for t in texts]
    for percent in (30, 50, 100):
        root = list(range(len(sets)))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if 100 * len(a & b) >= percent * len(a | b):
                        root[i] = root[j] = min(root[i], root[j])
        found = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs, percent=percent).collect()}
        assert found == dict(enumerate(root)), percent


def test_very_long_texts_and_an_empty_table(spark):
    word = " ".join(f"w{k % 5000}" for k in range(120_000))
    docs = spark.createDataFrame([(1, word), (2, word + " more"), (3, "short")], "doc_id long, text string")
    for work in (lambda x: quality.judge(x), lambda x: pii.find_personal_data(x), lambda x: licenses.scan_licenses(x), lambda x: lines.drop_common_lines(x), lambda x: fingerprints.with_fingerprints(x), lambda x: shards.assign_shards(x), lambda x: jaccard.jaccard_groups(x)):
        assert work(docs).count() == 3 and work(docs.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", word), (1, 1, "assistant", word)], "conv_id long, turn long, role string, text string")
    assert sum(len(r.rendered) for r in chats.format_chats(turns).collect()) > 2 * len(word)


def test_secrets_and_linear_time():
    assert [s for s in pii.secrets('x token = "24be64439e3e49cf46b2d7c9" y')] == [(11, 35)]
    assert pii.secrets("the token: is a word, password = short1") == []
    began = time.time()
    for text in ("a dot " * 20000, "a at " * 20000, "x at a" + " dot a" * 20000, "token_" * 20000):
        pii.deobfuscated(text, pii.detect(text))
        pii.secrets(text)
    assert time.time() - began < 20
