import random
import re

import pytest

from orrery.llm import graphs, jaccard


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    done = set()
    for at in holders.values():
        for i in at:
            for j in at:
                if i < j and (i, j) not in done:
                    done.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    if 100 * len(a & b) >= 75 * len(a | b):
                        root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, **more).collect()}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    result = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op1_jaccard(spark, sf_dir).collect()}
    assert result == brute(rows)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return words


def hard_rows():
    """Near copies in large groups and chains, short texts, passages and whole pages that many texts share."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(3000)}"
    texts = [None, "", "  \n ", "a", "A", "a b", "a b c d", "A b\tc D", "a b c d e", "a b c d e f", "a b c d e f g"]
    for size, copies in ((300, 120), (40, 90), (9, 80), (1200, 4)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            texts.append(" ".join(edited(base, rng.randrange(1 + size // 24), rng)))
    now = [word() for _ in range(200)]
    for _ in range(60):  # a chain: the ends have little in common
        now = edited(now, 3, rng)
        texts.append(" ".join(now))
    passage = [word() for _ in range(60)]
    for _ in range(80):
        texts.append(" ".join([*(word() for _ in range(rng.randrange(10, 200))), *passage]))
    for n in range(3, 30):  # at the threshold: b adds shingles to a
        base = [f"t{n}_{k}" for k in range(n + 4)]
        for more in (n // 3, n // 3 + 1):
            texts += [" ".join(base), " ".join(base + [f"x{k}" for k in range(more)])]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_hard_rows(spark):
    rows = hard_rows()
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize(("small", "long"), [(2, 4), (24, 3), (64, 1000)])
def test_any_boundary_and_list_length_give_the_same(spark, monkeypatch, small, long):
    rows = hard_rows()
    monkeypatch.setattr(jaccard, "boundary", lambda *a: small)
    monkeypatch.setattr(jaccard, "LONG_LIST", long)
    assert got(spark, rows) == brute(rows)


def test_without_hot_order(spark, monkeypatch):
    rows = hard_rows()
    monkeypatch.setattr(jaccard, "HOT_SHINGLES", 1)
    monkeypatch.setattr(jaccard, "SENT_IDS", 1)
    assert got(spark, rows) == brute(rows)


def test_boundary_weighs_both_costs():
    assert jaccard.boundary({10: 100}, 0.0) < 10  # nothing else in the lists: scanning is cheaper
    assert jaccard.boundary({10: 100}, 50.0) >= 10  # long lists: subsets are cheaper


def test_empty_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, sh int, part string, component_id string"
    assert jaccard.jaccard_groups(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f", 1, "", ""), (1, "a b c d e f", 1, "", ""), (None, "a b c d e f", 1, "", ""), (None, "z", 1, "", ""), (7, "z z", None, None, None), (4, None, 1, "", "")]
    result = jaccard.jaccard_groups(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0, r.n_same) for r in result) == [
        (False, 1, 2, 1, 3), (False, 1, 2, 1, 3), (False, 4, 0, 4, 1), (False, 7, 1, 7, 1), (True, 0, 1, 0, 1), (True, 0, 2, 1, 3),
    ]


def test_components_of_chain_and_stars(spark):
    rng = random.Random(1)
    ids = list(range(100))
    rng.shuffle(ids)
    pairs = list(zip(ids[:-1], ids[1:], strict=True)) + [(200, 200 + k) for k in range(1, 40)] + [(300, 300), (5, None)]
    found = {r.node: r.root for r in graphs.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(100)}, **{200 + k: 200 for k in range(40)}}
