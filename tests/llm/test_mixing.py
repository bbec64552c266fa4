from collections import Counter
from fractions import Fraction

import oracle
import pytest

from orrery.llm import mixing


def plain_targets(sizes, weights, share, most):
    """Targets by giving out the rest by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = Fraction(share * sum(sizes.values()), 100), set(order), {}
    while open_:
        v = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if v * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: v * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def checked(df, docs, weights=(3, 1, 2), share=150, most=2):
    rows = mixing.mix_sources(df, weights, share, most).collect()
    size = lambda t: len((t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("")
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, size(t)) for i, t, _ in docs)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += size(t)
    want = plain_targets(sizes, weights, share, most)
    source = {(i, size(t)): s for i, t, s in docs}
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(float(want[s]))
        assert 0 <= r["taken"] <= most * r["size"]
        taken[s] += r["taken"]
    assert sum(taken.values()) == min(share * sum(sizes.values()) // 100, most * sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= len(sizes)
    return sorted(map(tuple, rows), key=repr)


DOCS = [(i, " ".join(["w"] * (i * 7 % 40)), f"s{i % 5}" if i % 7 else None) for i in range(300)] + [(None, "a b", "s1"), (None, None, None), (1000, "", "empty"), (1001, "x " * 9000, "long"), (1002, "one", "é"), (1003, "one two\x0bthree", "Z")]


@pytest.mark.parametrize(("weights", "share", "most"), [((3, 1, 2), 150, 2), ((1,), 50, 1), ((5, 4), 290, 3), ((2, 1), 300, 2)])
def test_targets_and_taken_words(spark, weights, share, most):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    assert checked(df.repartition(5), DOCS, weights, share, most) == checked(df.repartition(2), DOCS, weights, share, most)


def test_same_as_the_sql(spark, sf_dir):
    oracle.same(spark, mixing.op12_mixing, mixing.OP12_SQL, sf_dir)


def test_a_third_of_the_rows_equal(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_PER_ROW", 16)
    docs = [(5, "a b c", "s0")] * 200 + [(i, "x y", f"s{i % 3}") for i in range(100, 500)]
    checked(spark.createDataFrame(docs, "doc_id long, text string, source string"), docs)


def test_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty).collect() == []
    none = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix_sources(none).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    df = spark.createDataFrame([("a", "x y", "s", 1, 2)], "doc_id string, text string, source string, `size` int, `rank` int")
    assert [tuple(r) for r in mixing.mix_sources(df).collect()] == [("a", 2, 2, 3.0, 3)]


def test_the_mix_is_in_the_order_of_finish_times(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    rows = sorted(mixing.schedule(df).where("taken > 0").collect(), key=lambda r: r["place"])
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
    at = 0
    for r in rows:
        assert r["place"] == at
        at += r["taken"]
