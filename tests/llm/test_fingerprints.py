import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from orrery.llm import fingerprints


def edited(rows):
    """id -> (edited text, id of the next)."""
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        n, (j, after) = len(t or ""), rows[(k + 1) % len(rows)]
        cut = n // 4
        out[i] = ((t or "")[: n - cut] + (after or "")[:cut], j)
    return out


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, texts = edited(rows), dict(rows)
    found = {r.doc_id: r for r in fingerprints.op5_fingerprints(spark, sf_dir).collect()}
    assert set(found) == set(texts)
    by_text, errors = {}, []
    for i, r in found.items():
        text = want[i][0]
        assert r.n_chars == len(texts[i] or "") and r.edited_sha256 == sha256(text.encode()).hexdigest()
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint
        a, b = shingles(texts[i] or ""), shingles(text)
        errors.append(abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)))
        assert 0 <= r.near_next <= 1
        if texts[i] != texts[want[i][1]] and not a & shingles(texts[want[i][1]] or ""):
            assert r.near_next < 0.15
    assert sum(errors) / len(errors) < 0.04 and max(errors) < 0.25


def test_estimate_follows_the_resemblance(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        n = rng.choice([6, 30, 300, 3000])
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = a[: n - n * k // 60] + [f"x{rng.randrange(10**6)}" for _ in range(n * k // 60)]
        rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("near")).collect()
    errors = [r.near - len(shingles(r.a) & shingles(r.b)) / len(shingles(r.a) | shingles(r.b)) for r in got]
    assert abs(sum(errors) / len(errors)) < 0.02 and sum(map(abs, errors)) / len(errors) < 0.06


def test_densified_bins_are_copies_of_filled_ones_and_hardly_collide(spark):
    rows = [(f"a{k} b c d e f g",) for k in range(40)]
    bins = [r[0] for r in spark.createDataFrame(rows, "t string").select(fingerprints.fingerprint(F.col("t"))).collect()]
    assert all(len(b) == 128 and len(set(b)) <= 3 and None not in b for b in bins)


@pytest.mark.parametrize(("ranges", "most"), [("1", 500), ("5", 500), ("9", 2)])
def test_order_over_ranges_nulls_and_ties(spark, monkeypatch, ranges, most):
    monkeypatch.setattr(fingerprints, "MOST_BOUNDS", most)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        rng = random.Random(2)
        rows = [(i, None if i % 13 == 0 else "" if i % 17 == 0 else " ".join(f"ü{rng.randrange(99)}" for _ in range(rng.randrange(40)))) for i in rng.sample(range(10**6), 200)]
        docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, range int")
        want = edited(rows)
        found = {r.doc_id: r for r in fingerprints.with_fingerprints(docs).collect()}
        assert {i: r.edited_sha256 for i, r in found.items()} == {i: sha256(t.encode()).hexdigest() for i, (t, _) in want.items()}
        with_null = spark.createDataFrame([(None, "abcd"), (None, "zz zz"), (1, "a b c d e f g h"), (1, "b")], "doc_id long, text string")
        got = sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in fingerprints.with_fingerprints(with_null).collect())
        hashed = lambda t: sha256(t.encode()).hexdigest()
        assert got == sorted([(0, 4, hashed("abcz")), (0, 5, hashed("zz za")), (1, 15, hashed("a b c d e f b")), (1, 1, hashed("b"))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_empty_table_and_one_row(spark):
    schema = "doc_id long, text string"
    assert fingerprints.with_fingerprints(spark.createDataFrame([], schema)).collect() == []
    (r,) = fingerprints.with_fingerprints(spark.createDataFrame([(3, None)], schema)).collect()
    assert (r.doc_id, r.n_chars, r.fingerprint, r.near_edited, r.near_next) == (3, 0, "", 1.0, 1.0)
