import re
from collections import Counter, defaultdict

import oracle
import pytest

from orrery.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, longest, absorb, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in own.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        rows = []
        for p, a in own.items():
            if 100 * inside[p] >= absorb * a:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -score) for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


DOCS = [
    ("en", "The Cat sat.  The cat\tsat; the cat ran! On the mat"), ("en", "the cat sat, the the the the the"), (None, "the cat. the cat"), ("und", "The cat"), ("en", None), ("en", ""), ("en", " .,; \n"),
    ("fr", "où est le chat\nOù est le chat"), ("fr", "où est le chat"), ("de", "ÄPFEL und Äpfel und Äpfel"), ("en", "one two three four five six " * 4), ("en", "On the mat"), ("", "a b a b"), ("x\0", "a b a b"),
]


@pytest.mark.parametrize(("least", "longest", "absorb", "top"), [(2, 5, 100, 2000), (2, 3, 50, 4), (3, 2, 100, 2000), (1, 5, 100, 7)])
def test_as_counted_plainly(spark, monkeypatch, least, longest, absorb, top):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 40)
    df = spark.createDataFrame(DOCS * 2, "lang string, text string").repartition(3)
    assert rows_of(phrases.collocations(df, least, longest, absorb, top)) == plain(DOCS * 2, least, longest, absorb, top)


def test_same_as_the_sql(spark, sf_dir):
    oracle.same(spark, phrases.op11_collocations, phrases.OP11_SQL, sf_dir)


def test_empty_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert rows_of(phrases.collocations(empty)) == []
    df = spark.createDataFrame([("en", "a b. a b. a b", 1, 2)], "lang string, text string, `n` int, `block` int")
    assert rows_of(phrases.collocations(df, 2)) == [("en", 1, "a b", 3, 3, 3, 6, 2000)]


def test_one_passage_in_many_documents_and_a_long_text(spark):
    docs = [("en", "same old words here")] * 3000 + [("en", " ".join(f"w{i % 977}" for i in range(200_000)))]
    df = spark.createDataFrame(docs, "lang string, text string")
    assert rows_of(phrases.collocations(df, 100)) == plain(docs, 100, 5, 100, 2000)


def test_products_beyond_64_bits(spark):
    big = 90_000_000_000_000_000
    found = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big + 7)], "lang string, phrase string, words int, f long")
    row = phrases.scored(found, spark.createDataFrame([("en", big + 9)], "lang string, n long")).first()
    assert row["score"] == 1000 * big * (big + 9) // (big * (big + 7))
