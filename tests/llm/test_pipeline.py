import random
from collections import defaultdict

import corpus_pipeline
from test_jaccard import brute
from test_packing import check

from orrery.llm import pii, quality


def plain(rows):
    """doc_id -> text after all stages but the last, by plain loops."""
    verdict = quality._checker()
    rows = {i: t for i, t in rows.items() if not quality.base_counts(t)[5] and verdict((t or "").encode())[0]}
    holders = defaultdict(set)
    key = lambda line: line.encode().strip(b" \t\n\r\x0b\x0c").lower().decode()
    for i, t in rows.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    rows = {i: "\n".join(x for x in (t or "").split("\n") if len(holders.get(key(x), ())) < 5 or i == max(holders[key(x)])) for i, t in rows.items()}
    groups = brute(list(rows.items()))
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    out = {}
    for i, t in rows.items():
        base = pii.detect(t)
        spans = sorted(base + pii.deobfuscated(t, base))
        hidden = pii.secrets(t)
        out[i] = pii.redacted(t, spans, hidden)
    return out


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = plain(dict(map(tuple, docs.select("doc_id", "text").collect())))
    assert 0 < len(texts) < docs.count()
    check(corpus_pipeline.run(spark, sf_dir).collect(), texts)


def test_stages_keep_the_columns_and_survive_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf_dir)
            if name != "packing":
                assert out.schema.simpleString() == docs.schema.simpleString()
                assert out.count() <= table.count()
            else:
                out.count()


def test_stages_take_nulls_repeats_and_any_names(spark, sf_dir):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    a, b = " ".join(word() for _ in range(300)), " ".join(word() for _ in range(300))
    schema = "doc_id long, text string, n_chars long, kept string, _row int, `a``b` int, _id int, spans string"
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, None), (5, ""), (None, a), (None, a + " x" * 5), (6, "z " * 90000), (7, a), (7, a)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "k", 1, 2, 3, "s") for i, t in rows], schema)
    near = corpus_pipeline.without_near_copies(spark, docs, sf_dir)
    assert near.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in near.collect()) == sorted([(1, len(a)), (2, len(b)), (4, 0), (5, 0), (6, 180000)])
    judged = corpus_pipeline.judged(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r["a`b"], r.kept) for r in judged) == sorted((i or 0, 2, "k") for i, t in rows if t and "z " not in t)
    for stage in (corpus_pipeline.without_common_lines, corpus_pipeline.redacted):
        found = stage(spark, docs, sf_dir)
        left = lambda i, t: "" if stage is corpus_pipeline.without_common_lines and t == a and i != 7 else t or ""  # noqa: E731, B023
        assert found.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in found.collect()) == sorted((i or 0, left(i, t)) for i, t in rows)
    check = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert len({(r.sequence_id, r.offset) for r in check}) == len(check) and sum(r.start == 0 for r in check) == len(rows)
