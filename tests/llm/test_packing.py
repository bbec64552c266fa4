from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from orrery.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "   \n", "Hello, world!", "don't we'll I'm", "ÀÉÎ straße İstanbul ΣΑΣ", "<|endoftext|> a<|startoftext|>b", "x" * 3000, "12 3.14 a1b2 ²½",
    "é ́a  nbsp em\u0085x", "word " * 9000, "日本語 emoji 😀 ok", "naïve-co_op (a) [b] \"q\" 'tis",
]


TOKENIZER = Tokenizer.from_file(PATH)


def want(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, texts, window=4096):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = want(texts[doc]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return by_sequence


def test_pieces_cover_every_id(spark):
    texts = dict(enumerate(TEXTS))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(packing.pack(docs, PATH).collect(), texts)


def test_whole_table_and_padding(spark, sf_dir):
    rows = packing.op2_packing(spark, sf_dir).collect()
    texts = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    sequences = check(rows, texts)
    used = sum(r.length for r in rows)
    assert len(sequences) * 4096 < 1.03 * used + 2 * 4096


def test_empty_table_repeats_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, block int")
    assert packing.pack(empty, PATH).collect() == []
    rows = packing.pack(spark.createDataFrame([(1, "a b", 5)] * 3 + [(None, "c", 1)], "doc_id long, text string, sequence_id int"), PATH).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 3)] * 3 + [(True, 2)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_differencing_is_near_equal_and_rises_above_capacity():
    got = packing.differenced([8, 7, 6, 5, 4], 16)  # differencing ends with 16 and 14
    assert sorted(i for w in got for i in w) == list(range(5)) and len(got) == 2
    got = packing.differenced([60, 60, 60], 100)  # two windows would hold 180, but no two fit together
    assert len(got) == 3
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 4000, 500).tolist()
    got = packing.differenced(sizes, 4096)
    assert sorted(i for w in got for i in w) == list(range(500))
    assert max(sum(sizes[i] for i in w) for w in got) <= 4096
    assert len(got) <= -(-sum(sizes) // 4096) + 25
