from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from orrery.llm import byte_pairs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.ranks(PATH), special_tokens={})
TEXTS = [
    None, "", " ", "\n\n  a  b\t c ", "Hello world, it's 12,345.67!", "  don't  we'll\n", "naïve Ünïcødé ñandú", "日本語のテキスト 中文", "😀👩‍👩‍👧 é", "\x00\x1c\x85 　x\xa0y",
    "x" * 700, "ab" * 300, "<|endoftext|>", "a  b", "'s 't 'LL", "!!!??? ...---===", "word " * 500, "0123456789" * 30, "\r\n\r\n",
]


def want(text):
    return ENCODING.encode_ordinary(text or "")


@pytest.mark.parametrize("sent", [0, 12, 10**6])
def test_ids_are_those_of_the_library_and_decode_to_the_text(spark, monkeypatch, sent):
    monkeypatch.setattr(byte_pairs, "MOST_SENT", sent)
    monkeypatch.setattr(byte_pairs, "BLOCK_BYTES", 300)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, "twice"), (100, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    found = byte_pairs.decode(byte_pairs.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == want(r.text), r.text
        assert bytes(r.decoded).decode() == (r.text or "")


def test_whole_table(spark, sf_dir):
    texts = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    found = byte_pairs.op7_byte_bpe(spark, sf_dir).collect()
    assert {r.doc_id for r in found} == set(texts)
    for r in found:
        ids = want(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((texts[r.doc_id] or "").encode()).hexdigest())


def test_empty_table_and_clashing_columns(spark):
    schema = "ids string, rows int, text string, `a.b` int, words array<string>"
    assert byte_pairs.encode(spark.createDataFrame([], schema), PATH, public_tokenizers.PATTERN).collect() == []
    row = byte_pairs.encode(spark.createDataFrame([("x", None, "a b", 3, ["q"])], schema), PATH, public_tokenizers.PATTERN).first()
    assert (row["rows"], row["a.b"], row["words"], row["ids"]) == (None, 3, ["q"], want("a b"))
    only = byte_pairs.encode(spark.createDataFrame([("a",)], "text string"), PATH, public_tokenizers.PATTERN).first()
    assert (only.text, only.ids) == ("a", want("a"))


def test_classes_find_the_same_pre_tokens_as_the_pattern():
    import random

    import pyarrow as pa
    import regex

    rng = random.Random(8)
    texts = ["".join(rng.choice("ab1é²½ .,\n\t\x85\xa0'sß\x1c漢") for _ in range(rng.randrange(30))) for _ in range(3000)]
    words, numbers, sizes = byte_pairs.numbered(pa.array(texts), public_tokenizers.PATTERN)
    flat, at = [words[int(n)].as_py() for n in numbers], 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        assert flat[at : at + n] == regex.findall(public_tokenizers.PATTERN, text)
        at += n
