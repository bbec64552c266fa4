"""Byte-level BPE: encoding by ranked merges that higher-order functions fold, decoding by joining pieces."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.frames import documents, drop, freed, named, others, slices, stored

#: Lists that the rank map is dealt to, so that looking up a pair compares few keys.
BUCKETS = 65521
#: Words of up to so many pieces merge one pair a step; longer ones all pairs of the lowest rank.
SHORT = 32
#: Text of the documents whose distinct words are encoded together.
BLOCK_BYTES = 3 << 20
#: Words that are encoded once for all blocks, of SENT_BYTES at most: at most 12 bytes and two for each byte of the word, about 24 in all.
MOST_SENT, SENT_BYTES = 1_000_000, 64
#: Words whose ids one row carries to the driver.
WORDS_PER_ROW = 50_000


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """The ranks in a tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def pair_ranks(table: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The rank of each pair of ranked pieces whose bytes, joined, have one."""
    found = {}
    for piece, rank in table.items():
        for k in range(1, len(piece)):
            if (a := table.get(piece[:k])) is not None and (b := table.get(piece[k:])) is not None:
                found[a, b] = rank
    return found


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encoded(word: Column, table: dict[bytes, int]) -> Column:
    """array<int>: the ids of one pre-token, given as array<int> of its bytes.

    Each step of the fold looks up the ranks of all neighbouring pieces and merges the pair of the lowest, the leftmost first; it ends
    when no pair has a rank. A merged piece's id is its rank. The rank map is a literal: pairs and ranks in short lists
    among which the pair's number picks one.
    """
    keys: list[list[int]] = [[] for _ in range(BUCKETS)]
    values: list[list[int]] = [[] for _ in range(BUCKETS)]
    for (a, b), rank in pair_ranks(table).items():
        key = (a << 32) + b
        keys[key % BUCKETS].append(key)
        values[key % BUCKETS].append(rank)
    keys_of, values_of = F.from_json(F.lit(json.dumps(keys)), "array<array<bigint>>"), F.from_json(F.lit(json.dumps(values)), "array<array<int>>")
    byte_ids = F.from_json(F.lit(json.dumps([table[bytes([b])] for b in range(256)])), "array<int>")
    none = F.lit(2**31 - 1)

    def rank(a: Column, b: Column) -> Column:
        key = F.shiftleft(a.cast("bigint"), 32) + b
        at = (key % BUCKETS).cast("int")
        return F.coalesce(F.get(F.get(values_of, at), F.array_position(F.get(keys_of, at), key).cast("int") - 1), none)

    def merged(p: Column, r: Column, least: Column) -> Column:
        at = F.array_position(r, least).cast("int")
        first = F.concat(F.slice(p, F.lit(1), at - 1), F.array(least), F.slice(p, at + 2, F.size(p)))

        def every(at: Column) -> Column:
            # Only a piece beside its like can be in two pairs; text replacement takes those from the left.
            two = F.concat(F.lit("<"), F.get(p, at - 1), F.lit("><"), F.get(p, at), F.lit(">"))
            text = F.replace(F.concat(F.lit("<"), F.array_join(p, "><"), F.lit(">")), two, F.concat(F.lit("<"), least, F.lit(">")))
            same = F.split(F.substr(text, F.lit(2), F.length(text) - 2), "><").cast("array<int>")
            apart = F.filter(F.transform(p, lambda x, i: F.when(F.get(r, i) == least, least).when(F.get(r, i - 1) == least, F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
            return F.when(F.get(p, at - 1) == F.get(p, at), same).otherwise(apart)

        return F.when(F.size(p) <= SHORT, first).otherwise(_bound(at, every))

    def step(state: Column) -> Column:
        p = state["p"]
        ranks_of = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), rank)

        def with_ranks(r: Column) -> Column:
            least = F.array_min(r)
            go = F.coalesce(least, none) < none
            return F.when(go, F.struct(merged(p, r, least).alias("p"), F.lit(True).alias("go"))).otherwise(F.struct(p.alias("p"), F.lit(False).alias("go")))

        return F.when(state["go"], _bound(ranks_of, with_ranks)).otherwise(state)

    start = F.struct(F.transform(word, lambda b: F.get(byte_ids, b)).alias("p"), (F.size(word) > 1).alias("go"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(word), F.lit(1))), start, lambda state, _: step(state), lambda state: state["p"])


@lru_cache(1)
def _classes() -> np.ndarray:
    """What each code point below U+0250 is to the pattern: 0 white space, 1 letter, 2 number, 3 anything else."""
    import regex

    kinds = [regex.compile(x).fullmatch for x in (r"\s", r"\p{L}", r"\p{N}")]
    return np.array([next((k for k, is_one in enumerate(kinds) if is_one(chr(c))), 3) for c in range(0x250)], np.uint8)


#: The pattern whose matches can be found by the classes of neighbouring characters, in texts that _SLOW does not match.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Apostrophes, runs of white space and code points from U+0250 on.
_SLOW = r"[\x{250}-\x{10FFFF}']|[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}]{2}"


def _starts(raw: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in UTF-8 bytes of texts that start at `heads`: at each change of class, but not after a space that leads a word."""
    kind = _classes()[:256][raw]
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        kind[lead] = kind[lead + 1] = _classes()[((raw[lead].astype(np.int32) & 0x1F) << 6) | (raw[lead + 1] & 0x3F)]
    start = np.ones(len(raw), bool)
    start[1:] = (kind[1:] != kind[:-1]) & ((raw[:-1] != 0x20) | (kind[1:] == 0))
    start[heads] = True
    return start


def numbered(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pre-tokens, the numbers of all texts' pre-tokens in turn, how many each text has)."""
    import regex

    slow = pc.match_substring_regex(texts, _SLOW) if pattern == KNOWN_PATTERN else pa.array([True] * len(texts), pa.bool_())
    find = regex.compile(pattern).findall
    at = np.flatnonzero(slow.to_numpy(zero_copy_only=False))
    by_hand = [find(texts[int(k)].as_py()) for k in at]
    quick = pc.if_else(slow, "", texts)
    bytes_of = quick.cast(pa.binary())
    lengths = pc.binary_length(bytes_of).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b"".join(bytes_of.to_pylist())
    raw, heads = np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(lengths)])
    starts = np.flatnonzero(_starts(raw, heads[:-1][lengths > 0])) if len(raw) else np.empty(0, np.int64)
    flat = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(data)])
    bounds = np.searchsorted(starts, heads)
    sizes = np.diff(bounds)
    if len(at):
        parts, done = [], 0
        for k, own in zip(at.tolist(), by_hand, strict=True):
            parts += [flat.slice(done, bounds[k] - done), pa.array(own, pa.string())]
            done, sizes[k] = bounds[k], len(own)
        flat = pa.concat_arrays([*parts, flat.slice(done)])
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), sizes


def _bytes_of(words: pa.Array) -> pa.Array:
    """list<int32>: each word's bytes."""
    raw = words.to_pylist()
    raw = [w.encode() for w in raw]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(w) for w in raw])]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)))


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each word: 64 to sort by and 32 more."""
    digests = b"".join(xxhash.xxh3_128_digest(w.encode()) for w in words.to_pylist())
    raw = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].astype(np.uint32)


def frequent_words(docs: DataFrame, path: str, pattern: str, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (in ascending order, and their further bits), bounds and ids of the most frequent pre-tokens of SENT_BYTES at most, at most `most` and each found twice or more.

    Counted over all documents; counts fall into levels of a sixteenth of a doubling, and the level that would exceed the bound is left out with those below.
    """

    @freed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _blocks(batches):
            words, numbers, _ = numbered(texts[0], pattern)
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(numbers, minlength=len(words)), pa.int64())], names=["word", "n"])

    counted = stored(docs.select("_text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= SENT_BYTES)))
    level = F.floor(16 * F.log2(F.col("n").cast("double")))
    least, left = 0, most
    for n, k in counted.groupBy(level.alias("level")).agg(F.count(F.lit(1))).orderBy(F.desc("level")).collect():
        left -= k
        if left < 0:
            least = n + 1
            break
    chosen = counted.where(level >= least)

    raw = F.transform(F.regexp_extract_all(F.hex(F.col("word").cast("binary")), F.lit("(..)")), lambda x: F.conv(x, 16, 10).cast("int"))

    @freed
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, WORDS_PER_ROW):
                some = b.slice(at, WORDS_PER_ROW)
                (h, g), lists = _hashes(some.column(0)), some.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                blobs = (h, g, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("<u1"), ids.astype("<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], names=["h", "g", "n", "ids"])

    # The words stay where they are: their hashes and ids come, some thousand in a row.
    found = chosen.select("word", encoded(raw, ranks(path)).alias("ids")).mapInArrow(pack, "h binary, g binary, n binary, ids binary").toArrow()
    read = lambda name, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in found[name])])
    h, g, n, ids = read("h", "<u8"), read("g", "<u4"), read("n", "<u1").astype(np.int64), read("ids", "<u4")
    del found
    drop(counted)
    ids = ids.astype(np.uint16 if not len(ids) or ids.max() < 65536 else np.int32)
    order = np.argsort(h, kind="stable")
    first, each = (np.cumsum(n) - n)[order], n[order]
    ends = np.cumsum(each)
    ids = ids[np.repeat(first - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
    return h[order], g[order], np.concatenate([[0], ends]).astype(np.int32), ids


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
    """The first column's texts, nulls as empty, in runs of about BLOCK_BYTES, each with the other columns' rows."""
    held: list[list[pa.Array]] = []
    size = 0
    for b in batches:
        at = 0
        for part in slices(b.column(0)):
            held.append([part, *(c.slice(at, len(part)) for c in b.columns[1:])])
            at += len(part)
            size += pc.sum(pc.binary_length(part)).as_py() or 0
            if size >= BLOCK_BYTES:
                first, *rest = (pa.concat_arrays(c) for c in zip(*held, strict=True))
                yield first, rest
                held, size = [], 0
    if held:
        first, *rest = (pa.concat_arrays(c) for c in zip(*held, strict=True))
        yield first, rest


def encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: Sequence[str] | None = None, instead: tuple[Sequence[T.StructField], Callable[[pa.ListArray], list[pa.Array]]] | None = None
) -> DataFrame:
    """docs (or its columns `keep`) with ids (array<int>) appended: the text's ids by the ranks in the file at `path`, pre-tokens by `pattern`.

    Each match of the pattern is encoded separately, without special tokens. Null and empty texts have no ids. Repeated rows and
    extra columns pass through; a column named ids is replaced. An empty table gives no rows. `instead` gives other columns in the place
    of ids: their fields, and a function that makes them from an Arrow array of the ids of some documents.

    Pre-tokens are counted first; the most frequent (MOST_SENT at most) are encoded once and sent to every executor. Then a
    task gathers documents to blocks of BLOCK_BYTES and numbers their distinct words; those that were not sent are
    encoded in the block's own row, by the same fold; and each document's ids are put together from its words'. Only
    words are shuffled, never texts. A word of any length is folded; one of n bytes costs as many steps as it has merges of different ranks,
    each over what is left of it, so a run of letters of a megabyte takes minutes.
    """
    fields, make = instead or ([T.StructField("ids", T.ArrayType(T.IntegerType()))], lambda ids: [ids])
    keep = others(docs, *(f.name for f in fields)) if keep is None else list(keep)
    kept = T.StructType([T.StructField(f"_k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)])
    blocks = T.StructType([T.StructField("rows", T.ArrayType(kept)), *(T.StructField(n, T.BinaryType()) for n in ("sizes", "numbers", "known")), T.StructField("words", T.ArrayType(T.ArrayType(T.IntegerType())))])
    work = docs.select(named(text_col).alias("_text"), *(named(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    found = frequent_words(work, path, pattern, MOST_SENT)
    context = docs.sparkSession.sparkContext
    sent_words, sent_lists = context.broadcast(found[:2]), context.broadcast(found[2:])
    del found

    @freed
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(blocks)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        hashes, more = sent_words.value
        for texts, columns in _blocks(batches):
            words, numbers, sizes = numbered(texts, pattern)
            own, rest_of = _hashes(words)
            at = np.searchsorted(hashes, own)
            known = np.full(len(own), -1, np.int64)
            if len(hashes):
                at[at == len(hashes)] = 0
                known = np.where((hashes[at] == own) & (more[at] == rest_of), at, -1)
            rest = words.filter(pa.array(known < 0))
            rows = pa.StructArray.from_arrays(columns, names=kept.names) if keep else pa.array([{}] * len(texts), pa.struct([]))
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype("<u4"), numbers.astype("<u4"), known.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([one(rows).cast(schema.field(0).type), *blobs, one(_bytes_of(rest)).cast(schema.field(4).type)], schema=schema)

    out = T.StructType([*kept.fields, *fields])

    @freed
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        sent_bounds, sent_ids = sent_lists.value
        for b in batches:
            for k in range(b.num_rows):
                rows, own = b.column(0)[k].values, b.column(4)[k].values
                sizes, numbers, known = (np.frombuffer(b.column(i)[k].as_py(), kind).astype(np.int64) for i, kind in ((1, "<u4"), (2, "<u4"), (3, "<i4")))
                # The block's words' ids in turn: first of those that were sent, then of the others.
                own_bounds = own.offsets.to_numpy().astype(np.int64)
                first, length = np.empty(len(known), np.int64), np.empty(len(known), np.int64)
                is_sent = known >= 0
                begin, size = sent_bounds[known[is_sent]].astype(np.int64), (sent_bounds[known[is_sent] + 1] - sent_bounds[known[is_sent]]).astype(np.int64)
                stop = np.cumsum(size)
                taken = sent_ids[np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
                first[is_sent], length[is_sent] = stop - size, size
                first[~is_sent], length[~is_sent] = own_bounds[:-1] + len(taken), np.diff(own_bounds)
                flat = np.concatenate([taken.astype(np.int32), own.values.to_numpy(zero_copy_only=False)])
                ends = np.cumsum(sizes)
                # Some documents at a time, so that few ids are in memory.
                a = 0
                while a < len(sizes):
                    z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 250_000)))
                    some = numbers[(ends[a - 1] if a else 0) : ends[z - 1]]
                    each = length[some]
                    past = np.cumsum(each)
                    ids = flat[np.repeat(first[some] - (past - each), each) + np.arange(past[-1] if len(past) else 0)]
                    offsets = np.concatenate([[0], past])[np.concatenate([[0], np.cumsum(sizes[a:z])])]
                    made = make(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
                    part = rows.slice(a, z - a)
                    yield pa.RecordBatch.from_arrays([*(part.field(i) for i in range(len(keep))), *(x.cast(f.type) for x, f in zip(made, list(schema)[len(keep) :], strict=True))], schema=schema)
                    a = z

    done = work.mapInArrow(gather, blocks).select("rows", "sizes", "numbers", "known", F.transform("words", lambda w: encoded(w, ranks(path))).alias("ids")).mapInArrow(spread, out)
    return done.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *(f.name for f in fields))


@lru_cache(2)
def pieces_of(path: str) -> list[bytes]:
    """Each id's bytes."""
    table = ranks(path)
    pieces = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        pieces[rank] = piece
    return pieces


def joined(ids: pa.ListArray, pieces: list[bytes]) -> Iterator[bytes | None]:
    """The bytes of each list of ids; None for a null list."""
    for x in ids:
        yield b"".join(map(pieces.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else None


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded (binary) appended: the pieces of ids, joined. Null for null ids; nulls and unknown ids among them raise."""
    keep = others(df, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(list(joined(b.column(0), pieces)), pa.binary())], names=[*b.schema.names[1:], "decoded"])

    work = df.select(named(ids_col).alias("_ids"), *(named(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    schema = T.StructType([*(T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keep)), T.StructField("decoded", T.BinaryType())])
    return work.mapInArrow(run, schema).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "decoded")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def digests(ids: pa.ListArray) -> list[pa.Array]:
        raw = [x.values.to_numpy(zero_copy_only=False).astype("<u4") for x in ids]
        hashed = [sha256(x.tobytes()).hexdigest() for x in raw]
        return [pa.array([len(x) for x in raw], pa.int64()), pa.array(hashed), pa.array([sha256(x).hexdigest() for x in joined(ids, pieces_of(path))])]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, keep=["doc_id"], instead=(fields, digests))
