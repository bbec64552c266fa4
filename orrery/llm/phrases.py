"""Phrase collocation mining: weighted n-grams of distinct pieces, counted out of core in duckdb for each hash bucket."""

from __future__ import annotations

import functools
import itertools
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.frames import documents, drop, few, freed, named, slices, stored

MIN_COUNT, LONGEST, ABSORB, TOP = 100, 5, 100, 2000
#: Pieces end at any of these; words lie between blanks and tabs.
PIECE_ENDS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[ \t]+"
#: Text of distinct pieces that one row holds, and that a task collects of all languages before it writes a row.
BLOCK_BYTES, HELD_BYTES = 4 << 20, 12 << 20
#: Text of documents whose distinct pieces one task packs, so that the number of blocks depends on the text and not on how many partitions a shuffle has.
PACKED_BYTES = 32 << 20
#: Memory of a bucket's database; what is beyond lies in the task's own scratch folder until the task ends.
BUCKET_MEMORY = "256MB"
#: Parts that a language's candidates are ranked in before the first of each part are ranked together.
RANK_PARTS = 64
#: Odd multipliers for the two halves of an n-gram's hash.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def in_duckdb(df: DataFrame, keys: list[str], sql: str, schema: str) -> DataFrame:
    """The rows of `sql` over `bucket`, the rows of df whose keys hash to one partition.

    All rows of one key lie in one bucket. A task streams its bucket into a database file in its own scratch folder (beside Spark's spill
    files, deleted with the task) and streams the result out, so memory is bounded whatever a bucket holds.
    """

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        folder = tempfile.mkdtemp(prefix="bucket-", dir=spill if os.path.isdir(spill) else None)
        try:
            con = duckdb.connect(f"{folder}/rows.db", config={"memory_limit": BUCKET_MEMORY, "threads": 1, "temp_directory": f"{folder}/spill", "preserve_insertion_order": False})
            rows = pa.RecordBatchReader.from_batches(first.schema, _chained(first, batches))
            con.execute("CREATE TABLE bucket AS SELECT * FROM rows")
            yield from con.sql(sql).to_arrow_reader(50_000)
            con.close()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return df.repartition(*keys).mapInArrow(run, schema)


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def distinct_pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, n): the distinct pieces of all texts, their words joined by single blanks, and how often they occur. Pieces without words are left out."""

    @freed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in slices(b.column(1)):
                lists = pc.split_pattern_regex(pc.ascii_lower(part), PIECE_ENDS)
                lang = b.column(0).slice(at, len(part)).take(pc.list_parent_indices(lists))
                at += len(part)
                piece = pc.ascii_trim(pc.replace_substring_regex(lists.flatten(), BLANKS, " "), " ")
                some = pa.table({"lang": lang, "piece": piece}).filter(pc.not_equal(piece, ""))
                if some.num_rows:
                    yield from some.group_by(["lang", "piece"]).aggregate([([], "count_all")]).rename_columns(["lang", "piece", "n"]).to_batches()

    rows = docs.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"), named(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = rows.mapInArrow(cut, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    return pieces.coalesce(1 + size // PACKED_BYTES)


_BLOCK = "block long, lang string, words long, pieces binary, counts array<long>"


def _packed(pieces: pa.Array) -> bytes:
    """Pieces, which hold no line end, as compressed text: blocks are stored and shuffled."""
    return zstandard.compress(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), "\n")[0].as_buffer(), 3)


def _unpacked(block: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([zstandard.decompress(block)]).cast(pa.string()), "\n").flatten() if block else pa.array([], pa.string())


def blocks_of(pieces: DataFrame) -> DataFrame:
    """The pieces in rows of about BLOCK_BYTES of text of one language, numbered, with the words that they stand for. To be stored: numbers depend on the tasks."""
    from pyspark import TaskContext

    def row(block: int, lang: str, texts: list[pa.Array], counts: list[pa.Array]) -> pa.RecordBatch:
        text, count = pa.concat_arrays(texts), pa.concat_arrays(counts)
        words = pc.sum(pc.multiply(pc.add(pc.cast(pc.count_substring(text, " "), pa.int64()), 1), count)).as_py()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lang]), pa.array([words], pa.int64()), pa.array([_packed(text)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(count)], pa.int32()), count)], names=["block", "lang", "words", "pieces", "counts"])

    @freed
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size: dict[str, int] = {}
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                some = b.filter(pc.equal(b.column(0), lang))
                texts, counts = held.setdefault(lang, ([], []))
                texts.append(some.column(1))
                counts.append(some.column(2))
                size[lang] = size.get(lang, 0) + pc.sum(pc.binary_length(some.column(1))).as_py() + 16 * some.num_rows
                if size[lang] >= BLOCK_BYTES:
                    size.pop(lang)
                    yield row(next(number), lang, *held.pop(lang))
            while sum(size.values()) > HELD_BYTES:
                lang = max(size, key=size.__getitem__)
                size.pop(lang)
                yield row(next(number), lang, *held.pop(lang))
        for lang, some in held.items():
            yield row(next(number), lang, *some)

    return pieces.select("lang", "piece", "n").mapInArrow(pack, _BLOCK)


class Grams:
    """The n-grams of one block's pieces: distinct ones with their weights, told apart by their words."""

    def __init__(self, lang: str, pieces: pa.Array, counts: np.ndarray, n: int):
        import pandas as pd

        lists = pc.split_pattern(pieces, " ")
        self.words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = self.words.dictionary_encode()
        ids, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        length = np.diff(offsets)
        #: First word of each n-gram, and the piece that it lies in.
        at = np.arange(len(ids), dtype=np.int64)
        self.start = at[at + n <= np.repeat(offsets[1:], length)]
        self.piece = np.repeat(np.arange(len(length)), length)[self.start]
        code = ids[self.start]
        for k in range(1, n):
            code = pd.factorize(code * len(distinct) + ids[self.start + k])[0].astype(np.int64)
        #: For each occurrence the number of its n-gram; for each n-gram its first occurrence and its weight.
        self.code, keys = pd.factorize(code)
        self.first = np.zeros(len(keys), np.int64)
        self.first[self.code[::-1]] = self.start[::-1]
        self.weight = np.zeros(len(keys), np.int64)
        np.add.at(self.weight, self.code, counts[self.piece])
        prefix = lang.encode() + b"\0"
        digests = b"".join(xxhash.xxh3_128_digest(prefix + w.encode()) for w in distinct.to_pylist())
        word_hash = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        #: 95 bits for each n-gram, from 128 of its words.
        h = word_hash[ids[self.first]]
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(31))) * MIX + word_hash[ids[self.first + k]]
        self.hash = h[:, 0].astype(np.int64), (h[:, 1] >> np.uint64(33)).astype(np.int64)
        self.n = n

    def phrases(self, which: np.ndarray) -> pa.Array:
        """The words of these n-grams, joined."""
        return _joined(self.words, self.first[which], self.n)


def _joined(words: pa.Array, starts: np.ndarray, length: int | np.ndarray) -> pa.Array:
    """words[start : start + length] for each start, joined by blanks."""
    length = np.broadcast_to(np.asarray(length, np.int64), starts.shape)
    offsets = np.concatenate([[0], np.cumsum(length)])
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], length)
    picked = words.take(pa.array(np.repeat(starts, length) + inside))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), picked), " ")


def _of(b: pa.RecordBatch, k: int) -> tuple[int, str, pa.Array, np.ndarray]:
    row = {name: b.column(i)[k] for i, name in enumerate(b.schema.names)}
    return row["block"].as_py(), row["lang"].as_py(), _unpacked(row["pieces"].as_py()), row["counts"].values.to_numpy(zero_copy_only=False)


def _asked(blocks: DataFrame, n: int) -> DataFrame:
    """(h, k, block, w): for each block's distinct n-grams their hash, its other 32 bits above the n-gram's number in the block, and their weight there."""

    @freed
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                block, lang, pieces, counts = _of(b, k)
                g = Grams(lang, pieces, counts, n)
                size = len(g.weight)
                columns = [g.hash[0], g.hash[1] << 32 | np.arange(size), np.full(size, block, np.int64), g.weight]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "k", "block", "w"])

    return blocks.select("block", "lang", "pieces", "counts").mapInArrow(run, "h long, k long, block long, w long")


def _pruned(blocks: DataFrame, n: int) -> DataFrame:
    """Blocks cut to the runs of words in which every n-gram is frequent, with the names and counts of the n-grams that are theirs to name.

    `frequent` has the numbers of the block's frequent n-grams, `own` those that it is to name with their counts over all blocks. Only such a run can hold a frequent phrase of n + 1 words. Runs that repeat in a block are one with their counts added.
    """

    @freed
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                block, lang, pieces, counts = _of(b, k)
                g = Grams(lang, pieces, counts, n)
                known = np.zeros(len(g.weight), bool)
                known[b.column(4)[k].values.to_numpy(zero_copy_only=False)] = True
                own = b.column(5)[k].values
                names, totals = g.phrases(own.field("i").to_numpy(zero_copy_only=False)), own.field("total")
                on = known[g.code] if len(g.code) else np.zeros(0, bool)
                start, piece = g.start[on], g.piece[on]
                new = np.ones(len(start), bool)
                new[1:] = (np.diff(start) != 1) | (np.diff(piece) != 0)
                first = np.flatnonzero(new)
                starts = np.diff(np.append(first, len(start)))
                long = starts > 1
                runs = pa.table({"p": _joined(g.words, start[first[long]], starts[long] + n - 1), "c": pa.array(counts[piece[first[long]]], pa.int64())})
                runs = runs.group_by("p").aggregate([("c", "sum")])
                lists = [pa.array([x], pa.list_(t)) for x, t in ((runs["c_sum"].to_pylist(), pa.int64()), (names.to_pylist(), pa.string()), (totals.to_pylist(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lang]), pa.array([_packed(runs["p"].combine_chunks()) if len(runs) else b""], pa.binary()), *lists], names=["block", "lang", "pieces", "counts", "phrases", "totals"])

    schema = "block long, lang string, pieces binary, counts array<long>, phrases array<string>, totals array<long>"
    return blocks.select("block", "lang", "pieces", "counts", "frequent", "own").mapInArrow(run, schema)


def frequent_phrases(pieces: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases of 1 to `longest` words that occur min_count times, (lang, n) words of each language). Both are stored.

    Level by level: the blocks send hashes of 95 bits and weights of their distinct n-grams to hash buckets. A bucket adds them up and answers each
    block, in one row, with those that are frequent; one block is to name each. The blocks keep what can still be part of a longer one: an n-gram's own
    (n-1)-grams are as frequent at least, so none is lost.
    """
    kept = blocks = stored(blocks_of(pieces))
    totals = stored(blocks.groupBy("lang").agg(F.sum("words").alias("n")))
    sql = f"""
        SELECT block, list((k & 4294967295)::INT) AS frequent,
               coalesce(list({{'i': (k & 4294967295)::INT, 'total': total}}) FILTER (WHERE block = namer), []) AS own
        FROM bucket b JOIN (SELECT h, k >> 32 AS h2, sum(w)::BIGINT AS total, min(block) AS namer FROM bucket GROUP BY ALL HAVING sum(w) >= {int(min_count)}) f ON b.h = f.h AND b.k >> 32 = f.h2
        GROUP BY block
    """
    answer, gathered = "block long, frequent array<int>, own array<struct<i int, total long>>", [F.flatten(F.collect_list(c)).alias(c) for c in ("frequent", "own")]
    named_rows = []
    for n in range(1, longest + 1):
        heard = in_duckdb(_asked(blocks, n), ["h"], sql, answer).groupBy("block").agg(*gathered)
        level = stored(_pruned(blocks.join(heard, "block"), n))
        drop(kept)
        names = level.select("lang", F.explode(F.arrays_zip("phrases", "totals")).alias("x"))
        named_rows.append(stored(names.select("lang", F.col("x.phrases").alias("phrase"), F.lit(n).alias("words"), F.col("x.totals").alias("f"))))
        kept, blocks = level, level.where(F.size("counts") > 0)
    found = stored(functools.reduce(DataFrame.unionByName, named_rows))
    drop(kept, *named_rows)
    return found, totals


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(found: DataFrame, totals: DataFrame, min_words: int = 2) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of each phrase of min_words or more at its lowest-scoring cut.

    Every cut asks for the counts of its two parts by a shuffle to where those are counted. Products are decimals of 38 digits, enough for 10^17 words.
    """
    own = found.where(F.col("words") >= min_words).select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = own.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    asks = cuts.select("lang", "phrase", "words", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, F.col("words")).alias("rest"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)).hint("merge")
    asked = asks.join(part("left", "l"), ["lang", "left"]).join(part("rest", "r"), ["lang", "rest"]).join(few(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    asked = asked.withColumn("up", wide("a") * wide("n")).withColumn("down", wide("l") * wide("r"))
    asked = asked.withColumn("score", F.expr("CAST(1000 * up AS DECIMAL(38,0)) div CAST(down AS DECIMAL(38,0))"))
    best = asked.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "n", "b.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, absorb: int = ABSORB, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score descending, a descending and phrase in byte order.

    A phrase of 2 to `longest` words is a candidate where it occurs min_count times within pieces, overlaps included. It is dropped where its words lie
    within a longer candidate of at least `absorb` percent of its occurrences, dropped or not. Null texts are empty, null languages are `und`;
    texts without words, an empty table and other columns are no matter, and rows that repeat count each. A text of any length is cut to
    pieces at once, a piece is never cut.

    Identical pieces become one row with a multiplicity before anything is counted, so copies cost nothing. A phrase that is everywhere
    is one row for each block of distinct pieces. Ranks are taken within parts of a language first.
    """
    pieces = distinct_pieces(docs, lang_col, text_col)
    found, totals = frequent_phrases(pieces, min_count, longest)
    own = found.where("words > 1").select("lang", F.split("phrase", " ").alias("w"), "words", F.col("f").alias("longer"))
    best = scored(found, totals)
    if longest > 2:
        inner = own.where("words > 2").select("lang", "w", "words", "longer", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
        inner = inner.select("lang", "w", "longer", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
        inner = inner.groupBy("lang", _part(F.col("w"), F.col("i"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer"))
        best = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(int(absorb)) * F.col("a")))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", place("lang", "part")).where(F.col("rank") <= top)
    return some.withColumn("rank", place("lang")).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("lang", "text"))


#: Phrases are lists of words here, counted all at once; products are 128-bit integers.
OP11_SQL = r"""
WITH low AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (
  SELECT lang, CASE WHEN p = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(p, '[ \t]+') END AS w
  FROM (SELECT lang, trim(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), ' ' || chr(9)) AS p FROM low)),
grams AS (
  SELECT lang, k.k AS words, array_to_string(w[i : i + k.k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces) p, (SELECT unnest(range(1, 6)) AS k) k
  WHERE i + k.k - 1 <= len(w)),
counts AS (SELECT lang, phrase, words, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1),
cuts AS (SELECT lang, phrase, words, a, w, unnest(range(1, words)) AS k FROM candidates),
scores AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, c.k,
         ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, words, a, m, unnest(range(1, words - m + 2)) AS i FROM (SELECT lang, w, words, a, unnest(range(2, words)) AS m FROM candidates))
  GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
