"""Corpus-wide line deduplication."""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.frames import add_columns, documents, freed, named, others, slices, stored

MIN_DOCS, MIN_CHARS = 5, 40


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key (ASCII white space stripped, A-Z lowered); None for keys under min_chars code points."""
    key = line.strip(b" \t\n\r\x0b\x0c").lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def drop_common_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    r"""docs with n_lines, n_dropped (long) and kept_text appended.

    Lines are what \n separates (null or empty text: one empty line). A key of at least min_chars code points that is found
    in at least min_docs documents loses its lines everywhere but in the document of the largest id that holds it, which keeps all of its own.
    Rows are documents: rows that repeat an id count one by one and, at the largest id, all keep the line. Null ids
    are smaller than any id. Extra columns pass through, whatever their names; ones named as the results are replaced. An empty table gives
    no rows. Texts may be of any length: one at a time is cut to lines.

    Documents are exploded into the hashes of their distinct keys (texts stay behind); counts combine before
    the shuffle, so a line that a third of all documents hold is no hot group there. Common lines are written before
    the join that finds their holders, which Spark can then split when skewed. What a document must drop comes back as one short row for
    its id and text, so rows of one id do not meet in one row unless their texts are equal too.
    """
    kind = docs.schema[id_col].dataType
    salt = F.xxhash64(named(text_col)).alias("_salt")
    holders = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"), salt).mapInArrow(
        freed(_hashes(min_chars)), T.StructType([T.StructField("_id", kind), T.StructField("_salt", T.LongType()), T.StructField("_hash", T.BinaryType())])
    )
    common = stored(holders.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keeper")).where(F.col("_n") >= min_docs).select("_hash", "_keeper"))
    drops = (
        holders.join(common, "_hash")
        .where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy(F.col("_id").alias("_of"), F.col("_salt").alias("_with"))
        .agg(F.collect_set("_hash").alias("_drops"))
    )
    own = ("n_lines", "n_dropped", "kept_text")
    kept = others(docs, *own)
    left = docs.select(named(text_col).alias("_text"), named(id_col).alias("_id"), salt, *(named(c).alias(f"_c{i}") for i, c in enumerate(kept)))
    joined = left.join(drops, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_with")), "left").select("_text", "_drops", *(f"_c{i}" for i in range(len(kept))))
    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]

    def keep(texts: list, drops: list) -> list[list]:
        out: list[list] = [[], [], []]
        for text, gone in zip(texts, drops, strict=True):
            lines = (text or "").encode().split(b"\n")
            if gone:
                gone = set(gone)
                left = [x for x in lines if line_hash(x, min_chars) not in gone]
            else:
                left = lines
            out[0].append(len(lines))
            out[1].append(len(lines) - len(left))
            out[2].append(b"\n".join(left).decode())
        return out

    done = add_columns(joined, ["_text", "_drops"], fields, keep)
    return done.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)), *own)


def _hashes(min_chars: int):
    def run(batches):
        for b in batches:
            at = 0
            for part in slices(b.column(1)):
                rows, hashes = [], []
                for i, text in enumerate(part.to_pylist(), at):
                    found = {line_hash(x, min_chars) for x in text.encode().split(b"\n")}
                    found.discard(None)
                    rows.extend([i] * len(found))
                    hashes.extend(found)
                at += len(part)
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.array(hashes, pa.binary())], names=["_id", "_salt", "_hash"])

    return run


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The lines are keyed by themselves here, not by hashes.
OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL OR c.keeper = doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY doc_id
"""
