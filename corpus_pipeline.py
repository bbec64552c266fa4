"""The corpus pipeline: documents are judged, stripped of common lines, thinned of near copies, redacted and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import jaccard, lines, packing, pii, quality
from orrery.llm.frames import documents, drop, few, named, stored


def _like(docs: DataFrame, done: DataFrame, text: str) -> DataFrame:
    """The columns of docs from done, with the column `text` of done as text and n_chars its code points."""
    new = {"text": F.col(text), "n_chars": F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long")}
    return done.select(*(new[c].alias(c) if c in new else named(c) for c in docs.columns))


def _kept(docs: DataFrame) -> DataFrame:
    """Rows that the rules keep, under positions for names, since a column may be named as a result."""
    work = docs.select(*(named(c).alias("text" if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)))
    return quality.judge(work).where("kept").select(*(F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (6): documents that they reject go, those without words among them. Each row is judged by its own text, so repeats go or stay together."""
    return _kept(docs).select(*map(named, docs.columns))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (8): lines of at least 40 code points that five documents hold stay in the last one only.

    Null texts become empty. Rows that repeat an id count one by one; null ids are smaller than any.
    """
    return _like(docs, lines.drop_common_lines(docs), "kept_text")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (1): of each group one row stays, that of the smallest id; of equal ids, that of the smallest hash of the text.

    Rows are told apart by id and text, so a row goes for its own text's sake alone; of rows equal in both one stays, the one that Spark
    meets first where other columns differ. Null ids come after all others. Rows without words link with nothing and stay.
    """
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat(F.coalesce(number, F.lit("null")), F.lit("/"), F.lpad(F.hex(F.xxhash64("text")), 16, "0")).alias("_row")
    groups = stored(jaccard.jaccard_groups(docs.select(key, "text"), id_col="_row").select("_row", "component_id", "n_shingles"))
    gone = stored(groups.where("component_id <> _row").select("_row").distinct())
    twice = stored(groups.where("n_shingles > 0").groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row"))
    kept = docs.withColumn("_row", key).join(few(gone, jaccard.SENT_IDS), "_row", "left_anti")
    if not twice.isEmpty():
        repeated = kept.join(few(twice, jaccard.SENT_IDS), "_row", "left_semi").dropDuplicates(["_row"])
        kept = kept.join(few(twice, jaccard.SENT_IDS), "_row", "left_anti").unionByName(repeated)
    return kept.select(*map(named, docs.columns))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (4): every span and secret is replaced by its kind. Null texts stay null; repeated rows stay equal."""
    return _like(docs, pii.find_personal_data(docs), "redacted_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (2): the pieces of all documents with their sequences. Null texts and ids and repeated rows are packed like others."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", judged), ("line dedup", without_common_lines), ("n-gram Jaccard join", without_near_copies), ("PII", redacted), ("packing", packed)]

#: SQL cannot express the compression bands, the deobfuscation or the differencing; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written, and deleted once the next one is."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            drop(before)
    return docs
