"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.frames import documents, drop, few, freed, named, stored

WEIGHTS, SHARE, MOST = (3, 1, 2), 150, 2
#: Equal rows that one row is turned into within a task; more are dealt out first.
COPIES_PER_ROW = 4096


def running(df: DataFrame, order: Sequence[Column | str], values: Sequence[str], prefix: str = "before_") -> DataFrame:
    """df with, for each of `values` (long), the sum over all rows that come before in `order`, as before_<value>. Stored, in that order.

    Rows are sorted by ranges over all tasks; a task sums its own range, and the ranges' totals, one row for each partition, are summed up then.
    df should be a stored table, since ranges are drawn from it first. The order must tell rows apart that are not equal.
    """
    from pyspark import TaskContext

    names = [*df.columns, "_part", *(prefix + v for v in values)]

    @freed
    def summed(batches):
        part, at = TaskContext.get().partitionId(), dict.fromkeys(values, 0)
        for b in batches:
            columns = list(b.columns) + [pa.array(np.full(b.num_rows, part, np.int32))]
            for v in values:
                x = b.column(b.schema.get_field_index(v)).to_numpy(zero_copy_only=False)
                ends = np.cumsum(x) + at[v]
                columns.append(pa.array(ends - x))
                at[v] = int(ends[-1]) if len(ends) else at[v]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), *(T.StructField(prefix + v, T.LongType()) for v in values)])
    table = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(summed, schema))
    parts = table.groupBy("_part").agg(*(F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)))
    up_to = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_s{i}").over(up_to), F.lit(0)).alias(f"_o{i}") for i in range(len(values))))
    done = table.join(F.broadcast(parts), "_part").select(*df.columns, *((F.col(prefix + v) + F.col(f"_o{i}")).alias(prefix + v) for i, v in enumerate(values)))
    done._stored_at = table._stored_at
    return done


def words_of(text: Column) -> Column:
    """How many words a text has: a word becomes one letter, and what lies between goes. No list of words is made."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with rank (from 0), weight, before_source_size (of the sources before it), target (double) and allowed (long, the target rounded up).

    Sources are ranked by code point, null last. All targets together are `share` percent of all sizes; a target is V x weight at one
    virtual time V for all, but `most` times its source's size at most. With sources by size / weight, V is the largest of the times at which the sources
    from each one on, alone, would use up what those before it leave. Both sums run over ranges, so sources may be any number.
    """
    ranked = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").isNull(), "source"], ["one", "source_size"])
    lcm = math.lcm(*weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before_one") % len(weights) + 1).cast("int")).cast("long")
    known = stored(ranked.select("source", "source_size", F.col("before_one").alias("rank"), weight.alias("weight"), "before_source_size"))
    drop(ranked)
    filled = running(known, [F.col("source_size") * (F.lit(lcm) / F.col("weight")).cast("long"), "rank"], ["source_size", "weight"], "full_")
    total, weighed = known.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weighed = total or 0, weighed or 0
    num, den = F.lit(share * total) - F.lit(100 * most) * F.col("full_source_size"), F.lit(100) * (F.lit(weighed) - F.col("full_weight"))
    best = filled.agg(F.max_by(F.struct(num.alias("num"), den.alias("den")), num / den).alias("v")).first()["v"]
    drop(filled)
    up, down = max(best["num"], 0) if best else 0, best["den"] if best else 1
    cap = F.lit(most) * F.col("source_size")
    target = F.least(cap.cast("double"), F.lit(up) * F.col("weight") / F.lit(down))
    return known.select("*", target.alias("target"), F.least(cap, F.expr(f"({up} * weight + {down - 1}) div {down}")).alias("allowed"))


def schedule(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: (id, source, size, copies, source_size, target, epoch, finish, place, taken), each distinct row of (id, source, size) once in each epoch. Stored.

    A source's documents queue in the order of a hash of their ids, `most` times over. A document's virtual finish time is the words of its source
    up to its end, divided by the source's weight. The mix is all queues in the order of finish times, sorted by ranges, and is cut where its words reach
    `share` percent of all: at that virtual time each source has been served to its target, the document in service in part. `place` counts
    the words of the mix before a row, `taken` its own; rows that the mix does not reach have 0.
    """
    size = words_of(named(text_col))
    rows = docs.select(named(id_col).alias("id"), named(source_col).cast("string").alias("source"), size.alias("size"))
    groups = stored(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("hash", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    words = F.col("size") * F.col("copies")
    known = targets(stored(groups.groupBy("source").agg(F.sum(words).alias("source_size"))), weights, share, most)
    on = few(stored(known.withColumnRenamed("source", "of")))
    own = stored(groups.join(on, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("words", words))
    queued = running(own, ["rank", "hash", "id", "size"], ["words"])
    start = F.col("epoch") * F.col("source_size") + F.col("before_words") - F.col("before_source_size")
    lcm = math.lcm(*weights)
    rows = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("start", start)
    clock = (F.col("start") + F.col("words")) * (F.lit(lcm) / F.col("weight")).cast("long")
    served = F.greatest(F.lit(0), F.least(F.col("allowed") - F.col("start"), F.col("words")))
    keep = ["id", "source", "size", "copies", "source_size", "target", "epoch"]
    rows = stored(rows.select(*keep, "rank", "hash", clock.alias("clock"), served.alias("served")))
    drop(groups, own, queued)
    mix = running(rows, ["clock", "rank", "epoch", "hash", "id", "size"], ["served"])
    drop(rows)
    budget = known.agg((F.lit(share) * F.sum("source_size")).alias("b")).first()["b"] or 0
    taken = F.greatest(F.lit(0), F.least(F.lit(budget // 100) - F.col("before_served"), F.col("served")))
    return stored(mix.select(*keep, (F.col("clock") / lcm).alias("finish"), F.col("before_served").alias("place"), taken.alias("taken")))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document: (id_col, size, source_size, target, taken), taken being the words that the mix has of it, repeats counted.

    Null and empty texts have no words and are never taken; null ids and sources are a value like others. Rows that repeat an id, source and
    size are queued as one with their words added, so none is a hot group, and told apart last: the first of them are taken whole, then one in
    part. Documents of one id that differ otherwise are documents apart. An empty table gives no rows; other columns are not read. Nothing
    depends on how the table is cut, so reruns agree. No text is shuffled, and no task holds a source: all sums run over ranges of rows.
    """
    rows = schedule(docs, weights, share, most, id_col, text_col, source_col)
    epochs = [F.sum(F.when(F.col("epoch") == e, F.col("taken")).otherwise(0)).alias(f"e{e}") for e in range(most)]
    groups = rows.groupBy("id", "source", "size", "copies", "source_size", "target").agg(*epochs)
    few_copies = groups.where(F.col("copies") <= COPIES_PER_ROW).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = groups.where(F.col("copies") > COPIES_PER_ROW).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES_PER_ROW}"))))
    first = F.col("part") * COPIES_PER_ROW
    many = many.repartition("part").withColumn("i", F.explode(F.sequence(first, F.least(first + (COPIES_PER_ROW - 1), F.col("copies") - 1)))).drop("part")
    taken = F.lit(0)
    for e in range(most):
        taken = taken + F.greatest(F.lit(0), F.least(F.col(f"e{e}") - F.col("i") * F.col("size"), F.col("size")))
    return few_copies.unionByName(many).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def op12_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS hash FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM docs GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(rank % 3 + 1)::INT] AS weight FROM sources),
filled AS (
  SELECT 150 * (SELECT sum(source_size) FROM weighed) - 200 * coalesce(sum(source_size) OVER w, 0) AS num,
         100 * ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0)) AS den
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
time AS (SELECT num::BIGINT AS num, den::BIGINT AS den FROM filled ORDER BY num / den DESC LIMIT 1),
targets AS (
  SELECT w.*, least(2.0::DOUBLE * source_size, (num * weight)::DOUBLE / den) AS target,
         least(2 * source_size, (num * weight + den - 1) // den) AS allowed
  FROM weighed w, time),
queued AS (
  SELECT d.doc_id, d.size, d.hash, t.*, epoch,
         epoch * source_size + coalesce(sum(size) OVER (PARTITION BY rank, epoch ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) e(epoch)),
served AS (SELECT *, greatest(0, least(allowed - start, size)) AS served, (start + size) * (6 // weight) AS clock FROM queued),
placed AS (
  SELECT *, coalesce(sum(served) OVER (ORDER BY clock, rank, epoch, hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM served)
SELECT doc_id, size, source_size, any_value(target) AS target,
       sum(greatest(0, least((SELECT 150 * sum(source_size) FROM weighed) // 100 - place, served)))::BIGINT AS taken
FROM placed GROUP BY doc_id, size, source_size, source
"""
