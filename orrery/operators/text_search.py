"""Text search over a project's models, sources, tests and SQL by a stored index of trigrams, for any number of asked texts at once."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators.catalog import not_deleted
from orrery.storage import few, many, shared_dir, stored

_CODED = ("DBT_MODEL", "DBT_SEED", "DBT_TEST")
_NAMES = ("item_name", "description", "table_name", "database_name")
#: What each search takes: types of items, and the columns in one of which a text must lie.
SEARCHES = {"models": (("DBT_MODEL", "DBT_SEED"), _NAMES), "sources": (("DBT_SOURCE",), _NAMES), "tests": (("DBT_TEST",), ("item_name", "description")), "bodies": (_CODED, ("expression",))}
#: Columns of a name that code() completes.
_LOOKED_UP = ("item_name", "table_name", "database_name")
_KEPT = ("item_id", "item_name", "item_type", "description", "table_name", "database_name", "expression")
_ITEM, _GRAM = ", ".join(f"{c} string" for c in _KEPT) + ", n long", "gram string, place string, item_type string, base long, bits long, part int"
#: Parts of the index by a gram's hash, of which a search reads those that it asks for.
PARTS = 64
#: Grams of a text that candidates must share; the rarest are taken, and the exact check settles the rest.
RAREST = 3
#: Signs of texts, rows of grams or candidates for each task: their files are small, so Spark, which goes by bytes, would put tens of millions into one.
ROWS = 1_000_000
_END = "\x00"


def _grams(text: Column) -> Column:
    """Each three signs of a text in small letters, distinct. A pattern that looks ahead keeps this linear where substring would count from the start each time."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), 1))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


class TextIndex:
    """Tables below a folder that driver and executors share: items with numbers, grams (gram, place, item_type, base, bits) and how many items of a type hold a gram in a place (a column).

    A row of grams names the items among 64 neighbours (numbers from 64 * base on) that hold the gram. They are found where the items lie, so what is shuffled, stored and joined is rows of 64 items.
    Texts are padded with two end signs, so that each of their signs begins a gram and a text of one or two signs is found as the beginning of grams.
    Grams lie by part, a large part in slices by a hash of their bases: a gram that many items hold is spread over files, and a search reads the parts that it asks for.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
        self.spark, self.folder, self.items, self.grams, self.counts = spark, folder, read("items", _ITEM), read("grams", _GRAM), read("counts", "gram string, place string, item_type string, n long, rows long")

    @classmethod
    def build(cls, items: DataFrame, folder: str | None = None) -> TextIndex:
        """An index of the items that are not deleted and of a type that a search takes; item_id is their key."""
        spark, folder = items.sparkSession, folder or shared_dir(items.sparkSession)
        types = sorted({t for kinds, _ in SEARCHES.values() for t in kinds})
        kept = items.where(not_deleted() & F.col("item_type").isin(types)).select(*(F.col(c).cast("string") for c in _KEPT))
        kept.withColumn("n", F.monotonically_increasing_id()).write.parquet(f"{folder}/items")
        own = spark.read.schema(_ITEM).parquet(f"{folder}/items")
        places = F.explode(F.array(*(F.struct(F.lit(c).alias("place"), F.col(c).alias("value")) for c in (*_NAMES, "expression"))))
        signs = own.agg(F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in (*_NAMES, "expression")))).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, signs // ROWS)
        values = own.withColumn("base", F.shiftright("n", 6)).repartition(tasks, "base").select("n", "base", "item_type", places.alias("v")).select("n", "base", "item_type", "v.*").where("value <> ''")
        grams = values.select(F.explode(_grams(F.concat("value", F.lit(_END * 2)))).alias("gram"), "place", "item_type", "base", "n")
        grams = grams.groupBy("gram", "place", "item_type", "base").agg(F.bit_or(_bit(F.col("n").bitwiseAND(F.lit(63)))).alias("bits"))
        grams = grams.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int"))
        slices = F.pmod(F.xxhash64("base"), F.lit(1 + 4 * tasks // PARTS))
        grams.repartition(tasks, "part", slices).sortWithinPartitions("part", "gram", "place", "item_type", "base").write.partitionBy("part").parquet(f"{folder}/grams")
        counts = spark.read.schema(_GRAM).parquet(f"{folder}/grams").groupBy("gram", "place", "item_type").agg(F.sum(F.bit_count("bits")).alias("n"), F.count(F.lit(1)).alias("rows"))
        counts.write.parquet(f"{folder}/counts")
        return cls(spark, folder)

    def _read(self, rows: int) -> DataFrame:
        """The grams, a scan for each group of parts, so that a scan's share of a task stays near ROWS however many there are."""
        groups = min(PARTS, 1 + rows // (ROWS * self.spark.sparkContext.defaultParallelism))
        scans = [self.grams.where(F.col("part").isin(*range(g, PARTS, groups))) for g in range(groups)]
        return functools.reduce(DataFrame.unionByName, scans)

    def _candidates(self, asks: DataFrame, columns: Sequence[str], types: Sequence[str] | None = None) -> DataFrame:
        """(ask_id, place, n): items of the types that hold the rarest grams of a text in one column; for texts of one or two signs, any gram that begins with it."""
        of_types = F.lit(True) if types is None else F.col("item_type").isin(*types)
        counts = self.counts.where(F.col("place").isin(*columns) & of_types).groupBy("gram", "place").agg(F.sum("n").alias("n"))
        long = asks.where(F.length("text") >= 3).select("ask_id", _grams(F.col("text")).alias("grams"))
        held = long.select("ask_id", F.size("grams").alias("all"), F.explode("grams").alias("gram")).join(counts, "gram")
        held = held.groupBy("ask_id", "all", "place").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, RAREST).alias("least"), F.count(F.lit(1)).alias("held")).where("held = all")
        chosen = held.select("ask_id", "place", F.size("least").alias("need"), F.inline("least"))
        for size in (1, 2):
            short = asks.where(F.length("text") == size).select("ask_id", F.lower("text").alias("start"))
            begun = counts.select(F.substring("gram", 1, size).alias("start"), "place", "gram", "n")
            chosen = chosen.unionByName(short.join(begun, "start").select("ask_id", "place", F.lit(1).alias("need"), "n", "gram"))
        chosen = stored(chosen.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int")))
        tasks = max(self.spark.sparkContext.defaultParallelism, (chosen.agg(F.sum("n")).first()[0] or 0) // ROWS)
        read = self._read(self.counts.agg(F.sum("rows")).first()[0] or 0).where(of_types)
        met = read.join(few(chosen.drop("n")), ["part", "gram", "place"]).select("ask_id", "place", "item_type", "base", "need", "bits").repartition(tasks, "base")
        # Texts of one gram, or of one or two signs, take what any of their grams names; others what all of them name.
        every = met.groupBy("ask_id", "place", "item_type", "base", "need").agg(F.count(F.lit(1)).alias("met"), F.bit_and("bits").alias("all"), F.bit_or("bits").alias("any"))
        bits = every.where("met >= need").select("ask_id", "place", "base", F.when(F.col("need") == 1, F.col("any")).otherwise(F.col("all")).alias("bits")).where("bits <> 0")
        places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("bits").bitwiseAND(_bit(i)) != 0)
        return bits.select("ask_id", "place", "base", F.explode(places).alias("i")).select("ask_id", "place", F.shiftleft("base", 6).bitwiseOR(F.col("i").cast("long")).alias("n"))

    def hits(self, asks: DataFrame, types: Sequence[str], columns: Sequence[str]) -> DataFrame:
        """(ask_id, text, item columns) of all items of the types that hold an ask's text in one of the columns, in any case. Empty and null texts hit nothing here."""
        own, asks = self.items.where(F.col("item_type").isin(*types)), stored(asks.select("ask_id", "text"))
        found = self._candidates(asks, columns, types).join(few(asks), "ask_id").join(many(own), "n")
        value = F.coalesce(*(F.when(F.col("place") == c, F.col(c)) for c in columns))
        found = found.where(F.coalesce(F.contains(F.lower(value), F.lower("text")), F.lit(False)))
        return found.select("ask_id", "text", *_KEPT).dropDuplicates(["ask_id", "item_id"])

    def search(self, asks: DataFrame, kind: str, most: int = 10) -> DataFrame:
        """The first items of a search (see SEARCHES) for each ask (ask_id, text), with their position from 1, short descriptions and beginnings of their SQL.

        Ordered by database, table, name and id, nulls last. An empty or null text takes all items of the kind, of which the first stand for every such ask.
        The first rows are cut within partitions before they are shuffled by ask, so an ask that all items match puts no more than `most` rows a task into one place.
        """
        types, columns = SEARCHES[kind]
        rank = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(*(F.asc_nulls_last(c) for c in ("database_name", "table_name", "item_name", "item_id"))))
        asked = self.hits(asks, types, columns).withColumn("position", rank("ask_id")).where(F.col("position") <= most)
        first = self.items.where(F.col("item_type").isin(*types)).select(*_KEPT, F.lit(True).alias("_blank")).withColumn("position", rank("_blank")).where(F.col("position") <= most)
        blank = asks.where(F.coalesce("text", F.lit("")) == "").withColumn("_blank", F.lit(True)).join(F.broadcast(first), "_blank")
        every = asked.unionByName(blank.select(*asked.columns))
        return every.select("ask_id", "text", "position", "item_id", "item_name", "item_type", "database_name", "table_name", F.substring("description", 1, 180).alias("description"), F.substring("expression", 1, 240 if kind == "models" else 220).alias("sql"))

    def code(self, asks: DataFrame, most: int = 10) -> DataFrame:
        """The SQL of models, seeds and tests by id, else by name in any case, else by a part of a name, table or database: the first stage that finds any.

        One row (status ONE, with its SQL) where one item is meant; up to `most` candidates (two at most by id) with status MANY and no SQL; one row NONE where
        nothing is found or asked. Items without SQL are not found. Asks found by id or name take no part in the search by grams.
        """
        texts = asks.select("ask_id", "text", F.trim("text").alias("_t"))
        own = self.items.where(F.col("item_type").isin(*_CODED) & (F.col("expression") != ""))
        asked = texts.where("_t <> ''")
        by_id = asked.join(own, F.col("_t") == F.col("item_id")).withColumn("stage", F.lit(0))
        by_name = asked.join(own, F.lower("_t") == F.lower("item_name")).withColumn("stage", F.lit(1))
        exact = by_id.unionByName(by_name)
        rest = asked.join(exact.select("ask_id").distinct(), "ask_id", "left_anti")
        within = self.hits(rest.select("ask_id", F.col("_t").alias("text")), _CODED, _LOOKED_UP).where("expression <> ''").withColumn("stage", F.lit(2))
        every = exact.select("ask_id", "stage", *_KEPT).unionByName(within.select("ask_id", "stage", *_KEPT))
        place = F.row_number().over(Window.partitionBy("ask_id").orderBy("stage", "item_name", "item_id"))
        # Stored, since it is read three times and the whole search stands behind it.
        firsts = stored(every.withColumn("place", place).where(F.col("place") <= most))
        least = firsts.groupBy("ask_id").agg(F.min("stage").alias("stage"))
        kept = firsts.join(least, ["ask_id", "stage"]).where((F.col("stage") > 0) | (F.col("place") <= 2))
        number = kept.groupBy("ask_id").agg(F.count(F.lit(1)).alias("n"))
        out = texts.join(kept.join(number, "ask_id"), "ask_id", "left")
        status = F.when(F.col("n").isNull(), "NONE").when(F.col("n") == 1, "ONE").otherwise("MANY")
        return out.select("ask_id", "text", status.alias("status"), "stage", "item_id", "item_name", "item_type", "table_name", F.when(status == "ONE", F.col("expression")).alias("sql"))
