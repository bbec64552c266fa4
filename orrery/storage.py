"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir; on one machine, where it is unset, below a temporary folder that is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: an iteration's lineage is cut, and nothing is lost with an executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that stored() returned, once nothing reads them any more; passes over others."""
    for table in tables:
        if (path := getattr(table, "_stored_at", None)) is not None:
            _delete(table.sparkSession, path)
            del table._stored_at


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Rounds:
    """A table that an iteration adds to, round by round: a round is written once, and read alone or with all others in one scan."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.schema, self.path = spark, schema, shared_dir(spark)

    def add(self, k: int, df: DataFrame) -> DataFrame:
        """df as round k, read back."""
        df.write.parquet(f"{self.path}/round={k}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={k}")

    def deal(self, df: DataFrame) -> None:
        """Adds rows to the rounds that df's column `round` names."""
        df.write.partitionBy("round").mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        """All rounds, with the column `round`."""
        return self.spark.read.schema(f"{self.schema}, round int").parquet(self.path)

    def only(self, k: int) -> DataFrame:
        return self.all().where(F.col("round") == k).drop("round")

    def drop(self) -> None:
        _delete(self.spark, self.path)


#: Rows that a side may have to be sent to every executor.
FEW = 100_000


def many(df: DataFrame) -> DataFrame:
    """df to be joined by a shuffle. Without the hint Spark sends a stored table of millions of rows to all, since it goes by the size of the compressed files."""
    return df.hint("merge")


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df with a broadcast hint where it has `most` rows at most; else it is joined by a shuffle. For stored or small tables."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else many(df)


#: Rows for each task where rows, not bytes, make a task's memory or time.
ROWS = 400_000


def spread(df: DataFrame, rows: int, *keys: str, each: int = ROWS) -> DataFrame:
    """df dealt by its keys over tasks of about `each` rows, and over all cores at least. Spark cuts tasks by the bytes of compressed files, so that a task of a large table has ever more rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)
