"""Tables in folders by a hash of their keys, so that a merge reads the folders that its rows fall into and rewrites those whose rows change."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.load import merged
from orrery.storage import _delete, drop, shared_dir, stored

#: The column that names a row's folder; a table may have no column of this name.
BUCKET = "_bucket_of"
#: The column that names a row's task in a merge.
_TASK = "_task_of"
#: Parts that a bucket is written in at first, and rows of a part in a merge: a task sorts one part.
_PARTS, _ROWS = 8, 2_000_000


class BucketTable:
    """A table below `path`, its rows in folders rows/_bucket_of=N by a hash of `keys`, and its layout beside them, so that it is opened by its path alone.

    Keys are never null and name one row. A merge writes new folders beside the table: lost tasks and executors are made good before the driver moves those that
    differ into place. Merges into one table go one after another.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        layout = spark.read.schema("keys array<string>, buckets int, schema string").parquet(f"{path}/layout").collect()[0]
        self.spark, self.path, self.keys, self.buckets = spark, path, list(layout.keys), layout.buckets
        self.schema = T.StructType.fromJson(json.loads(layout.schema))

    @classmethod
    def create(cls, df: DataFrame, keys: Sequence[str], buckets: int = 256, path: str | None = None) -> BucketTable:
        """A new table of df's rows. So many buckets that one holds what a task can write: a terabyte in 4,096 is 256 MB a bucket."""
        spark, path = df.sparkSession, path or shared_dir(df.sparkSession)
        if BUCKET in df.columns:
            raise ValueError(f"a table of buckets has no column {BUCKET}")
        if not set(df.columns) - set(keys):
            raise ValueError("a table of buckets has columns beside its keys")
        spark.createDataFrame([(list(keys), buckets, df.schema.json())], "keys array<string>, buckets int, schema string").coalesce(1).write.parquet(f"{path}/layout")
        table = cls(spark, path)
        table._write(df.withColumn(BUCKET, table._bucket()))
        return table

    def _hash(self) -> Column:
        return F.xxhash64(*(F.col(f"`{k}`").cast(self.schema[k].dataType) for k in self.keys))

    def _bucket(self) -> Column:
        return F.pmod(self._hash(), F.lit(self.buckets)).cast("int")

    def _part(self, parts: int) -> Column:
        """A row's part of its bucket, by bits of the hash that do not name the bucket alone."""
        return F.pmod(F.shiftright(self._hash(), 32), F.lit(parts)).cast("int")

    def _write(self, df: DataFrame) -> None:
        # Rows in the order of their keys lie beside those that are named alike, so files and later shuffles are smaller.
        dealt = df.repartition(BUCKET, self._part(_PARTS)).sortWithinPartitions(BUCKET, *(F.col(f"`{k}`") for k in self.keys))
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/rows")

    def _rows(self) -> DataFrame:
        # A table that began empty has no folder yet.
        rows = f"{self.path}/rows"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(rows)
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(rows) if there else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._rows().drop(BUCKET)

    def merge(self, new: DataFrame, policy: Mapping[str, str], reset: Mapping[str, object] | None = None) -> list[int]:
        """load.merged() of new's rows into the table; the numbers of the buckets rewritten, no more than the table has.

        Only folders that new's keys fall into are read and joined. Of those, the ones in which a row is new or a value differs are written; so a load that is
        repeated writes nothing, and folders without a change keep their files. New's rows without a key are left out.
        """
        if not set(new.columns) - set(self.keys):
            raise ValueError("a merge needs columns beside the keys")
        present = new.dropna(subset=list(self.keys))
        fresh = stored(present)
        touched = [r[0] for r in fresh.select(self._bucket().alias("b")).distinct().collect()]
        if not touched:
            drop(fresh)
            return []
        old = self._rows().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        # Both sides are dealt by the bucket's parts, so that the join's tasks write the folders without another shuffle.
        parts = max(1, -(-(old.count() + fresh.count()) // (len(touched) * _ROWS)))
        dealt = lambda df: df.withColumn(_TASK, self._bucket() * parts + self._part(parts)).repartitionById(self.buckets * parts, F.col(_TASK))
        result = merged(dealt(old), dealt(fresh), [_TASK, *self.keys], policy, reset, "_differs")
        found, beside = Observation(), f"{self.path}/merge-{uuid.uuid4().hex}"
        result = result.withColumn(BUCKET, F.floor(F.col(_TASK) / parts).cast("int")).observe(found, F.collect_set(F.when(F.col("_differs"), F.col(BUCKET))).alias("changed"))
        result.drop(_TASK, "_differs").write.partitionBy(BUCKET).parquet(beside)
        changed = sorted(found.get["changed"])
        self._replace(beside, changed)
        drop(fresh)
        return changed

    def _replace(self, beside: str, buckets: Sequence[int]) -> None:
        """Moves the folders of these buckets from the folder beside the table into it, and deletes what is left there."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        store.mkdirs(path(f"{self.path}/rows"))
        for b in buckets:
            new, place = path(f"{beside}/{BUCKET}={b}"), path(f"{self.path}/rows/{BUCKET}={b}")
            store.delete(place, True)
            if not store.rename(new, place):
                raise OSError(f"bucket {b} could not be moved from {beside}")
        _delete(self.spark, beside)
