"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.storage import drop, few, shared_dir, stored

__all__ = ["add_columns", "documents", "drop", "few", "freed", "named", "others", "shared_dir", "slices", "stored"]

#: Text that a task holds as Python objects at a time.
SLICE_BYTES = 2 << 20


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *taken: str) -> list[str]:
    """Columns of df whose names (in any case) are not taken by an operator's own columns."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A string column in runs of rows of about `most` bytes, nulls as empty texts."""
    import numpy as np

    column = column.fill_null("")
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield column.slice(at, end - at)
        at = end


def give_back() -> None:
    """Returns memory that this process no longer uses: a worker lives on after its task and would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def freed(run: Callable) -> Callable:
    """run, a function of a task's Arrow batches, that gives its memory back when the task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    compute: Callable[..., list[list]],
) -> DataFrame:
    """df with `fields` appended, computed in Python from the columns `inputs`, the first of which is the text.

    compute gets one list of Python values per input, for rows of about SLICE_BYTES of text, and returns one list per field. Columns of df that
    carry a field's name are replaced; all others pass through untouched. No shuffle.
    """
    keep = others(df, *(f.name for f in fields))
    work = df.select(*(named(c).alias(f"_in{i}") for i, c in enumerate(inputs)), *(named(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    n_in = len(inputs)
    schema = T.StructType([T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]
        for b in batches:
            at = 0
            for part in slices(b.column(0)):
                some = b.slice(at, len(part))
                at += len(part)
                new = compute(*(some.column(i).to_pylist() for i in range(n_in)))
                kept = [some.column(n_in + i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(v, type=t) for v, t in zip(new, types, strict=True)], names=schema.names)

    done = work.mapInArrow(freed(run), schema)
    return done.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *(F.col(f.name) for f in fields))
