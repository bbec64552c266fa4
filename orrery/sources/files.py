"""Files of a landing folder, decoding of uploads, and exports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "cp1253", "cp1252", "latin-1")
DELIMITERS = ",;\t|"


def text_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content) of all files of a name below a folder, each whole."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def staged_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV's columns as text, named by its header (a byte order mark gone)."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def uploaded_csv(spark: SparkSession, data: bytes) -> DataFrame:
    """A small uploaded CSV of unknown encoding and delimiter; a sep= line and a byte order mark are skipped."""
    import csv

    text = next(t for t in (_decoded(data, e) for e in ENCODINGS) if t is not None)
    lines = text.lstrip("﻿").splitlines(keepends=True)
    if lines and lines[0].lower().startswith("sep="):
        lines = lines[1:]
    mark = max(DELIMITERS, key=lambda d: (lines[0].count(d) if lines else 0, -DELIMITERS.index(d)))
    rows = list(csv.reader(io.StringIO("".join(lines)), delimiter=mark))
    header = [h.strip() for h in rows[0]] if rows else []
    schema = ", ".join(f"`{h}` string" for h in header)
    return spark.createDataFrame([tuple((r + [None] * len(header))[: len(header)]) for r in rows[1:]], schema)


def _decoded(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def flattened(df: DataFrame) -> DataFrame:
    """Columns that a CSV or a warehouse table cannot hold as JSON text."""
    simple = {"string", "boolean", "int", "bigint", "smallint", "double", "float", "date", "timestamp"}
    return df.select(*(F.col(f"`{f.name}`") if f.dataType.simpleString() in simple else F.to_json(f"`{f.name}`").alias(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str, order: Iterable[str] = (), one_file: bool = True, mark: bool = False) -> None:
    """A CSV with a header, also where there are no rows, and with a byte order mark if asked. One file only for reports of a size that one task may write."""
    out = flattened(df)
    out = out.orderBy(*order) if order else out
    # The mark stands before the header, so it is written as the first name's first sign.
    out = out.toDF("\ufeff" + out.columns[0], *out.columns[1:]) if mark else out
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Truncate and load."""
    flattened(df).write.mode("overwrite").parquet(path)


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9_.-]+", "_", name.strip().lower()) or "unnamed"


def zipped(folders: Iterable[str]) -> bytes:
    """An archive of landing folders on this machine, each below its own name."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder in map(Path, folders):
            for path in sorted(p for p in folder.rglob("*") if p.is_file()):
                z.write(path, f"{folder.name}/{path.relative_to(folder)}")
    return out.getvalue()
