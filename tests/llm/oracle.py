"""Rows of a query and of its SQL in DuckDB, to be compared."""

import math
from pathlib import Path

import duckdb


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(sql)
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
