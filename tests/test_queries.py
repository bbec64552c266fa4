import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from orrery.plans import artifact_queries, detail_queries, landing_queries, profile_queries, queries, search_queries  # noqa: F401


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_the_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert os.path.isdir("/root/testdata/sf0.001") is False or entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
