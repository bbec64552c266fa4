"""Patterns of column lineage run once for each text, block or item."""

from orrery.operators import column_lineage


def test_patterns_run_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(column_lineage, "stored", lambda df, real=column_lineage.stored: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    sql = "WITH c AS (SELECT a, COALESCE(a, SAFE_CAST(b AS INT64)) AS k, DATE_TRUNC(b, MONTH) FROM w.r), d AS (SELECT * FROM c UNION ALL SELECT * FROM c) SELECT d.a AS p, (SELECT MAX(k) FROM c) AS q, d.k + (1 * (d.a)) AS s FROM d JOIN w.r ON d.a = r.a"
    models = spark.createDataFrame([("w.m", [sql.replace("), d AS", ", x.y.z AS z FROM c)"), sql.replace(", DATE_TRUNC(b, MONTH)", "")])], "model string, texts array<string>")
    edges, reasons = column_lineage.lineage(models, spark.createDataFrame([("w.r", "a", 0), ("w.r", "b", 1)], "relation string, column string, place int"))
    assert reasons.collect() == []
    assert {tuple(r)[1:] for r in edges.collect()} == {("a", "w.m", "p", "rename"), ("a", "w.m", "q", "transformation"), ("b", "w.m", "q", "transformation"), ("a", "w.m", "s", "transformation"), ("b", "w.m", "s", "transformation")}
    lines = [line for plan in plans for line in plan.splitlines()]
    assert not [line for line in lines if "Filter" in line and "aggregate(" in line]
    peeled = [line for line in lines if "aggregate(" in line and column_lineage.INNER in line]
    assert len(peeled) == 1 and peeled[0].count(column_lineage.INNER) == 1
    assert sum(line.count(column_lineage.TOKEN) for line in lines) == 1
