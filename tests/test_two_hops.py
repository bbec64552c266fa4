"""Two hops are rows of edges joined with edges, and the query counts those rows."""

from pyspark.sql import functions as F

from orrery.operators import graph
from orrery.plans import queries


def test_hops_through_a_hub_are_rows_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOPS", 50, raising=False)
    pairs = [(f"A_::{i}", "H_::h") for i in range(40)] + [("H_::h", f"{t}_::{i}") for t in "AB" for i in range(20)] + [("A_::1", "B_::0"), ("B_::0", "C_::1"), ("B_::0", "A_::1"), (None, "H_::h"), ("H_::h", None), ("H_::h", "H_::h")]
    found = graph.two_hops_across(spark.createDataFrame(pairs + pairs[:30], "source string, target string"))
    want = sorted((a, b, d) for a, b in pairs for c, d in pairs if None not in (a, b, d) and b == c and a.split("_")[0] != d.split("_")[0])
    assert sorted(tuple(r) for r in found.collect()) == want
    most = found.where("middle = 'H_::h'").groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most < 600


def test_the_query_counts_joined_hops(spark, sf_dir, monkeypatch):
    rows = []
    monkeypatch.setattr(graph, "two_hops_across", lambda edges, real=graph.two_hops_across: rows.append(real(edges)) or rows[0])
    counted = queries.QUERIES["two_hops_across"](spark, sf_dir)
    assert len(rows) == 1 and rows[0].count() == counted.agg(F.sum("hops")).first()[0]
