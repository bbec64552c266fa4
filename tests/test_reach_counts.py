"""Counts of few marks go as bits of one number; edges are dealt over tasks by rows."""

import random

from pyspark.sql import functions as F

from orrery.operators import graph, reach
from orrery.plans import starmap


def brute(edges, rows):
    after, out = {}, {}
    for s, t in edges:
        if s is not None and t is not None:
            after.setdefault(s, set()).add(t)
    for node in after:
        seen, todo = set(), list(after[node])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += after.get(n, ())
        for kind in {k for _, k, _ in rows}:
            if n := len({w for m, k, w in rows if m in seen and k == kind and w is not None}):
                out[node, kind] = n
    return out


def test_few_marks_as_bits_in_any_graph(spark):
    dice = random.Random(5)
    for marks, steps in ((7, 60), (64, 130), (65, 90)):
        names = [f"T{i % 4}::{i}" for i in range(50)] + ["plain"]
        edges = [(dice.choice(names), dice.choice(names)) for _ in range(steps)] + [(None, "T1::1"), ("T1::1", None), ("T0::0", "T0::0")]
        rows = [(dice.choice(names), f"k{i % 2}", f"w{i}") for i in range(marks)] + [("T0::0", "k0", None), ("T0::0", "k1", "w1")]
        got = reach.counts(spark.createDataFrame(edges + edges[:9], "source string, target string"), spark.createDataFrame(rows, "node_id string, kind string, what string")).collect()
        assert {(r.node_id, r.kind): r.n for r in got} == brute(edges, rows) and len(got) == len(brute(edges, rows))


def test_few_marks_need_no_layers(spark):
    edges = spark.createDataFrame([(f"A::{i}", f"B::{i % 9}") for i in range(99)] + [(f"B::{i}", f"C::{i % 3}") for i in range(9)], "source string, target string")
    nodes = spark.createDataFrame([(f"C::{i}", f"n{i}", "C") for i in range(3)] + [(f"A::{i}", "a", "A") for i in range(99)], "node_id string, name string, group string")
    spark.sparkContext.setJobGroup("few marks", "few marks")
    assert {r.connected_reports for r in graph.backfilled(edges, nodes, ["A"], ["B"], ["C"]).collect()} == {1}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few marks"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60, jobs


def test_pairs_of_lines_are_dealt_before_they_are_made_distinct(spark, sf_dir):
    edges = starmap.edges(spark, sf_dir)
    assert edges.count() == edges.distinct().count()
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2, plan


def test_steps_that_repeat_give_each_path_and_hop_once(spark):
    edges = spark.createDataFrame([("A_::a", "B_::b"), ("A_::a", "B_::b"), ("B_::b", "C_::c"), ("B_::b", "C_::c")], "source string, target string")
    assert [(tuple(r.path), r.hops) for r in graph.shortest_paths(edges, "A_::a", "C_::c").collect()] == [(("A_::a", "B_::b", "C_::c"), 2)]
    assert [tuple(r) for r in graph.two_hop_counts(edges).collect()] == [("B_::b", 1)]


def test_nodes_are_dealt_over_tasks_by_rows(spark):
    staged = spark.createDataFrame([("x", "1", "T", "y", "2", "T"), ("z", "1", "T", "y", "2", "T")], "source string, source_id string, source_type string, target string, target_id string, target_type string")
    found = graph.nodes_of(staged)
    assert sorted(tuple(r) for r in found.collect()) == [("T::1", "x", "T"), ("T::2", "y", "T")]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_texts_of_models_are_dealt_over_tasks(spark, monkeypatch):
    from orrery.operators import column_lineage

    dealt = []
    monkeypatch.setattr(column_lineage, "spread", lambda df, rows, *keys, each: dealt.append((rows, each)) or df.repartition(3, *keys))
    models = spark.createDataFrame([("w.m", ["WITH c AS (SELECT a FROM w.r) SELECT x.a AS k FROM c AS x JOIN w.r ON c.a = x.a"])], "model string, texts array<string>")
    edges, reasons = column_lineage.lineage(models, spark.createDataFrame([("w.r", "a", 0)], "relation string, column string, place int"))
    assert [tuple(r) for r in edges.collect()] == [("w.r", "a", "w.m", "k", "rename")] and reasons.count() == 0
    assert len(dealt) == 4 and all(each == column_lineage.TEXTS for _, each in dealt)
