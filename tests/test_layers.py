"""Layers of graphs whose ids are numbers by themselves, and of others."""

import random

from pyspark.sql import functions as F

from orrery.operators import graph, reach


def brute(edges, nodes):
    steps = {(s, t) for s, t in edges if s != t and s in nodes and t in nodes}
    waits, layer = {n: {s for s, t in steps if t == n} for n in nodes}, {}
    freed, d = [n for n in nodes if not waits[n]], 0
    while freed:
        layer.update(dict.fromkeys(freed, d))
        freed, d = [n for n in nodes if n not in layer and waits[n] <= set(layer)], d + 1
    return {n: layer.get(n, 0) for n in nodes}


ODD = ["a::01", "a::-1", "a:: 1", "a::1 ", "a::", "a", "1", "a::1::2", "a::9223372036854775808", f"a::{1 << 48}", "::5", "a::1.0", "b:1", "A::+1", ""]


def test_layers_of_ids_of_all_shapes(spark):
    dice = random.Random(3)
    for more, steps in ((["::5", f"a::{(1 << 48) - 1}"], 45), (ODD, 60), (ODD, 25)):
        names = [f"{t}::{i}" for t in ("a", "b", "B") for i in range(12)] + more
        order = dice.sample(names, len(names))
        edges = [tuple(sorted(dice.sample(order, 2), key=order.index)) for _ in range(steps)] + [("b::1", "b::2"), ("b::2", "b::1"), ("a::1", "a::1")]
        # ends that are no nodes, of known types and others, before, between and behind nodes
        edges += [("a::99", "b::3"), ("b::3", "a::98"), ("a::98", "a::4"), ("x::1", "a::5"), ("a::6", "odd"), ("odd", "a::7"), (None, "a::8"), ("a::8", None)]
        got = graph.layers(spark.createDataFrame(edges + edges[:7], "source string, target string"), spark.createDataFrame([(n,) for n in names + names[:3]], "node_id string")).collect()
        assert {r.node_id: r.layer for r in got} == brute(edges, names) and len(got) == len(names)


def test_more_types_than_codes(spark, monkeypatch):
    monkeypatch.setattr(reach, "_CODES", 3)
    names = [f"T{i}::{j}" for i in range(9) for j in range(2)]
    edges = list(zip(names, names[1:]))
    got = graph.layers(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([(n,) for n in names], "node_id string")).collect()
    assert {r.node_id: r.layer for r in got} == brute(edges, names)


def test_a_round_takes_the_steps_of_its_types_alone(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(reach.Rounds, "add", lambda self, k, df, add=reach.Rounds.add: taken.append((self.schema, df._jdf.queryExecution().optimizedPlan().toString())) or add(self, k, df))
    names = [f"T{i}::{j}" for i in range(4) for j in range(5)]
    edges = [(s, t) for s in names for t in names if int(s[1]) + 1 == int(t[1])]
    ids, steps = reach.coded(spark.createDataFrame([(n,) for n in names], "node_id string").localCheckpoint(), spark.createDataFrame(edges, "source string, target string"))
    assert ids.select(F.shiftright("n", reach.CODED)).distinct().count() == 4 and steps.count() == 75
    assert {r.layer for r in reach.peeled(steps, ids.select(F.col("n").alias("node_id")), reach.CODED).collect()} == {0, 1, 2, 3}
    rounds = [plan for schema, plan in taken if "off" in schema]
    assert len(rounds) == 4 and all(f"shiftright(source" in plan for plan in rounds)


def test_searches_send_small_tables_alone(spark):
    far = spark.range(reach.SENT + 1).select(F.col("id").alias("node_id"))
    assert "strategy=broadcast" not in reach._sent(far)._jdf.queryExecution().analyzed().toString() and reach._sent(far.limit(0)) is None
    assert "strategy=broadcast" in reach._sent(far.limit(reach.SENT))._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in reach.few(far)._jdf.queryExecution().analyzed().toString()
